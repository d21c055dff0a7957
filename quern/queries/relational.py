"""Scans, joins, aggregation, windows, sorting, set operations and recursion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.operators import dml, joins, recursion
from quern.queries.base import query, sql, table
from quern.semantics import array_agg, asc, avg_exact, desc, sum_exact

D = "cast({} as decimal(18,2))"

# scans, projection, predicates
sql("scan_filter_project", "select l_orderkey, l_linenumber, l_quantity as qty, l_extendedprice * (1 - l_discount) > 1000 as large from {lineitem} where l_quantity < 5 and l_returnflag = 'R'")
sql("scan_bitmap_and_or", "select o_orderkey, o_totalprice from {orders} where (o_orderstatus = 'F' and o_totalprice > 100000) or (o_orderstatus = 'O' and o_totalprice < 5000) and not o_orderpriority = '1-URGENT'")
sql("result_constant", "select 1 as one, 'x' as label, 2 + 3 as total")
sql("one_time_filter", "select n_name from {nation} where 1 = 0")
sql("values_list", "select a, b from (values (1, 'one'), (2, 'two'), (null, 'none')) as v(a, b)")
sql("range_predicate", "select count(*) as n from {lineitem} where l_quantity > 10 and l_quantity < 20 and l_discount > 0.02 and l_discount < 0.06 and l_extendedprice > 5000")
sql("in_subquery", "select c_custkey, c_name from {customer} where c_nationkey in (select n_nationkey from {nation} where n_regionkey = 1)")
sql("exists_subquery", "select c_custkey from {customer} c where exists (select 1 from {orders} o where o.o_custkey = c.c_custkey and o.o_totalprice > 200000)")
sql("not_exists_subquery", "select c_custkey from {customer} c where not exists (select 1 from {orders} o where o.o_custkey = c.c_custkey)")
sql("scalar_subquery_correlated", "select o_orderkey, o_totalprice from {orders} o where o_totalprice > (select 1.5 * avg(o_totalprice) from {orders} p where p.o_orderpriority = o.o_orderpriority)")
sql("quantified_all", "select s_suppkey from {supplier} where s_acctbal >= (select max(s_acctbal) from {supplier})")
sql("cte_shared", "with t as (select o_custkey, count(*) as n from {orders} group by o_custkey) select a.n, count(*) as customers from t a where a.n >= (select avg(n) from t) group by a.n")
sql("case_coalesce", "select o_orderkey, case when o_totalprice > 200000 then 'high' when o_totalprice > 50000 then 'mid' else 'low' end as band, coalesce(nullif(o_orderstatus, 'O'), 'open') as status, greatest(o_custkey, 10) as g, least(o_custkey, 10) as l from {orders}")
sql("boolean_tests", "select o_orderkey, (o_totalprice > 100000) is true as t, (case when o_custkey % 3 = 0 then null else o_custkey % 2 = 0 end) is not true as nt, o_orderstatus is distinct from 'F' as d, o_totalprice between 1000 and 90000 as b from {orders}")

# joins
sql("join_inner", "select o_orderkey, c_name, o_totalprice from {orders} join {customer} on o_custkey = c_custkey where c_mktsegment = 'BUILDING'")
sql("join_left", "select c_custkey, o_orderkey from {customer} left join {orders} on o_custkey = c_custkey and o_totalprice > 250000")
sql("join_right", "select c_custkey, o_orderkey from {orders} right join {customer} on o_custkey = c_custkey and o_orderstatus = 'P'")
sql("join_full", "select a.s_suppkey as a, b.p_partkey as b from {supplier} a full join {part} b on a.s_suppkey = b.p_partkey + 5")
sql("join_semi", "select p_partkey, p_name from {part} left semi join {lineitem} on p_partkey = l_partkey and l_quantity >= 49", "select p_partkey, p_name from part where exists (select 1 from lineitem where p_partkey = l_partkey and l_quantity >= 49)")
sql("join_anti", "select p_partkey from {part} left anti join {lineitem} on p_partkey = l_partkey and l_quantity >= 49", "select p_partkey from part where not exists (select 1 from lineitem where p_partkey = l_partkey and l_quantity >= 49)")
sql("join_cross", "select r_name, n_name from {region} cross join {nation} where n_nationkey < 5")
sql("join_using", "select k, r_name, n_name from (select r_regionkey as k, r_name from {region}) join (select n_regionkey as k, n_name from {nation}) using (k)")
sql("join_natural", "select k, r_name, n_name from (select r_regionkey as k, r_name from {region}) natural join (select n_regionkey as k, n_name from {nation})")
sql("join_theta", "select a.n_name as a, b.n_name as b from {nation} a join {nation} b on a.n_nationkey < b.n_nationkey and a.n_regionkey = b.n_regionkey")
sql("join_self", "select a.s_suppkey as a, b.s_suppkey as b from {supplier} a join {supplier} b on a.s_nationkey = b.s_nationkey and a.s_suppkey < b.s_suppkey")
sql("join_five_way", "select n_name, count(*) as n, cast(sum(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2)))) as double) as revenue from {customer}, {orders}, {lineitem}, {supplier}, {nation}, {region} where c_custkey = o_custkey and l_orderkey = o_orderkey and l_suppkey = s_suppkey and s_nationkey = n_nationkey and n_regionkey = r_regionkey and r_name = 'ASIA' group by n_name")


@query("join_not_in_null", "select c_custkey from customer where c_custkey not in (select case when o_custkey < 0 then null else o_custkey end from orders)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return joins.not_in(table(spark, d, "customer"), table(spark, d, "orders"), "c_custkey", "o_custkey").select("c_custkey")


@query("join_range_bucket", "select event_id, q from events join (select p_partkey as q, p_retailprice / 10 as lo, p_retailprice / 10 + 0.02 as hi from part) r on value >= lo and value < hi")
def _(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "part").select(F.col("p_partkey").alias("q"), (F.col("p_retailprice") / 10).alias("lo"), (F.col("p_retailprice") / 10 + 0.02).alias("hi"))
    return joins.range_join(table(spark, d, "events"), r, "value", "lo", "hi", 2.0).select("event_id", "q")


@query("join_salted", "select event_type, count(*) as n from events join (select distinct event_type from events) using (event_type) group by event_type")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return joins.salted_join(e, e.select("event_type").distinct(), "event_type", 8).groupBy("event_type").agg(F.count("*").alias("n"))


@query("lateral_topk", "select o_custkey, o_orderkey from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as n from orders) where n <= 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    return joins.top_k_each(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 2).select("o_custkey", "o_orderkey")


sql("lateral_function", "select n_nationkey, k from {nation}, lateral explode(sequence(1, n_regionkey + 1)) as t(k)", "select n_nationkey, unnest(range(1, n_regionkey + 2))::int as k from nation")

# aggregates
sql("agg_basic", f"select l_returnflag, l_linestatus, cast(sum({D.format('l_quantity')}) as double) as sum_qty, cast(sum({D.format('l_extendedprice')}) as double) as sum_price, count(*) as n, count(l_tax) as n_tax, min(l_extendedprice) as lo, max(l_extendedprice) as hi, round(avg(l_discount), 6) as avg_disc from {{lineitem}} where l_shipdate <= timestamp '1998-09-02 00:00:00' group by l_returnflag, l_linestatus")
sql("agg_distinct", "select o_orderstatus, count(distinct o_custkey) as n, sum(distinct o_custkey % 50) as s from {orders} group by o_orderstatus", "select o_orderstatus, count(distinct o_custkey) as n, sum(distinct o_custkey % 50)::bigint as s from orders group by o_orderstatus")
sql("agg_stats", "select l_returnflag, round(var_pop(l_quantity), 6) as vp, round(var_samp(l_quantity), 6) as vs, round(stddev_pop(l_quantity), 6) as sp, round(stddev_samp(l_quantity), 6) as ss from {lineitem} group by l_returnflag")
sql("agg_regr", "select l_returnflag, regr_count(l_tax, l_discount) as n, round(regr_avgx(l_tax, l_discount), 6) as ax, round(regr_avgy(l_tax, l_discount), 6) as ay, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 3) as icept, round(regr_r2(l_extendedprice, l_quantity), 6) as r2, round(regr_sxx(l_tax, l_discount), 5) as sxx, round(regr_syy(l_tax, l_discount), 5) as syy, round(regr_sxy(l_tax, l_discount), 5) as sxy, round(covar_pop(l_extendedprice, l_quantity), 2) as cp, round(covar_samp(l_extendedprice, l_quantity), 2) as cs, round(corr(l_extendedprice, l_quantity), 6) as r from {lineitem} group by l_returnflag")
sql("agg_bool", "select o_orderpriority, bool_and(o_totalprice > 1000) as a, bool_or(o_totalprice > 300000) as o, every(o_custkey > 0) as e from {orders} group by o_orderpriority", "select o_orderpriority, bool_and(o_totalprice > 1000) as a, bool_or(o_totalprice > 300000) as o, bool_and(o_custkey > 0) as e from orders group by o_orderpriority")
sql("agg_bit", "select n_regionkey, bit_and(n_nationkey) as a, bit_or(n_nationkey) as o, bit_xor(n_nationkey) as x from {nation} group by n_regionkey")
sql("agg_string", "select n_regionkey, listagg(n_name, ', ') within group (order by n_name) as names from {nation} group by n_regionkey", "select n_regionkey, string_agg(n_name, ', ' order by n_name) as names from nation group by n_regionkey")
sql("agg_having", "select o_custkey, count(*) as n from {orders} group by o_custkey having count(*) > 15 and max(o_totalprice) > 100000")
sql("agg_implicit_group", "select count(*) as n from {orders} having count(*) > 10")
sql("agg_group_by_only", "select o_orderstatus, o_orderpriority from {orders} group by o_orderstatus, o_orderpriority")
sql("agg_group_ordinal", "select o_orderstatus as s, o_custkey % 5 as m, count(*) as n from {orders} group by 1, 2")
sql("agg_minmax", "select min(o_orderkey) as lo, max(o_orderkey) as hi, min(o_orderstatus) as smin, max(o_orderpriority) as smax from {orders}")
sql("agg_empty_input", "select count(*) as n, sum(o_custkey) as s, max(o_totalprice) as m from {orders} where o_orderkey < 0", "select count(*) as n, sum(o_custkey)::bigint as s, max(o_totalprice) as m from orders where o_orderkey < 0")
sql("agg_user_defined", "select o_custkey, aggregate(array_sort(collect_list(o_orderkey % 7)), 0L, (a, x) -> a * 3 % 1000 + x) as h from {orders} group by o_custkey", "select o_custkey, list_reduce(list_prepend(0, list_sort(list(o_orderkey % 7))), lambda a, x: a * 3 % 1000 + x) as h from orders group by o_custkey")


@query("agg_exact_sums", "select o_orderstatus, cast(sum(o_custkey) as varchar) as s, cast(round(sum(o_custkey)::decimal(38,12) / count(*), 6)::decimal(38,6) as varchar) as a from orders group by o_orderstatus")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupBy("o_orderstatus").agg(sum_exact("o_custkey").cast("string").alias("s"), avg_exact("o_custkey").cast("string").alias("a"))


@query("agg_array_nulls", "select n_regionkey, array_to_string(list(coalesce(cast(case when n_nationkey % 3 = 0 then null else n_nationkey end as varchar), '~') order by n_nationkey), ',') as vals from nation group by n_regionkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").withColumn("v", F.when(F.col("n_nationkey") % 3 != 0, F.col("n_nationkey")))
    return n.groupBy("n_regionkey").agg(F.array_join(array_agg("v", "n_nationkey"), ",", "~").alias("vals"))


# windows
sql("win_rank_family", "select o_orderkey, row_number() over w as rn, rank() over (partition by o_custkey order by o_orderstatus) as rk, dense_rank() over (partition by o_custkey order by o_orderstatus) as dr, round(percent_rank() over w, 6) as pr, round(cume_dist() over w, 6) as cd from {orders} window w as (partition by o_custkey order by o_totalprice, o_orderkey)")
sql("win_ntile", "select c_custkey, ntile(4) over (partition by c_mktsegment order by c_acctbal, c_custkey) as q from {customer}")
sql("win_lag_lead", "select o_orderkey, lag(o_totalprice) over w as p, lag(o_totalprice, 2, 0.0D) over w as p2, lead(o_orderkey, 1) over w as n from {orders} window w as (partition by o_custkey order by o_orderdate, o_orderkey)", "select o_orderkey, lag(o_totalprice) over w as p, lag(o_totalprice, 2, 0.0) over w as p2, lead(o_orderkey, 1) over w as n from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)")
sql("win_first_last_nth", "select o_orderkey, first_value(o_orderkey) over w as f, last_value(o_orderkey) over w as l, nth_value(o_orderkey, 2) over w as n from {orders} window w as (partition by o_custkey order by o_totalprice, o_orderkey rows between unbounded preceding and unbounded following)")
sql("win_rows_frame", "select l_orderkey, l_linenumber, cast(sum(cast(l_quantity as decimal(18,2))) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity rows between 1 preceding and 1 following) as double) as s from {lineitem}")
sql("win_range_default", "select o_orderkey, count(*) over (partition by o_custkey order by o_orderstatus) as n, max(o_totalprice) over (partition by o_custkey order by o_orderstatus range between unbounded preceding and current row) as m from {orders}")
sql("win_agg_of_agg", "select o_custkey, count(*) as n, sum(count(*)) over (partition by o_custkey % 10 order by o_custkey) as running from {orders} group by o_custkey", "select o_custkey, count(*) as n, (sum(count(*)) over (partition by o_custkey % 10 order by o_custkey))::bigint as running from orders group by o_custkey")
sql("win_empty_over", "select r_regionkey, count(*) over () as n, max(r_name) over () as m from {region}")

# sets, sorting, limits
sql("set_union", "select n_regionkey as k from {nation} union select r_regionkey from {region}")
sql("set_union_all", "select n_regionkey as k from {nation} union all select r_regionkey from {region}")
sql("set_intersect", "select c_nationkey as k from {customer} intersect select s_nationkey from {supplier}")
sql("set_intersect_all", "select c_nationkey as k from {customer} intersect all select s_nationkey from {supplier}")
sql("set_except", "select n_nationkey as k from {nation} except select s_nationkey from {supplier}")
sql("set_except_all", "select c_nationkey as k from {customer} except all select s_nationkey from {supplier}")
sql("distinct", "select distinct o_orderstatus, o_orderpriority from {orders}")
sql("limit_offset", "select o_orderkey from {orders} order by o_totalprice desc, o_orderkey limit 10 offset 5")
sql("top_n", "select l_orderkey, l_linenumber, l_extendedprice from {lineitem} order by l_extendedprice desc, l_orderkey, l_linenumber limit 25")
sql("merge_append", "select k from (select n_nationkey as k from {nation} union all select r_regionkey from {region}) order by k limit 12")
sql("order_collate", "select n_name from {nation} order by lower(n_name) limit 7")


@query("sort_nulls_last", "select o_orderkey, row_number() over (partition by o_orderstatus, o_orderpriority order by (case when o_custkey % 4 = 0 then null else o_custkey end) asc nulls last, o_orderkey) as up, row_number() over (partition by o_orderstatus, o_orderpriority order by (case when o_custkey % 4 = 0 then null else o_custkey end) desc nulls first, o_orderkey) as down from orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    o = table(spark, d, "orders").withColumn("v", F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey")))
    w = lambda *x: F.row_number().over(Window.partitionBy("o_orderstatus", "o_orderpriority").orderBy(*x))
    return o.select("o_orderkey", w(asc("v"), F.col("o_orderkey")).alias("up"), w(desc("v"), F.col("o_orderkey")).alias("down"))


@query("distinct_on", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) as n from orders) where n = 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    return joins.distinct_on(table(spark, d, "orders"), ["o_custkey"], [desc("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


sql("recursive_union_all", "with recursive t(n) as (select 1 union all select n + 1 from t where n < 50) select n, n * n as sq from t")


@query("recursive_union_fixpoint", "with recursive t(a, b) as (select n_nationkey, (n_nationkey * 7 + 3) % 25 from nation where n_nationkey < 3 union select t.b, (t.b * 7 + 3) % 25 from t) select a, b from t")
def _(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "nation").select(F.col("n_nationkey").alias("a"), ((F.col("n_nationkey") * 7 + 3) % 25).alias("b"))
    start = edges.where("a < 3")
    return recursion.recursive_union(start, lambda t: t.select(F.col("b").alias("a")).join(edges, "a"))


@query("recursive_tree_path", "with recursive t(k, depth, path) as (select 1, 0, '1' union all select p_partkey::int, depth + 1, path || '.' || p_partkey from part join t on p_partkey // 2 = k and p_partkey > 1) select k, depth, path from t")
def _(spark: SparkSession, d: str) -> DataFrame:
    from quern.functions.extensions import connectby

    tree = table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("k"), F.floor(F.col("p_partkey") / 2).cast("int").alias("up"))
    return connectby(tree, "k", "up", 1, separator=".").select("k", F.col("level").alias("depth"), F.col("branch").alias("path"))


# data changes
@query("dml_insert_returning", "select n_nationkey, n_name from nation union all select r_regionkey + 100, upper(r_name) from region")
def _(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "region").select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.upper("r_name").alias("n_name"))
    return dml.insert(table(spark, d, "nation"), new)[0].select("n_nationkey", "n_name")


@query("dml_update", "select c_custkey, case when c_nationkey = 3 then c_acctbal + 1 else c_acctbal end as c_acctbal from customer")
def _(spark: SparkSession, d: str) -> DataFrame:
    return dml.update(table(spark, d, "customer"), F.col("c_nationkey") == 3, c_acctbal=F.col("c_acctbal") + 1)[0].select("c_custkey", "c_acctbal")


@query("dml_delete_returning", "select s_suppkey, s_name from supplier where s_acctbal < 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    return dml.delete(table(spark, d, "supplier"), F.col("s_acctbal") < 0)[1].select("s_suppkey", "s_name")


@query("inheritance_union", "select k, name from (select c_custkey as k, c_name as name from customer union all select s_suppkey, s_name from supplier)")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"))
    c = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("extra"))
    return dml.inherit(p, c)


# sources and sinks
@query("copy_round_trip", "select o_orderkey, case when o_custkey % 5 = 0 then null else o_orderpriority end as p, o_orderstatus || chr(9) || 'x' as t from orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    from quern.session import shared_path
    from quern.sources.copy import copy_from, copy_to

    path = shared_path(spark, "copy")
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 5 != 0, F.col("o_orderpriority")).alias("p"), F.concat("o_orderstatus", F.lit("\tx")).alias("t"))
    copy_to(o, path, csv=True, null="\\N")
    return copy_from(spark, path, o.schema, csv=True, null="\\N")


sql("group_cube_extra", "select o_orderstatus, o_orderpriority, count(*) as n from {orders} group by cube(o_orderstatus, o_orderpriority)")
sql("stream_tumbling_batch", "select cast(unix_timestamp(date_trunc('hour', ts)) as bigint) as h, event_type, count(*) as n from {events} group by 1, 2", "select epoch(date_trunc('hour', ts))::bigint as h, event_type, count(*) as n from events group by 1, 2")
