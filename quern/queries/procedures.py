"""Types, user-defined functions, prepared statements, views, and more text search."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.functions import textsearch as TS, types as Y
from quern.operators import procedures as P
from quern.queries.base import query, sql, table
from quern.session import shared_path

NS = uuid.UUID("6ba7b810-9dad-11d1-80b4-00c04fd430c8")
_HEX = "{}(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode(n_name))"


def _uuid_sql(h: str, version: str) -> str:
    variant = f"format('{{:x}}', (('0x' || {h}[17:17])::int & 3) | 8)"
    return f"{h}[1:8] || '-' || {h}[9:12] || '-{version}' || {h}[14:16] || '-' || {variant} || {h}[18:20] || '-' || {h}[21:32]"


@query("fn_uuid", f"with h as (select n_nationkey, {_HEX.format('md5')} as m, {_HEX.format('sha1')} as s from nation) select n_nationkey, {_uuid_sql('m', '3')} as v3, {_uuid_sql('s', '5')} as v5 from h")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", Y.uuid_v3(NS, "n_name").alias("v3"), Y.uuid_v5(NS, "n_name").alias("v5"))


@query("fn_domain_check", "select p_partkey, p_size as size, p_retailprice as price from part")
def _(spark: SparkSession, d: str) -> DataFrame:
    size, price = Y.Domain("int", "value > 0 and value <= 1000", True), Y.Domain("double", "value >= 0")
    return table(spark, d, "part").select("p_partkey", size.check("p_size").alias("size"), price.check("p_retailprice").alias("price"))


@query("fn_money", "select c_custkey, (case when c_acctbal::decimal(19,2) < 0 then '-' else '' end) || '$' || format('{:,}', trunc(abs(c_acctbal::decimal(19,2)))::bigint) || '.' || lpad(((abs(c_acctbal::decimal(19,2)) * 100)::bigint % 100)::varchar, 2, '0') as m from customer")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", Y.money_text("c_acctbal").alias("m"))


@query("fn_to_number", "select s_suppkey, s_acctbal::decimal(38,2)::double as n from supplier")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "supplier").select("s_suppkey", Y.money_text("s_acctbal").alias("t"))
    return t.select("s_suppkey", Y.to_number("t", "L999,999.99").cast("double").alias("n"))


@query("fn_typeof", "select 'integer' as a, 'text' as b, 'double precision' as c, 'bigint' as d, count(*) as n from supplier")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return s.groupBy(Y.typeof_name("s_nationkey").alias("a"), Y.typeof_name("s_name").alias("b"), Y.typeof_name("s_acctbal").alias("c"), Y.typeof_name("s_suppkey").alias("d")).agg(F.count("*").alias("n"))


@query("fn_sequence", "select count(*) as n, min(i) as lo, max(i) as hi, count(distinct i) as k from (select 100 + 5 * (row_number() over () - 1) as i from orders)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return Y.nextval(table(spark, d, "orders").repartition(4), "i", 100, 5).agg(F.count("*").alias("n"), F.min("i").alias("lo"), F.max("i").alias("hi"), F.count_distinct("i").alias("k"))


@query("ext_citext", "select lower(c_mktsegment) as k, count(*) as n from customer group by 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 2 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("s"))
    return c.groupBy(Y.ci("s").alias("g")).agg(F.count("*").alias("n")).select(F.lower(F.collate("g", "UTF8_BINARY")).alias("k"), "n")


@query("ext_seg", "select l_orderkey, l_linenumber, l_quantity <= 20 and l_quantity + 5 >= 10 as o, l_quantity >= 10 and l_quantity + 5 <= 20 as c from lineitem")
def _(spark: SparkSession, d: str) -> DataFrame:
    s, box = Y.seg(F.col("l_quantity") + 5, F.col("l_quantity")), Y.seg(F.lit(10), F.lit(20))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", Y.seg_overlap(s, box).alias("o"), Y.seg_contains(box, s).alias("c"))


@query("ext_dictionaries", "select p_partkey, left(p_partkey::varchar, 3) as t from part union all select p_partkey, 'one' from part where left(p_partkey::varchar, 3) = '1'")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "part").select("p_partkey", Y.dict_int(F.col("p_partkey").cast("string"), 3).alias("t"))
    return Y.dict_synonyms(t, "t", spark.createDataFrame([("1", "one")], "word string, synonym string"))


@query("udf_scalar", "select n_nationkey, case when n_nationkey % 4 = 0 then null else n_nationkey * 3 + n_regionkey end as v from nation")
def _(spark: SparkSession, d: str) -> DataFrame:
    f = P.function(lambda a, b: int(a) * 3 + int(b), "long")
    return table(spark, d, "nation").select("n_nationkey", f(F.when(F.col("n_nationkey") % 4 != 0, F.col("n_nationkey")), F.col("n_regionkey")).alias("v"))


@query("udf_aggregate", "select o_orderstatus, bit_xor(o_custkey) as x from orders group by o_orderstatus")
def _(spark: SparkSession, d: str) -> DataFrame:
    import numpy as np

    f = P.aggregate(lambda s: int(np.bitwise_xor.reduce(s.to_numpy())), "long")
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(f("o_custkey").alias("x"))


@query("udf_table", "select n_nationkey, unnest(range(1, n_regionkey + 2)) as i, unnest(list_transform(range(1, n_regionkey + 2), lambda i: i * i)) as sq from nation")
def _(spark: SparkSession, d: str) -> DataFrame:
    squares = P.table_function(lambda n: ((i, i * i) for i in range(1, n + 2)), "i long, sq long")
    spark.udtf.register("squares", squares)
    return spark.sql("select n_nationkey, i, sq from {n}, lateral squares(n_regionkey)", n=table(spark, d, "nation"))


@query("prepared_statement", "select o_orderkey, o_totalprice from orders where o_orderstatus = 'F' and o_totalprice > 150000")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = P.Prepared(spark, "select o_orderkey, o_totalprice from {orders} where o_orderstatus = :status and o_totalprice > :least", orders=table(spark, d, "orders"))
    return p.execute(status="F", least=150000)


@query("materialized_view", "select o_custkey, count(*) as n from orders group by o_custkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    v = P.MaterializedView(spark, shared_path(spark, "view"), lambda: table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")))
    v.refresh()
    return v.read()


sql("view_nested", "with v as (select o_custkey, o_totalprice from {orders} where o_orderstatus = 'O'), w as (select o_custkey, max(o_totalprice) as m from v group by o_custkey) select c_name, m from w join {customer} on c_custkey = o_custkey")


@query("ts_phrase_headline", r"select item_id, regexp_replace(text, '\b(the|of)\b', '<b>\1</b>', 'gi') as h from benchmark")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", TS.headline("text", TS.to_tsquery("the | of")).alias("h"))


@query("ts_rewrite_match", r"select item_id from benchmark where list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), 'and') and not list_contains(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), 'of')")
def _(spark: SparkSession, d: str) -> DataFrame:
    q = TS.to_tsquery("cat & !of").rewrite(TS.Query("word", ("cat",)), TS.Query("word", ("and",)))
    return table(spark, d, "benchmark").where(q.match(TS.to_tsvector("text", ()))).select("item_id")
