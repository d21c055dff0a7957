"""Scalar functions, special types and extension modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern.functions import arrays as A, bits as B, datetimes as T, documents as J, extensions as X, geometry as G, maths as M, network as N, ranges as R, strings as S, textsearch as TS
from quern.queries.base import query, sql, table
from quern.semantics import concat, days_between, dow, int_div, log10, round_double, subscript


@query("fn_string", "select p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') as ic, substring(p_name, 1, 2) as sub0, left(p_name, -3) as l, right(p_name, -3) as r, reverse(p_name) as rev, strpos(p_name, 'a') as pos, split_part(p_brand, '#', 2) as part, lpad(p_brand, 12, '*') as lp, rpad(p_brand, 4, '*') as rp, translate(p_type, 'AEI', 'xy') as tr, replace(p_type, 'E', 'ee') as rep, md5(p_name) as m, lower(hex(p_name)) as hx, ascii(p_name) as asc, repeat('ab', p_size % 3) as rpt, length(p_name) as len, concat(p_brand, null, '-', p_size) as cc from part")
def _(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_name")
    return table(spark, d, "part").select(
        "p_partkey", S.initcap("p_name").alias("ic"), S.substr("p_name", -1, 4).alias("sub0"), S.left("p_name", -3).alias("l"), S.right("p_name", -3).alias("r"), F.reverse(n).alias("rev"), S.strpos("p_name", "a").cast("long").alias("pos"), S.split_part("p_brand", "#", 2).alias("part"),
        F.lpad("p_brand", 12, "*").alias("lp"), F.rpad("p_brand", 4, "*").alias("rp"), F.translate("p_type", "AEI", "xy").alias("tr"), F.replace("p_type", F.lit("E"), F.lit("ee")).alias("rep"), F.md5(n.cast("binary")).alias("m"), S.encode("p_name", "hex").alias("hx"), S.ascii_("p_name").alias("asc"),
        F.expr("repeat('ab', p_size % 3)").alias("rpt"), F.length(n).cast("long").alias("len"), concat("p_brand", F.lit(None), F.lit("-"), "p_size").alias("cc"),
    )


@query("fn_regex", r"select p_partkey, regexp_replace(p_name, '[aeiou]', '<\0>') as first, regexp_replace(p_name, '[aeiou]', '', 'g') as every, case when regexp_matches(p_name, '([a-z])([a-z]+)') then regexp_extract(p_name, '([a-z])([a-z]+)', 1) end as sub, list_extract(regexp_split_to_array(p_name, '\s+'), 1) as word, regexp_full_match(p_type, '(.*)(STEEL|BRASS)(.*)') as sim, p_type ilike '%steel%' as il from part")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        "p_partkey", S.regexp_replace("p_name", "[aeiou]", "<\\&>").alias("first"), S.regexp_replace("p_name", "[aeiou]", "", "g").alias("every"), S.regexp_substring("p_name", "([a-z])([a-z]+)").alias("sub"),
        F.element_at(S.regexp_split("p_name", "\\s+"), 1).alias("word"), S.similar_to("p_type", "%(STEEL|BRASS)%").alias("sim"), F.col("p_type").ilike("%steel%").alias("il"),
    )


@query("fn_pattern", "select p_partkey, '''' || replace(p_name, '''', '''''') || '''' as ql, case when regexp_full_match(p_brand, '[a-z_][a-z0-9_]*') then p_brand else '\"' || p_brand || '\"' end as qi, 'part ' || p_brand || ' costs ' || '''' || p_type || '''' as f, p_name like '%a_e%' as lk from part")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", S.quote_literal("p_name").alias("ql"), S.quote_ident("p_brand").alias("qi"), S.format_("part %1$s costs %2$L", "p_brand", "p_type").alias("f"), F.col("p_name").like("%a_e%").alias("lk"))


@query("fn_math", "select o_orderkey, round(sqrt(o_totalprice), 6) as sq, round(cbrt(o_totalprice), 6) as cb, round(ln(o_totalprice), 6) as ln, round(log10(o_totalprice), 6) as lg, round(exp(o_custkey % 5), 6) as ex, round(pow(o_custkey % 7, 2.5), 6) as pw, sign(o_custkey - 50)::double as sg, trunc(o_totalprice) as tr, o_custkey % 7 as md, factorial((o_custkey % 10)::int)::varchar as fc, round(degrees(o_custkey % 4), 6) as dg, case when o_totalprice < 1000 then 0 when o_totalprice >= 200000 then 11 else floor((o_totalprice - 1000) * 10 / 199000) + 1 end::int as wb, (o_custkey & 12) | (o_custkey << 2) as bt, xor(o_custkey, 5) as xr from orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    p, k = F.col("o_totalprice"), F.col("o_custkey")
    r = lambda c: F.round(c, 6)
    return table(spark, d, "orders").select(
        "o_orderkey", r(M.sqrt(p)).alias("sq"), r(M.cbrt(p)).alias("cb"), r(M.ln(p)).alias("ln"), r(log10(p)).alias("lg"), r(F.exp(k % 5)).alias("ex"), r(F.pow(k % 7, F.lit(2.5))).alias("pw"), F.signum(k - 50).alias("sg"), M.trunc(p).alias("tr"), M.mod(k, F.lit(7)).alias("md"),
        M.factorial(k % 10).cast("string").alias("fc"), r(F.degrees(k % 4)).alias("dg"), M.width_bucket(p, 1000.0, 200000.0, 10).alias("wb"), F.expr("(o_custkey & 12) | shiftleft(o_custkey, 2)").alias("bt"), F.expr("o_custkey ^ 5").alias("xr"),
    )


@query("fn_round_modes", "select l_orderkey, l_linenumber, round_even(l_quantity / 2, 0) as even, cast(round(cast(l_extendedprice as decimal(18,2)), 1) as double) as half_up, cast(round(cast(l_extendedprice as decimal(18,2)), -2) as double) as hundreds from lineitem")
def _(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("l_extendedprice").cast("decimal(18,2)")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", round_double(F.col("l_quantity") / 2).alias("even"), F.round(x, 1).cast("double").alias("half_up"), F.round(x, -2).cast("double").alias("hundreds"))


@query("fn_int_division", "select n_nationkey, (n_nationkey - 12) // 5 + case when (n_nationkey - 12) % 5 <> 0 and n_nationkey < 12 and (n_nationkey - 12) // 5 < (n_nationkey - 12) / 5.0 - 1 then 1 else 0 end as q, (n_nationkey - 12) % 5 as r from nation")
def _(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n_nationkey") - 12
    return table(spark, d, "nation").select("n_nationkey", int_div(n, F.lit(5)).cast("int").alias("q"), (n % 5).alias("r"))


@query("fn_date_extract", "select o_orderkey, year(o_orderdate)::int as y, quarter(o_orderdate)::int as q, month(o_orderdate)::int as m, day(o_orderdate)::int as d, dayofweek(o_orderdate)::int as dow, isodow(o_orderdate)::int as isodow, dayofyear(o_orderdate)::int as doy, week(o_orderdate)::int as w, isoyear(o_orderdate)::int as iy, epoch(o_orderdate)::bigint as e, decade(o_orderdate)::int as dec, century(o_orderdate)::int as c, millennium(o_orderdate)::int as mil from orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    names = {"y": "year", "q": "quarter", "m": "month", "d": "day", "dow": "dow", "isodow": "isodow", "doy": "doy", "w": "week", "iy": "isoyear", "dec": "decade", "c": "century", "mil": "millennium"}
    return table(spark, d, "orders").select("o_orderkey", *(T.extract(f, "o_orderdate").cast("int").alias(a) for a, f in names.items()), T.extract("epoch", "o_orderdate").cast("long").alias("e"))


@query("fn_date_trunc", "select o_orderkey, " + ", ".join(f"strftime(date_trunc('{f}', o_orderdate), '%Y-%m-%d') as t_{f}" for f in ("week", "month", "quarter", "year", "decade")) + ", ((year(o_orderdate) - 1) // 100 * 100 + 1) || '-01-01' as t_century, ((year(o_orderdate) - 1) // 1000 * 1000 + 1) || '-01-01' as t_millennium from orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", *(F.date_format(T.date_trunc(f, "o_orderdate"), "yyyy-MM-dd").alias(f"t_{f}") for f in ("week", "month", "quarter", "year", "decade", "century", "millennium")))


@query("fn_date_arith", "select o_orderkey, (o_orderdate::date - date '1992-01-01')::int as days, strftime(o_orderdate + interval 1 month, '%Y-%m-%d') as plus, strftime(o_orderdate::date + 45, '%Y-%m-%d') as d45, datediff('day', date '1990-01-07', o_orderdate::date) % 7 as dow2, datesub('month', timestamp '1990-05-31 10:00:00', o_orderdate)::int as age_months from orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("o_orderdate")
    age = T.age(t, F.lit("1990-05-31 10:00:00").cast("timestamp_ntz"))
    return table(spark, d, "orders").select("o_orderkey", days_between(t.cast("date"), F.lit("1992-01-01").cast("date")).alias("days"), F.date_format(T.add_interval(t, T.interval(1)), "yyyy-MM-dd").alias("plus"), F.date_format(F.date_add(t.cast("date"), 45), "yyyy-MM-dd").alias("d45"), dow(t).cast("long").alias("dow2"), age["months"].cast("int").alias("age_months"))


@query("fn_overlaps", "select a.event_id as a, b.event_id as b, (a.ts < b.ts + interval 90 second and b.ts < a.ts + interval 1 minute) as o from events a join events b on b.event_id = a.event_id + 1")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    j = e.select(F.col("event_id").alias("a"), F.col("ts").alias("t1")).join(e.select(F.col("event_id").alias("b"), F.col("ts").alias("t2")), F.expr("b = a + 1"))
    return j.select("a", "b", T.overlaps(F.col("t1"), F.expr("t1 + interval 1 minute"), F.col("t2"), F.expr("t2 + interval 90 second")).alias("o"))


@query("fn_to_char", "select o_orderkey, strftime(o_orderdate, '%Y/%m/%d %H:%M:%S') as c, strftime(strptime(strftime(o_orderdate, '%d-%m-%Y'), '%d-%m-%Y'), '%Y-%m-%d') as back from orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", T.to_char("o_orderdate", "YYYY/MM/DD HH24:MI:SS").alias("c"), F.date_format(T.to_date(T.to_char("o_orderdate", "DD-MM-YYYY"), "DD-MM-YYYY"), "yyyy-MM-dd").alias("back"))


@query("fn_intervals", "select v, (v // 86400) // 30 as months, (v // 86400) % 30 as days, v % 86400 as secs from (select event_id * 7919 as v from events)")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select((F.col("event_id") * 7919).alias("v"))
    i = T.justify_interval(T.interval(0, 0, F.col("v") * 1_000_000))
    return e.select("v", i["months"].alias("months"), i["days"].alias("days"), F.floor(i["micros"] / 1_000_000).alias("secs"))


@query("fn_array", "select k, len(a) as n, '[1:' || len(a) || ']' as dims, a[2] as second, a[9] as beyond, array_to_string(a[2:3], ',') as sl, array_to_string(list_filter(a, lambda x: x <> 2), ',') as rem, array_to_string(list_transform(a, lambda x: case when x = 1 then 10 else x end), ',') as rep, list_has_all(a, [1, 2]) as con, list_has_any(a, [7, 8]) as ov, list_contains(a, 3) as anyq, array_to_string(list_append(list_prepend(0, a), 9), '-') as ap from (select n_nationkey as k, [n_nationkey % 3, n_nationkey % 4, n_nationkey % 5] as a from nation)")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    t = table(spark, d, "nation").select(k.alias("k"), F.array(k % 3, k % 4, k % 5).alias("a"))
    return t.select(
        "k", A.array_length("a").cast("long").alias("n"), A.array_dims("a").alias("dims"), subscript("a", 2).alias("second"), subscript("a", 9).alias("beyond"), A.array_to_string(A.array_slice("a", 2, 3), ",").alias("sl"), A.array_to_string(A.array_remove("a", 2), ",").alias("rem"), A.array_to_string(A.array_replace("a", 1, 10), ",").alias("rep"),
        A.contains("a", F.array(F.lit(1), F.lit(2))).alias("con"), A.overlaps("a", F.array(F.lit(7), F.lit(8))).alias("ov"), A.any_equal(F.lit(3), "a").alias("anyq"), A.array_to_string(F.array_append(F.array_prepend("a", 0), 9), "-").alias("ap"),
    )


@query("fn_array_ops", "select o_orderkey, unnest(string_split(o_orderpriority, '-')) as part from orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.explode(A.string_to_array("o_orderpriority", "-")).alias("part"))


@query("fn_json", "select event_id, json_valid(props) as ok, list_sort(json_keys(props))::varchar as keys from events")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.is_valid_json("props").alias("ok") if hasattr(F, "is_valid_json") else F.json_object_keys("props").isNotNull().alias("ok"), F.concat(F.lit("["), F.array_join(F.array_sort(J.object_keys("props")), ", "), F.lit("]")).alias("keys"))


@query("fn_json_build", "select n_nationkey, json_object('k', n_nationkey, 'name', n_name, 'none', null)::varchar as j, json_extract_string(json_object('a', [n_nationkey, 7]), '$.a[1]') as x from nation")
def _(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    j = J.row_to_json(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.lit(None).cast("string").alias("none"))
    return n.select("n_nationkey", j.alias("j"), J.extract_path_text(F.to_json(F.struct(F.array("n_nationkey", F.lit(7)).alias("a"))), "a", 1).alias("x"))


@query("fn_xml", "select r_regionkey, '<r id=\"' || r_regionkey || '\"><name>' || r_name || '</name></r>' as x, r_name as back, '<!--' || r_name || '-->' as c from region")
def _(spark: SparkSession, d: str) -> DataFrame:
    x = J.xmlelement("r", {"id": "r_regionkey"}, J.xmlforest(name="r_name"))
    return table(spark, d, "region").select("r_regionkey", x.alias("x"), J.xpath(x, "/r/name/text()")[0].alias("back"), J.xmlcomment("r_name").alias("c"))


sql("fn_conditional", "select c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') as s, case c_nationkey % 3 when 0 then 'zero' when 1 then 'one' else 'more' end as m, c_acctbal is not null as nn, cast(c_acctbal as bigint) is null as cn, greatest(c_nationkey, null, 5) as g from {customer}")
sql("fn_generate_series", "select n_nationkey, s from {nation} lateral view explode(sequence(n_nationkey, n_nationkey + 6, 3)) t as s", "select n_nationkey, unnest(range(n_nationkey, n_nationkey + 7, 3))::int as s from nation")


@query("fn_bits", "select n_nationkey, lpad(bin(n_nationkey), 6, '0') as b, lpad(bin(n_nationkey & 13), 6, '0') as a, lpad(bin(n_nationkey | 13), 6, '0') as o, lpad(bin(xor(n_nationkey, 13)), 6, '0') as x, lpad(bin(n_nationkey >> 1), 6, '0') as s from nation")
def _(spark: SparkSession, d: str) -> DataFrame:
    b, m = B.from_int("n_nationkey", 6), F.lit("001101")
    return table(spark, d, "nation").select("n_nationkey", b.alias("b"), B.bit_and(b, m).alias("a"), B.bit_or(b, m).alias("o"), B.bit_xor(b, m).alias("x"), B.shift_right(b, 1).alias("s"))


@query("fn_enum", "select o_orderkey, case o_orderpriority when '1-URGENT' then 1 when '2-HIGH' then 2 when '3-MEDIUM' then 3 when '4-NOT SPECIFIED' then 4 else 5 end::bigint as o from orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = B.Enum("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    return table(spark, d, "orders").select("o_orderkey", e.ordinal("o_orderpriority").alias("o"))


@query("range_overlap", "select a.n_nationkey as a, b.n_nationkey as b, '[' || greatest(a.n_nationkey, b.n_nationkey) || ',' || least(a.n_nationkey + 4, b.n_nationkey + 4) || ')' as i from nation a join nation b on a.n_nationkey < b.n_nationkey and a.n_nationkey + 4 > b.n_nationkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    r = n.select(F.col("n_nationkey").alias("k"), F.explode(F.sequence(F.floor(F.col("n_nationkey") / 4), F.floor((F.col("n_nationkey") + 3) / 4))).alias("bucket"), R.make(F.col("n_nationkey"), F.col("n_nationkey") + 4, "[)", True).alias("r"))
    j = r.alias("x").join(r.alias("y"), F.expr("x.bucket = y.bucket and x.k < y.k")).where(R.overlaps(F.col("x.r"), F.col("y.r")))
    return j.select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), R.to_text(R.intersect(F.col("x.r"), F.col("y.r"))).alias("i")).distinct()


@query("geo_point_box", "select l_orderkey, l_linenumber, round(sqrt(pow(l_quantity - 25, 2) + pow(l_discount * 100 - 5, 2)), 6) as dist, l_quantity between 10 and 30 and l_discount * 100 between 2 and 8 as inside, sqrt(pow(l_quantity - 25, 2) + pow(l_discount * 100 - 5, 2)) <= 6 as near from lineitem")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").withColumn("p", G.point(F.col("l_quantity"), F.col("l_discount") * 100)).withColumn("c", G.point(F.lit(25), F.lit(5)))
    b = G.box(G.point(F.lit(30), F.lit(2)), G.point(F.lit(10), F.lit(8)))
    return t.select("l_orderkey", "l_linenumber", F.round(G.distance("p", "c"), 6).alias("dist"), G.box_contains_point(b, "p").alias("inside"), (G.distance("p", "c") <= 6).alias("near"))


@query("net_inet", "select n, '10.' || (k % 4) || '.' || (k * 16) || '.0/20' as net, '10.' || (k % 4) || '.' || (k * 16 + 15) || '.255/20' as bc, '255.255.240.0' as mask, k % 4 = 1 as inside from (select n_nationkey as n, n_nationkey % 16 as k from nation)")
def _(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey") % 16
    t = table(spark, d, "nation").select(F.col("n_nationkey").alias("n"), F.format_string("10.%d.%d.7/20", (k % 4), (k * 16 + 3)).alias("a"))
    return t.select("n", N.network("a").alias("net"), N.broadcast("a").alias("bc"), N.netmask("a").alias("mask"), N.contained("a", F.lit("10.1.0.0/16")).alias("inside"))


@query("ts_match", "select item_id, list_contains(w, 'the') as has_the, len(list_distinct(list_filter(w, lambda x: x not in ('" + "','".join(TS.STOP) + "')))) as lexemes from (select item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w from benchmark)")
def _(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "benchmark")
    return b.select("item_id", TS.to_tsquery("the").match(TS.to_tsvector("text", ())).alias("has_the"), F.size(F.map_keys(TS.to_tsvector("text"))).cast("long").alias("lexemes"))


@query("ts_stat", "select word, count(distinct item_id) as ndoc, count(*) as nentry from (select item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) as word from benchmark) group by word")
def _(spark: SparkSession, d: str) -> DataFrame:
    return TS.ts_stat(table(spark, d, "benchmark").select(TS.to_tsvector("text", ()).alias("v")), "v")


_G = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, len(w) + 2), lambda i: ('  ' || w || ' ')[i:i + 2]))))"


@query("ext_trgm_similarity", f"with g as (select p_partkey, {_G.format('p_name')} as a, {_G.format('p_type')} as b from part) select p_partkey, round(len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))), 6) as s from g")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.round(X.similarity("p_name", "p_type"), 6).alias("s"))


@query("ext_fuzzy", "select a.n_name as a, b.n_name as b, levenshtein(a.n_name, b.n_name)::int as l, least(levenshtein(a.n_name, b.n_name), 4)::int as l3 from nation a join nation b on a.n_nationkey < b.n_nationkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    j = n.select(F.col("n_name").alias("a"), F.col("n_nationkey").alias("i")).join(n.select(F.col("n_name").alias("b"), F.col("n_nationkey").alias("k")), F.expr("i < k"))
    return j.select("a", "b", X.levenshtein("a", "b").alias("l"), X.levenshtein("a", "b", 3).alias("l3"))


@query("ext_crosstab", "select o_custkey, max(o_totalprice) filter (where o_orderstatus = 'F') as c_F, max(o_totalprice) filter (where o_orderstatus = 'O') as c_O, max(o_totalprice) filter (where o_orderstatus = 'P') as c_P from orders group by o_custkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    return X.crosstab(table(spark, d, "orders"), "o_custkey", "o_orderstatus", "o_totalprice", ["F", "O", "P"])


@query("ext_earthdistance", "select s_suppkey, round(2 * 6378168.0 * asin(sqrt(pow(sin((radians(s_suppkey % 90) - radians(10)) / 2), 2) + cos(radians(10)) * cos(radians(s_suppkey % 90)) * pow(sin((radians(s_nationkey * 3) - radians(20)) / 2), 2))), 2) as m from supplier")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select("s_suppkey", F.round(X.earth_distance(F.lit(10.0), F.lit(20.0), F.col("s_suppkey") % 90, F.col("s_nationkey") * 3), 2).alias("m"))


@query("ext_cube", "select l_orderkey, l_linenumber, l_quantity between 5 and 20 and l_discount between 0.02 and 0.05 as inside, round(sqrt(pow(greatest(5 - l_quantity, l_quantity - 20, 0), 2) + pow(greatest(0.02 - l_discount, l_discount - 0.05, 0), 2)), 6) as dist from lineitem")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = F.array("l_quantity", "l_discount")
    box = X.cube(F.array(F.lit(20.0), F.lit(0.02)), F.array(F.lit(5.0), F.lit(0.05)))
    t = table(spark, d, "lineitem")
    return t.select("l_orderkey", "l_linenumber", X.cube_contains(box, X.cube(p, p)).alias("inside"), F.round(X.cube_distance(box, X.cube(p, p)), 6).alias("dist"))


@query("ext_intarray", "select o_custkey, len(list_distinct(list(o_orderkey % 9))) as n, array_to_string(list_sort(list_distinct(list(o_orderkey % 9))), ',') as u from orders group by o_custkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    u = X.uniq(X.sort_ints(F.collect_list(F.col("o_orderkey") % 9)))
    return table(spark, d, "orders").groupBy("o_custkey").agg(X.icount(u).cast("long").alias("n"), A.array_to_string(u, ",").alias("u"))


@query("ext_hstore", "select n_nationkey, '\"a\"=>\"' || n_nationkey || '\", \"b\"=>\"' || n_name || '\"' as t, n_nationkey = 3 as c from nation")
def _(spark: SparkSession, d: str) -> DataFrame:
    m = X.hstore_concat(F.create_map(F.lit("a"), F.lit("0")), F.create_map(F.lit("a"), F.col("n_nationkey").cast("string"), F.lit("b"), F.col("n_name")))
    return table(spark, d, "nation").select("n_nationkey", X.hstore_text(m).alias("t"), X.hstore_contains(m, F.create_map(F.lit("a"), F.lit("3"))).alias("c"))


@query("ext_unaccent", "select doc_id, len(strip_accents(lower(text)))::bigint as n, md5(strip_accents(lower(text))) as m from documents")
def _(spark: SparkSession, d: str) -> DataFrame:
    u = X.unaccent(F.lower("text"))
    return table(spark, d, "documents").select("doc_id", F.length(u).cast("long").alias("n"), F.md5(u.cast("binary")).alias("m"))


@query("ext_ltree", "select p_partkey, split_part(p_type, ' ', 1) = 'STANDARD' as under, len(string_split(p_type, ' ')) as levels, array_to_string(string_split(p_type, ' ')[2:], '.') as rest from part")
def _(spark: SparkSession, d: str) -> DataFrame:
    p = F.replace(F.col("p_type"), F.lit(" "), F.lit("."))
    return table(spark, d, "part").select("p_partkey", X.is_ancestor(F.lit("STANDARD"), p).alias("under"), X.nlevel(p).cast("long").alias("levels"), X.subpath(p, 1).alias("rest"))


@query("ext_crypto", "select n_nationkey, md5(n_name) as m, sha1(n_name) as s1, sha256(n_name) as s2 from nation")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", *(X.digest("n_name", k).alias(a) for k, a in (("md5", "m"), ("sha1", "s1"), ("sha256", "s2"))))
