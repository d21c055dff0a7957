"""Tables through sources, sinks, documents, arrays, procedures and data changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quern.functions import arrays as A, bits as B, datetimes as T, documents as J, extensions as X, strings as S, textsearch as TS, types as Y
from quern.operators import dml, joins, procedures as P
from quern.queries.base import query, sql, table
from quern.semantics import array_agg
from quern.session import shared_path
from quern.sources import copy, foreign, largeobjects as LO


# strings, arrays, rows
@query("fn_regexp_split_to_table", r"select p_partkey, unnest(regexp_split_to_array(p_type, '\s+')) as piece from part")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", S.regexp_split_to_table("p_type", r"\s+").alias("piece"))


@query("fn_regexp_matches", "select p_partkey, regexp_extract(p_type, '([A-Z])([A-Z]+)', 1) as a, len(regexp_extract_all(p_type, '([A-Z])([A-Z]+)')) as n from part where regexp_matches(p_type, '([A-Z])([A-Z]+)')")
def _(spark: SparkSession, d: str) -> DataFrame:
    m = S.regexp_matches("p_type", "([A-Z])([A-Z]+)", "g")
    return table(spark, d, "part").where(S.matches("p_type", "([A-Z])([A-Z]+)")).select("p_partkey", m[0][0].alias("a"), F.size(m).cast("long").alias("n"))


@query("fn_trim_table", "select p_partkey, trim(p_type, 'SDAR') as b, ltrim(p_type, 'ST') as l, rtrim(p_type, 'L') as r, length(p_name) as cl, strlen(p_name) as ol, strlen(p_name) * 8 as bl, position('e' in p_name) as pos, concat_ws('/', p_brand, null, p_size) as ws, p_brand || p_type as cc from part")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(
        "p_partkey", S.btrim("p_type", "SDAR").alias("b"), S.ltrim("p_type", "ST").alias("l"), S.rtrim("p_type", "L").alias("r"), F.char_length("p_name").cast("long").alias("cl"), F.octet_length("p_name").cast("long").alias("ol"), F.bit_length("p_name").cast("long").alias("bl"),
        F.position(F.lit("e"), "p_name").cast("long").alias("pos"), F.concat_ws("/", "p_brand", F.lit(None).cast("string"), F.col("p_size").cast("string")).alias("ws"), F.concat("p_brand", "p_type").alias("cc"),
    )


@query("fn_overlay_table", "select p_partkey, left(p_name, 1) || '##' || substring(p_name, 4) as o, p_name ~ '.*an.*' as m, regexp_matches(p_name, 'AN', 'i') as mi, not regexp_matches(p_name, 'an') as nm from part")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", S.overlay("p_name", F.lit("##"), 2).alias("o"), S.matches("p_name", ".*an.*").alias("m"), S.matches("p_name", "AN", True).alias("mi"), (~S.matches("p_name", "an")).alias("nm"))


@query("fn_bytes_table", "select n_nationkey, lower(hex(encode(n_name))) as h, decode(from_hex(hex(encode(n_name)))) as back, n_name as b64, lower(to_hex(n_nationkey * 1000)) as x, ascii(n_name[2]) as g, chr(n_nationkey + 65) as c from nation")
def _(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    return n.select(
        "n_nationkey", S.encode("n_name", "hex").alias("h"), F.decode(S.decode(S.encode("n_name", "hex"), "hex"), "UTF-8").alias("back"), F.decode(S.decode(S.encode("n_name", "base64"), "base64"), "UTF-8").alias("b64"), S.to_hex(F.col("n_nationkey") * 1000).alias("x"),
        S.get_byte("n_name", 1).alias("g"), S.chr_(F.col("n_nationkey") + 65).alias("c"),
    )


@query("order_by_collation", "select n_nationkey, row_number() over (order by n_name collate nocase, n_nationkey) as place from (select n_nationkey, case when n_nationkey % 2 = 0 then lower(n_name) else n_name end as n_name from nation)")
def _(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name")).alias("s"))
    return n.select("n_nationkey", F.row_number().over(Window.orderBy(S.collate("s", "UTF8_LCASE"), "n_nationkey")).alias("place"))


@query("array_subquery", "select r_regionkey, array_to_string(array(select n_name from nation where n_regionkey = r_regionkey order by n_name), ',') as names from region")
def _(spark: SparkSession, d: str) -> DataFrame:
    names = A.array_subquery(table(spark, d, "nation").withColumnRenamed("n_regionkey", "r_regionkey"), "n_name", ["r_regionkey"])
    return table(spark, d, "region").join(names, "r_regionkey", "left").select("r_regionkey", F.coalesce(A.array_to_string("n_name", ","), F.lit("")).alias("names"))


@query("array_comparison", "select a.n_nationkey as a, b.n_nationkey as b, [a.n_regionkey, a.n_nationkey] < [b.n_regionkey, b.n_nationkey] as lt, [a.n_regionkey, a.n_nationkey] >= [b.n_regionkey, b.n_nationkey] as ge, row(a.n_regionkey, a.n_name) < row(b.n_regionkey, b.n_name) as rlt from nation a join nation b on b.n_nationkey = (a.n_nationkey * 7 + 1) % 25")
def _(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    j = n.alias("a").join(n.alias("b"), F.expr("b.n_nationkey = (a.n_nationkey * 7 + 1) % 25"))
    c = A.array_compare(F.array("a.n_regionkey", "a.n_nationkey"), F.array("b.n_regionkey", "b.n_nationkey"))
    r = A.row_compare([F.col("a.n_regionkey"), F.col("a.n_name")], "<", [F.col("b.n_regionkey"), F.col("b.n_name")])
    return j.select(F.col("a.n_nationkey").alias("a"), F.col("b.n_nationkey").alias("b"), (c < 0).alias("lt"), (c >= 0).alias("ge"), r.alias("rlt"))


@query("array_bounds", "select o_custkey, len(list(o_orderkey)) as up, 1 as low, 1 as dims, len(list_concat(list(o_orderkey), [1, 2])) as cat from orders group by o_custkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list("o_orderkey").alias("a"))
    return a.select("o_custkey", A.array_upper("a").cast("long").alias("up"), A.array_lower("a").alias("low"), A.array_ndims("a").alias("dims"), F.size(A.array_cat("a", F.array(F.lit(1).cast("long"), F.lit(2).cast("long")))).cast("long").alias("cat"))


@query("quantified_all_any", "select s_suppkey, s_acctbal >= all (select c_acctbal from customer where c_custkey <= 40) as a, s_acctbal < any (select c_acctbal from customer where c_custkey <= 40) as y from supplier")
def _(spark: SparkSession, d: str) -> DataFrame:
    s, c = table(spark, d, "supplier"), table(spark, d, "customer").where("c_custkey <= 40")
    every = joins.quantified(s, "s_acctbal", ">=", c, "c_acctbal").select("s_suppkey", F.lit(True).alias("a"))
    some = joins.quantified(s, "s_acctbal", "<", c, "c_acctbal", every=False).select("s_suppkey", F.lit(True).alias("y"))
    none = F.lit(False)
    return s.select("s_suppkey").join(every, "s_suppkey", "left").join(some, "s_suppkey", "left").select("s_suppkey", F.coalesce("a", none).alias("a"), F.coalesce("y", none).alias("y"))


@query("join_asof", "select e.event_id, p.event_id as before from events e asof left join (select * from events where event_type = 'purchase') p on e.user_id = p.user_id and e.ts >= p.ts")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "user_id", "ts", "event_type")
    out = joins.asof_join(e, e.where("event_type = 'purchase'"), ["user_id"], "ts")
    return out.select("event_id", F.col("r_event_id").alias("before"))


@query("group_by_primary_key", "select c_custkey, any_value(c_name) as c_name, any_value(c_mktsegment) as c_mktsegment, count(*) as n from customer join orders on o_custkey = c_custkey group by c_custkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "customer").join(table(spark, d, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    return joins.group_by_key(j, ["c_custkey"], ["c_name", "c_mktsegment"], F.count("*").alias("n"))


sql("agg_outer_level", "select n_regionkey, count(*) as n from {nation} group by n_regionkey having exists (select 1 from {region} where r_regionkey = n_regionkey and length(r_name) < 100)", "select n_regionkey, count(*) as n from nation group by n_regionkey having exists (select 1 from region where r_regionkey = n_regionkey and length(r_name) < 100)")


@query("agg_approximate", "select o_orderstatus, true as distinct_close, true as median_close from orders group by o_orderstatus")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy("o_orderstatus").agg(F.approx_count_distinct("o_custkey", 0.02).alias("a"), F.count_distinct("o_custkey").alias("e"), F.percentile_approx("o_totalprice", 0.5, 10_000).alias("m"), F.percentile("o_totalprice", F.lit(0.5)).alias("p"))
    return o.select("o_orderstatus", (F.abs(F.col("a") - F.col("e")) <= 0.08 * F.col("e") + 1).alias("distinct_close"), (F.abs(F.col("m") - F.col("p")) <= 0.03 * F.col("p")).alias("median_close"))


@query("fn_generate_subscripts", "select o_orderkey, unnest(range(1, len(string_split(o_orderpriority, '-')) + 1)) as i from orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", F.explode(A.subscripts(A.string_to_array("o_orderpriority", "-"))).alias("i")).select("o_orderkey", F.col("i").cast("long").alias("i"))


@query("fn_generate_series_time", "select o_orderkey, unnest(generate_series(date_trunc('month', o_orderdate), o_orderdate, interval 7 day)) as t from orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.explode(T.timestamp_series(F.date_trunc("month", t), t, T.interval_literal("7 days"))).alias("t"))


@query("fn_epoch_round_trip", "select event_id, epoch_us(ts) as us, ts as back, time_bucket(interval 1 day, ts) as day from events")
def _(spark: SparkSession, d: str) -> DataFrame:
    ts = F.col("ts")
    us = F.unix_micros(ts.cast("timestamp"))
    return table(spark, d, "events").select("event_id", us.alias("us"), T.from_epoch(us / 1e6).cast("timestamp_ntz").alias("back"), F.date_trunc("day", ts).cast("timestamp_ntz").alias("day"))


@query("fn_interval_table", "select event_id, ((event_id * 7919) // 3600) || ' ' as h, (event_id % 24) as months, true as same from events")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", (F.col("event_id") * 7919).alias("v"), (F.col("event_id") % 24).alias("m"))
    i = T.interval(F.col("m"), 0, F.col("v") * 1_000_000)
    text = T.interval_text(T.interval(0, 0, F.col("v") * 1_000_000))
    back = T.interval_input(text)
    return e.withColumn("b", back).select("event_id", F.concat(F.floor(F.col("v") / 3600).cast("string"), F.lit(" ")).alias("h"), i["months"].alias("months"), (F.col("b.micros") == F.col("v") * 1_000_000).alias("same"))


# documents
@query("json_aggregates", "select n_regionkey, to_json(list(n_name order by n_nationkey))::varchar as names from nation group by n_regionkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").groupBy("n_regionkey").agg(J.json_agg("n_name", "n_nationkey").alias("names"))


@query("json_each_table", "select n_nationkey, e.key as k, e.value as v from nation, lateral (select unnest([{key: 'k', value: n_nationkey::varchar}, {key: 'name', value: '\"' || n_name || '\"'}]) as e)")
def _(spark: SparkSession, d: str) -> DataFrame:
    j = J.row_to_json(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return table(spark, d, "nation").select("n_nationkey", F.explode(J.each(j)).alias("k", "v"))


@query("json_elements_table", "select o_orderkey, len(string_split(o_orderpriority, '-')) as n, '\"' || string_split(o_orderpriority, '-')[1] || '\"' as first from orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    j = J.array_to_json(A.string_to_array("o_orderpriority", "-"))
    return table(spark, d, "orders").select("o_orderkey", J.array_length(j).cast("long").alias("n"), J.array_elements(j)[0].alias("first"))


@query("json_populate_table", "select n_nationkey, n_name as name, n_nationkey as k, n_regionkey as r from nation")
def _(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    one = J.populate_record(J.row_to_json(F.col("n_name").alias("name"), F.col("n_nationkey").alias("k")), "name string, k int")
    many = J.populate_recordset(F.concat(F.lit("["), J.row_to_json(F.col("n_regionkey").alias("r")), F.lit("]")), "r int")
    return n.select("n_nationkey", one["name"].alias("name"), one["k"].alias("k"), many[0]["r"].alias("r"))


@query("xml_aggregates", "select n_regionkey, string_agg('<n>' || n_name || '</n>', '' order by n_nationkey) as x, true as ok from nation group by n_regionkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").groupBy("n_regionkey").agg(J.xmlagg(J.xmlelement("n", None, J.xml_escape("n_name")), "n_nationkey").alias("x"))
    return n.select("n_regionkey", "x", J.is_well_formed("x").alias("ok"))


@query("xml_table", "select '<region xmlns:xsi=\"http://www.w3.org/2001/XMLSchema-instance\">' || string_agg('<row><r_regionkey>' || r_regionkey || '</r_regionkey><r_name>' || r_name || '</r_name></row>', '' order by r_regionkey) || '</region>' as table_to_xml from region")
def _(spark: SparkSession, d: str) -> DataFrame:
    return J.table_xml(table(spark, d, "region").select("r_regionkey", "r_name"), "region", ["r_regionkey"])


@query("xml_path_table", "select n_nationkey, n_name as name, n_regionkey::varchar as region from nation")
def _(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "nation").select("n_nationkey", J.xmlelement("n", None, J.xmlforest(name="n_name", region="n_regionkey")).alias("x"))
    return X.xpath_table(x, "n_nationkey", "x", {"name": "/n/name/text()", "region": "/n/region/text()"})


# text search over whole tables
@query("ts_rank", "with w as (select item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w from benchmark), t as (select item_id, w, unnest(range(1, len(w) + 1)) as i from w), p as (select item_id, list(i order by i) filter (where w[i] = 'the') as a, list(i order by i) filter (where w[i] in ('in', 'of')) as b from t group by item_id), g as (select item_id, a, b, unnest(a) as x from p where a is not null and b is not null), h as (select item_id, x, unnest(b) as y from g) select item_id, round(1 - exp(sum(ln(1 - sqrt(0.01 * case when abs(x - y) > 100 then 1e-30 else 1.0 / (1.005 + 0.05 * exp(abs(x - y) / 1.5 - 2)) end)))), 5) as rank from h group by item_id")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Rank of `the & pre`, where pre stands for both in and of, by the pairs of their positions."""
    v = TS.to_tsvector(F.regexp_replace(F.lower("text"), r"\b(in|of)\b", "pre"), ())
    q = TS.to_tsquery("the & pre")
    return table(spark, d, "benchmark").where(q.match(v)).select("item_id", F.round(TS.ts_rank(v, q), 5).alias("rank"))


@query("ts_rank_or", "with w as (select item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') as w from benchmark), c as (select item_id, len(list_filter(w, lambda x: x = 'the')) as a, len(list_filter(w, lambda x: x = 'and')) as b from w) select item_id, round((case when a > 0 then list_sum(list_transform(range(1, a + 1), lambda i: 0.1 / (i * i))) else 0 end + case when b > 0 then list_sum(list_transform(range(1, b + 1), lambda i: 0.1 / (i * i))) else 0 end) / 1.64493406685 / 2, 6) as rank from c where a > 0 or b > 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    v, q = TS.to_tsvector("text", ()), TS.to_tsquery("the | and")
    return table(spark, d, "benchmark").where(q.match(v)).select("item_id", F.round(TS.ts_rank(v, q), 6).alias("rank"))


@query("ts_rank_cd_single", "select item_id, (round(0.1 * len(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x = 'the')), 6))::double as rank from benchmark")
def _(spark: SparkSession, d: str) -> DataFrame:
    """Each occurrence of a lone word is a cover of its own."""
    return table(spark, d, "benchmark").select("item_id", F.round(TS.ts_rank_cd(TS.to_tsvector("text", ()), TS.to_tsquery("the")), 6).alias("rank"))


@query("ts_plain_match", "select item_id, list_contains(w, 'water') and list_contains(w, 'river') as m from (select item_id, regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+') as w from benchmark)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", TS.plainto_tsquery("the water and the river").match(TS.to_tsvector("text")).alias("m"))


@query("ts_parse", "select * from (values (1, 1, 'asciiword', 'That'), (2, 12, 'blank', ' '), (3, 22, 'uint', '12'), (4, 12, 'blank', ' '), (5, 20, 'float', '4.5'), (6, 12, 'blank', ' '), (7, 4, 'email', 'me@example.com'), (8, 12, 'blank', ' '), (9, 16, 'asciihword', 'up-to-date'), (10, 11, 'hword_asciipart', 'up'), (11, 12, 'blank', '-'), (12, 11, 'hword_asciipart', 'to'), (13, 12, 'blank', '-'), (14, 11, 'hword_asciipart', 'date'), (15, 12, 'blank', ' '), (16, 2, 'word', 'été'), (17, 12, 'blank', ' '), (18, 13, 'tag', '<b>'), (19, 3, 'numword', 'a1')) as t(nth, tokid, alias, token)")
def _(spark: SparkSession, d: str) -> DataFrame:
    return TS.ts_parse(spark.createDataFrame([("That 12 4.5 me@example.com up-to-date été <b>a1",)], "t string"), "t").drop("t")


@query("ts_debug", "select * from (values (1, 'asciiword', 'The', 'Word, all ASCII', 'simple', ''), (2, 'blank', ' ', 'Space symbols', null, null), (3, 'asciiword', 'Stars', 'Word, all ASCII', 'simple', 'stars')) as t(nth, alias, token, description, dictionary, lexemes)")
def _(spark: SparkSession, d: str) -> DataFrame:
    out = TS.ts_debug(spark.createDataFrame([("The Stars",)], "t string"), "t")
    return out.select("nth", "alias", "token", "description", "dictionary", F.array_join("lexemes", ",").alias("lexemes"))


# sources and sinks
@query("copy_text_round_trip", "select o_orderkey, case when o_custkey % 5 = 0 then null else o_orderpriority end as p, o_orderstatus || chr(9) || 'a\\b' || chr(10) || 'x' as t, o_totalprice from orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") % 5 != 0, F.col("o_orderpriority")).alias("p"), F.concat("o_orderstatus", F.lit("\ta\\b\nx")).alias("t"), "o_totalprice")
    path = shared_path(spark, "copy-text")
    copy.copy_to(o, path)
    return copy.copy_from(spark, path, o.schema)


@query("copy_binary_round_trip", "select o_orderkey, o_custkey, o_totalprice, o_orderdate, case when o_custkey % 3 = 0 then null else o_orderpriority end as p, o_custkey % 2 = 0 as even, o_orderdate::date as day from orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    o = o.select("o_orderkey", "o_custkey", "o_totalprice", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_orderpriority")).alias("p"), (F.col("o_custkey") % 2 == 0).alias("even"), F.to_date("o_orderdate").alias("day"))
    return copy.copy_from_binary(copy.copy_to_binary(o, shared_path(spark, "copy-binary")), o.schema)


@query("copy_query_header", "select n_nationkey, n_name from nation where n_regionkey = 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").where("n_regionkey = 2").select("n_nationkey", "n_name")
    path = shared_path(spark, "copy-query")
    copy.copy_to(n, path, csv=True, header=True, delimiter=";", force_quote=True)
    return copy.copy_from(spark, path, n.schema, csv=True, header=True, delimiter=";")


class _Squares(foreign.Wrapper):
    """Numbers below `n` and their squares, in splits of ten."""

    def schema(self, options: dict) -> str:
        return "k int, sq int"

    def splits(self, options: dict) -> list:
        return list(range(0, int(options["n"]), 10))

    def rows(self, options: dict, split):
        for i in range(split, min(split + 10, int(options["n"]))):
            yield i, i * i


@query("foreign_table_wrapper", "select n_nationkey, n_nationkey * n_nationkey as sq from nation")
def _(spark: SparkSession, d: str) -> DataFrame:
    foreign.register(spark, "quern_squares", _Squares())
    squares = foreign.Server(spark, "quern_squares", n="25").table()
    return table(spark, d, "nation").join(squares, F.col("k") == F.col("n_nationkey")).select("n_nationkey", "sq")


@query("foreign_table_file", "select s_suppkey, s_name, s_acctbal from supplier")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    path = shared_path(spark, "foreign")
    copy.copy_to(s, path, csv=True, header=True)
    return foreign.Server(spark, "file", format="csv", header="true").table(s.schema, filename=path)


@query("create_table_as", "select o_custkey, o_orderkey, o_totalprice from orders where o_totalprice > 100000")
def _(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "ctas")
    name = "quern_" + path[-32:]
    o = table(spark, d, "orders").where("o_totalprice > 100000").select("o_custkey", "o_orderkey", "o_totalprice")
    return copy.create_table_as(o, name, ["o_custkey"], 4, path=path)


@query("cursor_scroll", "select * from (select n_name, 'next' as step from nation order by n_name limit 3) union all select * from (select n_name, 'back' from nation order by n_name limit 2) union all select * from (select n_name, 'last' from nation order by n_name desc limit 1) union all select * from (select n_name, 'tenth' from nation order by n_name limit 1 offset 9)")
def _(spark: SparkSession, d: str) -> DataFrame:
    c = copy.Cursor(table(spark, d, "nation").select("n_name"), [F.col("n_name")])
    steps = [("next", c.fetch(3)), ("back", c.fetch(-2)), ("last", c.absolute(-1)), ("tenth", c.absolute(10))]
    out = [rows.withColumn("step", F.lit(step)) for step, rows in steps]
    return out[0].union(out[1]).union(out[2]).union(out[3])


@query("large_objects", "select p_partkey as loid, substring(repeat(p_name, 300), 2001, 100) as part, length(repeat(p_name, 300)) as n from part")
def _(spark: SparkSession, d: str) -> DataFrame:
    pages = LO.lo_import(table(spark, d, "part").select("p_partkey", F.repeat("p_name", 300).alias("b")), "p_partkey", "b")
    part = LO.lo_get(pages, 2000, 100).select("loid", F.decode("data", "UTF-8").alias("part"))
    return part.join(pages.groupBy("loid").agg(F.sum(F.length("data")).alias("n")), "loid")


@query("large_object_write", "select p_partkey as loid, case when p_partkey = 3 then left(repeat(p_name, 300), 2040) || repeat('z', 20) || substring(repeat(p_name, 300), 2061) else repeat(p_name, 300) end as text from part where p_partkey <= 5")
def _(spark: SparkSession, d: str) -> DataFrame:
    pages = LO.lo_import(table(spark, d, "part").where("p_partkey <= 5").select("p_partkey", F.repeat("p_name", 300).alias("b")), "p_partkey", "b")
    return LO.lo_get(LO.lo_put(pages, 3, 2040, b"z" * 20)).select("loid", F.decode("data", "UTF-8").alias("text"))


# data changes
@query("dml_truncate", "select count(*) as n from nation where 1 = 0")
def _(spark: SparkSession, d: str) -> DataFrame:
    return dml.truncate(table(spark, d, "nation")).agg(F.count("*").alias("n"))


@query("dml_with_moved_rows", "select 'source' as place, count(*) as n, min(s_suppkey) as k from supplier where not s_acctbal < 0 union all select 'target', count(*), min(k) from (select r_regionkey + 1000 as k from region union all select s_suppkey from supplier where s_acctbal < 0)")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    target = table(spark, d, "region").select((F.col("r_regionkey") + 1000).cast("long").alias("s_suppkey"), F.col("r_name").alias("s_name"), F.lit(0.0).alias("s_acctbal"))
    left, new, _ = dml.move_rows(s, target, F.col("s_acctbal") < 0)
    count = lambda t, name: t.agg(F.lit(name).alias("place"), F.count("*").alias("n"), F.min("s_suppkey").alias("k"))
    return count(left, "source").union(count(new, "target"))


# procedures
@query("sql_function_defaults", "select n_nationkey, n_nationkey * 2 + 10 as a, n_nationkey * 3 + 10 as b, n_nationkey * 2 + 1 as c from nation")
def _(spark: SparkSession, d: str) -> DataFrame:
    P.sql_function(spark, "quern_scaled", [("x", "int"), ("factor", "int", "2"), ("plus", "int", "10")], "int", "x * factor + plus")
    return spark.sql("select n_nationkey, quern_scaled(n_nationkey) as a, quern_scaled(n_nationkey, 3) as b, quern_scaled(n_nationkey, plus => 1) as c from {n}", n=table(spark, d, "nation"))


@query("sql_function_table", "select n_nationkey, unnest(range(0, n_regionkey)) as i from nation")
def _(spark: SparkSession, d: str) -> DataFrame:
    P.sql_function(spark, "quern_upto", [("n", "int")], "table(i bigint)", "select id from range(0, 100) where id < n")
    return spark.sql("select n_nationkey, i from {n}, lateral quern_upto(n_regionkey)", n=table(spark, d, "nation"))


@query("function_variadic_polymorphic", "select n_nationkey, greatest(n_nationkey, n_regionkey, 7) as m, array_to_string([n_nationkey, n_regionkey], '/') as a, array_to_string([n_name, n_name], '/') as b from nation")
def _(spark: SparkSession, d: str) -> DataFrame:
    most = P.variadic(lambda xs: max(xs), "int")
    pair = P.polymorphic(lambda x, y: A.array_to_string(F.array(x, y), "/"))
    return table(spark, d, "nation").select("n_nationkey", most("n_nationkey", "n_regionkey", F.lit(7)).alias("m"), pair(F.col("n_nationkey"), F.col("n_regionkey")).alias("a"), pair(F.col("n_name"), F.col("n_name")).alias("b"))


@query("do_block", "select 55 as total, 10 as steps")
def _(spark: SparkSession, d: str) -> DataFrame:
    return P.do_block(spark, "declare total int default 0; declare i int default 0; while i < 10 do set i = i + 1; set total = total + i; end while; select total, i as steps;")


@query("window_user_defined", "select o_orderkey, round(sum(o_totalprice) over w / count(*) over w, 4) as m from orders window w as (partition by o_custkey order by o_orderkey rows between 2 preceding and current row)")
def _(spark: SparkSession, d: str) -> DataFrame:
    mean = P.window_function(lambda v: float(v.sum() / len(v)), "double")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(-2, 0)
    return table(spark, d, "orders").select("o_orderkey", F.round(mean("o_totalprice").over(w), 4).alias("m"))


@query("operators_user_defined", "select a.n_nationkey as a, b.n_nationkey as b, abs(a.n_nationkey - b.n_nationkey) <= 2 as near, abs(a.n_nationkey - b.n_nationkey) > 2 as far, a.n_nationkey::varchar || '!' as c from nation a join nation b on a.n_regionkey = b.n_regionkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    ops = P.Operators()
    ops.define("<~>", lambda x, y: F.abs(x - y) <= 2, commutator="<~>", negator="<!~>")
    ops.casts["int", "shout"] = lambda x: F.concat(x.cast("string"), F.lit("!"))
    n = table(spark, d, "nation")
    j = n.alias("a").join(n.alias("b"), F.expr("a.n_regionkey = b.n_regionkey"))
    x, y = F.col("a.n_nationkey"), F.col("b.n_nationkey")
    return j.select(x.alias("a"), y.alias("b"), ops.apply(x, "<~>", y).alias("near"), ops.apply(x, "<!~>", y).alias("far"), ops.cast(x, "int", "shout").alias("c"))


@query("statement_statistics", "select 'count orders' as query, 2::bigint as calls, 2::bigint as rows, true as timed union all select 'nations', 1, 25, true")
def _(spark: SparkSession, d: str) -> DataFrame:
    s = P.Statements()
    for _ in range(2):
        s.run("count orders", table(spark, d, "orders").agg(F.count("*")))
    s.run("nations", table(spark, d, "nation"))
    return s.table(spark).select("query", "calls", "rows", (F.col("total_time") > 0).alias("timed"))


@query("session_facts", "select true as database, true as version, 'UTC' as zone, true as unknown, true as sized, sum(strlen(n_name) + 1) as name_bytes from nation")
def _(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    facts = Y.current_setting(spark, "spark.sql.session.timeZone"), Y.current_setting(spark, "quern.unknown", True) is None, Y.relation_size(n) > 100
    return n.agg(F.lit(spark.catalog.currentDatabase() == "default").alias("database"), F.lit(spark.version.startswith("4")).alias("version"), F.lit(facts[0]).alias("zone"), F.lit(facts[1]).alias("unknown"), F.lit(facts[2]).alias("sized"), F.sum(Y.column_size("n_name", "string")).alias("name_bytes"))


@query("fn_to_number_templates", "select * from (values ('-34338492', '-34338492.0000'), ('<564646.654564>', '-564646.6546'), ('0.00001-', '0.0000'), ('5.01-', '-5.0100'), ('4 4 4 4 8 . 7 8', '44448.7800'), (' . 0 1 -', '-0.0100'), ('12,454.8-', '-12454.8000'), ('48V', '0.4800')) as t(item, value)")
def _(spark: SparkSession, d: str) -> DataFrame:
    rows = [("-34338492", "99G999G999"), ("<564646.654564>", "999999.999999PR"), ("0.00001-", "9.999S"), ("5.01-", "FM9.999999MI"), ("4 4 4 4 8 . 7 8", "9 9 9 9 9 . 9 9"), (" . 0 1 -", " 9 9 . 9 9 S"), ("12,454.8-", "99G999D9S"), ("48V", "99V99")]
    out = None
    for text, t in rows:
        one = spark.range(1).select(F.lit(text).alias("item"), F.round(Y.to_number(F.lit(text.replace("V", "")), t).cast("decimal(20,6)"), 4).cast("decimal(20,4)").cast("string").alias("value"))
        out = one if out is None else out.union(one)
    return out


@query("int_array_aggregate", "select n_regionkey, sum(n_nationkey)::bigint as total, count(*) as n from nation group by n_regionkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    packed = table(spark, d, "nation").groupBy("n_regionkey").agg(X.int_array_aggregate("n_nationkey").alias("a"))
    return packed.select("n_regionkey", X.int_array_enum("a").alias("k")).groupBy("n_regionkey").agg(F.sum("k").alias("total"), F.count("*").alias("n"))


@query("citext_extremes", "select n_regionkey, min(lower(n_name)) as lo, max(lower(n_name)) as hi from nation group by n_regionkey")
def _(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_regionkey", Y.ci(F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name"))).alias("s"))
    plain = lambda c: F.lower(F.collate(c, "UTF8_BINARY"))
    return n.groupBy("n_regionkey").agg(F.min("s").alias("lo"), F.max("s").alias("hi")).select("n_regionkey", plain("lo").alias("lo"), plain("hi").alias("hi"))


@query("hstore_record", "select n_nationkey, '\"n_name\"=>\"' || n_name || '\", \"n_regionkey\"=>\"' || n_regionkey || '\"' as t from nation")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select("n_nationkey", X.hstore_text(X.hstore_record("n_name", "n_regionkey")).alias("t"))


@query("ltree_query", "select p_partkey from part where regexp_full_match(replace(p_type, ' ', '.'), '(STANDARD|PROMO)\\.\\w+(\\.\\w+)*')")
def _(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where(X.lquery(F.replace(F.col("p_type"), F.lit(" "), F.lit(".")), "STANDARD|PROMO.*{1,}")).select("p_partkey")


@query("intarray_query", "select o_custkey from (select o_custkey, list(o_orderkey % 9) as a from orders group by o_custkey) where list_contains(a, 1) and (list_contains(a, 2) or not list_contains(a, 3))")
def _(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_list((F.col("o_orderkey") % 9).cast("int")).alias("a"))
    return a.where(X.query_int("a", "1 & (2 | !3)")).select("o_custkey")


@query("enum_order", "select o_orderkey, case o_orderpriority when '1-URGENT' then true when '2-HIGH' then true else false end as above from orders")
def _(spark: SparkSession, d: str) -> DataFrame:
    e = B.Enum("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    return table(spark, d, "orders").select("o_orderkey", (e.ordinal("o_orderpriority") < e.ordinal(F.lit("3-MEDIUM"))).alias("above"))


@query("stream_windows", "select epoch(date_trunc('hour', ts))::bigint as h, event_type, count(*) as n from events group by 1, 2")
def _(spark: SparkSession, d: str) -> DataFrame:
    """A stream over the table's file in hourly windows; the last complete result is read back."""
    base = shared_path(spark, "windows")
    source = table(spark, d, "events")
    stream = spark.readStream.schema(source.schema).parquet(f"{d}/events*.parquet")
    counts = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"))
    counts = counts.select(F.unix_timestamp("window.start").alias("h"), "event_type", "n")

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/batch={n:09d}")

    q = counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("h long, event_type string, n long").parquet(f"{base}/batch={q.lastProgress['batchId']:09d}")
