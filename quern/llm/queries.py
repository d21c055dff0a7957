"""Registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def op1(spark: SparkSession, d: str) -> DataFrame:
    from quern.llm.jaccard_join import jaccard_join

    return jaccard_join(_read(spark, d, "documents")).select("doc_id", "class_id", "n_links")


def op2(spark: SparkSession, d: str) -> DataFrame:
    from quern.llm.warc import read_records, write_warc

    return read_records(write_warc(_read(spark, d, "pages"))).drop("n_chunks")


def op3(spark: SparkSession, d: str) -> DataFrame:
    from quern.llm.sharding import shuffle_to_shards

    out = shuffle_to_shards(_read(spark, d, "documents"))
    return out.select("doc_id", F.col("__size").alias("size"), F.col("__crc32").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    from quern.llm.token_store import read_store, write_store

    return read_store(write_store(_read(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def op5(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    from quern.llm.packing import pack

    return pack(_read(spark, d, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6(spark: SparkSession, d: str) -> DataFrame:
    from quern.llm.language_id import identify

    return identify(_read(spark, d, "documents"))


def op7(spark: SparkSession, d: str) -> DataFrame:
    from quern.llm.mixing import mix

    docs = _read(spark, d, "documents").select("doc_id", "source")
    return mix(docs).select("doc_id", "source", F.col("__block").alias("block"), F.col("__slot").alias("slot"), F.col("__at").alias("position"))


def op8(spark: SparkSession, d: str) -> DataFrame:
    from quern.llm.topk import top_k

    return top_k(_read(spark, d, "embeddings"))


def op9(spark: SparkSession, d: str) -> DataFrame:
    from quern.llm.suffix_dedup import remove_repeats

    return remove_repeats(_read(spark, d, "documents")).drop("kept")


def op10(spark: SparkSession, d: str) -> DataFrame:
    from quern.llm.exact_dedup import exact_dedup

    return exact_dedup(_read(spark, d, "documents"))


QUERIES = {
    "op1_ngram_jaccard_join": op1,
    "op2_warc": op2,
    "op3_sharding": op3,
    "op4_token_store": op4,
    "op5_best_fit_packing": op5,
    "op6_language_id": op6,
    "op7_mixing": op7,
    "op8_exact_top_k": op8,
    "op9_suffix_array_dedup": op9,
    "op10_exact_dedup": op10,
}

ORACLES = {
    "op1_ngram_jaccard_join": r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') as g from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from w where len(w) > 0)),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where c >= 0.8 * (x.n + y.n - c) - 1e-9),
r(doc, root) as (select doc_id, doc_id from documents union select l.b, r.root from r join l on l.a = r.doc)
select d.doc_id, (select min(root) from r where doc = d.doc_id) as class_id, (select count(*) from l where l.a = d.doc_id) as n_links from documents d""",
    "op2_warc": r"""
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, h, sha1(h) as x, min(page_id) over (partition by h) as first from p),
b as (select *, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(('0x' || x[i])::int), 4, '0')), '') as bits from d)
select page_id, strlen(h) as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(1, 6), lambda j: substring(bits, (5 * i + j)::int, 1)::int * (1 << (5 - j)::int)))::int, 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to from b""",
    "op8_exact_top_k": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v, len(embedding) as n from embeddings
  where vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
s as (select a.vec_id as query_id, b.vec_id, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::bigint as score from v a join v b on a.vec_id <> b.vec_id and a.n = b.n where a.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20""",
    "op9_suffix_array_dedup": """
with d as (select doc_id, strlen(coalesce(text, '')) as n, hex(encode(coalesce(text, ''))) as h from documents),
c as (select doc_id, n, c, substring(h, (2048 * c + 1)::bigint, 2446) as h from (select doc_id, n, h, unnest(range(0, (greatest(n - 199, 0) + 1023) // 1024)) as c from d)),
w as (select doc_id, 1024 * c + j as p, md5_number(substring(h, (2 * j + 1)::bigint, 400)) as k from (select doc_id, c, h, unnest(range(0, least(1024, n - 199 - 1024 * c))) as j from c)),
r as (select doc_id, p from w where k in (select k from w group by k having count(*) > 1)),
g as (select doc_id, p, coalesce(p > lag(p) over o + 200, true) as fresh, least(200, coalesce(lead(p) over o - p, 200)) as gone from r window o as (partition by doc_id order by p)),
s as (select doc_id, span, min(p) as a, max(p) + 200 as b from (select doc_id, p, sum(fresh::int) over (partition by doc_id order by p) as span from g) group by doc_id, span),
t as (select doc_id, count(*) as spans, sum(b - a) as gone from s group by doc_id),
k as (select s.doc_id, string_agg(substring(h, (2 * coalesce(before, 0) + 1)::bigint, (2 * (a - coalesce(before, 0)))::bigint), '' order by a) as head, max(b) as last from (select *, lag(b) over (partition by doc_id order by a) as before from s) s join d using (doc_id) group by s.doc_id)
select d.doc_id, d.n as n_bytes, coalesce(t.gone, 0)::bigint as n_removed, coalesce(t.spans, 0) as n_spans,
  sha256(from_hex(case when k.doc_id is null then h else coalesce(k.head, '') || substring(h, (2 * k.last + 1)::bigint) end)) as kept_sha256
from d left join t using (doc_id) left join k using (doc_id)""",
    "op10_exact_dedup": r"""
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents)
select doc_id, min(doc_id) over (partition by t) as keep_id, count(*) over (partition by t) as group_size, doc_id = min(doc_id) over (partition by t) as kept, sha256(t) as text_sha256 from t""",
}
