"""Two-pass external shuffle into shards.

Pass one scatters rows uniformly into memory-sized buckets by a seeded hash of the row; each bucket is a
partition of its own. Pass two takes a bucket into memory, puts it into an order that doesn't depend on
arrival, runs a seeded Fisher-Yates shuffle over it and writes it to the shards. The row at global position p
(buckets in turn) goes to shard p mod n, slot p div n, so the counts of shards differ by one at most (law
`rows`) and slots have no gaps. Seed and rows alone decide: other files or partitions give the same order.

Defined results: null text has size 1 and the crc32 of an empty text; rows with null or repeated
doc_id are placed like others (the hash takes all columns in, but for maps, which have none); rows that
are equal throughout are interchangeable; an empty table gives no rows; extra columns are carried into
the written shards, but for those named in OWN, which are replaced.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from quern.llm._io import work_dir

#: More buckets are never made, so their offsets (16 bytes each) can be broadcast; from 48 TB on buckets grow beyond bucket_bytes.
MOST_BUCKETS = 1_000_000
#: Columns that the operator makes.
OWN = ("__size", "__crc32", "slot", "shard", "__order", "__bucket", "__before")


def fisher_yates(n: int, seed: int) -> np.ndarray:
    """A seeded permutation of range(n); numpy's shuffle swaps from the end as Fisher and Yates do."""
    p = np.arange(n)
    np.random.default_rng(seed).shuffle(p)
    return p


def write_shards(docs: DataFrame, text_col: str = "text", *, n_shards: int = 16, seed: int = 42, bucket_bytes: int = 48 << 20) -> str:
    """Write the rows of docs with __size, __crc32 and slot into folders shard=0 to shard=n-1; returns the folder's URI.

    A file holds the rows that one bucket gives to one shard, by ascending slot.
    """
    docs = docs.drop(*OWN)
    wide = [f.name for f in docs.schema.fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    weight = sum((F.coalesce(F.octet_length(docs[c]), F.lit(0)) for c in wide), F.lit(200))
    total = docs.agg(F.sum(weight)).first()[0] or 0
    buckets = min(max(1, -(-total // bucket_bytes)), MOST_BUCKETS)
    hashed = [docs[f.name] for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    order = F.xxhash64(F.lit(seed), *hashed)
    counts = docs.select(F.pmod(order, F.lit(buckets)).cast("int").alias("__bucket")).groupBy("__bucket").agg(F.count("*").alias("n"))
    before = counts.select(F.col("__bucket").alias("__b"), (F.sum("n").over(Window.orderBy("__bucket")) - F.col("n")).alias("__before"))  # a row for each bucket
    placed = docs.withColumn("__order", order).withColumn("__bucket", F.pmod("__order", F.lit(buckets)).cast("int"))
    placed = placed.join(F.broadcast(before), F.col("__bucket") == F.col("__b")).drop("__b")
    scattered = placed.repartitionById(buckets, F.col("__bucket")).sortWithinPartitions("__bucket", "__order", F.xxhash64(F.lit(seed + 1), *hashed))
    keep = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("__size", T.LongType()), T.StructField("__crc32", T.LongType()), T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    out = list(to_arrow_schema(schema))

    def emit(bucket: int, parts: list):
        table = pa.Table.from_batches(parts)
        at = table.column("__before")[0].as_py() + np.arange(table.num_rows)
        table = table.take(pa.array(fisher_yates(table.num_rows, seed * 1_000_003 + bucket)))
        turn = np.lexsort((at, at % n_shards))  # shard after shard, so that the writer has one file open
        for s in range(0, len(turn), 2000):
            part, pos = table.take(pa.array(turn[s : s + 2000])), at[turn[s : s + 2000]]
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(text_col).to_pylist()]
            cols = [pa.concat_arrays(part.column(c).chunks) for c in keep]
            cols += [pa.array([len(t) + 1 for t in texts], pa.int64()), pa.array([zlib.crc32(t) for t in texts], pa.int64()), pa.array(pos // n_shards), pa.array((pos % n_shards).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, out, strict=True)], schema=pa.schema(out))

    def second_pass(batches):
        held, now = [], None
        for x in batches:
            ids = np.asarray(x.column("__bucket"))
            for b in np.unique(ids):
                at = np.flatnonzero(ids == b)
                if held and b != now:
                    yield from emit(now, held)
                    held = []
                now = int(b)
                held.append(x.slice(int(at[0]), len(at)))
        if held:
            yield from emit(now, held)

    path = work_dir(docs.sparkSession, "shards")
    scattered.mapInArrow(second_pass, schema).write.partitionBy("shard").parquet(path)
    return path


def read_shards(spark: SparkSession, path: str, columns: T.StructType) -> DataFrame:
    """The rows of written shards: columns (of the table that was written), __size, __crc32, slot and shard."""
    schema = T.StructType([*(f for f in columns.fields if f.name not in OWN), T.StructField("__size", T.LongType()), T.StructField("__crc32", T.LongType()), T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])
    return spark.read.schema(schema).parquet(path)


def shuffle_to_shards(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs with __size, __crc32, slot and shard, read back from the written shards."""
    return read_shards(docs.sparkSession, write_shards(docs, text_col, **options), docs.schema)
