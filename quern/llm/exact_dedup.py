"""Exact deduplication by composable polynomial fingerprints.

A chunk of bytes b_1..b_n has, for each modulus p and base x, the value sum b_i * x^(n-i) mod p.
Chunks combine by length-shifted arithmetic, H(ab) = H(a) * x^|b| + H(b), so chunks of a huge
document are hashed independently, in any task, and combined in any bracketing. Documents of equal
length and fingerprint are then compared chunk by chunk with the row that would stay; rows that
differ from it (a collision) go through another round under other bases.

Texts of up to `huge_bytes` are hashed where they are read; longer ones are cut into chunk rows that
any task hashes, and combine_chunks() brings their fingerprints together. Only rows of groups of two or
more move their text: the others are held back in the scan by a prefilter of fixed size.

Defined results: null text counts as empty and equals it; rows with a null doc_id sort after all
others of their group; of rows that repeat the smallest doc_id in a group exactly one is kept;
extra columns are not read (decisions) or passed through (deduplicate).
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quern.llm._io import release, written
from quern.llm.hot import join_hot
from quern.llm.jaccard_join import _groups
from quern.llm.keyfilter import Prefilter

CHUNK = 1 << 15
MODULI = (2147483647, 2147483629)
BLANKS = re.compile(r"[\x20\x09-\x0D]+")
#: The same class for Java and DuckDB patterns.
BLANKS_SQL = r"[\x20\x09-\x0D]+"
SALT_ROWS = 64
#: Longer texts are fingerprinted in chunks by many tasks.
HUGE = 1 << 16


def normalise(text: str | None) -> bytes:
    return BLANKS.sub(" ", text or "").encode("utf-8", "surrogatepass")


class Fingerprint:
    """The monoid: leaf() of a chunk, combine() of two neighbours; values are (length, hash, hash)."""

    def __init__(self, moduli: tuple[int, int] = MODULI, seed: int = 0):
        rng = np.random.default_rng([seed, 11])
        self.moduli = moduli
        self.bases = [int(rng.integers(2, max(3, p))) % p for p in moduli]
        self.powers = []
        for p, x in zip(moduli, self.bases, strict=True):
            out = np.ones(CHUNK, np.uint64)
            n = 1
            while n < CHUNK:  # doubling: x^(n+i) = x^n * x^i
                out[n : 2 * n] = out[: min(n, CHUNK - n)] * np.uint64(pow(x, n, p)) % np.uint64(p)
                n *= 2
            self.powers.append(out[::-1].copy())

    def leaf(self, chunk) -> tuple[int, int, int]:
        b = np.frombuffer(chunk, np.uint8)
        n = len(b)
        return (n, *(int(np.dot(b.astype(np.uint64), w[CHUNK - n :])) % p if n else 0 for p, w in zip(self.moduli, self.powers, strict=True)))

    def combine(self, a, b) -> tuple[int, int, int]:
        return (a[0] + b[0], *((u * pow(x, b[0], p) + v) % p for u, v, x, p in zip(a[1:], b[1:], self.bases, self.moduli, strict=True)))

    def of(self, data) -> tuple[int, int, int]:
        view, out = memoryview(data), (0, 0, 0)
        for i in range(0, len(view), CHUNK):
            out = self.combine(out, self.leaf(view[i : i + CHUNK]))
        return out


def combine_chunks(chunks: DataFrame, seed: int = 0, moduli: tuple[int, int] = MODULI) -> DataFrame:
    """Fingerprints of documents given as rows (key, chunk_no, data), chunks hashed in parallel.

    Returns key, n_bytes, fp1, fp2. Only 24 bytes a chunk are shuffled; an empty document needs one
    row with empty or null data. The chunks of a key may lie in any partitions; a chunk number given twice counts once.
    """
    f = Fingerprint(moduli, seed)

    def leaves(batches):
        for x in batches:
            n, a, b = zip(*([f.of(d.as_buffer() if d.is_valid else b"") for d in x.column(2)] or [(0, 0, 0)]), strict=True)
            if x.num_rows:
                yield pa.record_batch([x.column(0), x.column(1), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["key", "chunk_no", "n", "a", "b"])

    def join(batches):
        for (key,), t in _groups(batches, ["key"]):
            out, last = (0, 0, 0), None
            for no, *part in zip(*(t[c].to_pylist() for c in ("chunk_no", "n", "a", "b")), strict=True):
                if no != last:
                    out, last = f.combine(out, part), no
            yield pa.record_batch([pa.array([v], pa.int64()) for v in (int(key), *out)], ["key", "n_bytes", "fp1", "fp2"])

    rows = chunks.selectExpr("cast(key as long) key", "cast(chunk_no as long) chunk_no", "data").mapInArrow(leaves, "key long, chunk_no long, n long, a long, b long")
    return rows.repartition("key").sortWithinPartitions("key", "chunk_no").mapInArrow(join, "key long, n_bytes long, fp1 long, fp2 long")


def _normal(text) -> Column:
    """The normalised text as bytes, in the JVM."""
    return F.encode(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS_SQL, " "), "UTF-8")


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text and key, by which a row is found again in another scan."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("key"))


def _fingerprints(docs: DataFrame, moduli, seed: int, huge_bytes: int) -> DataFrame:
    """doc_id, key, n_bytes, fp1, fp2, text_sha256 of the rows of _slim()."""
    f = Fingerprint(moduli, seed)

    def run(batches):
        for x in batches:
            for s in range(0, x.num_rows, 256):  # a few texts at a time are held twice
                part = x.slice(s, 256)
                got = []
                for t in part.column("text"):
                    data = normalise(t.as_py())
                    got.append((*f.of(data), hashlib.sha256(data).hexdigest()))
                n, a, b, sha = zip(*got, strict=True)
                yield pa.record_batch([part.column("doc_id"), part.column("key"), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sha)], names)
        release()

    names = ["doc_id", "key", "n_bytes", "fp1", "fp2", "text_sha256"]
    is_huge = F.coalesce(F.octet_length("text"), F.lit(0)) > huge_bytes
    near = docs.where(~is_huge).mapInArrow(run, "doc_id long, key long, n_bytes long, fp1 long, fp2 long, text_sha256 string")
    huge = docs.where(is_huge).select("doc_id", "key", _normal(F.col("text")).alias("data"))
    chunk = F.transform(F.sequence(F.lit(0), F.floor((F.length("data") - 1) / CHUNK).cast("int")), lambda i: F.struct(i.alias("no"), F.substring("data", i * CHUNK + 1, F.lit(CHUNK)).alias("data")))
    chunks = huge.select("key", F.explode(chunk).alias("c")).select("key", F.col("c.no").alias("chunk_no"), "c.data")
    far = huge.select("doc_id", "key", F.sha2("data", 256).alias("text_sha256")).join(combine_chunks(chunks, seed, moduli), "key")
    return near.unionByName(far)


def _differing(docs: DataFrame, prints: DataFrame, groups: DataFrame) -> DataFrame:
    """(doc_id, key) of rows whose text isn't that of the row that stays, by streaming comparison."""
    on = ["n_bytes", "fp1", "fp2"]
    members = join_hot(prints, groups, on, "group_size", prints.count())
    members = members.groupBy("doc_id", "key", *on).agg(F.max(F.col("row") == F.col("keep_row")).alias("first"), F.first("group_size").alias("group_size"))
    members = written(members, "members")
    near = Prefilter(members.select("key")).maybe(docs, F.col("key"))
    m = members.withColumnsRenamed({"doc_id": "m_id", "key": "m_key"}).hint("merge")
    rows = near.join(m, (F.col("key") == F.col("m_key")) & F.col("doc_id").eqNullSafe(F.col("m_id")))
    salts = F.ceil(F.col("group_size") / SALT_ROWS).cast("int")
    own = F.pmod(F.xxhash64("doc_id", "key", F.lit(1)), salts.cast("long")).cast("int")
    rows = rows.withColumn("salt", F.explode(F.when(F.col("first"), F.sequence(F.lit(0), salts - 1)).otherwise(F.array(own))))

    def compare(batches):
        group = data = None
        for x in batches:
            bad = []
            for i, (g, mine, text) in enumerate(zip(zip(*(x.column(c).to_pylist() for c in (*on, "salt")), strict=True), x.column("first").to_pylist(), x.column("data"), strict=True)):
                if g != group:
                    if not mine:
                        raise RuntimeError("a group came without its first row")
                    group, data = g, text.as_buffer()
                    continue
                here, other = memoryview(data), memoryview(text.as_buffer())  # slices of views aren't copies
                if len(here) != len(other) or any(here[c : c + CHUNK] != other[c : c + CHUNK] for c in range(0, len(here), CHUNK)):
                    bad.append(i)
            if bad:
                yield pa.RecordBatch.from_arrays([x.column(c).take(pa.array(bad)) for c in ("doc_id", "key")], ["doc_id", "key"])

    rows = rows.select(*on, "salt", "first", "doc_id", "key", _normal(F.col("text")).alias("data"))
    return rows.repartition(*on, "salt").sortWithinPartitions(*on, "salt", F.desc("first")).mapInArrow(compare, "doc_id long, key long")


def _decide(slim: DataFrame, moduli, max_rounds: int, huge_bytes: int) -> DataFrame:
    """doc_id, key, keep_id, group_size, kept, text_sha256 of the rows of _slim()."""
    on, todo, done = ["n_bytes", "fp1", "fp2"], slim, []
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")

    def grouped(prints: DataFrame) -> DataFrame:
        best = prints.groupBy(*on).agg(F.min(order).alias("m"), F.count("*").alias("group_size")).where("group_size > 1")
        return written(best.select(*on, F.col("m.doc_id").alias("keep_id"), F.col("m.row").alias("keep_row"), "group_size"), "groups")

    for seed in range(max_rounds):
        prints = written(_fingerprints(todo, moduli if seed == 0 else MODULI, seed, huge_bytes).withColumn("row", F.monotonically_increasing_id()), "prints")
        groups = grouped(prints)
        bad = written(_differing(todo, prints, groups), "collisions")
        again = bool(bad.take(1))
        settled = prints
        if again:
            apart = bad.distinct().withColumnsRenamed({"doc_id": "a_id", "key": "a_key"})
            same = (F.col("key") == F.col("a_key")) & F.col("doc_id").eqNullSafe(F.col("a_id"))
            settled = prints.join(apart, same, "left_anti")
            groups = grouped(settled)
        out = join_hot(settled, groups, on, "group_size", prints.count(), "left")
        alone = F.col("group_size").isNull()
        done.append(out.select(
            "doc_id", "key", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
            (alone | (F.col("row") == F.col("keep_row"))).alias("kept"), "text_sha256",
        ))
        if not again:
            break
        todo = written(todo.join(apart, same, "left_semi"), "apart")
    else:
        raise RuntimeError("fingerprints still collide")
    result = done[0]
    for d in done[1:]:
        result = result.union(d)
    return result


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, moduli: tuple[int, int] = MODULI, max_rounds: int = 50, huge_bytes: int = HUGE) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Fingerprints of all rows are written once (about 100 bytes a row). Only groups of two or more
    move text for the comparison; a large group is salted, with its first row copied to each salt.
    """
    return _decide(_slim(docs, id_col, text_col), moduli, max_rounds, huge_bytes).drop("key")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns. Of rows that repeat both id and text any one stays.

    Rows that nothing equals are passed on by the scan; only possible copies are shuffled.
    """
    made = _decide(_slim(docs, id_col, text_col), MODULI, 50, HUGE)
    touched = made.groupBy("doc_id", "key").agg(F.sum(F.col("kept").cast("long")).alias("__stay"), F.count("*").alias("n")).where("n > __stay")
    touched = written(touched.select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), "__stay"), "touched")
    key = F.xxhash64(docs[id_col].cast("long"), docs[text_col])
    near = Prefilter(touched.select("__key"))
    doubtful = near.maybe(docs, key).join(touched.hint("merge"), (key == F.col("__key")) & docs[id_col].cast("long").eqNullSafe(F.col("__id")), "left")
    one = Window.partitionBy("__id", "__key").orderBy(F.lit(1))
    single = doubtful.where("__stay = 1").withColumn("__n", F.row_number().over(one)).where("__n = 1")
    return near.never(docs, key).union(doubtful.where("__stay is null").select(*docs.columns)).union(single.select(*docs.columns))
