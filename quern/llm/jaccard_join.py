"""N-gram Jaccard join with Bayesian candidate pruning.

1. Every document becomes a set of five-word shingles with MinHash values; documents of one set
   form a class with one representative, so copies are never expanded.
2. Bands of MinHash values place representatives into buckets. In a bucket, pairs that are not yet
   connected are compared some MinHash values at a time; a pair goes as soon as the posterior
   probability (uniform prior) that its similarity reaches the threshold is below the tolerance.
   The rest connect clusters: one edge for each member at most, however large the bucket.
3. Members of clusters are read again and cut into shingles once; the other documents stay in the scan. Inside a
   cluster, cut into blocks of bounded rows and shingles, each pair runs through the same pruning and the
   survivors are verified exactly on their shingle sets, which travel packed. Only sums of links and a
   spanning forest leave a task.

Defined results: rows with a null doc_id give class_id null and n_links 0 (unless doc_id is null
they take part); null, empty and blank texts have no shingles, link to nothing, and are their own
class; texts under five words are one shingle; rows repeating a doc_id count as separate documents,
and one whose text differs is grouped with its own text. Extra columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quern.llm import shingles as sh
from quern.llm._io import release, written
from quern.llm.components import connected_components
from quern.llm.hot import join_hot
from quern.llm.keyfilter import Prefilter

STEP = 8


def least_matches(n_hashes: int, threshold: float, tolerance: float) -> dict[int, int]:
    """For each number n of compared values, the fewest matches that keep a pair alive.

    With a uniform prior the posterior is Beta(m+1, n-m+1), whose upper tail at t is the
    probability that Binomial(n+1, t) is at most m.
    """
    out = {}
    for n in range(STEP, n_hashes + 1, STEP):
        tail, m = 0.0, -1
        while tail < tolerance:
            m += 1
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def survivors(one: np.ndarray, many: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Indices of many that the incremental comparison with one does not drop."""
    alive, hits = np.arange(len(many)), np.zeros(len(many), np.int32)
    for n, m in least.items():
        hits += (many[alive, n - STEP : n] == one[n - STEP : n]).sum(1, dtype=np.int32)
        ok = hits >= m
        if not ok.all():
            alive, hits = alive[ok], hits[ok]
            if not len(alive):
                break
    return alive


def _groups(batches, keys: list[str]):
    """Column dicts of the runs of equal keys in a stream of sorted Arrow batches."""
    kept, last = [], None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [np.asarray(b.column(k)) for k in keys]
        cut = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        for s, e in zip([0, *cut], [*cut, b.num_rows], strict=True):
            k = tuple(c[s] for c in cols)
            if kept and k != last:
                yield last, pa.Table.from_batches(kept)
                kept = []
            kept.append(b.slice(s, e - s))
            last = k
    if kept:
        yield last, pa.Table.from_batches(kept)


def _matrix(col) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint32).reshape(len(col), -1)


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def _bucket_edges(reps: np.ndarray, sig: np.ndarray, least) -> list[tuple[int, int]]:
    """Edges from the least node of each group of the bucket's nodes that surviving pairs connect to its others."""
    label = np.arange(len(reps))
    for i in range(len(reps) - 1):
        rest = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        if not len(rest):
            continue
        for j in rest[survivors(sig[i], sig[rest], least)]:
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
    return _stars(reps, label)


def _stars(nodes: np.ndarray, label: np.ndarray) -> list[tuple[int, int]]:
    order = np.lexsort((nodes, label))
    first = np.concatenate([[True], label[order][1:] != label[order][:-1]]) if len(order) else np.empty(0, bool)
    low = nodes[order][first][np.cumsum(first) - 1]
    return list(zip(low[~first].tolist(), nodes[order][~first].tolist(), strict=True))


def _verify(nodes, mult, left, right, sig, packed, threshold, least):
    """Links between left and right rows of a block pair: (nodes, links of each, forest edges)."""
    _, rows = np.unique(nodes, return_index=True)  # a row that repeats id and text comes more than once
    nodes, mult, left, right, sig = nodes[rows], mult[rows], left[rows], right[rows], sig[rows]
    sets = [np.frombuffer(packed[i].as_buffer(), np.uint64) for i in rows.tolist()]
    sizes = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else np.empty(0, np.int64)
    at = np.concatenate([[0], np.cumsum(sizes)])
    seen = np.zeros(int(codes.max()) + 1 if len(codes) else 0, bool)
    links, parent = np.zeros(len(nodes), np.int64), list(range(len(nodes)))
    for i in range(len(nodes)):
        other = np.flatnonzero(right & (np.arange(len(nodes)) > i) if left[i] and right[i] else (right if left[i] else np.zeros(len(nodes), bool)))
        if not len(other):
            continue
        other = other[survivors(sig[i], sig[other], least)]
        if not len(other):
            continue
        seen[codes[at[i] : at[i + 1]]] = True
        flat = np.concatenate([codes[at[j] : at[j + 1]] for j in other])
        common = np.add.reduceat(seen[flat].astype(np.int64), np.concatenate([[0], np.cumsum(sizes[other])[:-1]]))
        seen[codes[at[i] : at[i + 1]]] = False
        near = other[common >= threshold * (sizes[i] + sizes[other] - common) - 1e-9]
        links[i] += mult[near].sum()
        links[near] += mult[i]
        for j in near:
            a, b = _root(parent, i), _root(parent, int(j))
            if a != b:
                parent[a] = b
    return nodes, links, _stars(nodes, np.array([_root(parent, i) for i in range(len(nodes))], np.int64))


def jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, k: int = 5, threshold: float = 0.8,
    bands: int = 24, rows: int = 4, tolerance: float = 1e-6, bucket_rows: int = 4096, block_rows: int = 512, block_shingles: int = 1 << 18,
) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its group), n_links (other documents at the threshold), text_key (hash of the text).

    A pair at the threshold of 0.8 shares no band with probability (1 - 0.8^4)^24 = 3e-6.
    """
    a, b = sh.coefficients(bands * rows)
    least = least_matches(bands * rows, threshold, tolerance)

    def sign(batches):
        for x in batches:
            for s in range(0, x.num_rows, 256):  # the sets of a few texts at a time
                part = x.slice(s, 256)
                sets = [sh.shingle_set(t.as_py(), k) for t in part.column("text")]
                digests = pa.array([sh.set_digest(v) if len(v) else None for v in sets], pa.binary())
                sigs = pa.array([sh.minhash(v, a, b).tobytes() if len(v) else None for v in sets], pa.binary())
                yield pa.record_batch([part.column("doc_id"), part.column("text_key"), digests, sigs, pa.array([len(v) for v in sets], pa.int32())], ["doc_id", "text_key", "digest", "sig", "n"])
        release()

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    signed = written(slim.mapInArrow(sign, "doc_id long, text_key long, digest binary, sig binary, n int"), "signed")
    first = F.min(F.struct("doc_id", "text_key")).alias("first")
    reps = signed.where("doc_id is not null and digest is not null").groupBy("digest").agg(first, F.count("*").alias("mult"), F.first("sig").alias("sig"), F.first("n").alias("size"))
    # representatives are smallest ids; a repeated doc_id can represent two texts, so nodes are numbered by text
    reps = written(reps.select("digest", F.col("first.doc_id").alias("rep"), F.col("first.text_key").alias("rep_key"), "mult", "sig", "size"), "reps").withColumn("node", F.xxhash64("rep", "digest"))

    keys = reps.select("node", F.explode(F.expr(f"transform(sequence(0, {bands - 1}), b -> xxhash64(b, substring(sig, b * {4 * rows} + 1, {4 * rows})))")).alias("key"))
    crowded = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / bucket_rows).cast("int")
    mine = F.pmod(F.col("node"), parts.cast("long")).cast("int")
    placed = keys.join(crowded, "key").join(reps.select("node", "sig"), "node").withColumn("mine", mine).withColumn("theirs", F.explode(F.sequence(F.lit(0), parts - 1)))
    placed = placed.select("key", F.least("mine", "theirs").alias("x"), F.greatest("mine", "theirs").alias("y"), "node", "sig")

    def connect(batches):
        out: list[tuple[int, int]] = []
        for _, t in _groups(batches, ["key", "x", "y"]):
            out += _bucket_edges(np.asarray(t["node"]), _matrix(t["sig"]), least)
            if len(out) > 50_000:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["u", "v"])
                out = []
        if out:
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["u", "v"])

    edges = placed.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(connect, "u long, v long")
    cluster = written(connected_components(edges), "clusters")
    members = cluster.join(reps, "node")
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum("size") / block_shingles)).cast("int").alias("nb"))
    wanted = members.join(sizes, "root").select("root", "node", "rep", "rep_key", "mult", "sig", "nb", F.pmod(F.xxhash64("node"), F.col("nb").cast("long")).cast("int").alias("mine"))
    wanted = written(wanted, "wanted")
    near = Prefilter(wanted.select(F.xxhash64("rep", "rep_key").alias("key")))
    texts = near.maybe(slim, F.xxhash64("doc_id", "text_key")).join(wanted.hint("merge"), (F.col("doc_id") == F.col("rep")) & (F.col("text_key") == F.col("rep_key")))

    def shingle(batches):
        keep = ["root", "node", "mult", "nb", "mine", "sig"]
        for x in batches:
            for s in range(0, x.num_rows, 256):
                part = x.slice(s, 256)
                packed = pa.array([sh.shingle_set(t.as_py(), k).tobytes() for t in part.column("text")], pa.binary())
                yield pa.record_batch([*(part.column(c) for c in keep), packed], [*keep, "shingles"])
        release()

    sets = texts.select("root", "node", "mult", "nb", "mine", "sig", "text").mapInArrow(shingle, "root long, node long, mult long, nb int, mine int, sig binary, shingles binary")
    blocks = sets.withColumn("theirs", F.explode(F.expr("sequence(0, nb - 1)")))
    blocks = blocks.select("root", F.least("mine", "theirs").alias("x"), F.greatest("mine", "theirs").alias("y"), "mine", "node", "mult", "sig", "shingles")

    def verify(batches):
        for (_, x, y), t in _groups(batches, ["root", "x", "y"]):
            mine = np.asarray(t["mine"])
            r, links, es = _verify(np.asarray(t["node"]), np.asarray(t["mult"]), mine == x, mine == y, _matrix(t["sig"]), t["shingles"].combine_chunks(), threshold, least)
            some = links > 0
            u = np.concatenate([r[some], [e[0] for e in es]]).astype(np.int64)
            yield pa.record_batch([pa.array(u), pa.array([None] * int(some.sum()) + [e[1] for e in es], pa.int64()), pa.array([*links[some].tolist(), *[0] * len(es)], pa.int64())], ["u", "v", "links"])

    checked = written(blocks.repartition("root", "x", "y").sortWithinPartitions("root", "x", "y").mapInArrow(verify, "u long, v long, links long"), "checked")
    linked = checked.where("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("links").alias("links"))
    groups = connected_components(checked.where("v is not null").select("u", "v"))
    found = groups.join(reps.select("node", "rep"), "node")
    first = found.groupBy("root").agg(F.min("rep").alias("class_id"))
    final = reps.select("node", "digest", "rep", "mult").join(found.select("node", "root").join(first, "root").select("node", "class_id"), "node", "left").join(linked, "node", "left")
    final = final.select("digest", "mult", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    some = F.col("doc_id").isNotNull() & F.col("digest").isNotNull()
    none = signed.where(~some).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), "text_key")
    out = join_hot(signed.where(some), final, ["digest"], "mult", signed.count())
    return out.select("doc_id", "class_id", F.col("n_links").cast("long").alias("n_links"), "text_key").union(none)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that are alone or first of their near-duplicate group; rows with a null id stay.

    Rows are told apart by doc_id and text. Rows that repeat both share their fate. Only rows that may go are shuffled.
    """
    gone = jaccard_join(docs, id_col, text_col, **options).where("class_id <> doc_id").select(F.col("doc_id").alias("__gone"), F.col("text_key").alias("__key")).distinct()
    gone = written(gone, "gone")
    near = Prefilter(gone.select(F.xxhash64("__gone", "__key").alias("key")))
    key = F.xxhash64(docs[id_col].cast("long"), F.xxhash64(docs[text_col]))
    same = (docs[id_col].cast("long") == F.col("__gone")) & (F.xxhash64(docs[text_col]) == F.col("__key"))
    return near.never(docs, key).union(near.maybe(docs, key).join(gone.hint("merge"), same, "left_anti"))
