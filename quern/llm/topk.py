"""Exact top-k inner products by aggregation without random access, in rounds.

Each dimension of a block of candidates is a sorted list, read from its top for a positive query
component and from its bottom for a negative one. A round reads all lists on to twice the depth and adds
what it reads to the known part of each candidate's score. The unread parts give a lower bound (the far end
of each list) and an upper bound (the last value read from it). A query stops once all but a few candidates have an
upper bound under the k-th best lower bound, and the scores of these few are resolved; a query that
never gets there reads its lists to their ends, where both bounds are the score. Candidates that can't
qualify for any query of a batch are read no further. Ties at the bound are never cut.

Defined results: vectors that are null, empty, or hold null or non-finite components take no part,
nor do rows with a null vec_id; only vectors of equal length are compared; rows that repeat a vec_id
are separate candidates, none of them for a query of that id, and a repeated query id is answered
once for each of its different vectors, its rows merged to one list; ties go to the smaller vec_id; components
are whole numbers of any size; a score beyond the long type counts as the nearest long.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

FIRST_DEPTH = 64
LONG = (-(2**63), 2**63 - 1)


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) exactly: int64 where all fit into 53 bits, else Python's integers."""
    small = np.abs(x) < 2**53 / scale
    if small.all():
        return np.floor(scale * x).astype(np.int64)
    out = np.empty(x.shape, object)
    flat = out.reshape(-1)
    for i, v in enumerate(x.reshape(-1).tolist()):
        n, d = v.as_integer_ratio()
        flat[i] = scale * n // d
    return out


class Lists:
    """The sorted lists of a block: values, and each value's place in its list from the top."""

    def __init__(self, v: np.ndarray):
        self.v = v
        order = np.argsort(-v, axis=0, kind="stable")
        self.place = np.empty(v.shape, np.int32)
        np.put_along_axis(self.place, order, np.arange(len(v), dtype=np.int32)[:, None], 0)
        self.sorted = np.take_along_axis(v, order, 0)
        self.bound = max(1, int(abs(v.max())), int(abs(v.min())))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= cut)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def block_top_k(lists: Lists, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, k: int, first_depth: int = FIRST_DEPTH) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each query (candidate indices, scores) of its k best in the block, and the depth to which it read the lists."""
    n = len(lists.v)
    most = lists.bound * max(1, int(np.abs(q).max(initial=0))) * q.shape[1]
    kind = np.float32 if most < 2**24 else np.float64  # sums are exact in either
    if most >= 2**53:  # scores that only Python's integers hold: the lists are read to their ends at once
        out = []
        for x, own in zip(q, q_ids, strict=True):
            at = np.flatnonzero(ids != own)
            s = np.array([min(max(int(y), LONG[0]), LONG[1]) for y in lists.v[at].astype(object) @ x.astype(object)], np.int64)
            b = np.array(sorted(range(len(at)), key=lambda i: (-int(s[i]), int(ids[at[i]])))[:k], np.int64)
            out.append((at[b], s[b]))
        return out, np.full(len(q), n)
    want = min(n, k + int(np.unique(ids, return_counts=True)[1].max(initial=1)))  # a query's own rows may be among them
    cols, v, place = np.arange(n), lists.v.astype(kind), lists.place
    open_, out, read = np.arange(len(q)), [None] * len(q), np.full(len(q), n)
    up_q, down_q = np.maximum(q, 0).astype(kind), np.minimum(q, 0).astype(kind)
    known = np.zeros((len(q), n), kind)
    ends = lists.sorted[n - 1].astype(kind), lists.sorted[0].astype(kind)
    done, depth = 0, min(n, max(first_depth, want))
    while True:
        from_top, from_bottom = place, n - 1 - place
        known += up_q @ np.where((from_top >= done) & (from_top < depth), v, 0).astype(kind).T + down_q @ np.where((from_bottom >= done) & (from_bottom < depth), v, 0).astype(kind).T
        far_top, far_bottom = (from_top >= depth).astype(kind).T, (from_bottom >= depth).astype(kind).T
        fronts = lists.sorted[depth - 1].astype(kind), lists.sorted[n - depth].astype(kind)
        high = known + (up_q * fronts[0]) @ far_top + (down_q * fronts[1]) @ far_bottom
        low = known + (up_q * ends[0]) @ far_top + (down_q * ends[1]) @ far_bottom
        rank = len(cols) - want
        floor = np.partition(low, rank, axis=1)[:, rank]
        can = high >= floor[:, None]
        ends_now = (can.sum(1) <= 2 * want) | (depth == n)
        for i in np.flatnonzero(ends_now):
            at = cols[can[i]]
            at = at[ids[at] != q_ids[open_[i]]]
            s = lists.v[at].astype(np.int64) @ q[open_[i]].astype(np.int64)
            b = _best(s, ids[at], k)
            out[open_[i]], read[open_[i]] = (at[b], s[b]), depth
        if ends_now.all():
            return out, read
        left = np.flatnonzero(~ends_now)
        alive = np.flatnonzero(can[left].any(0))
        open_, up_q, down_q, known = open_[left], up_q[left], down_q[left], known[np.ix_(left, alive)]
        cols, v, place = cols[alive], v[alive], place[alive]
        done, depth = depth, min(n, 2 * depth)


def top_k(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 20, every: int = 20, scale: int = 64, block_rows: int = 8192) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each row whose id is divisible by `every`, against all other rows.

    Candidates lie in blocks of about block_rows by a hash of the id; each block gets the queries as
    a stream after its own rows, so a task holds one block. Blocks return k rows a query at most.
    """
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    finite = F.forall(F.col(vector_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & (F.size(vector_col) > 0)).where(finite).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), F.size(vector_col).alias("dim"))
    blocks = max(1, -(-rows.count() // block_rows))
    mine = rows.select("dim", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "v")
    ask = rows.where(F.col("id") % every == 0).select("dim", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "id", "v")

    def search(batches):
        names, key, held, lists, ids = ["query_id", "vec_id", "score"], None, [], None, None
        for x in batches:
            keys = list(zip(x.column("dim").to_pylist(), x.column("block").to_pylist(), x.column("kind").to_pylist(), strict=True))
            at = 0
            while at < len(keys):
                end = at
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                part = x.slice(at, end - at)
                m = whole(np.asarray(part.column("v").flatten(), np.float64).reshape(end - at, keys[at][0]), scale)
                p_ids = np.asarray(part.column("id"))
                if keys[at][:2] != key:
                    key, held, lists = keys[at][:2], [], None
                if keys[at][2] == 0:
                    held.append((p_ids, m))
                elif held:
                    if lists is None:
                        ids, all_v = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                        lists = Lists(all_v)
                    for s in range(0, len(m), 256):
                        got, _ = block_top_k(lists, ids, m[s : s + 256], p_ids[s : s + 256], k)
                        q = np.concatenate([np.full(len(g[0]), p_ids[s + i]) for i, g in enumerate(got)]).astype(np.int64)
                        yield pa.record_batch([pa.array(q), pa.array(np.concatenate([ids[g[0]] for g in got]).astype(np.int64)), pa.array(np.concatenate([g[1] for g in got]).astype(np.int64))], names)
                at = end

    found = mine.union(ask).repartition("dim", "block").sortWithinPartitions("dim", "block", "kind").mapInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
