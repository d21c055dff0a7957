"""Removal of repeated byte strings by suffix sorting, distributed over content-defined buckets.

A start p belongs to the bucket of the smallest 64-gram hash (leftmost on ties) of the strings that
begin in the `width` bytes from p. Equal strings of that width have the same bucket and the same
offset in it, so a bucket sees every repeat of its starts. Buckets with one run of starts hold no
repeat; equal runs (same bucket, same bytes) are repeats as a whole and one of them stands for all;
only differing runs of one bucket are suffix-sorted, by the difference-cover algorithm to the depth
`width`, and neighbours in that order are compared. That bounds the text to sort to the seams
of repeated passages, and no task needs the corpus.

Runs that are equal within a batch of documents are counted there, before the shuffle, and one of them is
dealt to its bucket; so a line that a third of all documents share brings a bucket one row for each batch.

Defined results: null text is empty; strings never cross documents; rows that repeat a doc_id count
as separate documents; the last bytes that start no full string are removed only if a repeated
string covers them. Extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from quern.llm._io import written
from quern.llm.suffix_array import suffix_array

GRAM = 64
PIECE = 1 << 23
BATCH = 1 << 20
#: Distinct runs of one bucket beyond which its starts are dealt out one by one.
CROWD = 2000
_rng = np.random.default_rng(99)
_TABLE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_STEPS = [np.uint64(int(x) | 1) for x in _rng.integers(0, 2**64, 6, dtype=np.uint64)]


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 64 bytes from each position, by doubling the covered length."""
    h = _TABLE[b]
    for i, c in enumerate(_STEPS):
        h = h[: -(1 << i)] * c + h[1 << i :]
    return h ^ (h >> np.uint64(31))


def runs(b: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, first start, last start) of the runs of starts of b that share a smallest 64-gram."""
    bucket, lo, hi = [], [], []
    for base in range(0, max(len(b) - width + 1, 0), PIECE):
        h = gram_hashes(b[base : base + PIECE + width - 1])
        span = width - GRAM + 1
        m = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while 2 * size <= span:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        if span > size:
            m = np.minimum(m[: size - span], m[span - size :])
        a = (m & np.uint64(0xFFFFFF)).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
        bucket.append(h[a[start]].view(np.int64))
        lo.append(start + base)
        hi.append(np.concatenate([start[1:], [len(a)]]) - 1 + base)
    none = np.empty(0, np.int64)
    return tuple(np.concatenate(x) if x else none for x in (bucket, lo, hi))


def repeated_starts(segments: list[bytes], width: int) -> list[tuple[int, int, int]]:
    """(segment, first, last): the starts in segments whose string of that width also starts elsewhere in them."""
    sizes = np.array([len(s) for s in segments])
    n = len(segments)
    text = np.empty(int(sizes.sum()) + n, np.int64)
    ends = np.cumsum(sizes + 1)
    data = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8)
    text[:] = data
    text += n + 1
    text[ends - 1] = np.arange(1, n + 1)  # separators differ, so nothing matches across them
    order = suffix_array(text, width)
    owner = np.repeat(np.arange(n), sizes + 1)
    full = np.arange(len(text)) + width < ends[owner]
    order = order[full[order]]
    same = np.zeros(len(order) + 1, bool)
    for i in range(0, len(order) - 1, 1 << 16):
        left, right = order[i : i + (1 << 16)][: len(order) - 1 - i], order[i + 1 : i + 1 + (1 << 16)]
        eq = np.ones(len(right), bool)
        for off in range(0, width, 8):  # eight bytes at a time, only for those still equal
            at = np.flatnonzero(eq)
            if not len(at):
                break
            step = np.arange(off, min(off + 8, width))
            eq[at] = (data[left[at, None] + step] == data[right[at, None] + step]).all(1)
        same[i + 1 : i + 1 + len(eq)] = eq
    hit = np.zeros(len(text) + 1, bool)
    hit[order[same[:-1] | same[1:]]] = True
    cut = np.flatnonzero(hit[1:] != hit[:-1]) + 1 if not hit[0] else np.concatenate([[0], np.flatnonzero(hit[1:] != hit[:-1]) + 1])
    first, last = cut[::2], cut[1::2] - 1
    begin = ends - sizes - 1
    out = []
    for f, e in zip(first.tolist(), last.tolist(), strict=True):
        s = int(owner[f])
        out.append((s, f - int(begin[s]), e - int(begin[s])))
    return out


def _record(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, width: int = 200) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes left)."""
    key = ["doc_id", "text_key"]
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_key", F.xxhash64("doc_id", "text"))

    def scan(batches):
        for x in batches:
            ids, keys, texts = (x.column(c) for c in ("doc_id", "text_key", "text"))
            rows, out = [], [[], [], [], []]
            for i, t in enumerate(texts):
                b = t.as_buffer() if t.is_valid else b""
                if len(b) < width:
                    continue
                bucket, lo, hi = runs(np.frombuffer(b, np.uint8), width)
                view = memoryview(b)
                out[0].append(bucket)
                out[1].append(np.array([xxhash.xxh3_64_intdigest(view[s : e + width]) for s, e in zip(lo.tolist(), hi.tolist(), strict=True)], np.uint64).view(np.int64))
                out[2].append(lo)
                out[3].append((hi - lo + 1).astype(np.int32))
                rows.append(np.full(len(lo), i))
            if rows:
                at = np.concatenate(rows)
                bucket, digest, lo, n = (np.concatenate(c) for c in out)
                # the first of equal runs of a batch stands for the others, which are repeats whatever else there is
                order = np.lexsort((digest, bucket))
                new = np.concatenate([[True], (bucket[order][1:] != bucket[order][:-1]) | (digest[order][1:] != digest[order][:-1])])
                first = np.flatnonzero(new)
                copies = np.zeros(len(at), np.int32)
                copies[order[first]] = np.diff(np.concatenate([first, [len(at)]]))
                for s in range(0, len(at), 100_000):
                    p = pa.array(at[s : s + 100_000])
                    yield pa.record_batch([ids.take(p), keys.take(p), *(pa.array(c[s : s + 100_000]) for c in (bucket, digest, lo, n, copies))], [*key, "bucket", "digest", "lo", "n", "copies"])

    seen = written(slim.mapInArrow(scan, "doc_id long, text_key long, bucket long, digest long, lo long, n int, copies int"), "seen")
    by_bucket, by_run = Window.partitionBy("bucket"), Window.partitionBy("bucket", "digest")
    found = seen.where("copies > 0").withColumn("in_run", F.sum("copies").over(by_run)).withColumn("nth", F.row_number().over(by_run.orderBy(*key, "lo")))
    found = found.withColumn("in_bucket", F.sum("copies").over(by_bucket)).where("in_bucket > 1")
    found = written(found.withColumn("kinds", F.sum(F.when(F.col("nth") == 1, 1).otherwise(0)).over(by_bucket)), "runs")

    asked = found.where("nth = 1 and kinds > 1").groupBy(*key).agg(F.collect_list(F.struct("bucket", "digest", "lo", "n", "kinds")).alias("asked"))

    def cut(batches):
        kinds, names = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()], ["home", "bucket", "digest", "off", "data"]
        last = None
        for x in batches:
            rows = []
            for i, k, t, asked in zip(*(x.column(c).to_pylist() for c in key), x.column("text"), x.column("asked").to_pylist(), strict=True):
                if (i, k) == last:  # a repeated row
                    continue
                last = (i, k)
                view, seen = memoryview(t.as_buffer()), set()
                for a in asked:
                    if (a["bucket"], a["digest"]) in seen:
                        continue
                    seen.add((a["bucket"], a["digest"]))
                    if a["kinds"] <= CROWD:
                        rows.append((a["bucket"], a["bucket"], a["digest"], 0, bytes(view[a["lo"] : a["lo"] + a["n"] - 1 + width])))
                    else:
                        for off in range(a["n"]):
                            w = bytes(view[a["lo"] + off : a["lo"] + off + width])
                            rows.append((xxhash.xxh3_64_intdigest(w) - 2**63, a["bucket"], a["digest"], off, w))
                if len(rows) > 20_000:
                    yield _record(rows, kinds, names)
                    rows = []
            if rows:
                yield _record(rows, kinds, names)

    def sort(batches):
        kinds, names = [pa.int64(), pa.int64(), pa.int64(), pa.int64()], ["bucket", "digest", "a", "b"]
        rows, total, home, last = [], 0, None, None  # rows are of whole homes
        group, held, first, least = [], 0, {}, 0  # of the home being read: all rows, and one of each string

        def flush(rows):
            got = repeated_starts([r[4] for r in rows], width)
            return _record([(rows[s][1], rows[s][2], rows[s][3] + a, rows[s][3] + b) for s, a, b in got], kinds, names)

        for x in batches:
            for r in zip(*(x.column(c).to_pylist() for c in ("home", "bucket", "digest", "off", "data")), strict=True):
                if r[:4] == last:  # from a repeated row
                    continue
                last = r[:4]
                if r[0] != home:
                    rows += group
                    total += held
                    home, group, held, first, least = r[0], [], 0, {}, 0
                n = len(r[4]) + 1
                if rows and total + held + n > BATCH:
                    yield flush(rows)
                    rows, total = [], 0
                if held + n > BATCH and 2 * least <= BATCH:  # one of each string stands for a home that goes on; differing runs, CROWD at most, stay together
                    yield flush(group)
                    group, held = list(first.values()), least
                group.append(r)
                held += n
                if r[4] not in first:
                    first[r[4]] = r
                    least += n
        if rows or group:
            yield flush(rows + group)

    texts = slim.join(asked.withColumnsRenamed({"doc_id": "d", "text_key": "t"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")))
    pieces = texts.select(*key, "text", "asked").mapInArrow(cut, "home long, bucket long, digest long, off int, data binary")
    sorted_out = written(pieces.repartition("home").sortWithinPartitions("home", "bucket", "digest", "off").mapInArrow(sort, "bucket long, digest long, a long, b long").distinct(), "repeats")

    repeated = found.where("in_run > 1").select(*key, "lo", "n").union(seen.where("copies = 0").select(*key, "lo", "n"))
    whole = repeated.select(*key, F.col("lo").alias("s"), (F.col("lo") + F.col("n") - 1 + width).alias("e"))
    partly = found.where("in_run = 1").join(sorted_out, ["bucket", "digest"]).select(*key, (F.col("lo") + F.col("a")).alias("s"), (F.col("lo") + F.col("b") + width).alias("e"))
    spans = written(whole.union(partly).groupBy(*key).agg(F.collect_list(F.struct("s", "e")).alias("spans")).withColumnsRenamed({"doc_id": "d", "text_key": "t"}), "spans")

    def finish(batches):
        for x in batches:
            rows = []
            for i, t, spans in zip(x.column("doc_id").to_pylist(), x.column("text"), x.column("spans"), strict=True):
                view = memoryview(t.as_buffer() if t.is_valid else b"")
                kept, n, last, gone = [], 0, 0, 0
                if spans.is_valid:
                    s, e = (np.asarray(spans.values.field(c)) for c in ("s", "e"))
                    o = np.argsort(s, kind="stable")
                    s, e = s[o], np.maximum.accumulate(e[o])
                    new = np.concatenate([[True], s[1:] > e[:-1]])
                    for a, b in zip(s[new].tolist(), e[np.concatenate([new[1:], [True]])].tolist(), strict=True):
                        kept.append(view[last:a])
                        last, n, gone = b, n + 1, gone + b - a
                kept.append(view[last:])
                left = b"".join(kept)
                rows.append((i, len(view), gone, n, hashlib.sha256(left).hexdigest(), left))
            yield _record(rows, [pa.int64()] * 4 + [pa.string(), pa.binary()], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = slim.join(spans, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("t")), "left")
    return out.select("doc_id", "text", "spans").mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
