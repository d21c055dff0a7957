"""Conflict-constrained best-fit packing of token ids into sequences.

Texts become token ids with an end id after each, and are cut into pieces of the bin's capacity; the pieces
of a group of neighbouring rows are packed longest first. Bins are ordered by residual capacity; each
carries a bitmap of its sources and one of its duplicate clusters (texts equal up to blanks and case, or a
given column, such as the class_id of the n-gram Jaccard join). The successor search starts at the smallest
residual that holds the piece and goes on to larger ones until it meets a bin whose bitmaps hold neither the
piece's cluster nor, more than `per_source` times, its source: the tightest compatible bin; among bins of
one residual, the one that has had it longest. Else a new bin opens.

For each frequent source the residuals that have some compatible bin are kept in a bitmap of
their own, so a source with a third of the rows doesn't make the search walk its own bins.

Groups are runs of `group_rows` rows (or `group_ids` ids, whichever comes first) as read, so the order of the
input (a mixture) is kept from group to group, nothing is shuffled and a task holds one group's ids. Bins close
at the end of a group, so the groups, and with them the bins, follow from the layout of the input.

Defined results: texts without ids (null, empty, blank) give one piece of length 0, which needs no bin of its own;
a null source is a source; rows with null or repeated doc_id are packed like others; a null in a given cluster
column is no cluster; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from quern.llm._io import trim
from quern.llm.token_store import encoder

PACK_TYPE = "doc_id long, piece int, start long, length long, bin string, bin_fill long, at long, source string, cluster long, ids binary"
BIN_TYPE = "bin string, bin_fill long, doc_ids array<long>, lengths array<long>, ids binary"


def best_fit(lengths: list[int], sources: list, clusters: list, capacity: int, per_source: int = 1) -> list[int]:
    """The bin of each piece; pieces are placed longest first, equal ones in input order. A null cluster is no cluster."""
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    copies = Counter(clusters)
    bit_of_source = {s: i for i, s in enumerate(dict.fromkeys(sources))}
    bit_of_cluster = {c: i for i, c in enumerate(c for c in dict.fromkeys(clusters) if copies[c] > 1 and c is not None)}
    often = {s for s, n in Counter(sources).items() if n * 50 >= len(sources)}
    at: list[dict[int, None]] = [{} for _ in range(capacity + 1)]
    filled = 0  # bit r: some bin has residual r
    open_for = dict.fromkeys(often, 0)  # bit r: some bin of residual r takes this source
    n_open = {s: [0] * (capacity + 1) for s in often}
    residual, sbits, cbits, counts, out = [], [], [], [], [0] * len(lengths)

    def move(b: int, add: int) -> None:
        nonlocal filled
        r = residual[b]
        if add > 0:
            at[r][b] = None
        else:
            at[r].pop(b, None)
        filled = filled | (1 << r) if at[r] else filled & ~(1 << r)
        for s in often:
            if not sbits[b] >> bit_of_source[s] & 1:
                n_open[s][r] += add
                open_for[s] = open_for[s] | (1 << r) if n_open[s][r] else open_for[s] & ~(1 << r)

    for i in order:
        s, c, size = sources[i], clusters[i], lengths[i]
        sb, cb = 1 << bit_of_source[s], (1 << bit_of_cluster[c]) if c in bit_of_cluster else 0
        mask = (open_for[s] if s in often else filled) >> size
        r, found = size, -1
        while mask and found < 0:
            step = (mask & -mask).bit_length() - 1
            r, mask = r + step, mask >> step
            for b in at[r]:
                if not (sbits[b] & sb or cbits[b] & cb):
                    found = b
                    break
            r, mask = r + 1, mask >> 1
        if found < 0:
            found = len(residual)
            residual.append(capacity)
            sbits.append(0)
            cbits.append(0)
            counts.append(Counter())
            move(found, 1)
        move(found, -1)
        residual[found] -= size
        counts[found][s] += 1
        if counts[found][s] >= per_source:  # the bit says that the bin takes no more of the source
            sbits[found] |= sb
        cbits[found] |= cb
        move(found, 1)
        out[i] = found
    return out


def _packed(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, source_col: str, cluster_col: str | None, end_id: int, capacity: int, per_source: int, group_rows: int, group_ids: int, emit, schema: str) -> DataFrame:
    cluster = F.lit(None).cast("long") if cluster_col is None else F.col(cluster_col).cast("long")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).cast("string").alias("source"), cluster.alias("cluster"))

    def close(part: int, group: int, rows: list[tuple], ids: list[bytes], size: int):
        bins = np.array(best_fit([r[3] for r in rows], [r[4] for r in rows], [r[5] for r in rows], capacity, per_source), np.int64)
        lengths = np.array([r[3] for r in rows], np.int64)
        fill = np.bincount(bins, lengths).astype(np.int64)
        order = np.argsort(bins, kind="stable")  # pieces of a bin in input order
        before = np.cumsum(lengths[order]) - lengths[order]
        first = np.concatenate([[True], bins[order][1:] != bins[order][:-1]])
        at = np.empty(len(rows), np.int64)
        at[order] = before - before[first][bins[order]]
        names = np.array([f"{part}-{group}-{b}" for b in range(len(fill))])
        data = [ids[r[6]][r[2] * size : (r[2] + r[3]) * size] for r in rows]
        yield from emit(rows, bins, names, fill, at, order, data)

    def run(batches):
        from pyspark import TaskContext

        part, group, rows, ids, n_docs, held, coder = TaskContext.get().partitionId(), 0, [], [], 0, 0, None
        for x in batches:
            for i, text, s, c in zip(x.column(0).to_pylist(), x.column(1), x.column(2).to_pylist(), x.column(3).to_pylist(), strict=True):
                if coder is None:
                    coder = encoder(tokenizer)
                    size, end = coder.kind.itemsize, coder.pack([end_id])
                text = text.as_py() or ""
                got = coder.encode(text)
                got = got + end if got else got
                n = len(got) // size
                if cluster_col is None:
                    c = xxhash.xxh3_64_intdigest(" ".join(text.lower().split())) - 2**63
                rows += [(i, p, at, min(capacity, n - at), s, None if c is None else (c + p + 2**63) % 2**64 - 2**63, len(ids)) for p, at in enumerate(range(0, max(n, 1), capacity))]
                ids.append(got)
                n_docs, held = n_docs + 1, held + n
                if n_docs == group_rows or held >= group_ids:
                    yield from close(part, group, rows, ids, size)
                    group, rows, ids, n_docs, held = group + 1, [], [], 0, 0
        if rows:
            yield from close(part, group, rows, ids, size)
        rows, ids = [], []
        trim()

    return slim.mapInArrow(run, schema)


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None, *,
    end_id: int = 1, capacity: int = 2048, per_source: int = 4, group_rows: int = 8192, group_ids: int = 1 << 24,
) -> DataFrame:
    """One row per piece: doc_id, piece, start (ids of the document before it), length, bin, bin_fill, at (ids of the bin before it), source, cluster, ids (packed, two or four bytes each)."""

    def emit(rows, bins, names, fill, at, order, data):
        names_of = ["doc_id", "piece", "start", "length", "bin", "bin_fill", "at", "source", "cluster", "ids"]
        for s in range(0, len(rows), 4096):
            cols, e = list(zip(*rows[s : s + 4096], strict=True)), s + 4096
            yield pa.record_batch([
                pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(names[bins[s:e]]),
                pa.array(fill[bins[s:e]]), pa.array(at[s:e]), pa.array(cols[4], pa.string()), pa.array(cols[5], pa.int64()), pa.array(data[s:e], pa.binary()),
            ], names_of)

    return _packed(docs, tokenizer, id_col, text_col, source_col, cluster_col, end_id, capacity, per_source, group_rows, group_ids, emit, PACK_TYPE)


def sequences(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster_col: str | None = None, *,
    end_id: int = 1, capacity: int = 2048, per_source: int = 4, group_rows: int = 8192, group_ids: int = 1 << 24,
) -> DataFrame:
    """One row per bin, ready to train on: bin, bin_fill, doc_ids and lengths of its pieces in order, ids (the pieces' ids in that order)."""

    def emit(rows, bins, names, fill, at, order, data):
        out = [(str(n), int(f), [], [], []) for n, f in zip(names, fill, strict=True)]
        for i in order.tolist():
            if rows[i][3]:
                for kept, v in zip(out[bins[i]][2:], (rows[i][0], rows[i][3], data[i]), strict=True):
                    kept.append(v)
        kinds = [pa.string(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        out = [(*r[:4], b"".join(r[4])) for r in out if r[1]]
        for s in range(0, len(out), 4096):
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out[s : s + 4096], strict=True), kinds, strict=True)], ["bin", "bin_fill", "doc_ids", "lengths", "ids"])

    return _packed(docs, tokenizer, id_col, text_col, source_col, cluster_col, end_id, capacity, per_source, group_rows, group_ids, emit, BIN_TYPE)
