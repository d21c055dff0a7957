"""Pfair mixing of sources to target weights.

Each source is cut into blocks. Block i (from 1) of a source of weight w has release time floor((i-1)/w) and
deadline ceil(i/w), in slots of one block; earliest deadline first, among released blocks, gives a
schedule in which every source is within less than one block of its due share at every slot.

Windows are built from the weights as they are, in whole numbers (a float is an exact binary fraction), and
hold over a whole phase. A phase ends when a source has no blocks left, and the others go on with their
weights scaled up. The driver runs through the slots and keeps only the counts at the head of each stretch
of them; tasks run the stretches again and give the slot of each block. No row is dropped or repeated.

Defined results: a null source is a source; rows with null or repeated doc_id are placed like others, by the
hash of all their columns, so that only rows that are equal throughout tie; empty tables give no rows; the last block of a source may be short; extra columns are passed on.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

#: Slots of one stretch.
STRETCH = 1 << 14


def edf(weights: list[int], done: list[int], t: int = 0) -> Iterator[int]:
    """Number of the source of each slot from t on, when done blocks of each are placed; weights are whole and count against their sum."""
    total = sum(weights)
    waiting = [(n * total // w, -(-(n + 1) * total // w), i, n + 1) for i, (w, n) in enumerate(zip(weights, done, strict=True))]
    heapq.heapify(waiting)
    ready: list = []
    while True:
        while waiting and waiting[0][0] <= t:
            _, deadline, i, k = heapq.heappop(waiting)
            heapq.heappush(ready, (deadline, i, k))
        deadline, i, k = heapq.heappop(ready)
        if deadline <= t:
            raise RuntimeError("a block misses its deadline")
        yield i
        t += 1
        w = weights[i]
        heapq.heappush(waiting, (k * total // w, -(-(k + 1) * total // w), i, k + 1))


def edf_period(shares: dict, period: int) -> list:
    """Source of each slot of a period; shares are whole block counts for each source that sum to it."""
    names = [s for s, n in shares.items() if n]
    return [names[i] for i in islice(edf([shares[s] for s in names], [0] * len(names)), period)]


def rounded(weights: dict, period: int) -> dict:
    """Whole shares of the period, 1 at least, in proportion to weights by largest remainders."""
    total = sum(weights.values())
    exact = {s: w * period / total for s, w in weights.items()}
    out = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (-(exact[s] - int(exact[s])), str(s)))
    i = 0
    while (short := period - sum(out.values())) != 0:
        s = order[i % len(order)] if short > 0 else max(out, key=lambda x: (out[x] - exact[x], out[x] > 1, str(x)))
        if short < 0 and out[s] == 1:
            s = max(out, key=out.get)
        out[s] += 1 if short > 0 else -1
        i += 1
    return out


def whole(weights: dict) -> dict:
    """Whole numbers in exactly the given proportions."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    unit = math.lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * unit) for s, w in exact.items()}


def plan(blocks: dict, weights: dict, stretch: int = STRETCH) -> list[tuple]:
    """(phase, first slot of the phase, slots of it before, slots, live sources, their blocks before the phase, and in it before) of stretches that place all blocks."""
    names, exact = list(blocks), whole(weights)
    left, done, start, out, phase = dict(blocks), dict.fromkeys(blocks, 0), 0, [], 0
    while live := [i for i, s in enumerate(names) if left[s] > 0]:
        first = [done[names[i]] for i in live]
        need, count, t = [left[names[i]] for i in live], [0] * len(live), 0
        order, ends = edf([exact[names[i]] for i in live], count), False
        while not ends:
            before = list(count)
            if len(live) == 1:  # nothing to choose
                n = min(stretch, need[0] - count[0])
                count[0] += n
                ends = count[0] == need[0]
            else:
                n = 0
                for i in islice(order, stretch):
                    n += 1
                    count[i] += 1
                    if count[i] == need[i]:
                        ends = True
                        break
            out.append((phase, start, t, n, live, first, before))
            t += n
        for i, n in zip(live, count, strict=True):
            left[names[i]] -= n
            done[names[i]] += n
        start, phase = start + t, phase + 1
    return out


def slots(stretch: tuple, weights: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(source, block, slot) of the slots of a stretch of the plan; weights are of all sources."""
    _, start, t, n, live, first, before = stretch
    turn = np.fromiter(islice(edf([weights[i] for i in live], before, t), n), np.int64, n) if len(live) > 1 else np.zeros(n, np.int64)
    block = np.empty(n, np.int64)
    for i, (a, b) in enumerate(zip(first, before, strict=True)):
        at = np.flatnonzero(turn == i)
        block[at] = a + b + np.arange(len(at))
    return np.asarray(live, np.int64)[turn], block, start + t + np.arange(n)


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", *, weights: dict | None = None, temper: float = 0.5, block_rows: int = 16, seed: int = 3, max_sources: int = 512, bucket_rows: int = 8192) -> DataFrame:
    """docs with __block (in its source), __slot (of the mixture) and __at (position of the row).

    Without weights a source gets rows^temper. One row for each source reaches the driver, at most max_sources.
    """
    spark = docs.sparkSession
    name = F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("null"))
    sizes = dict(sorted((r["s"], r["n"]) for r in docs.groupBy(name.alias("s")).agg(F.count("*").alias("n")).limit(max_sources + 1).collect()))  # ties go by name
    if len(sizes) > max_sources:
        raise ValueError(f"more than {max_sources} sources; raise max_sources or group them")
    target = {s: (weights or {}).get(None if s == "null" else s[1:], 0) if weights else n**temper for s, n in sizes.items()}
    least = min([w for w in target.values() if w > 0], default=1) / 1000
    target = {s: w if w > 0 else least for s, w in target.items()}  # a source without weight still goes out, last
    names, weigh = list(sizes), list(whole(target).values())
    table = plan({s: -(-n // block_rows) for s, n in sizes.items()}, target)
    kinds = {"phase": pa.int32(), "start": pa.int64(), "t": pa.int64(), "n": pa.int32(), "live": pa.list_(pa.int32()), "first": pa.list_(pa.int64()), "before": pa.list_(pa.int64())}
    columns = [pa.array([r[i] for r in table], kind) for i, kind in enumerate(kinds.values())]
    stretches = spark.createDataFrame(pa.table(columns, list(kinds)))  # as Arrow: a list of rows would start Python workers of another kind, which stay

    def placed(batches):
        for x in batches:
            for r in x.to_pylist():
                source, block, slot = slots(tuple(r.values()), weigh)
                yield pa.record_batch([pa.array(names, pa.string()).take(pa.array(source)), pa.array(block), pa.array(slot)], ["__p", "__pb", "__slot"])

    steps = stretches.mapInArrow(placed, "__p string, __pb long, __slot long")

    salts = F.create_map(*(F.lit(x) for s, n in sizes.items() for x in (s, max(1, -(-n // bucket_rows))))) if sizes else F.create_map(F.lit(""), F.lit(1))
    hashed = [f.name for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]  # maps have no hash
    rows = docs.withColumn("__s", name).withColumn("__h", F.xxhash64(F.lit(seed), *(docs[c] for c in hashed)))
    rows = rows.withColumn("__salt", F.pmod("__h", salts[F.col("__s")].cast("long")))
    counts = rows.groupBy("__s", "__salt").agg(F.count("*").alias("n"))
    before = counts.select(F.col("__s").alias("__bs"), F.col("__salt").alias("__bsalt"), "n", (F.sum("n").over(Window.partitionBy("__s").orderBy("__salt")) - F.col("n")).alias("__before"))
    # the slots of the blocks that a salted bucket's rows fall into, at most bucket_rows / block_rows of them or so
    block_of = lambda i: F.floor(i / block_rows).cast("long")
    spread = before.withColumn("__b", F.explode(F.sequence(block_of(F.col("__before")), block_of(F.col("__before") + F.col("n") - 1))))
    before = spread.join(steps, (F.col("__bs") == F.col("__p")) & (F.col("__b") == F.col("__pb"))).groupBy("__bs", "__bsalt", "__before").agg(F.sort_array(F.collect_list(F.struct("__b", "__slot"))).alias("__turns"))
    before = before.select("__bs", "__bsalt", "__before", F.transform("__turns", lambda x: x["__slot"]).alias("__slots"))
    within = F.row_number().over(Window.partitionBy("__s", "__salt").orderBy("__h", id_col)) - 1
    rows = rows.withColumn("__i", within).join(before, (F.col("__s") == F.col("__bs")) & (F.col("__salt") == F.col("__bsalt"))).withColumn("__i", F.col("__i") + F.col("__before"))
    rows = rows.withColumn("__block", block_of(F.col("__i")))
    slot = F.element_at("__slots", (F.col("__block") - block_of(F.col("__before")) + 1).cast("int"))
    rows = rows.withColumn("__slot", slot).withColumn("__at", F.col("__slot") * block_rows + F.pmod("__i", F.lit(block_rows)))
    return rows.select(*docs.columns, "__block", "__slot", "__at")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs in the order of the mixture, range-partitioned, so that files written hold it."""
    out = mix(docs, **options)
    return out.repartitionByRange("__at").sortWithinPartitions("__at").select(*docs.columns)
