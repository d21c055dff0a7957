"""Connected components by alternating large-star and small-star rounds.

Every round is a few shuffles over at most two rows per edge, written to the shared folder, so that
lineage stays short and a lost executor costs one round; the table of the round before is deleted.
The edges of a hub of over 100,000 edges stay where they are: its minimum is broadcast (see hot.py). Nothing is collected but three numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quern.llm._io import dropped, written_at
from quern.llm.hot import hub_limit, join_hot

#: Edges of one node, of 16 bytes each, that one task takes in any case.
HUB = 100_000


def _round(edges: DataFrame, total: int, hubs: bool) -> DataFrame:
    """With hubs the edges of hot nodes are joined apart (the same rows come out of either form)."""

    def with_least(rows: DataFrame, low: DataFrame) -> DataFrame:
        return join_hot(rows, low, ["u"], "n", 2 * total, least=HUB).drop("n") if hubs else rows.join(low.drop("n"), "u")

    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    large = with_least(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    small = with_least(down, least)
    return small.select("u", F.col("m").alias("v")).union(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()


def _facts(edges: DataFrame) -> tuple[int, object, int]:
    """Number of edges, a sum of their hashes, and the most edges that a node has as the lesser end: one row.

    Hubs are lesser ends: the edges given are stars around their least node, and the rounds make such stars.
    """
    each = edges.groupBy("v").agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
    n, h, most = each.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("h"), F.lit(0).cast("decimal(38,0)")), F.coalesce(F.max("n"), F.lit(0))).first()
    return n, h, most


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (u, v long) to (node, root): root is the smallest node of the component.

    Loops and repeated edges are ignored; an empty table gives an empty one; nulls take no part.
    """
    start = edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    now, path = written_at(start.distinct(), "edges")
    before = _facts(now)
    if before[0]:
        for _ in range(max_rounds):
            new, new_path = written_at(_round(now, before[0], before[2] > hub_limit(2 * before[0], HUB)), "edges")
            dropped(path)
            now, path = new, new_path
            after = _facts(now)
            if after[:2] == before[:2]:
                break
            before = after
        else:
            raise RuntimeError(f"no fix-point after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
