"""Recursive queries to a fix-point (UNION: rows already seen aren't expanded again)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from quern.session import shared_path


def cut(df: DataFrame, label: str = "round") -> DataFrame:
    """df written to the shared folder and read back, so that lineage stays short and a lost executor costs one round."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def recursive_union(start: DataFrame, step: Callable[[DataFrame], DataFrame], max_rounds: int = 1000) -> DataFrame:
    """Semi-naive recursion: step() sees only the rows that the last round found.

    Only the rows of each round are written; what was found before is the union of those tables.
    """
    rounds = [cut(start.distinct())]
    for _ in range(max_rounds):
        found = rounds[0]
        for r in rounds[1:]:
            found = found.unionByName(r)
        fresh = cut(step(rounds[-1]).select(*found.columns).distinct().subtract(found))
        if fresh.isEmpty():
            return found
        rounds.append(fresh)
        if len(rounds) > 32:  # a plan of many small tables costs more than their rows
            rounds = [cut(found), fresh]
    raise RuntimeError(f"no fix-point after {max_rounds} rounds")
