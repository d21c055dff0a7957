"""A join that leaves the rows of hot keys where they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Rows of one key up to which they may meet in one task, at least.
LEAST = 1000


def hub_limit(total: int, least: int = LEAST) -> int:
    return max(least, total // 50_000)


def join_hot(rows: DataFrame, keys: DataFrame, on: list[str], size: str, total: int, how: str = "inner", least: int = LEAST) -> DataFrame:
    """rows joined with keys, which has one row for each key and, in the column size, how many of the total rows have it.

    Keys with more than max(least, total / 50,000) rows, of which there are 50,000 at most whatever the data, are
    broadcast; the others meet by a shuffle. how: inner or left.
    """
    limit = hub_limit(total, least)
    big = F.broadcast(keys.where(F.col(size) > limit))
    light = rows.join(big.select(*on), on, "left_anti").join(keys.where(F.col(size) <= limit).hint("merge"), on, how)
    return light.unionByName(rows.join(big, on))
