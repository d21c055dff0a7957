"""INSERT, UPDATE, DELETE with RETURNING over immutable tables: each gives (new table, returned rows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def insert(table: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Missing columns become null."""
    rows = rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(table.schema[c].dataType).alias(c) for c in table.columns))
    return table.unionByName(rows), rows


def update(table: DataFrame, where: Column, **changes: Column) -> tuple[DataFrame, DataFrame]:
    """All right sides see the old row; rows where the condition is null stay."""
    hit = F.coalesce(where, F.lit(False))
    new = table.select(*(F.when(hit, changes[c]).otherwise(F.col(c)).cast(table.schema[c].dataType).alias(c) if c in changes else F.col(c) for c in table.columns))
    returned = table.where(hit).select(*(changes[c].cast(table.schema[c].dataType).alias(c) if c in changes else F.col(c) for c in table.columns))
    return new, returned


def delete(table: DataFrame, where: Column) -> tuple[DataFrame, DataFrame]:
    hit = F.coalesce(where, F.lit(False))
    return table.where(~hit), table.where(hit)


def truncate(table: DataFrame) -> DataFrame:
    return table.where(F.lit(False))


def inherit(parent: DataFrame, *children: DataFrame) -> DataFrame:
    """The parent with its children's rows, cut to the parent's columns."""
    out = parent
    for c in children:
        out = out.unionByName(c.select(*parent.columns))
    return out


def move_rows(source: DataFrame, target: DataFrame, where: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """WITH moved AS (DELETE ... RETURNING *) INSERT INTO target SELECT * FROM moved: (source, target, moved).

    All parts see the tables as they were, as data-modifying WITH queries do.
    """
    left, moved = delete(source, where)
    new, _ = insert(target, moved)
    return left, new, moved
