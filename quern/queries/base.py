"""Registration: Spark text or function, and the oracle's text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sql(name: str, text: str, oracle: str | None = None) -> None:
    """text has {table} where a driver table is read; without oracle the same text serves DuckDB."""
    used = [t for t in TABLES if "{" + t + "}" in text]

    def run(spark: SparkSession, d: str) -> DataFrame:
        return spark.sql(text, **{t: table(spark, d, t) for t in used})

    QUERIES[name] = run
    ORACLES[name] = re.sub(r"\{(\w+)\}", r"\1", text) if oracle is None else oracle


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def cases(name: str, rows: list[tuple]) -> None:
    """A query of (item, value) for literal inputs with published results; rows: (item, function that gives the column, result as text or None)."""
    from pyspark.sql import functions as F

    def run(spark: SparkSession, d: str) -> DataFrame:
        got = F.array(*(F.struct(F.lit(item).alias("item"), make().cast("string").alias("value")) for item, make, _ in rows))
        return spark.range(1).select(F.inline(got))

    quote = lambda v: "null" if v is None else "'" + v.replace("'", "''") + "'"
    QUERIES[name] = run
    ORACLES[name] = "select * from (values " + ", ".join(f"({quote(item)}, {quote(want)}::varchar)" for item, _, want in rows) + ") as t(item, value)"
