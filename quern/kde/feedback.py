"""Query feedback: run a range query once, record its true selectivity beside its ranges."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from quern.kde import ranges as R

FEEDBACK = T.StructType().add("ts", "timestamp").add("table", "string").add("columns", "long").add("ranges", R.RANGE_TYPE).add("alltuples", "long").add("qualifiedtuples", "long")


def observe(df: DataFrame, table: str, clauses: list[tuple]) -> DataFrame | None:
    """One feedback row, from one scan; None where the predicate has other clauses or nothing was read."""
    found, _ = R.extract(clauses)
    if not found:
        return None
    row = df.agg(F.count("*").alias("n"), F.count_if(R.predicate(found)).alias("q")).first()
    if row["n"] == 0:
        return None
    record = (datetime.now(timezone.utc), table, R.columns_bitmap([r.col for r in found], df.columns), R.encode(found), row["n"], row["q"])
    return df.sparkSession.createDataFrame([record], FEEDBACK)


def append(feedback: DataFrame, path: str) -> None:
    feedback.write.mode("append").parquet(path)


def window(spark: SparkSession, path: str, table: str, n: int = -1) -> DataFrame:
    """The last n rows of a table's feedback; all for -1."""
    rows = spark.read.schema(FEEDBACK).parquet(path).where(F.col("table") == table).orderBy(F.desc("ts"))
    return rows if n < 0 else rows.limit(n)


def observations(feedback: DataFrame, limit: int = 100_000) -> list[tuple[list[R.Range], float]]:
    """(ranges, true selectivity) for the optimiser; at most `limit` rows, the window's bound."""
    return [(R.decode(r["ranges"]), r["qualifiedtuples"] / r["alltuples"]) for r in feedback.limit(limit).collect()]
