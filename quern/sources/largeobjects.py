"""Large objects as a table of pages (loid, pageno, data), so that a read or write touches its pages only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

PAGE = 2048


def lo_import(df: DataFrame, loid: str, data: str) -> DataFrame:
    """One object for each row: its bytes cut into pages."""
    b = F.col(data).cast("binary")
    pages = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.length(b) - 1) / PAGE), F.lit(0)).cast("int")), lambda i: F.struct(i.alias("pageno"), F.substring(b, i * PAGE + 1, F.lit(PAGE)).alias("data")))
    return df.select(F.col(loid).cast("long").alias("loid"), F.explode(pages).alias("p")).select("loid", "p.pageno", "p.data")


def lo_get(pages: DataFrame, offset: int = 0, length: int | None = None) -> DataFrame:
    """loid, data: the bytes from offset on, at most length; other pages aren't read."""
    first = offset // PAGE
    near = pages.where(F.col("pageno") >= first)
    if length is not None:
        near = near.where(F.col("pageno") <= (offset + max(length, 1) - 1) // PAGE)
    joined = F.aggregate(F.transform(F.array_sort(F.collect_list(F.struct("pageno", "data"))), lambda s: s["data"]), F.lit(b""), lambda a, d: F.concat(a, d))
    rest = F.substring(joined, offset - first * PAGE + 1, length if length is not None else 1 << 30)
    return pages.select("loid").distinct().join(near.groupBy("loid").agg(rest.alias("data")), "loid", "left").select("loid", F.coalesce("data", F.lit(b"")).alias("data"))


def lo_put(pages: DataFrame, loid: int, offset: int, data: bytes) -> DataFrame:
    """Bytes written over an object from offset on; it grows where they reach beyond its end, with zeros in a gap."""
    spark = pages.sparkSession
    last = (offset + len(data) - 1) // PAGE
    mine = pages.where(F.col("loid") == loid)
    touched = spark.range(offset // PAGE, last + 1).select(F.lit(loid).cast("long").alias("loid"), F.col("id").cast("int").alias("pageno"))
    have = mine.agg(F.coalesce(F.max("pageno"), F.lit(-1)).alias("m")).first()["m"]
    gap = spark.range(min(have, last), last + 1).select(F.lit(loid).cast("long").alias("loid"), F.greatest(F.col("id"), F.lit(0)).cast("int").alias("pageno"))
    all_ = mine.select("loid", "pageno").union(touched).union(gap).distinct().join(mine, ["loid", "pageno"], "left")
    old = F.coalesce("data", F.lit(b""))
    start = F.lit(offset) - F.col("pageno") * PAGE  # where the new bytes begin in this page
    head = F.rpad(old, F.greatest(start, F.lit(0)), F.lit(b"\0"))
    body = F.substring(F.lit(data), F.greatest(-start, F.lit(0)) + 1, F.greatest(F.least(F.lit(PAGE) - F.greatest(start, F.lit(0)), F.lit(len(data)) - F.greatest(-start, F.lit(0))), F.lit(0)))
    end = F.length(head) + F.length(body)
    tail = F.substring(old, end + 1, F.lit(PAGE))
    hit = F.col("pageno").between(offset // PAGE, last)
    new = F.when(hit, F.concat(head, body, tail)).otherwise(old)
    new = F.when(F.col("pageno") < F.greatest(F.lit(have), F.lit(last)), F.rpad(new, F.lit(PAGE), F.lit(b"\0"))).otherwise(new)
    return pages.where(F.col("loid") != loid).union(all_.select("loid", "pageno", new.alias("data")))


def lo_truncate(pages: DataFrame, loid: int, length: int) -> DataFrame:
    keep = F.col("pageno") < max(1, -(-length // PAGE))
    cut: Column = F.when((F.col("loid") == loid) & (F.col("pageno") == length // PAGE), F.substring("data", 1, length % PAGE)).otherwise(F.col("data"))
    return pages.where((F.col("loid") != loid) | keep).select("loid", "pageno", cut.alias("data"))


def lo_unlink(pages: DataFrame, loid: int) -> DataFrame:
    return pages.where(F.col("loid") != loid)
