"""Joins that Spark doesn't plan well by itself."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

#: Buckets that a range may cover at its level.
WIDE = 16


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float, how: str = "inner") -> DataFrame:
    """point in [low, high) as an equi-join on buckets of `width`, not a nested loop. how: inner, left or left_semi or left_anti (points are left).

    A range of up to WIDE buckets is repeated once for each bucket that it meets; wider ones go to buckets WIDE times
    as wide, and so on, so no range is repeated more than WIDE + 1 times.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("a range join is inner, left, left_semi or left_anti: its ranges are repeated")
    r = ranges.where(F.col(low) < F.col(high))
    span = F.greatest(F.lit(0), F.ceil(F.ln((F.col(high) - F.col(low)) / F.lit(float(width))) / math.log(WIDE))).cast("int")
    r = r.withColumn("__level", span)
    levels = [x[0] for x in r.select("__level").distinct().orderBy("__level").limit(64).collect()]  # by the logarithm of the widths
    size = F.lit(float(width)) * F.pow(F.lit(float(WIDE)), F.col("__level"))
    bucket = lambda c: F.floor(c / size).cast("long")
    r = r.withColumn("__c", F.explode(F.sequence(bucket(F.col(low)), bucket(F.col(high))))).withColumnRenamed("__level", "__l")
    named = points.withColumn("__row", F.monotonically_increasing_id()) if how == "left" else points
    p = named.withColumn("__level", F.explode(F.array(*map(F.lit, levels)))) if levels else named.withColumn("__level", F.lit(0))
    p = p.withColumn("__b", bucket(F.col(point)))
    hit = (F.col("__b") == F.col("__c")) & (F.col("__level") == F.col("__l")) & (F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))
    if how in ("left_semi", "left_anti"):
        kept = p.join(r, hit, "left_semi").drop("__level", "__b")
        return kept.distinct() if how == "left_semi" else points.join(kept.distinct(), [points[c].eqNullSafe(kept[c]) for c in points.columns], "left_anti")
    out = p.join(r, hit, "inner").drop("__b", "__c", "__level", "__l")
    if how == "inner":
        return out
    alone = named.join(out.select("__row"), "__row", "left_anti").select(*points.columns, *(F.lit(None).cast(f.dataType).alias(f.name) for f in ranges.schema.fields))
    return out.drop("__row").union(alone)


def not_in(left: DataFrame, right: DataFrame, key: str, other: str) -> DataFrame:
    """left.key NOT IN (select other from right): nothing where right has a null, no null keys unless right is empty."""
    right = right.select(F.col(other).alias("__o"))
    facts = right.agg(F.count("*").alias("__n"), F.count_if(F.col("__o").isNull()).alias("__nulls"))  # one row
    out = left.join(right.where("__o is not null"), F.col(key) == F.col("__o"), "left_anti").crossJoin(F.broadcast(facts))
    return out.where((F.col("__n") == 0) | ((F.col("__nulls") == 0) & F.col(key).isNotNull())).drop("__n", "__nulls")


def salted_join(big: DataFrame, small: DataFrame, key: str, salts: int, how: str = "inner") -> DataFrame:
    """An equi-join whose hot keys are spread: big gets a salt, small one copy for each salt. how keeps big's rows: inner, left, left_semi or left_anti.

    The salt is a hash of big's row, so a task that is run again deals its rows out alike.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("a salted join is inner, left, left_semi or left_anti: the small side is repeated")
    b = big.withColumn("__s", F.pmod(F.xxhash64(*(big[f.name] for f in big.schema.fields if "map<" not in f.dataType.simpleString())), F.lit(salts)))
    s = small.withColumn("__s", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return b.join(s, [key, "__s"], how).drop("__s")


def top_k_each(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group (LATERAL ... LIMIT k); Catalyst limits groups before the shuffle."""
    from pyspark.sql import Window

    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= k).drop("__n")


def distinct_on(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_k_each(df, keys, order, 1)


def asof_join(left: DataFrame, right: DataFrame, on: list[str], time: str, prefix: str = "r_") -> DataFrame:
    """Each left row with the last right row of its keys at or before its time; right columns get a prefix, and are null without one.

    One shuffle by key: both sides pass one sorted window, no row is paired with more than one other.
    """
    values = [c for c in right.columns if c not in on]
    l = left.select(*on, F.col(time).alias("__t"), F.lit(1).alias("__side"), F.struct(*left.columns).alias("__l"), F.lit(None).cast(right.select(F.struct(*values).alias("v")).schema["v"].dataType).alias("__r"))
    r = right.select(*on, F.col(time).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(l.schema["__l"].dataType).alias("__l"), F.struct(*values).alias("__r"))
    from pyspark.sql import Window

    w = Window.partitionBy(*on).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = l.unionByName(r).withColumn("__m", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    return out.select("__l.*", *(F.col(f"__m.{v}").alias(prefix + v) for v in values))


def quantified(df: DataFrame, column: str, op: str, rows: DataFrame, other: str, every: bool = True) -> DataFrame:
    """Rows of df where column op ALL (or ANY) of other holds in three-valued logic, by one row of facts about rows."""
    r = rows.select(F.col(other).alias("__o"))
    facts = r.agg(F.count("*").alias("__n"), F.count_if(F.col("__o").isNull()).alias("__nulls"), F.min("__o").alias("__lo"), F.max("__o").alias("__hi"))  # one row
    x, lo, hi = F.col(column), F.col("__lo"), F.col("__hi")
    holds = {
        (">", True): x > hi, (">=", True): x >= hi, ("<", True): x < lo, ("<=", True): x <= lo, ("=", True): (x == lo) & (x == hi),
        (">", False): x > lo, (">=", False): x >= lo, ("<", False): x < hi, ("<=", False): x <= hi, ("<>", False): (x != lo) | (x != hi),
    }.get((op, every))
    if holds is None:
        raise ValueError("= ANY and <> ALL are IN and NOT IN")
    joined = df.crossJoin(F.broadcast(facts))
    ok = (F.col("__n") == 0) | ((F.col("__nulls") == 0) & F.coalesce(holds, F.lit(False))) if every else F.coalesce(holds, F.lit(False))
    return joined.where(ok).select(*df.columns)


def group_by_key(df: DataFrame, key: list[str], dependent: list[str], *aggs: Column) -> DataFrame:
    """GROUP BY a primary key: the columns that depend on it may stand beside the aggregates."""
    return df.groupBy(*key).agg(*(F.any_value(c).alias(c) for c in dependent), *aggs)
