"""What the estimator is measured against: independent equi-depth histograms, and constants."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quern.kde.ranges import INF, Range

#: Fallbacks for one inequality, one two-sided range and one equality.
INEQUALITY, TWO_SIDED, EQUALITY = 1 / 3, 0.005, 0.005


def histograms(df: DataFrame, columns: list[str], buckets: int = 100) -> dict[str, list[float]]:
    """Equi-depth bounds of each column, buckets + 1 numbers, in one aggregation."""
    at = [i / buckets for i in range(buckets + 1)]
    row = df.agg(*(F.percentile_approx(c, at, 10_000).alias(c) for c in columns)).first()
    return {c: [float(x) for x in row[c] or []] for c in columns}


def share(bounds: list[float], r: Range) -> float:
    """Part of the rows in the range, linear inside buckets."""

    def below(v: float) -> float:
        if v >= bounds[-1]:
            return 1.0
        if v <= bounds[0]:
            return 0.0
        i = next(i for i, b in enumerate(bounds) if b > v) - 1
        width = bounds[i + 1] - bounds[i]
        return (i + ((v - bounds[i]) / width if width else 0.5)) / (len(bounds) - 1)

    if not bounds:
        return 0.0
    return max(0.0, below(r.hi) - below(r.lo))


def independent(hist: dict[str, list[float]], ranges: list[Range]) -> float:
    out = 1.0
    for r in ranges:
        out *= share(hist[r.col], r)
    return out


def constant(ranges: list[Range]) -> float:
    out = 1.0
    for r in ranges:
        out *= EQUALITY if r.lo == r.hi else INEQUALITY if INF in (r.hi, -r.lo) else TWO_SIDED
    return out
