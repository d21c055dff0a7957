"""Kernel density models over a bounded sample of standardised points.

Estimating a batch of range queries is one pass over queries x sample, the sample (at most kde_samplesize
rows) being broadcast. Columns are built-in expressions, so it all stays in generated code.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from quern.kde.ranges import INF, Range

#: The rational approximation of erf by Abramowitz and Stegun, 7.1.26.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)
_erf = np.vectorize(math.erf)


def erf(x: Column) -> Column:
    """erf to 1.5e-7; Spark has none."""
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * F.abs(x))
    poly = F.lit(0.0)
    for a in reversed(ERF_A):
        poly = (poly + F.lit(a)) * t
    return F.signum(x) * (F.lit(1.0) - poly * F.exp(-x * x))


def scott(d: int, s: int, variance: float = 1.0) -> float:
    """Bandwidth of one standardised dimension."""
    return variance * (4.0 / ((d + 2) * s)) ** (1.0 / (d + 4))


def epanechnikov(x: Column, lo: Column, hi: Column, h: float | Column) -> Column:
    """Mass of one kernel around x within [lo, hi] in one dimension (factor 0.75 outside)."""
    h = h if isinstance(h, Column) else F.lit(float(h))
    a, b = F.greatest(lo, x - h), F.least(hi, x + h)
    mass = ((h * h - x * x) * (b - a) + x * (b * b - a * a) - (b * b * b - a * a * a) / 3.0) / (h * h * h)
    return F.when(b > a, mass).otherwise(F.lit(0.0))


def gauss(x: Column, lo: Column, hi: Column, h: float | Column) -> Column:
    """erf difference in one dimension (factor 0.5 outside); a zero bandwidth is a point."""
    h = h if isinstance(h, Column) else F.lit(float(h))
    b = F.lit(1.0) / (F.lit(math.sqrt(2.0)) * h)
    return F.when(h == 0, F.signum(hi - x) - F.signum(lo - x)).otherwise(erf((hi - x) * b) - erf((lo - x) * b))


KERNELS = {"epanechnikov": (epanechnikov, 0.75), "gauss": (gauss, 0.5)}


def moments(df: DataFrame, columns: list[str]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, means and sample deviations in one aggregation."""
    row = df.agg(F.count("*"), *(F.avg(c) for c in columns), *(F.stddev_samp(c) for c in columns)).first()
    d = len(columns)
    sd = np.array([x if x else 1.0 for x in row[1 + d :]], float)
    return int(row[0]), np.array([x or 0.0 for x in row[1 : 1 + d]], float), sd


def random_sample(df: DataFrame, columns: list[str], size: int, seed: int = 1) -> DataFrame:
    """A uniform sample of `size` rows: a thinned scan, then top rows by a random number, without a full sort."""
    n = df.count()
    rows = df.select(*columns).where(" and ".join(f"{c} is not null" for c in columns))
    if n > 4 * size:
        rows = rows.sample(min(1.0, 2.0 * size / n + 10.0 / n), seed=seed)
    return rows.withColumn("__r", F.rand(seed)).orderBy("__r").limit(size).drop("__r")


def scv_bandwidth(points: np.ndarray, limit: int = 800, seed: int = 1, rounds: int = 60) -> np.ndarray:
    """Diagonal bandwidths by smoothed cross-validation, on at most `limit` of the points.

    The criterion is the normal kernels' integrated squared error with a pilot smoothing of the bias term; a search
    in the logarithms steps each dimension up and down, with steps that shrink.
    """
    x = points if len(points) <= limit else points[np.random.default_rng(seed).choice(len(points), limit, replace=False)]
    n, d = x.shape
    gaps = (x[:, None, :] - x[None, :, :]) ** 2
    sd = np.maximum(x.std(0, ddof=1), 1e-9)
    pilot = sd * (2.0 / (n * (d + 8))) ** (1.0 / (d + 10)) / 2  # normal-scale pilot, for a sixth-order functional

    def mean_normal(var: np.ndarray) -> float:
        return float(np.exp(-0.5 * (gaps / var).sum(2)).mean() / np.sqrt((2 * math.pi * var).prod()))

    def criterion(log_h: np.ndarray) -> float:
        h2, g2 = np.exp(2 * log_h), pilot**2
        return 1.0 / (n * (4 * math.pi) ** (d / 2) * math.exp(log_h.sum())) + mean_normal(2 * h2 + 2 * g2) - 2 * mean_normal(h2 + 2 * g2) + mean_normal(2 * g2)

    at = np.log(sd * scott(d, n))
    best, step = criterion(at), 0.5
    for _ in range(rounds):
        moved = False
        for k in range(d):
            for sign in (1, -1):
                trial = at.copy()
                trial[k] += sign * step
                value = criterion(trial)
                if value < best:
                    at, best, moved = trial, value, True
                    break
        if not moved:
            step /= 2
            if step < 1e-3:
                break
    return np.exp(at)


def sample_is_safe(blocks: int, rows: int, max_per_block: float) -> bool:
    """False for empty tables and where the fullest block holds over 1.75 times the mean."""
    return blocks > 0 and rows > 0 and max_per_block / (rows / blocks) <= 1.75


@dataclass
class Model:
    """A model of some columns of a table; points and bandwidths are standardised."""

    table: str
    columns: list[str]
    points: np.ndarray
    mean: np.ndarray
    sd: np.ndarray
    bandwidth: np.ndarray
    rows: int
    kernel: str = "gauss"
    representation: str = "plain"
    karma: np.ndarray = field(default_factory=lambda: np.empty(0))
    version: int = 0
    batches: dict[str, int] = field(default_factory=dict)  # the last micro-batch of each stream that the model holds

    @classmethod
    def analyze(cls, df: DataFrame, table: str, columns: list[str], size: int = 4300, kernel: str = "gauss", seed: int = 1) -> Model:
        """ANALYZE table(columns): sample, standardise, Scott's bandwidth."""
        raw = np.array([[float(r[c]) for c in columns] for r in random_sample(df, columns, size, seed).collect()], float).reshape(-1, len(columns))  # size rows at most
        n = df.count()
        if not len(raw):
            raise ValueError("an empty table has no model")
        mean, sd = raw.mean(0), raw.std(0, ddof=1) if len(raw) > 1 else np.ones(len(columns))
        sd = np.where(sd > 0, sd, 1.0)
        h = np.full(len(columns), scott(len(columns), len(raw)))
        return cls(table, columns, (raw - mean) / sd, mean, sd, h, n, kernel, karma=np.zeros(len(raw)))

    def h(self) -> np.ndarray:
        return np.exp(self.bandwidth) if self.representation == "log" else self.bandwidth

    def standard(self, ranges: list[Range]) -> tuple[np.ndarray, np.ndarray]:
        by = {r.col: r for r in ranges}
        lo = np.array([by[c].lo if c in by else -INF for c in self.columns])
        hi = np.array([by[c].hi if c in by else INF for c in self.columns])
        return (lo - self.mean) / self.sd, (hi - self.mean) / self.sd

    def factors(self, lo: np.ndarray, hi: np.ndarray, h: np.ndarray | None = None) -> np.ndarray:
        """Per point and dimension, with the kernel's constant."""
        h = self.h() if h is None else h
        x = self.points
        if self.kernel == "gauss":
            b = 1 / (math.sqrt(2) * np.maximum(h, 1e-300))
            return 0.5 * (_erf((hi - x) * b) - _erf((lo - x) * b))
        a, b = np.maximum(lo, x - h), np.minimum(hi, x + h)
        mass = ((h * h - x * x) * (b - a) + x * (b * b - a * a) - (b**3 - a**3) / 3) / h**3
        return 0.75 * np.where(b > a, mass, 0.0)

    def contributions(self, ranges: list[Range], h: np.ndarray | None = None) -> np.ndarray:
        return self.factors(*self.standard(ranges), h).prod(1)

    def estimate(self, ranges: list[Range], h: np.ndarray | None = None) -> float:
        return float(self.contributions(ranges, h).mean())

    def gradient(self, ranges: list[Range]) -> np.ndarray:
        """d estimate / d bandwidth for the Gauss kernel, in the model's representation."""
        lo, hi = self.standard(ranges)
        h, x = self.h(), self.points
        l, u = lo - x, hi - x
        with np.errstate(invalid="ignore", over="ignore"):
            edge = np.where(np.isfinite(l), l * np.exp(-(l**2) / (2 * h * h)), 0) - np.where(np.isfinite(u), u * np.exp(-(u**2) / (2 * h * h)), 0)
        f = self.factors(lo, hi)
        out = np.empty(len(h))
        for k in range(len(h)):
            out[k] = (edge[:, k] * np.delete(f, k, 1).prod(1)).mean() / (h[k] ** 2 * math.sqrt(2 * math.pi))
        return out * h if self.representation == "log" else out

    def to_log(self) -> None:
        if self.representation == "plain":
            self.bandwidth, self.representation = np.log(self.bandwidth), "log"


def estimate_batch(queries: DataFrame, sample: DataFrame, columns: list[str], bandwidth: list[float], kernel: str = "epanechnikov") -> DataFrame:
    """query_id, estimate for queries (query_id, lo_<c>, hi_<c>) over a sample of standardised columns.

    The sample is broadcast (its size is a setting); queries stay where they are until the sum.
    """
    one, norm = KERNELS[kernel]
    joined = queries.crossJoin(F.broadcast(sample.select(*columns)))
    mass = F.lit(1.0)
    for c, h in zip(columns, bandwidth, strict=True):
        mass = mass * one(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}"), h) * F.lit(norm)
    return joined.groupBy("query_id").agg((F.sum(mass) / F.count("*")).alias("estimate"))


def gradient_batch(queries: DataFrame, sample: DataFrame, columns: list[str], bandwidth: list[float]) -> DataFrame:
    """query_id, estimate, g_<c>: Gauss estimates and their gradients by plain bandwidth, in one pass."""
    joined = queries.crossJoin(F.broadcast(sample.select(*columns)))
    f = {c: gauss(F.col(c), F.col(f"lo_{c}"), F.col(f"hi_{c}"), h) * F.lit(0.5) for c, h in zip(columns, bandwidth, strict=True)}
    whole = F.lit(1.0)
    for c in columns:
        whole = whole * f[c]
    aggs = [(F.sum(whole) / F.count("*")).alias("estimate")]
    for c, h in zip(columns, bandwidth, strict=True):
        l, u = F.col(f"lo_{c}") - F.col(c), F.col(f"hi_{c}") - F.col(c)
        edge = l * F.exp(-l * l / (2.0 * h * h)) - u * F.exp(-u * u / (2.0 * h * h))
        rest = F.lit(1.0)
        for o in columns:
            if o != c:
                rest = rest * f[o]
        aggs.append((F.sum(edge * rest) / F.count("*") / F.lit(h * h * math.sqrt(2 * math.pi))).alias(f"g_{c}"))
    return joined.groupBy("query_id").agg(*aggs)
