"""Error metrics between an estimated and a true selectivity, and their derivatives by the estimate."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from quern.kde.config import Metric

C = 1e-10


def loss(metric: Metric, e, t) -> Column:
    e, t = (x if isinstance(x, Column) else F.col(x) for x in (e, t))
    return {
        Metric.ABSOLUTE: lambda: F.abs(e - t),
        Metric.RELATIVE: lambda: F.abs(e - t) / (C + t),
        Metric.QUADRATIC: lambda: (e - t) * (e - t),
        Metric.SQUARED_Q: lambda: F.pow(F.ln(C + t) - F.ln(C + e), F.lit(2.0)),
        Metric.SQUARED_RELATIVE: lambda: F.pow((t - e) / (C + t), F.lit(2.0)),
    }[metric]()


def value(metric: Metric, e: float, t: float) -> float:
    return {
        Metric.ABSOLUTE: lambda: abs(e - t),
        Metric.RELATIVE: lambda: abs(e - t) / (C + t),
        Metric.QUADRATIC: lambda: (e - t) ** 2,
        Metric.SQUARED_Q: lambda: (math.log(C + t) - math.log(C + e)) ** 2,
        Metric.SQUARED_RELATIVE: lambda: ((t - e) / (C + t)) ** 2,
    }[metric]()


def slope(metric: Metric, e: float, t: float) -> float:
    """d loss / d estimate. The squared-Q form is the analytic derivative of the loss above."""
    sign = (e > t) - (e < t)
    return {
        Metric.ABSOLUTE: lambda: float(sign),
        Metric.RELATIVE: lambda: sign / (C + t),
        Metric.QUADRATIC: lambda: 2 * (e - t),
        Metric.SQUARED_Q: lambda: 2 * (math.log(C + e) - math.log(C + t)) / (C + e),
        Metric.SQUARED_RELATIVE: lambda: 2 * (e - t) / (C + t) ** 2,
    }[metric]()
