"""EXPLAIN with learned row estimates, and EXPLAIN ANALYZE by observation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F

from quern.kde import ranges as R
from quern.kde.baselines import constant
from quern.kde.model import Model


def estimate_rows(model: Model, clauses: list[tuple]) -> float:
    """Joint selectivity of the range clauses times fallbacks for the others, in rows."""
    found, rest = R.extract(clauses, strict=False)
    if found is None:
        return 0.0
    known = [r for r in found if r.col in model.columns]
    other = [r for r in found if r.col not in model.columns]
    sel = (model.estimate(known) if known else 1.0) * constant(other) * (1 / 3) ** len(rest)
    return sel * model.rows


def explain(df: DataFrame, model: Model, clauses: list[tuple], analyze: bool = False) -> str:
    found, _ = R.extract(clauses, strict=False)
    q = df.where(R.predicate(found or []))
    line = f"rows={estimate_rows(model, clauses):.0f}"
    if analyze:
        o = Observation()
        q.observe(o, F.count("*").alias("n")).write.format("noop").mode("overwrite").save()
        line += f" actual={o.get['n']}"
    return line + "\n" + q._sc._jvm.PythonSQLUtils.explainString(q._jdf.queryExecution(), "formatted")
