"""Query workloads: centres from the data (D) or uniform (U), sizes by volume (V) or by tuples (T), and moving targets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from quern.kde.ranges import Range


def generate(df: DataFrame, columns: list[str], kind: str, n: int, selectivity: float = 0.01, tolerance: float = 0.01, seed: int = 1, sample: int = 4000) -> list[list[Range]]:
    """kind: dv, uv, dt, ut or rnd. Tuple sizes are met on a bounded sample, by bisection of the scale."""
    rng = np.random.default_rng(seed)
    b = df.agg(*(F.min(c) for c in columns), *(F.max(c) for c in columns)).first()
    d = len(columns)
    lo, hi = np.array(b[:d], float), np.array(b[d:], float)
    rows = np.array([[float(x) for x in r] for r in df.select(*columns).orderBy(F.rand(seed)).limit(sample).collect()], float)
    out = []
    for _ in range(n):
        k = kind if kind != "rnd" else str(rng.choice(["dv", "uv", "dt", "ut"]))
        target = selectivity if kind != "rnd" else max(0.001, selectivity + rng.uniform(-0.09, 0.09))
        c = rows[rng.integers(len(rows))] if k[0] == "d" else rng.uniform(lo, hi)
        shape = rng.dirichlet(np.ones(d)) * d
        if k[1] == "v":
            half = (hi - lo) * target ** (1 / d) / 2
        else:
            small, large = 0.0, 2.0
            for _ in range(40):
                mid = (small + large) / 2
                got = (np.abs(rows - c) <= (hi - lo) * shape * mid).all(1).mean()
                if abs(got - target) <= tolerance * target:
                    break
                small, large = (mid, large) if got < target else (small, mid)
            half = (hi - lo) * shape * mid
        out.append([Range(col, float(c[i] - half[i]), False, float(c[i] + half[i]), False) for i, col in enumerate(columns)])
    return out


def truth(df: DataFrame, queries: list[list[Range]]) -> list[int]:
    """True counts of a workload, all in one scan."""
    from quern.kde.ranges import predicate

    return list(df.agg(*(F.count_if(predicate(q)).alias(f"q{i}") for i, q in enumerate(queries))).first())


def moving_target(d: int, steps: int, per_step: int, delete: bool, seed: int = 1):
    """(op, row) changes of a cluster that moves along the diagonal; with delete, old clusters go."""
    rng = np.random.default_rng(seed)
    held: list[np.ndarray] = []
    for s in range(steps):
        rows = rng.normal(s / max(steps - 1, 1), 0.05, (per_step, d))
        for r in rows:
            yield "insert", r
        held.append(rows)
        if delete and len(held) > 3:
            for r in held.pop(0):
                yield "delete", r
