"""Keeping the sample fresh: karma of points and the replacement strategies."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, functions as F

from quern.kde.model import Model, _erf
from quern.kde.ranges import Range


def karma_column(contribution, estimate, truth, s: int, karma, limit: float = 4.0, squared: bool = False) -> Column:
    """New karma of a point: how much better the estimate is with it than without, summed, capped."""
    c, e, t, k = (x if isinstance(x, Column) else F.col(x) for x in (contribution, estimate, truth, karma))
    without = (e * s - c) / (s - 1)
    gain = (without - t) * (without - t) - (e - t) * (e - t) if squared else F.abs(without - t) - F.abs(e - t)
    return F.least(k + gain * s, F.lit(limit))


def update_karma(model: Model, ranges: list[Range], truth: float, limit: float = 4.0, squared: bool = False) -> None:
    c, s = model.contributions(ranges), len(model.points)
    e = c.mean()
    without = (e * s - c) / max(s - 1, 1)
    gain = (without - truth) ** 2 - (e - truth) ** 2 if squared else np.abs(without - truth) - abs(e - truth)
    model.karma = np.minimum(model.karma + s * gain, limit)


def replace(model: Model, slots: np.ndarray, rows: np.ndarray) -> None:
    """Put raw rows into the slots with fresh karma."""
    n = min(len(slots), len(rows))
    model.points[slots[:n]] = (rows[:n] - model.mean) / model.sd
    model.karma[slots[:n]] = 0.0


def tkr_slots(model: Model, threshold: float = -2.0, ranges: list[Range] | None = None, truth: float | None = None) -> np.ndarray:
    """Points under the karma threshold; where nothing qualified, also those that contribute more than any point outside the ranges could.

    A point outside lies beyond one bound at least. Its contribution is largest on a side's middle: there the factor of
    that dimension is erf(w / (sqrt(2) h)) / 2 for a side of width w, and that of each other one is the largest of all,
    erf(w / (2 sqrt(2) h)), 1 without bounds. Where no dimension is bounded there is no outside, and nothing to evict.
    """
    bad = model.karma < threshold
    if truth == 0 and ranges is not None:
        lo, hi = model.standard(ranges)
        h, w = model.h(), hi - lo
        with np.errstate(invalid="ignore"):
            full, half = _erf(w / (np.sqrt(2) * h)), _erf(w / (2 * np.sqrt(2) * h))
        # a side with one bound has its largest factor far from it, and half of that on the bound
        half, full = np.where(np.isfinite(w), half, 1.0), np.where(np.isfinite(w), full, 1.0)
        sided = np.isfinite(lo) | np.isfinite(hi)
        if sided.any():
            ratio = np.max(np.where(sided, full / np.maximum(2 * half, 1e-300), 0.0))
            bad |= model.contributions(ranges) > half.prod() * ratio + 1e-12
    return np.flatnonzero(bad)


def pkr_slot(model: Model) -> np.ndarray:
    return np.array([int(np.argmin(model.karma))])


def prr_slot(model: Model, rng: np.random.Generator) -> np.ndarray:
    return rng.integers(0, len(model.points), 1)


def floyd(n: int, k: int, rng: np.random.Generator) -> list[int]:
    """k distinct numbers below n, by Floyd's method."""
    out: set[int] = set()
    for j in range(n - k, n):
        t = int(rng.integers(0, j + 1))
        out.add(j if t in out else t)
    return sorted(out)


def car_insert(model: Model, row: np.ndarray, rng: np.random.Generator) -> None:
    """An inserted row takes Binomial(s, 1/N) distinct slots, N counting it."""
    model.rows += 1
    k = int(rng.binomial(len(model.points), 1 / model.rows))
    for slot in floyd(len(model.points), k, rng):
        replace(model, np.array([slot]), row[None, :])


def slots_of(model: Model, row: np.ndarray) -> np.ndarray:
    """Slots that hold exactly this raw row."""
    return np.flatnonzero((np.abs(model.points - (row - model.mean) / model.sd) <= 1e-9).all(1))


def car_batch(model: Model, inserted: int, deleted: int, hit: np.ndarray, rng: np.random.Generator, new_rows, fresh) -> np.ndarray:
    """A batch of changes at once; returns the slots that were given other rows.

    Each slot of a uniform sample of the table with its new rows holds one of these with probability inserted / all, so one
    Binomial says how many slots change and new_rows(k) gives k of the inserted rows. Slots that hit names (of deleted
    rows) and that weren't changed get fresh(k) rows of the table after the batch; fewer rows repeat.
    """
    before = model.rows
    model.rows = before + inserted
    k = int(rng.binomial(len(model.points), inserted / model.rows)) if inserted and model.rows > 0 else 0
    taken = rng.choice(len(model.points), k, replace=False) if k else np.empty(0, np.int64)
    if k:
        rows = new_rows(k)
        replace(model, taken, rows[np.arange(k) % len(rows)])
    model.rows -= deleted
    lost = np.setdiff1d(hit, taken)
    if len(lost):
        rows = fresh(len(lost))
        if len(rows):
            replace(model, lost, rows[np.arange(len(lost)) % len(rows)])
        else:
            model.points, model.karma = np.delete(model.points, lost, 0), np.delete(model.karma, lost)
    return np.concatenate([taken, lost])


def car_delete(model: Model, row: np.ndarray, fresh) -> int:
    """Slots that hold exactly the deleted row get fresh rows from fresh(n)."""
    model.rows -= 1
    at = np.flatnonzero(np.abs(model.points[:, 0] - (row[0] - model.mean[0]) / model.sd[0]) <= 1e-9)
    hit = at[(np.abs(model.points[at] - (row - model.mean) / model.sd) <= 1e-9).all(1)]
    if len(hit):
        replace(model, hit, fresh(len(hit)))
    return len(hit)
