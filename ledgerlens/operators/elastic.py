"""Elastic-net logistic regression for many penalties and folds at once.

All models of a search take their Newton steps together: one pass over the rows gives every model's loss, gradient and
curvature (added up per task, then per model), so a search costs a few dozen passes whatever the size of its grid. What
reaches the driver is a row a model. One model a fold is fitted first; the others start from it. The steps themselves (to the minimum of the penalised quadratic, halved until the
objective falls) work on these sums. The objective is MLlib's without standardisation: weighted mean log loss plus
``strength * (l1 * |b| + (1 - l1) / 2 * b^2)`` on the original scale, the intercept left out.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

ROWS_AT_ONCE = 4096
FEW_MODELS = 12  # up to so many, curvature is summed model by model
TOLERANCE = 1e-10


@dataclass
class Fits:
    """A row a model: coefficients on the original scale, intercepts, objective, whether its steps ended."""

    coefficients: np.ndarray
    intercepts: np.ndarray
    objective: np.ndarray
    converged: np.ndarray
    rounds: int


def _blocks(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(block): up to ``ROWS_AT_ONCE`` rows of doubles in one value, which reaches Python several times faster than the rows."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            for k in range(0, len(table), ROWS_AT_ONCE):
                yield pa.RecordBatch.from_arrays([pa.array([table[k: k + ROWS_AT_ONCE].tobytes()], pa.binary())], names=["block"])

    return rows.select(*columns).mapInArrow(task, "block binary")


def _sums(blocks: DataFrame, width: int, add) -> dict[int, np.ndarray]:
    """Sums of ``add(table, totals)`` over all blocks of ``width`` columns: arrays by model number."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for block in batch.column(0):
                add(np.frombuffer(block.as_buffer()).reshape(-1, width), totals)
        if totals:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(totals), pa.int32()), pa.array([t.tolist() for t in totals.values()], pa.list_(pa.float64()))], names=["model", "part"])

    parts = blocks.mapInArrow(task, "model int, part array<double>")
    total = parts.groupBy("model").agg(Summarizer.sum(array_to_vector("part")).alias("total"))
    return {r["model"]: r["total"].toArray() for r in total.collect()}  # one row a model


def _by_fold(table: np.ndarray, d: int, mean: np.ndarray, scale: np.ndarray):
    """Per fold of a table of features, label, weight, fold: scaled features with a last column of ones, labels, weights."""
    for fold in np.unique(table[:, d + 2]):
        part = table[table[:, d + 2] == fold]
        yield fold, np.column_stack([(part[:, :d] - mean) / scale, np.ones(len(part))]), part[:, d], part[:, d + 1]


def _descend(b: np.ndarray, g: np.ndarray, h: np.ndarray, l1: np.ndarray, l2: np.ndarray, turns: int = 300) -> np.ndarray:
    """Minimum of one model's penalised quadratic around ``b``, by signs: solve for the coefficients with their signs held,
    stop where one changes its sign, then let in the one that the penalty holds at 0 with the most slope beyond it."""
    n = len(b)
    a = h + np.diag(l2)
    a[np.arange(n), np.arange(n)] += 1e-10 * np.maximum(np.diag(a), 1e-4)
    c = g - h @ b  # the quadratic is c u + u a u / 2 + l1 |u|
    u, free = b.copy(), l1 == 0
    sign = np.where(free, 0.0, np.sign(u))

    def height(v: np.ndarray) -> float:
        return float(c @ v + v @ a @ v / 2 + l1 @ np.abs(v))

    low = height(u)
    for _ in range(turns):
        held = free | (sign != 0)
        goal = np.zeros(n)
        goal[held] = np.linalg.solve(a[np.ix_(held, held)], -(c + l1 * sign)[held])
        crossed = held & ~free & (goal * sign < 0) & (u != 0)
        cuts = np.unique(np.append(u[crossed] / (u[crossed] - goal[crossed]), 1.0))
        tries = []
        for t in cuts:
            v = u + t * (goal - u)
            v[crossed & (np.abs(u + t * (goal - u)) <= 1e-12 * np.abs(u - goal))] = 0
            tries.append((height(v), v))
        value, v = min(tries, key=lambda x: x[0])
        if value < low:
            moved, u, low = low - value, v, value
        else:
            moved = 0.0
        sign = np.where(free, 0.0, np.sign(u))
        if crossed.any() and moved > 1e-14:
            continue
        slope = c + a @ u
        excess = np.where(free | (u != 0), 0.0, np.abs(slope) - l1)
        j = int(np.argmax(excess))
        if excess[j] <= 1e-9:
            break
        sign[j] = -np.sign(slope[j])
    return u


def _leaders(strength: np.ndarray, without: np.ndarray) -> np.ndarray:
    """For every model the one of median strength among those that leave out the same fold: it is fitted first."""
    out = np.zeros(len(strength), int)
    for fold in np.unique(without):
        group = np.flatnonzero(without == fold)
        out[group] = group[np.argsort(strength[group], kind="stable")[len(group) // 2]]
    return out


def fit_all(rows: DataFrame, features: Sequence[str], label: str, weight: str, fold: str, strength: Sequence[float],
            l1_share: Sequence[float], without_fold: Sequence[int], most_rounds: int = 1000) -> Fits:
    """Fit model ``m`` with its penalty on the rows of all folds but ``without_fold[m]`` (-1: on all rows).

    ``rows`` is read twice and written as blocks, which are read once a round. Most rounds are those of the first models, one a fold. Features without spread get coefficient 0; a null or
    non-finite feature is an error; a model without rows stays at 0.
    """
    d, m = len(features), len(strength)
    first = rows.agg(*[F.avg(c) for c in features], *[F.stddev_pop(c) for c in features],
                     *[F.count_if(F.col(c).isNull() | ~F.col(c).between(-1.7e308, 1.7e308)) for c in features]).first()
    broken = [c for c, n in zip(features, first[2 * d:]) if n]
    if broken:
        raise ValueError(f"null or non-finite values in {broken}")
    mean, spread = (np.array([v or 0.0 for v in part], float) for part in (first[:d], first[d: 2 * d]))
    fixed = spread <= 1e-12 * np.maximum(np.abs(mean), 1)
    scale = np.where(fixed, 1.0, spread)
    strength, l1_share, without = np.array(strength, float), np.array(l1_share, float), np.array(without_fold)
    zero = np.zeros((m, 1))
    l1 = np.hstack([np.outer(strength * l1_share, 1 / scale), zero])
    l2 = np.hstack([np.outer(strength * (1 - l1_share), 1 / scale ** 2), zero])
    upper = np.triu_indices(d + 1)
    width = 2 + (d + 1) + len(upper[0])
    columns = [*features, label, weight, fold]
    blocks = cut_lineage(_blocks(rows, columns), "blocks")

    def penalty(u: np.ndarray) -> np.ndarray:
        return (l1 * np.abs(u) + l2 * u * u / 2).sum(axis=1)

    def evaluate(at: np.ndarray, live: np.ndarray):
        """Loss, gradient and curvature of the live models at ``at``; models at one point that leave out one fold are one."""
        numbers = np.flatnonzero(live)
        points, place = np.unique(np.column_stack([at[numbers], without[numbers]]), axis=0, return_inverse=True)
        at, left_out = points[:, :-1], points[:, -1]

        def add(table: np.ndarray, totals: dict[int, np.ndarray]) -> None:
            for f, x, y, w in _by_fold(table, d, mean, scale):
                mine = np.flatnonzero(left_out != f)
                if not len(mine):
                    continue
                x[:, :d][:, fixed] = 0
                weighted, real = x * w[:, None], w * y
                margin = x @ at[mine].T
                e = np.exp(-np.abs(margin))
                q = 1 / (1 + e)
                p, curve = np.where(margin >= 0, q, e * q), e * q * q
                loss = w @ (np.maximum(margin, 0) + np.log1p(e)) - real @ margin
                gradient = p.T @ weighted - real @ x
                if len(mine) > FEW_MODELS:
                    curved = curve.T @ (weighted[:, upper[0]] * x[:, upper[1]])
                else:
                    curved = np.array([((weighted * c[:, None]).T @ x)[upper] for c in curve.T])
                mass = w.sum()
                for k, n in enumerate(mine.tolist()):
                    part = np.concatenate([[mass, loss[k]], gradient[k], curved[k]])
                    totals[n] = totals[n] + part if n in totals else part

        found = _sums(blocks, len(columns), add)
        out = np.array([found.get(n, np.zeros(width)) for n in range(len(points))])[place.ravel()].reshape(len(numbers), width)
        mass = np.where(out[:, 0] > 0, out[:, 0], 1.0)[:, None]
        out = out[:, 1:] / mass
        h = np.zeros((len(numbers), d + 1, d + 1))
        h[:, upper[0], upper[1]] = h[:, upper[1], upper[0]] = out[:, d + 2:]
        h[:, np.arange(d)[fixed], np.arange(d)[fixed]] += 1.0  # keeps a feature without spread at 0
        return out[:, 0], out[:, 1: d + 2], h

    at = np.zeros((m, d + 1))
    trial, step, target, fall = at.copy(), np.ones(m), at.copy(), np.zeros(m)
    leader = _leaders(strength, without)
    objective, converged, rounds = np.full(m, np.inf), np.zeros(m, bool), 0
    live = leader == np.arange(m)
    waiting = ~live
    while (live.any() or waiting.any()) and rounds < most_rounds:
        if not live.any():  # the others start where the model ended that leaves out the same fold
            trial[waiting], live, waiting = at[leader[waiting]], waiting, np.zeros(m, bool)
        rounds += 1
        numbers = np.flatnonzero(live)
        loss, g, h = evaluate(trial, live)
        value = loss + penalty(trial)[numbers]
        better = value <= objective[numbers] + 1e-4 * step[numbers] * fall[numbers] + 1e-13  # the last digits of the sums vary
        took, back = numbers[better], numbers[~better]
        if len(took):
            at[took], objective[took], step[took] = trial[took], value[better], 1.0
            for k, n in zip(np.flatnonzero(better), took):
                target[n] = _descend(at[n], g[k], h[k], l1[n], l2[n])
            fall[took] = ((g[better] * (target[took] - at[took])).sum(axis=1) + penalty(target)[took] - penalty(at)[took])
            done = took[fall[took] > -TOLERANCE * np.maximum(1.0, np.abs(objective[took]))]
            converged[done], live[done] = True, False
        step[back] /= 4
        live[back[step[back] < 1e-9]] = False
        trial = at + step[:, None] * (target - at)
    coefficients = np.where(fixed, 0.0, at[:, :d] / scale)
    return Fits(coefficients, at[:, d] - coefficients @ mean, objective, converged, rounds)


def held_out_f1(rows: DataFrame, features: Sequence[str], label: str, fold: str, fits: Fits, without_fold: Sequence[int]) -> np.ndarray:
    """F1 of label 1 of every model on the fold it was not fitted on; 0 without true positives. One pass for all models."""
    d, without = len(features), np.array(without_fold)
    weights, intercepts = fits.coefficients, fits.intercepts

    def add(table: np.ndarray, totals: dict[int, np.ndarray]) -> None:
        for f in np.unique(table[:, d + 1]):
            part, mine = table[table[:, d + 1] == f], np.flatnonzero(without == f)
            if not len(mine):
                continue
            said, real = part[:, :d] @ weights[mine].T + intercepts[mine] > 0, part[:, d] == 1
            for k, n in enumerate(mine.tolist()):
                counts = np.array([(said[:, k] & real).sum(), (said[:, k] != real).sum()], float)
                totals[n] = totals[n] + counts if n in totals else counts

    found = _sums(_blocks(rows, [*features, label, fold]), d + 2, add)
    out = np.zeros(len(without))
    for n, (hits, misses) in found.items():
        out[n] = 2 * hits / (2 * hits + misses) if hits else 0.0
    return out
