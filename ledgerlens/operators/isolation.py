"""Isolation forest on one column.

A tree over one column only cuts the number line, so it is a step function from
value to path length, and a whole forest is one step function with a bounded number
of steps (trees x sample size). Trees grow in parallel tasks on bounded samples;
scoring is one vectorised binary search per Arrow batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# ---- fixed values ---------------------------------------------------------------
TREES, SAMPLE, CONTAMINATION, SEED = 100, 256, 0.1, 42


def _mean_depth(n: int) -> float:
    """Mean depth of an unsuccessful search in a binary tree of n keys."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _grow(values: np.ndarray, rng: np.random.Generator, depth: int, limit: int) -> Iterator[tuple[float, float]]:
    """(left edge, path length) of the leaves from left to right; the first edge is -inf."""
    lo, hi = values.min(), values.max()
    if depth >= limit or len(values) <= 1 or lo == hi:
        yield -np.inf, depth + _mean_depth(len(values))
        return
    cut = rng.uniform(lo, hi)
    left, right = values[values <= cut], values[values > cut]
    if not len(left) or not len(right):
        yield -np.inf, depth + _mean_depth(len(values))
        return
    yield from _grow(left, rng, depth + 1, limit)
    for i, (edge, path) in enumerate(_grow(right, rng, depth + 1, limit)):
        yield (cut if i == 0 else edge), path


@dataclass
class IsolationScores:
    score: Column
    is_outlier: Column
    threshold: float


def _sampled(df: DataFrame, column: str, trees: int, sample: int, seed: int) -> DataFrame:
    """About ``sample`` rows for each tree, at most; the sample size does not grow with the data.

    Rows are drawn by a hash of all their columns, so the sample does not depend on partitions.
    """
    rows = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"), F.xxhash64(*df.columns).alias("k"))
    n = rows.count()
    share = min(1.0, 2.0 * trees * sample / max(n, 1))
    copies = 1 if share < 1 else int(min(trees, -(-2 * trees * sample // max(n, 1))))
    whole = 1 << 40
    picked = rows.filter(F.pmod(F.xxhash64("k", F.lit(seed)), F.lit(whole)) < int(share * whole)).withColumn(
        "copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))

    def drawn(salt):
        return F.xxhash64("k", "copy", F.lit(salt))

    keyed = picked.select("x", F.pmod(drawn(seed + 1), F.lit(trees)).cast("int").alias("tree"), drawn(seed + 2).alias("r"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy("r", "x"))
    return keyed.withColumn("rank", rank).filter(F.col("rank") <= sample).select("tree", "x")


def isolation_scores(df: DataFrame, column: str, trees: int = TREES, sample: int = SAMPLE,
                     contamination: float = CONTAMINATION, seed: int = SEED) -> IsolationScores:
    """Anomaly score of a column and the mask of its top ``contamination`` share."""
    limit = int(np.ceil(np.log2(max(sample, 2))))

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rng = np.random.default_rng([seed, int(key[0])])
        leaves = list(_grow(pdf["x"].to_numpy(), rng, 0, limit))
        return pd.DataFrame({
            "tree": int(key[0]), "edge": [e for e, _ in leaves], "path": [p for _, p in leaves],
            "rows": len(pdf),
        })

    layout = "tree int, edge double, path double, rows int"
    leaves = _sampled(df, column, trees, sample, seed).groupBy("tree").applyInPandas(grow, layout).toPandas()
    grown = leaves["tree"].nunique()
    edges, paths = _forest_steps(leaves)
    norm = _mean_depth(int(leaves.groupby("tree")["rows"].first().mean())) or 1.0
    scores = np.power(2.0, -(paths / grown) / norm)
    score = _step_value(F.col(column).cast("double"), edges, scores)
    # as many distinct scores as steps, whatever the size of the data
    held = df.filter(F.col(column).isNotNull()).groupBy(score.alias("s")).agg(F.count("*").alias("n")).collect()
    threshold = _weighted_quantile([(r["s"], r["n"]) for r in held], 1 - contamination)
    return IsolationScores(score, score > threshold, threshold)


def _forest_steps(leaves: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sum of the trees' step functions: right-open intervals after each edge, equal
    neighbours merged."""
    change = leaves.sort_values(["tree", "edge"])
    change["delta"] = change["path"] - change.groupby("tree")["path"].shift(1, fill_value=0.0)
    total = change.groupby("edge")["delta"].sum().sort_index().cumsum()
    return total.index.to_numpy()[1:], total.to_numpy()


def _step_value(x: Column, edges: np.ndarray, values: np.ndarray) -> Column:
    """Value of the step function at ``x``; null stays null."""
    @F.pandas_udf("double")
    def at(v: pd.Series) -> pd.Series:
        found = pd.Series(values[np.searchsorted(edges, v.to_numpy(), side="left")])
        return found.where(v.notna().to_numpy())

    return at(x)


def _weighted_quantile(pairs: list[tuple[float, int]], q: float) -> float:
    pairs = sorted(pairs)
    total = sum(n for _, n in pairs)
    target, seen = q * (total - 1), 0
    for value, n in pairs:
        seen += n
        if target < seen:
            return float(value)
    return float(pairs[-1][0]) if pairs else float("nan")
