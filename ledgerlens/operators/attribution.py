"""Additive per-row attribution of tree models, along the paths of their exported node tables.

For a leaf, each feature on its path has a share: of the training weight that takes the leaf's side at every split on the
feature (what is expected when the feature is unknown), and of the row (0 or 1). The polynomial of these shares is extended by
one feature after the other and unwound by each in turn; weighing its coefficients gives the feature's part of the leaf's value.
Rows that agree on which features lead to a leaf share one entry of a table. The parts of all leaves add up, with the base value
(the expectation without any feature), to the model's margin.

The node tables are as large as the model, whatever the data: they are read on the driver and broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cache
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

_CODES = 12  # path features up to here are told apart by one number, for which a table holds the parts


@cache
def _gauss(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Points and weights of an integral from 0 to 1."""
    point, weight = np.polynomial.legendre.leggauss(n)
    return (point + 1) / 2, weight / 2


@dataclass
class Leaf:
    """A leaf's value in the margin, and of each feature on its path the share of weight and the side taken."""

    value: float
    features: np.ndarray
    share: np.ndarray
    rules: list[list[tuple]]  # of each feature: (threshold or categories, whether the path goes left)

    def agrees(self, x: np.ndarray, known: dict | None = None) -> np.ndarray:
        """Rows x features: whether the row's value takes the leaf's side. ``known`` keeps the sides of the rows at each split,
        which the leaves of all trees share."""
        known = {} if known is None else known
        out = np.ones((len(self.features), len(x)), dtype=bool)
        for j, (f, rules) in enumerate(zip(self.features.tolist(), self.rules)):
            for split, left in rules:
                if (f, split) not in known:
                    goes = np.isin(x[:, f], list(split)) if isinstance(split, frozenset) else x[:, f] <= split  # NaN goes right
                    known[f, split] = (~goes, goes)
                out[j] &= known[f, split][left]
        return out.T

    def table(self) -> np.ndarray:
        """Features x codes: the parts for every way to agree, bit ``j`` of the code for feature ``j``. The weights of the
        coefficients are integrals of ``t^k (1 - t)^(m - 1 - k)``, so a sum over Gauss points in place of ``parts``' unwinding is exact."""
        m, z = len(self.features), self.share
        t, weight = _gauss(m // 2 + 1)
        factor = (1 - t) * z[:, None, None] + t * np.array([[0.0], [1.0]])  # features x agreeing x points
        path = (self.value * weight)[:, None]
        for j in range(m):
            path = np.concatenate([path * factor[j, 0][:, None], path * factor[j, 1][:, None]], axis=1)
        side = (np.array([[0.0], [1.0]]) - z[:, None, None]) / factor
        out = np.empty((m, 1 << m))
        for j in range(m):
            out[j] = np.einsum("qhol,oq->hol", path.reshape(len(t), -1, 2, 1 << j), side[j]).ravel()
        return out

    def parts(self, agrees: np.ndarray) -> np.ndarray:
        """The features' parts of the value for rows (any number) that agree as given."""
        n, m = agrees.shape
        one = agrees.astype(np.float64)
        path = np.zeros((n, m + 1))
        path[:, 0] = 1.0
        for j in range(m):  # extend: times (share + one * t)
            path[:, 1:j + 2] = path[:, 1:j + 2] * self.share[j] + path[:, :j + 1] * one[:, j:j + 1]
            path[:, 0] *= self.share[j]
        weight = np.array([factorial(k) * factorial(m - 1 - k) / factorial(m) for k in range(m)])
        out = np.zeros((n, m))
        for j in range(m):  # unwind: divided by (share + one * t)
            z, on = self.share[j], agrees[:, j]
            left = np.zeros((n, m))
            left[:, m - 1] = path[:, m]
            for k in range(m - 1, 0, -1):
                left[:, k - 1] = path[:, k] - z * left[:, k]
            if z > 0:
                left[~on] = path[~on, :m] / z
            out[:, j] = self.value * (one[:, j] - z) * (left @ weight)
        return out


@dataclass
class Ensemble:
    """All leaves of a model, and the base value."""

    leaves: list[Leaf]
    base: float
    width: int

    def contributions(self, x: np.ndarray) -> np.ndarray:
        out, known = np.zeros((self.width, len(x))), {}
        x = np.asfortranarray(x)
        for leaf in self.leaves:
            m = len(leaf.features)
            if not m:
                continue
            agrees = leaf.agrees(x, known)
            if m <= _CODES and leaf.share.min() > 0:
                code = np.zeros(len(x), np.uint16)
                for j in range(m):
                    code |= agrees[:, j].astype(np.uint16) << np.uint16(j)
                code = code.astype(np.intp)
                for f, part in zip(leaf.features, leaf.table()):
                    out[f] += part.take(code)
            else:
                out[leaf.features] += leaf.parts(agrees).T
        return out.T


def _leaves(nodes: dict[int, dict], value, scale: float) -> tuple[list[Leaf], float]:
    """The leaves below node 0 and the expected value; ``value`` of a leaf's row, times ``scale``."""
    def weight(node: dict) -> float:
        return node["weight"]

    out, base, stack = [], 0.0, [(0, 1.0, {})]
    while stack:
        at, reach, path = stack.pop()
        node = nodes[at]
        if node["left"] < 0:
            v = scale * value(node)
            base += v * reach
            used = sorted(path)
            out.append(Leaf(v, np.array(used, dtype=int), np.array([path[f][0] for f in used]), [path[f][1] for f in used]))
            continue
        for child, left in ((node["left"], True), (node["right"], False)):
            share = weight(nodes[child]) / weight(node) if weight(node) > 0 else 0.0
            before, rules = path.get(node["feature"], (1.0, []))
            stack.append((child, reach * share, {**path, node["feature"]: (before * share, [*rules, (node["split"], left)])}))
    return out, base


def _node(row) -> dict:
    split, stats = row["split"], list(row["impurityStats"])
    rule = split["leftCategoriesOrThreshold"]
    return {"left": row["leftChild"], "right": row["rightChild"], "feature": split["featureIndex"], "stats": stats, "prediction": row["prediction"],
            "split": (rule[0] if split["numCategories"] == -1 else frozenset(rule)) if row["leftChild"] >= 0 else None}


def export(spark: SparkSession, core, kind: str, width: int) -> Ensemble:
    """The paths of a fitted forest (margin: the probability of class 1) or boosted model (margin: half the log-odds)."""
    folder = shared_folder(spark, "trees")
    core.write().save(folder)
    trees: dict[int, dict[int, dict]] = {}
    for r in spark.read.parquet(f"{folder}/data").select("treeID", "nodeData.*").collect():  # as large as the model
        node = _node(r)
        # the training weight: classes of a classification tree, or the first of (weight, sum, sum of squares)
        node["weight"] = sum(node["stats"]) if kind == "forest" else node["stats"][0]
        trees.setdefault(r["treeID"], {})[r["id"]] = node
    if kind == "forest":
        scales = [1.0 / len(trees)] * len(trees)
    else:
        scales = list(core.treeWeights)

    def value(node: dict) -> float:
        if kind != "forest":
            return node["prediction"]
        return node["stats"][1] / node["weight"] if node["weight"] > 0 else 0.0

    leaves, base = [], 0.0
    for t in sorted(trees):
        own, expected = _leaves(trees[t], value, scales[t])
        leaves, base = leaves + own, base + expected
    return Ensemble(leaves, base, width)


def contributions(spark: SparkSession, ensemble: Ensemble, features: Sequence[Column]) -> Column:
    """An array with the part of each feature in the margin of the row."""
    shared = spark.sparkContext.broadcast(ensemble)

    @F.arrow_udf("array<double>")
    def parts(values: pa.Array) -> pa.Array:
        width = shared.value.width
        x = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), width)
        found = shared.value.contributions(x)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(found).ravel()))

    return parts(F.array(*[F.coalesce(c.cast("double"), F.lit(float("nan"))) for c in features]))


def attribute(df: DataFrame, core, kind: str, features: Sequence[str]) -> DataFrame:
    """Add ``base_value`` and ``contributions`` (feature to part); together they give the margin."""
    spark = df.sparkSession
    ensemble = export(spark, core, kind, len(features))
    df = df.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))  # a row's work is that of all leaves
    found = contributions(spark, ensemble, [F.col(c) for c in features])
    named = F.map_from_arrays(F.array(*[F.lit(c) for c in features]), found)
    return df.withColumns({"base_value": F.lit(ensemble.base), "contributions": named})
