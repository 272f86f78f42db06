"""Random forests grown level by level: one pass over the binned rows gives the class counts of all open nodes of all trees.

Rows are binned once (32 bins a feature, cut at quantiles of all rows) and written in blocks of a byte a feature. In a pass each
task draws every tree's bootstrap of its blocks (Poisson, seeded by tree and block), follows the tree and counts classes by node, drawn
feature and bin; counts are added up and the best split chosen in a group a tree. Nodes are opened in such portions that a
task's counts stay below ``COUNT_BYTES``. What reaches the driver is the model, a row a node. The result is MLlib's own forest
model: weighted Gini impurity, leaves of a split that decides nothing merged, stored in MLlib's format and loaded by it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import ceil, log2, sqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, shared_folder

BINS = 32
BLOCK_ROWS = 16_384
ROWS_AT_ONCE = 131_072
COUNT_BYTES = 128 << 20
_DRAWS = 65_536


def cuts(rows: DataFrame, inputs: Sequence[str]) -> list[np.ndarray]:
    """Values at which each feature may be split: ``BINS - 1`` quantiles, the smallest value first."""
    found = rows.approxQuantile(list(inputs), [i / (BINS - 1) for i in range(BINS - 1)], 1 / (8 * BINS))
    return [np.unique(np.array(f, float)) for f in found]


def binned(rows: DataFrame, inputs: Sequence[str], label: str, at: list[np.ndarray]) -> DataFrame:
    """A written table (block, bins, labels): the bins feature by feature, a byte each. A null or non-finite feature is an error."""
    def pack(number: int, table: np.ndarray) -> pa.RecordBatch:
        if not np.isfinite(table).all():
            raise ValueError("null or non-finite values in the features")
        bins = np.array([np.searchsorted(cut, table[:, i], "left") for i, cut in enumerate(at)], np.uint8)
        return pa.RecordBatch.from_arrays([
            pa.array([number], pa.int64()), pa.array([bins.tobytes()], pa.binary()),
            pa.array([table[:, -1].astype(np.uint8).tobytes()], pa.binary())], names=["block", "bins", "labels"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            table = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            for k in range(0, len(table), BLOCK_ROWS):
                held.append(table[k: k + BLOCK_ROWS])
                n += len(held[-1])
                if n >= BLOCK_ROWS:
                    yield pack(number, np.concatenate(held))
                    number, held, n = number + 1, [], 0
        if n:
            yield pack(number, np.concatenate(held))

    blocks = rows.select(*inputs, label).mapInArrow(task, "block long, bins binary, labels binary")
    return cut_lineage(blocks.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism), "binned")


def drawn_features(strategy: str, width: int) -> int:
    """Features drawn for a node, as MLlib counts them."""
    known = {"auto": ceil(sqrt(width)), "sqrt": ceil(sqrt(width)), "log2": max(1, ceil(log2(width))), "onethird": ceil(width / 3), "all": width}
    if strategy in known:
        return known[strategy]
    return min(int(strategy), width) if strategy.isdigit() else max(1, ceil(float(strategy) * width))


def _bootstrap(seed: int, tree: int, block: int, n: int) -> np.ndarray:
    """How often each row of a block is drawn for a tree: Poisson with mean 1."""
    share = np.exp(-1) / np.cumprod([1.0, *range(1, 9)])
    times = np.searchsorted((np.cumsum(share) * _DRAWS).round(), np.arange(_DRAWS), "right").astype(np.uint8)
    return times[np.random.default_rng([seed, tree, block]).integers(0, _DRAWS, n, dtype=np.uint16)]


class Tree:
    """Nodes in the order of their making; the right child follows the left one. A leaf leads to itself."""

    def __init__(self):
        self.feature, self.bin, self.left, self.counts, self.gain = [], [], [], [], []

    def add(self, counts: np.ndarray) -> int:
        at = len(self.left)
        for values, v in zip((self.feature, self.bin, self.left, self.counts, self.gain), (0, 255, at, counts, -1.0)):
            values.append(v)
        return at

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return np.array(self.feature, np.int64), np.array(self.bin, np.uint8), np.array(self.left, np.int32)


def _drawn(seed: int, tree: int, nodes: np.ndarray, k: int, width: int) -> np.ndarray:
    """Nodes x k: the features of each node."""
    return np.array([np.random.default_rng([seed, 1, tree, int(n)]).permutation(width)[:k] for n in nodes])


def _level(blocks: DataFrame, trees: dict[int, Tree], opened: dict[int, np.ndarray], width: int, classes: int, weights: np.ndarray,
           k: int, depth: int, min_rows: int, seed: int) -> list:
    """The best split of every open node: (tree, slot, feature, bin, gain, rows of each class left and right)."""
    spark = blocks.sparkSession
    plan = {}
    for t, nodes in opened.items():
        slots = np.full(len(trees[t].left), -1, np.int32)
        slots[nodes] = np.arange(len(nodes))
        plan[t] = (*trees[t].table(), slots, _drawn(seed, t, nodes, k, width))
    shared = spark.sparkContext.broadcast(plan)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {t: np.zeros((k, len(p[4]) * BINS * classes), np.int64 if len(p[4]) < 64 else np.int32) for t, p in shared.value.items()}

        def add(part: list) -> None:
            codes = np.concatenate([b for _, b, _ in part], axis=1)
            labels = np.concatenate([y for _, _, y in part]).astype(np.int64)
            n, flat = codes.shape[1], codes.ravel()
            for t, (feature, split, left, slots, drawn) in shared.value.items():
                times = np.concatenate([_bootstrap(seed, t, block, len(y)) for block, _, y in part])
                row = np.flatnonzero(times)
                at, start = np.zeros(len(row), np.int32), feature * n
                for _ in range(depth):
                    at = left[at] + (flat[start[at] + row] > split[at])
                slot = slots[at]
                if (slot < 0).any():
                    row, slot = row[slot >= 0], slot[slot >= 0]
                often, cell = times[row].astype(float), slot.astype(np.int64) * (BINS * classes) + labels[row]
                for j in range(k):
                    found = flat[(drawn[:, j] * n)[slot] + row].astype(np.int64)
                    totals[t][j] += np.bincount(cell + found * classes, often, totals[t].shape[1]).astype(totals[t].dtype)

        part, n = [], 0
        for batch in batches:
            for block, bins, labels in zip(batch.column("block").to_pylist(), batch.column("bins"), batch.column("labels")):
                part.append((block, np.frombuffer(bins.as_buffer(), np.uint8).reshape(width, -1), np.frombuffer(labels.as_buffer(), np.uint8)))
                n += len(part[-1][2])
                if n >= ROWS_AT_ONCE:
                    add(part)
                    part, n = [], 0
        if part:
            add(part)
        for t, total in totals.items():
            small = total.astype(np.min_scalar_type(int(total.max())))
            yield pa.RecordBatch.from_arrays([pa.array([t], pa.int32()), pa.array([small.dtype.str]), pa.array([small.tobytes()], pa.binary())],
                                             names=["tree", "kind", "counts"])

    def choose(group: pa.Table) -> pa.Table:
        t = group.column("tree")[0].as_py()
        drawn = shared.value[t][4]
        total = np.zeros(k * len(drawn) * BINS * classes, np.int64)
        for kind, counts in zip(group.column("kind").to_pylist(), group.column("counts")):
            total += np.frombuffer(counts.as_buffer(), np.dtype(kind))
        before = total.reshape(k, len(drawn), BINS, classes).transpose(1, 0, 2, 3).cumsum(axis=2)
        whole = before[:, :, -1:]
        after = whole - before

        def mass(n: np.ndarray) -> np.ndarray:
            return (n * weights).sum(axis=-1)

        def impure(n: np.ndarray) -> np.ndarray:
            """Weight times Gini impurity."""
            w = mass(n)
            return w - ((n * weights) ** 2).sum(axis=-1) / np.where(w > 0, w, 1.0)

        gain = (impure(whole) - impure(before) - impure(after)) / np.maximum(mass(whole), 1e-300)
        gain[(before.sum(axis=-1) < min_rows) | (after.sum(axis=-1) < min_rows)] = -1.0
        best = gain.reshape(len(drawn), -1).argmax(axis=1)
        j, b, s = best // BINS, best % BINS, np.arange(len(drawn))
        return pa.table({"tree": pa.array(np.full(len(s), t), pa.int32()), "slot": pa.array(s, pa.int32()), "feature": pa.array(drawn[s, j], pa.int32()),
                         "bin": pa.array(b, pa.int32()), "gain": pa.array(gain[s, j, b]),
                         "before": pa.array(before[s, j, b].tolist(), pa.list_(pa.int64())), "after": pa.array(after[s, j, b].tolist(), pa.list_(pa.int64()))})

    counted = blocks.mapInArrow(count, "tree int, kind string, counts binary")
    found = counted.groupBy("tree").applyInArrow(
        choose, "tree int, slot int, feature int, bin int, gain double, before array<bigint>, after array<bigint>").toArrow().to_pylist()
    shared.destroy()
    return found


def grow(blocks: DataFrame, width: int, classes: int, weights: Sequence[float], trees: int, max_depth: int, min_rows: int, k: int, seed: int) -> list[Tree]:
    """All trees of a forest over ``binned`` rows."""
    made, weights, portion = {t: Tree() for t in range(trees)}, np.array(weights, float), max(1, COUNT_BYTES // (k * BINS * classes * 4))
    for tree in made.values():
        tree.add(np.zeros(classes, np.int64))
    opened = [(t, 0) for t in made]
    for depth in range(max_depth):
        following = []
        for first in range(0, len(opened), portion):
            nodes: dict[int, list[int]] = {}
            for t, at in opened[first: first + portion]:
                nodes.setdefault(t, []).append(at)
            found = _level(blocks, made, {t: np.array(n) for t, n in nodes.items()}, width, classes, weights, k, depth, max(min_rows, 1), seed)
            for r in found:
                t, tree = r["tree"], made[r["tree"]]
                at, sides = nodes[t][r["slot"]], [np.array(r["before"]), np.array(r["after"])]
                if not at:
                    tree.counts[0] = sides[0] + sides[1]
                if r["gain"] <= 0:
                    continue
                left, right = (tree.add(n) for n in sides)
                tree.feature[at], tree.bin[at], tree.left[at], tree.gain[at] = r["feature"], r["bin"], left, r["gain"]
                following += [(t, child) for child, n in zip((left, right), sides) if np.count_nonzero(n) > 1 and n.sum() > 1]
        opened = sorted(following)
        if not opened:
            break
    if not max_depth:
        raise ValueError("a forest needs a depth of 1 at least")
    return list(made.values())


def _stored(trees: list[Tree], at: list[np.ndarray], weights: np.ndarray) -> pa.Table:
    """The nodes as MLlib stores them; two leaves with one prediction become one, as MLlib does."""
    rows = []
    for t, tree in enumerate(trees):
        n = len(tree.left)
        stats = np.array(tree.counts) * weights
        said, inner = stats.argmax(axis=1), [left != i for i, left in enumerate(tree.left)]
        for i in range(n - 1, -1, -1):  # children stand behind their parent
            if inner[i] and not inner[tree.left[i]] and not inner[tree.left[i] + 1] and said[tree.left[i]] == said[tree.left[i] + 1]:
                inner[i], said[i] = False, said[tree.left[i]]
        kept = [0]
        for i in kept:
            if inner[i]:
                kept += [tree.left[i], tree.left[i] + 1]
        number = {i: m for m, i in enumerate(kept)}
        for i in kept:
            w = float(stats[i].sum())
            rows.append({"treeID": t, "nodeData": {
                "id": number[i], "prediction": float(said[i]), "impurity": 1.0 - float((stats[i] ** 2).sum()) / w ** 2 if w > 0 else 0.0,
                "impurityStats": stats[i].tolist(), "rawCount": int(sum(tree.counts[i])), "gain": float(tree.gain[i]) if inner[i] else -1.0,
                "leftChild": number[tree.left[i]] if inner[i] else -1, "rightChild": number[tree.left[i] + 1] if inner[i] else -1,
                "split": {"featureIndex": tree.feature[i] if inner[i] else -1, "numCategories": -1,
                          "leftCategoriesOrThreshold": [float(at[tree.feature[i]][tree.bin[i]])] if inner[i] else []}}})
    split = pa.struct([("featureIndex", pa.int32()), ("leftCategoriesOrThreshold", pa.list_(pa.float64())), ("numCategories", pa.int32())])
    node = pa.struct([("id", pa.int32()), ("prediction", pa.float64()), ("impurity", pa.float64()), ("impurityStats", pa.list_(pa.float64())),
                      ("rawCount", pa.int64()), ("gain", pa.float64()), ("leftChild", pa.int32()), ("rightChild", pa.int32()), ("split", split)])
    return pa.Table.from_pylist(rows, pa.schema([("treeID", pa.int32()), ("nodeData", node)]))


def as_model(spark: SparkSession, estimator: RandomForestClassifier, trees: list[Tree], at: list[np.ndarray], weights: np.ndarray) -> RandomForestClassificationModel:
    """MLlib's model of the trees: one that it fits on a row a class lends its parameters, ours its nodes."""
    given = spark.createDataFrame([(Vectors.dense([float(y)] * len(at)), float(y), 1.0) for y in range(len(weights))],
                                  [estimator.getFeaturesCol(), estimator.getLabelCol(), estimator.getWeightCol()])
    lent, own = shared_folder(spark, "forest"), shared_folder(spark, "forest")
    estimator.copy({estimator.maxDepth: 1}).fit(given).write().save(lent)
    spark.read.text(f"{lent}/metadata").coalesce(1).write.text(f"{own}/metadata")
    spark.read.parquet(f"{lent}/treesMetadata").write.parquet(f"{own}/treesMetadata")
    spark.createDataFrame(_stored(trees, at, weights)).write.parquet(f"{own}/data")
    model = RandomForestClassificationModel.load(own)
    model.set(model.maxDepth, estimator.getMaxDepth())
    return model


def fit(estimator: RandomForestClassifier, rows: DataFrame, inputs: Sequence[str], label: str, weights: Sequence[float]) -> RandomForestClassificationModel:
    """Fit with the estimator's parameters; ``weights`` of the classes 0, 1, ..."""
    at = cuts(rows, inputs)
    blocks = binned(rows, inputs, label, at)
    k = drawn_features(estimator.getFeatureSubsetStrategy(), len(at))
    trees = grow(blocks, len(at), len(weights), weights, estimator.getNumTrees(), estimator.getMaxDepth(),
                 estimator.getMinInstancesPerNode(), k, estimator.getSeed())
    return as_model(rows.sparkSession, estimator, trees, at, np.array(weights, float))
