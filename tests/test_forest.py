import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import forest, models

NAMES = ["x0", "x1", "x2"]


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 3)).round(1)
    x[:, 2] = x[:, 2] > 1.9  # a rare value
    return x, ((x[:, 0] > 0.2) ^ (rng.random(500) < 0.05)).astype(int)


@pytest.fixture(scope="module")
def rows(spark, table):
    return spark.createDataFrame([(i, int(y), *map(float, r)) for i, (r, y) in enumerate(zip(*table))],
                                 "tx_id long, isFraud int, " + ", ".join(f"{c} double" for c in NAMES)).repartition(3)


def nodes(trees):
    return [(t.feature, t.bin, t.left, [c.tolist() for c in t.counts]) for t in trees]


def test_splits_are_the_best_of_their_bootstrap(rows):
    at = forest.cuts(rows, NAMES)
    assert 0.0 in at[2]
    blocks = forest.binned(rows, NAMES, "isFraud", at).localCheckpoint()
    tree, = forest.grow(blocks, 3, 2, [1.0, 3.0], 1, 2, 5, 3, 7)
    n, cells = np.zeros(2), np.zeros((3, forest.BINS, 2))
    for b in blocks.collect():
        y = np.frombuffer(b.labels, np.uint8)
        times = forest._bootstrap(7, 0, b.block, len(y))
        for f, codes in enumerate(np.frombuffer(b.bins, np.uint8).reshape(3, -1)):
            np.add.at(cells[f], (codes, y), times)
        n += np.bincount(y, times, 2)
    assert tree.counts[0].tolist() == n.tolist()
    w = np.array([1.0, 3.0])

    def impure(c):
        return (c * w).sum() * (1 - (((c * w) / (c * w).sum()) ** 2).sum())

    found = {(f, b): impure(n) - impure(l) - impure(n - l) for f in range(3) for b in range(forest.BINS)
             if min((l := cells[f, :b + 1].sum(axis=0)).sum(), (n - l).sum()) >= 5}
    assert found[tree.feature[0], tree.bin[0]] == pytest.approx(max(found.values()))


def test_portions_of_nodes_give_the_same_trees(rows, monkeypatch):
    blocks = forest.binned(rows, NAMES, "isFraud", forest.cuts(rows, NAMES))
    at_once = forest.grow(blocks, 3, 2, [1.0, 1.0], 3, 4, 1, 2, 42)
    monkeypatch.setattr(forest, "COUNT_BYTES", 2 * 2 * forest.BINS * 2 * 4)
    by_portions = forest.grow(blocks, 3, 2, [1.0, 1.0], 3, 4, 1, 2, 42)
    a, b = ([sorted(map(str, t.counts)) for t in trees] for trees in (at_once, by_portions))
    assert a == b


def test_model_scores_by_its_trees(spark, rows, table):
    model = models.fit(models.Spec("forest", params={"trees": 20, "max_depth": 4}), rows, NAMES)
    assert model.core.getNumTrees == 20 and max(t.depth for t in model.core.trees) <= 4
    right = model(rows).agg(F.avg((F.col("fraud_prediction") == F.col("isFraud")).cast("double"))).first()[0]
    assert right > 0.9
    assert model.importance(spark, top=1).first().feature == "x0"


def test_missing_values_are_an_error(rows):
    with pytest.raises(Exception, match="null or non-finite"):
        forest.binned(rows.withColumn("x1", F.when(F.col("tx_id") != 3, F.col("x1"))), NAMES, "isFraud", forest.cuts(rows, NAMES))


def test_drawn_features_are_those_of_mllib():
    assert [forest.drawn_features(s, 21) for s in ("auto", "sqrt", "log2", "onethird", "all", "4", "0.5")] == [5, 5, 5, 7, 21, 4, 11]
