from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import attribution, models

NAMES = [f"x{i}" for i in range(6)]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 6)).round(2)
    x[::17, 2] = np.nan
    y = ((x[:, 0] > 0) ^ (x[:, 1] + 0.3 * x[:, 3] > 0.2)).astype(int)
    return spark.createDataFrame([(i, int(t), *map(float, r)) for i, (t, r) in enumerate(zip(y, x))],
                                 "tx_id long, isFraud int, " + ", ".join(f"{c} double" for c in NAMES)).repartition(3)


def expected(nodes, value, x, known, at=0):
    """The mean of a tree for a row whose features in ``known`` are given."""
    node = nodes[at]
    if node["left"] < 0:
        return value(node)
    left, right = node["left"], node["right"]
    if node["feature"] in known:
        return expected(nodes, value, x, known, left if x[node["feature"]] <= node["split"] else right)
    w = nodes[left]["weight"] / node["weight"]
    return w * expected(nodes, value, x, known, left) + (1 - w) * expected(nodes, value, x, known, right)


def by_subsets(trees, scales, value, x):
    def worth(known):
        return sum(s * expected(t, value, x, known) for s, t in zip(scales, trees))

    out = []
    for i in range(6):
        others = [j for j in range(6) if j != i]
        out.append(sum(factorial(k) * factorial(5 - k) / factorial(6) * (worth({*s, i}) - worth(set(s)))
                       for k in range(6) for s in combinations(others, k)))
    return worth(set()), out


@pytest.mark.parametrize("kind,params", [("forest", {"trees": 4, "max_depth": 5, "features": "all"}), ("boosting", {"rounds": 4, "max_depth": 4})])
def test_parts_are_those_of_all_subsets_and_add_up(spark, rows, kind, params, monkeypatch):
    model = models.fit(models.Spec(kind, params=params), rows.where(~F.isnan("x2")), NAMES)
    kept = []
    whole = attribution._leaves
    monkeypatch.setattr(attribution, "_leaves", lambda nodes, value, scale: kept.append((nodes, value, scale)) or whole(nodes, value, scale))
    out = model.attributions(model(rows)).where("tx_id % 40 = 0 or tx_id % 170 = 0").collect()
    trees, scales, value = [k[0] for k in kept], [k[2] for k in kept], kept[0][1]
    for r in out:
        base, parts = by_subsets(trees, scales, value, [r[c] for c in NAMES])
        assert abs(base - r.base_value) < 1e-9 and np.allclose(parts, [r.contributions[c] for c in NAMES], rtol=0, atol=1e-9)
    margins = model.attributions(model(rows)).select("fraud_score", (F.col("base_value") + F.aggregate(
        F.map_values("contributions"), F.lit(0.0), lambda a, v: a + v)).alias("m")).toPandas()
    score = margins["m"] if kind == "forest" else 1 / (1 + np.exp(-2 * margins["m"]))
    assert np.abs(score - margins["fraud_score"]).max() < 1e-9


def test_long_paths_without_codes(monkeypatch):
    rng = np.random.default_rng(0)
    leaf = attribution.Leaf(2.0, np.arange(6), rng.uniform(0.1, 1, 6), [[(0.0, bool(i % 2))] for i in range(6)])
    x = rng.normal(size=(50, 6))
    ensemble = attribution.Ensemble([leaf], 2.0 * leaf.share.prod(), 6)
    by_code = ensemble.contributions(x)
    monkeypatch.setattr(attribution, "_CODES", 0)
    assert np.allclose(by_code, ensemble.contributions(x))
    assert np.allclose(by_code.sum(axis=1) + ensemble.base, 2.0 * leaf.agrees(x).all(axis=1))


def test_table_holds_the_parts_of_every_way_to_agree():
    rng = np.random.default_rng(4)
    for m in (1, 2, 5, 10):
        leaf = attribution.Leaf(1.7, np.arange(m), rng.uniform(0.01, 1, m), [[(0.0, True)]] * m)
        ways = (np.arange(1 << m)[:, None] >> np.arange(m) & 1).astype(bool)
        assert np.allclose(leaf.table().T, leaf.parts(ways), rtol=1e-9, atol=1e-12)


def test_rows_of_one_partition_are_spread_before_attribution(spark, rows):
    model = models.fit(models.Spec("forest", params={"trees": 2, "max_depth": 2}), rows.where(~F.isnan("x2")), NAMES)
    assert model.attributions(rows.coalesce(1)).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_categories_and_a_single_leaf():
    leaf = attribution.Leaf(1.0, np.array([1]), np.array([0.25]), [[(frozenset({0.0, 2.0}), True)]])
    x = np.array([[5.0, 0.0], [5.0, 1.0]])
    assert attribution.Ensemble([leaf], 0.25, 2).contributions(x).tolist() == [[0.0, 0.75], [0.0, -0.25]]
    alone = attribution.Leaf(1.0, np.array([], int), np.array([]), [])
    assert attribution.Ensemble([alone], 1.0, 2).contributions(x).tolist() == [[0.0, 0.0], [0.0, 0.0]]


def test_mean_attribution_of_a_forest_ranks_what_matters(spark, rows):
    model = models.fit(models.Spec("forest", params={"trees": 10, "max_depth": 5}), rows.where(~F.isnan("x2")), NAMES)
    ranked = [r.feature for r in model.mean_attribution(rows).orderBy(F.desc("importance")).collect()]
    assert set(ranked[:2]) == {"x0", "x1"}
