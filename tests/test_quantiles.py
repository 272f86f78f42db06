"""Distributed order statistics, running totals and rank correlation against brute force."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import correlation, drift, evaluation, prefix, quantiles, splitting


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows hold one value; the rest span many magnitudes, some null."""
    rng = np.random.default_rng(1)
    x = np.concatenate([np.zeros(1000), rng.lognormal(8, 4, 2000)])
    y = np.where(rng.random(3000) < 0.4, 7.0, rng.normal(0, 50, 3000)).round(1)
    pdf = pd.DataFrame({"id": range(3000), "x": rng.permutation(x), "y": y, "g": rng.choice(["a", "b", "b", "b"], 3000)})
    return pdf, spark.createDataFrame(pdf).withColumn("y", F.when(F.col("id") % 50 != 0, F.col("y")))


@pytest.mark.parametrize("bins", [2, 7, 2048])
def test_quantiles_equal_exact(skewed, bins, monkeypatch):
    pdf, df = skewed
    monkeypatch.setattr(quantiles.order_statistics, "__defaults__", (None, bins))
    probs = [0, 0.1, 0.25, 0.5, 0.75, 0.999, 1]
    assert np.allclose(quantiles.quantiles(df, ["x", "y"], probs)[(None, "x")], np.quantile(pdf.x, probs))


def test_quantiles_with_nan_infinities_and_wide_ranges(spark):
    inf, nan = float("inf"), float("nan")
    values = [nan, inf, inf, -inf, 1.0, 2.0, 3.0, -1.7e308, 1.7e308, 5e-324, 0.0, None]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    ordered = [-inf, -1.7e308, 0.0, 5e-324, 1.0, 2.0, 3.0, 1.7e308, inf, inf, nan]
    got = quantiles.quantiles(df, ["x"], [i / 10 for i in range(11)])[(None, "x")]
    assert np.array_equal(got, ordered, equal_nan=True)
    only = spark.createDataFrame([(nan,), (inf,)], "x double")
    assert np.array_equal(quantiles.quantiles(only, ["x"], [0, 1])[(None, "x")], [inf, nan], equal_nan=True)


def test_cut_points_do_not_grow_with_rows(spark):
    few, many = (spark.range(n).selectExpr("cast(hash(id) as double) as x") for n in (1_000, 1_000_000))
    n = prefix.BUCKETS_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1
    assert len(prefix.range_splits(few, ["x"])["x"]) == len(prefix.range_splits(many, ["x"])["x"]) == n


@pytest.mark.parametrize("buckets", [1, 7, 30])
def test_grouped_quantiles(skewed, buckets):
    pdf, df = skewed
    probs = [0.0, 0.5, 0.9, 0.999]
    table = quantiles.quantile_table(df, ["x", "y"], probs, "g", buckets=buckets)
    got = {(r.g, r.column, r.prob): r.value for r in table.collect()}
    clean = df.toPandas()
    for g, part in clean.groupby("g"):
        for c in ("x", "y"):
            want = np.quantile(part[c].dropna(), probs)
            assert np.allclose([got[(g, c, p)] for p in probs], want)


def test_empty_column(spark):
    df = spark.createDataFrame([(None,), (None,)], "x double")
    assert quantiles.quantiles(df, ["x"], [0.5])[(None, "x")] == [None]


@pytest.mark.parametrize("descending", [False, True])
def test_bucketed_running_totals(skewed, descending):
    pdf, df = skewed
    rows = df.select("g", "x")
    splits = prefix.range_splits(rows, ["x"], buckets=30)
    assert len(splits["x"]) > 5
    counted = prefix.assign_buckets(rows, splits).groupBy("g", "x_bucket", "x").agg(F.count("*").alias("n"))
    got = prefix.running_totals(counted, ["g"], "x", {"cum": "n"}, "x_bucket", descending).toPandas()
    for g, part in pdf.groupby("g"):
        want = part.groupby("x").size().sort_index(ascending=not descending).cumsum()
        mine = got[got.g == g].set_index("x").cum
        assert (mine.reindex(want.index) == want).all()


def test_spearman_buckets_and_nulls(skewed):
    pdf, df = skewed
    got = correlation.spearman(df, ["x", "y"], buckets=15).first().r
    clean = df.dropna().toPandas()
    assert got == pytest.approx(clean.x.rank().corr(clean.y.rank()), abs=1e-9)


def test_kendall_against_all_pairs(spark):
    rng = random.Random(3)
    rows = [(float(rng.choice([0, 0, rng.randint(0, 40)])), float(rng.randint(-20, 20))) for _ in range(250)]
    got = correlation.kendall_pair(spark.createDataFrame(rows, "x double, y double"), "x", "y", buckets=7).first().r
    sign = lambda v: (v > 0) - (v < 0)
    s = tx = ty = 0
    for (a, b), (c, d) in itertools.combinations(rows, 2):
        s += sign(a - c) * sign(b - d)
        tx += a != c
        ty += b != d
    assert got == pytest.approx(s / math.sqrt(tx * ty), abs=1e-12)


def test_ks_with_and_without_buckets(skewed):
    _, df = skewed
    ref, cur = df.filter("g = 'a'"), df.filter("g = 'b'").withColumn("x", F.col("x") * 1.5)
    one = {r.feature: r for r in drift.ks_drift(ref, cur, ["x", "y"]).collect()}
    many = {r.feature: r for r in drift.ks_drift(ref, cur, ["x", "y"], buckets=30).collect()}
    a, b = ref.toPandas().x.to_numpy(), cur.toPandas().x.to_numpy()
    grid = np.unique(np.concatenate([a, b]))
    d = max(abs((a <= v).mean() - (b <= v).mean()) for v in grid)
    assert one["x"].drift_score == pytest.approx(d) and many["x"].drift_score == pytest.approx(d)
    assert many["y"].n_reference == ref.filter("y is not null").count()


def test_auc_with_ties_and_buckets(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 400)
    s = np.where(rng.random(400) < 0.4, 0.5, (rng.random(400) * 0.7 + y * 0.3)).round(2)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": s})).withColumn("p", (F.col("s") >= 0.5).cast("int"))
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    for size in (1, 30):
        r = evaluation.metrics_by(df, [], "y", "p", "s", buckets=size).first()
        assert r.auc_roc == pytest.approx(auc, abs=1e-12)
        assert r.true_positives == int(((y == 1) & (s >= 0.5)).sum())


def test_one_class_gives_no_auc(spark):
    r = evaluation.metrics_by(spark.createDataFrame([(0, 0, 0.1), (0, 1, 0.9)], "y int, p int, s double"), [], "y", "p", "s").first()
    assert r.auc_roc is None and r.recall == 0.0 and r.false_positives == 1


def test_splits_are_exact_and_disjoint(spark):
    df = spark.range(5000).withColumn("isFraud", (F.col("id") % 37 == 0).cast("int"))
    train, test = splitting.train_test(df, "isFraud", ["id"])
    n = {r.isFraud: r["count"] for r in test.groupBy("isFraud").count().collect()}
    whole = {r.isFraud: r["count"] for r in df.groupBy("isFraud").count().collect()}
    assert n == {k: splitting.half_up(0.2 * v) for k, v in whole.items()}
    assert train.count() + test.count() == 5000 and train.join(test, "id").count() == 0


def test_folds_are_even(spark):
    df = spark.range(1003).withColumn("isFraud", (F.col("id") % 10 == 0).cast("int"))
    sizes = splitting.stratified_folds(df, "isFraud", ["id"], 5).groupBy("isFraud", "fold").count().toPandas()
    for _, part in sizes.groupby("isFraud"):
        assert len(part) == 5 and part["count"].max() - part["count"].min() <= 1


def test_small_inputs_are_kept_whole(spark):
    df = spark.range(100).withColumn("isFraud", (F.col("id") % 10 == 0).cast("int"))
    assert splitting.stratified_downsample(df, "isFraud", ["id"]).count() == 100
    assert splitting.uniform_sample(df, ["id"], 1000).count() == 100 and splitting.uniform_sample(df, ["id"], 7).count() == 7
    assert splitting.stratified_downsample(df, "isFraud", ["id"], above=50, size=50).groupBy("isFraud").count().count() == 2
