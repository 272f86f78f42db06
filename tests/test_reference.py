import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import drift, reference
from ledgerlens.session import shared_folder

COLS = ["x", "y"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    x, y = rng.lognormal(3, 2, 4000), rng.normal(0, 5, 4000) * (rng.random(4000) < 0.8)
    data = [(int(k % 8), float(a * (1.3 if k % 8 == 7 else 1)), None if k % 50 == 0 else float(b)) for k, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "d int, x double, y double").withColumn("ts", F.expr("timestamp'2024-03-01' + make_interval(0, 0, 0, d)")).persist()


def counted(df):
    return {(r["feature"], r["cell"]): r["rows"] for r in df.collect()}


def test_cells_keep_the_order(spark):
    values = [-float("inf"), -1e300, -5.0, -4.0, -1e-8, -1e-12, 0.0, 1e-8, 1.0, 1.05, 1e300, float("inf")]
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)] + [(99, None), (98, float("nan"))], "k int, v double")
    got = {r["k"]: r["c"] for r in df.select("k", reference.cell(F.col("v")).alias("c")).collect()}
    cells = [got[k] for k in range(len(values))]
    assert cells == sorted(cells) and got[99] is None and got[98] is None and got[5] == got[6] == 0 and len(set(cells)) == len(cells) - 1


def test_merged_days_are_the_profile_of_all(spark, rows):
    folder = shared_folder(spark, "reference")
    reference.add_days(rows.where("d < 5"), COLS, folder, F.col("ts"))
    reference.add_days(rows.where("d >= 4"), COLS, folder, F.col("ts"))  # the fifth day once more
    assert counted(reference.merged(spark, folder, "2024-03-01", "2024-03-08")) == counted(reference.profile(rows, COLS))
    plan = reference.merged(spark, folder, "2024-03-08", "2024-03-08")._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [isnotnull(day" in plan


def test_distance_within_its_bound(spark, rows):
    before, now = rows.where("d < 7"), rows.where("d = 7")
    exact = {r["feature"]: r for r in drift.ks_drift(before, now, COLS).collect()}
    found = {r["feature"]: r for r in reference.distance(reference.profile(before, COLS), reference.profile(now, COLS)).collect()}
    assert set(found) == set(COLS)
    for c in COLS:
        assert (found[c]["n_reference"], found[c]["n_current"]) == (exact[c]["n_reference"], exact[c]["n_current"])
        assert found[c]["drift_score"] <= exact[c]["drift_score"] + 1e-12 <= found[c]["drift_score"] + found[c]["most_below"] + 2e-12


def test_nothing_to_compare(rows):
    empty = reference.profile(rows.limit(0), COLS)
    assert reference.distance(reference.profile(rows, COLS), empty).count() == 0
