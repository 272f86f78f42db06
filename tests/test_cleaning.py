import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import cleaning, encoding, isolation, quality
from ledgerlens.schema import TRANSACTION
from ledgerlens.sources import driver_tables

from .conftest import SF

SAMPLE = [
    (1, "CASH_IN", 1000.0, "C1", 2000.0, 3000.0, "C2", 0.0, 0.0, 0, 0),
    (2, "CASH_OUT", 500.0, "C3", 1000.0, 900.0, "C4", 0.0, 500.0, 0, 0),
    (3, "PAYMENT", 100.0, "C5", 400.0, 300.0, "M6", 0.0, 0.0, 0, 1),
    (3, "PAYMENT", 100.0, "C5", 400.0, 300.0, "M6", 0.0, 0.0, 0, 1),
    (900, "TRANSFER", -5.0, "C7", 100.0, 105.0, "C8", 0.0, 0.0, 1, 0),
]


@pytest.fixture(scope="module")
def tx(spark):
    return spark.createDataFrame(SAMPLE, TRANSACTION)


def test_consistency(tx):
    got = {r.check: r.rows for r in quality.consistency_report(tx).collect()}
    assert got == {"duplicate_rows": 1, "invalid_types": 0, "balance_inconsistencies": 1,
                   "negative_amounts": 1, "invalid_steps": 1, "flagged_not_fraud": 2}


def test_empty_frame(spark):
    empty = spark.createDataFrame([], TRANSACTION)
    got = {(r.check, r.column): r.value for r in quality.quality_report(empty).collect()}
    assert got[("is_empty", "")] == 1 and got[("fraud_rate_pct", "isFraud")] == 0
    assert quality.duplicate_rows(empty).first()[0] == 0


def test_missing_columns_fail(tx):
    with pytest.raises(ValueError):
        quality.require_columns(tx.drop("amount"))
    assert quality.require_columns(tx.withColumn("more", F.lit(1))).columns[-1] == "more"


def test_repair(tx):
    rows = cleaning.repair_balances(tx).orderBy("step").collect()
    assert rows[1].newbalanceOrig == 500.0 and rows[0].newbalanceOrig == 3000.0


def test_strategies():
    choose = cleaning.choose_strategy
    assert [choose(True, p) for p in (4.9, 5, 19.9, 20, 50, 50.1)] == ["mean", "median", "median", "knn", "knn", "drop"]
    assert choose(False, 30) == "mode"


@pytest.mark.parametrize("strategy,amount", [("mean", 200.0), ("median", 150.0), ("mode", 100.0), ("knn", 200.0)])
def test_imputation(spark, strategy, amount, tmp_path):
    rows = [(1, t, a) for t, a in [("A", 100.0), ("A", 100.0), ("B", 200.0), (None, 400.0), ("B", None)]]
    df = spark.createDataFrame(rows, "step bigint, type string, amount double")
    fitted = cleaning.fit_imputation(df.drop("type") if strategy in ("mean", "median") else df, strategy)
    fitted.save(spark, str(tmp_path / "fit"))
    out = cleaning.Imputation.load(spark, str(tmp_path / "fit")).transform(df)
    assert out.filter("amount is null").count() == 0
    assert out.filter(F.col("amount") == amount).count() >= 1
    if strategy in ("mode", "knn"):
        assert [r.type for r in out.filter("amount = 400").collect()] == ["A"]  # smallest of the tied modes


def test_clean_counts_and_labels_survive(spark):
    rows = [(i, "CASH_IN", float(i % 7) * 100, "C1", 0.0, float(i % 7) * 100, "C2", 0.0, 0.0, int(i == 5), 0) for i in range(1, 40)]
    rows.append((40, "CASH_IN", 1e6, "C1", 0.0, 3.0, "C2", 0.0, 0.0, 1, 0))
    out, stats = cleaning.clean(spark.createDataFrame(rows, TRANSACTION))
    s = stats.first()
    assert s.outliers_detected == 1 and s.missing_values_handled == 0 and s.business_rule_violations >= 1
    assert out.agg(F.sum("isFraud")).first()[0] == 2 and out.agg(F.max("step")).first()[0] == 40
    assert out.agg(F.max("amount")).first()[0] < 1e6


def test_coercion_gives_null(spark):
    df = spark.createDataFrame([("1", "x"), ("a", "2.5")], "step string, amount string")
    got = cleaning.convert_types(df).collect()
    assert [(r.step, r.amount) for r in got] == [(1, None), (None, 2.5)]


def test_isolation_marks_the_far_value(spark):
    rng = np.random.default_rng(0)
    values = [*rng.normal(100, 5, 990), *rng.normal(5000, 900, 10)]
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    scored = isolation.isolation_scores(df, "x", trees=30)
    far = df.filter("x > 1000").agg(F.count_if(scored.is_outlier).alias("n")).first()[0]
    share = df.agg(F.count_if(scored.is_outlier) / F.count("*")).first()[0]
    assert far == 10 and share <= 0.1 + 1e-9


def test_encoder_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("b", 1.0, 5.0), ("a", 2.0, 5.0), (None, None, 5.0)], "t string, x double, k double")
    enc = encoding.fit_encoder(df, ["t"], ["x", "k"])
    enc.save(spark, str(tmp_path / "enc"))
    back = encoding.Encoder.load(spark, str(tmp_path / "enc"))
    got, want = back.transform(df).orderBy("t").collect(), enc.transform(df).orderBy("t").collect()
    assert got == want and [r.t for r in got] == [0, 1, 2]
    assert [r.x for r in got if r.t == 2] == [0.0] and all(r.k == 0.0 for r in got)
    assert enc.feature_names() == ["t", "x", "k"]


def test_unknown_labels(spark):
    d = encoding.label_dictionary(spark.createDataFrame([("a",), ("b",)], "t string"), "t")
    new = spark.createDataFrame([("z",)], "t string")
    assert encoding.label_encode(new, "t", d).first().t == 0
    with pytest.raises(Exception, match="unknown category"):
        encoding.label_encode(new, "t", d, unknown="error").collect()


def test_codes_by_sorted_parts_equal_the_window(spark):
    df = spark.range(3000).select(F.md5(F.col("id").cast("string")).alias("t"))
    small = encoding.label_dictionary(df, "t")
    large = encoding.sorted_codes(df.select(F.col("t").alias("value")).distinct())
    assert small.exceptAll(large.select("value", F.col("code").cast("bigint").alias("code"))).count() == 0


@pytest.mark.parametrize("kind,span", [("standard", (0.0, 1.0)), ("minmax", (-2.0, 3.0))])
def test_scaling_inverts(spark, kind, span):
    df = spark.range(1, 50).select((F.col("id") * 1.5).alias("x"))
    s = encoding.fit_scalers(df, ["x"], kind, feature_range=span)
    diff = encoding.unscale(encoding.scale(df, s), s).agg(F.sum("x")).first()[0] - df.agg(F.sum("x")).first()[0]
    assert abs(diff) < 1e-6
    if kind == "minmax":
        r = encoding.scale(df, s).agg(F.min("x"), F.max("x")).first()
        assert (r[0], r[1]) == pytest.approx(span)


def test_counters_are_observed_while_the_rows_are_written(spark, tmp_path):
    tx = driver_tables.transactions_dirty(spark, SF)
    rows, counters = cleaning.clean(tx)
    seen = cleaning.write_clean(tx, str(tmp_path / "clean"))
    assert seen == counters.first().asDict() and seen["outliers_detected"] > 0 and seen["business_rule_violations"] > 0
    written = spark.read.parquet(str(tmp_path / "clean"))
    assert written.columns == rows.columns and written.exceptAll(rows).count() == 0 == rows.exceptAll(written).count()


def test_counting_adds_no_scan(spark, tmp_path):
    tx, read = driver_tables.transactions_dirty(spark, SF), spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    watched, fills = tx.mapInArrow(count, tx.schema), cleaning.fit_imputation(tx)
    cleaning.clean(watched, imputation=fills)[0].write.parquet(str(tmp_path / "a"))
    uncounted = read.value
    cleaning.write_clean(watched, str(tmp_path / "b"), imputation=fills)
    assert 0 < uncounted == read.value - uncounted
