from pyspark.sql import functions as F

from ledgerlens.operators import evaluation, monitoring


def counting(spark, df):
    """``df`` and how often its rows are read."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def mark(_):
        seen.add(1)
        return True

    return df.filter(mark.asNondeterministic()(F.col(df.columns[0]))), seen


def test_metrics_read_the_rows_once(spark, monkeypatch):
    """Ranges are cut over the counted scores, not over the rows."""
    rows, seen = counting(spark, spark.createDataFrame(
        [(i % 3, i % 7 / 7, int(i % 5 == 0), int(i % 7 > 3)) for i in range(2100)], "batch int, score double, label int, said int"))
    cut, real = [], evaluation.range_splits

    def splits(table, columns, buckets=None):
        cut.append(table.count())
        return real(table, columns, buckets)

    monkeypatch.setattr(evaluation, "range_splits", splits)
    got = evaluation.metrics_by(rows, ["batch"], "label", "said", "score").collect()
    assert cut == [21] and seen.value == 2100
    assert [r.total_predictions for r in got] == [700] * 3
    for r in got:
        part = [i for i in range(2100) if i % 3 == r.batch]
        good, bad = [i % 7 for i in part if i % 5 == 0], [i % 7 for i in part if i % 5]
        area = sum((a > b) + (a == b) / 2 for a in good for b in bad) / len(good) / len(bad)
        assert abs(r.auc_roc - area) < 1e-12 and r.true_positives == sum(a > 3 for a in good)


def test_summary_reads_its_tables_once(spark):
    days = [(i, 0.5 + i / 100, 0.4, 0.6, 100, 0.1) for i in range(14)]
    history, seen_history = counting(spark, spark.createDataFrame(
        days, "day int, f1_score double, precision double, recall double, total_predictions long, fraud_rate double"))
    checks = [(d, f, f == "a") for d in (1, 2, 3) for f in ("a", "b")]
    drift, seen_drift = counting(spark, spark.createDataFrame(checks, "day int, feature string, is_drift boolean"))
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("day") * 86400).alias("ts")
    got = {r["name"]: r.value for r in monitoring.summary(history.select("*", at), drift.select("*", at), "2024-01-04 12:00:00").collect()}
    assert seen_history.value == 14 and seen_drift.value == 6
    assert got["total_performance_records"] == 14 and got["total_predictions"] == 1000 and abs(got["avg_f1_score"] - 0.585) < 1e-12
    assert got["total_drift_detections"] == 3 and got["features_monitored"] == 2 and got["recent_drift_alerts_24h"] == 1
