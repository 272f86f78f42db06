import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import alerts, decisions, registry

T = alerts.with_cooldowns([60, 60, 120])
LAYOUT = "tx_id bigint, us bigint, nameOrig string, type string, amount double, fraud_score double"


def frame(spark, rows):
    return spark.createDataFrame(rows, LAYOUT).withColumn("ts", F.timestamp_micros("us")).drop("us")


def greedy(rows):
    """Sequential rule, row by row."""
    last, out = {}, set()
    for tx, us, name, _, _, score in sorted(rows, key=lambda r: (r[1], r[0])):
        t = next((t for t in T if t.low <= score and (score < t.high or t.high >= 1)), None)
        if t is None:
            continue
        k = (t.name, name)
        if k not in last or us - last[k] >= t.cooldown_seconds * 1_000_000:
            out.add(tx)
            last[k] = us
    return out


def rows_of(seed, n=900):
    """One account holds half of the rows and never pauses."""
    rng = random.Random(seed)
    rows, t = [], 1_700_000_000_000_000
    for i in range(n):
        t += rng.choice([0, 1_000_000, 7_500_000, 20_000_000, 61_000_000])
        name = "HOT" if rng.random() < 0.5 else rng.choice([None, f"C{rng.randint(0, 8)}"])
        rows.append((i, t, name, "TRANSFER", 5.0, rng.choice([0.5, 0.6, 0.79, 0.8, 0.9, 1.0])))
    return rows


@pytest.mark.parametrize("fold_rows", [1, 25, 1_000_000])
def test_cooldown_equals_the_sequential_rule(spark, fold_rows):
    rows = rows_of(fold_rows)
    got = {r.tx_id for r in alerts.raise_alerts(frame(spark, rows), T, fold_rows=fold_rows).select("tx_id").collect()}
    assert got == greedy(rows)


def test_no_two_alerts_inside_the_gap(spark):
    out = alerts.raise_alerts(frame(spark, rows_of(11)), T).select("threshold_name", "nameOrig", "cooldown_seconds", F.unix_micros("ts").alias("us"))
    a, b = out.alias("a"), out.alias("b")
    close = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("threshold_name", "nameOrig")]).filter(
        (F.col("a.us") < F.col("b.us")) & (F.col("b.us") - F.col("a.us") < F.col("a.cooldown_seconds") * 1_000_000))
    assert close.count() == 0


def test_top_score_alerts_and_gaps_do_not(spark):
    rows = [(1, 0, "A", "DEBIT", 1.0, 1.0), (2, 0, "B", "DEBIT", 1.0, 0.59)]
    got = alerts.raise_alerts(frame(spark, rows)).collect()
    assert [(r.tx_id, r.severity, r.risk_level) for r in got] == [(1, "CRITICAL", "CRITICAL")]
    assert got[0].message == "FRAUD ALERT: CRITICAL | Score: 1.000 | Transaction: DEBIT $1.00 | Account: A"


def test_threshold_changes():
    base = alerts.DEFAULT_THRESHOLDS
    with pytest.raises(ValueError):
        alerts.Threshold("x", 0.9, 0.8, "LOW", 1)
    with pytest.raises(ValueError):
        alerts.add_threshold(base, base[0])
    with pytest.raises(KeyError):
        alerts.remove_threshold(base, "none")
    assert len(alerts.remove_threshold(base, "high_risk_fraud")) == 2
    assert alerts.update_threshold(base, "high_risk_fraud", enabled=False)[1].enabled is False


def test_disabled_thresholds_match_nothing(spark):
    off = tuple(alerts.replace(t, enabled=False) for t in T)
    assert alerts.match(frame(spark, rows_of(1, 20)), off).count() == 0


def test_latest_outcome_wins(spark):
    d = spark.createDataFrame([("a", 1), ("b", 0)], "decision_id string, prediction int")
    o = spark.createDataFrame([("a", 2, 1), ("a", 1, 0), ("a", 3, 0)], "decision_id string, s bigint, actual_outcome int") \
        .withColumn("ts", F.timestamp_seconds("s"))
    got = {r.decision_id: r.actual_outcome for r in decisions.with_outcomes(d, o).collect()}
    assert got == {"a": 0, "b": None}


def test_registry(spark):
    runs = spark.createDataFrame([], registry.LAYOUT)
    new = spark.createDataFrame([("m1", "fraud", "forest", "staging", ["x", "y"], None, 10, {"f1": 0.5})],
                                "model_id string, model_name string, model_type string, status string, tags array<string>, "
                                "created_at timestamp, size_bytes bigint, metrics map<string,double>")
    one = registry.register(runs, new)
    two = registry.register(one, new.withColumn("model_id", F.lit("m2")))
    assert [r.version for r in two.orderBy("version").collect()] == ["v1.0.0", "v2.0.0"]
    assert registry.list_models(two, tags=["x", "z"]).count() == 0 and registry.list_models(two, status="staging").count() == 2
    both = registry.register(two, new.select(*[F.lit(None).cast("string").alias("model_id") if c == "model_id" else c for c in new.columns])
                             .withColumn("model_id", F.explode(F.array(F.lit("m4"), F.lit("m3")))))
    assert {r.model_id: r.version for r in both.collect()} == {"m1": "v1.0.0", "m2": "v2.0.0", "m3": "v3.0.0", "m4": "v4.0.0"}
    live = registry.set_status(two, "m1", "production")
    assert registry.delete(live, "m1").count() == 2 and registry.delete(live, "m1", force=True).count() == 1 and registry.delete(live, "m2").count() == 1
    assert {r.model_id: r.tags for r in registry.add_tags(two, "m2", ["y", "z"]).collect()} == {"m1": ["x", "y"], "m2": ["x", "y", "z"]}
    with pytest.raises(ValueError):
        registry.set_status(two, "m1", "lost")
    up = registry.update_metrics(two, spark.createDataFrame([("m1", {"f1": 0.7, "auc": 0.9})], "model_id string, metrics map<string,double>"))
    assert {r.model_id: r.metrics for r in up.collect()} == {"m1": {"f1": 0.7, "auc": 0.9}, "m2": {"f1": 0.5}}
