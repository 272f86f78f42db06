"""Model monitoring over time-keyed tables: performance, drift, health and metric events.

``history`` is a performance table (one row per batch with ``ts`` and the metrics),
``drift`` a drift table (``ts``, ``feature``, ``drift_score``, ``p_value``, ``is_drift``).
Both hold one row per batch or check, not per transaction.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pvalues import student_t_two_sided
from ..session import cut_lineage
from .evaluation import metrics_by
from .prefix import assign_buckets, range_splits
from .quality import since

# ---- fixed values -----------------------------------------------------------------
DEGRADATION, SEVERE_DEGRADATION = 0.1, 0.2
RECENT_RECORDS, TREND_RECORDS, TREND_SLOPE, TREND_P = 10, 5, 0.01, 0.05
DRIFT_PENALTY, MAX_DRIFT_PENALTY, DROP_FACTOR, MAX_DROP_PENALTY = 0.1, 0.3, 2.0, 0.4
RETENTION_DAYS = 30
HIGH_DRIFT_RATE = 0.1
LIMITS = [  # alert, severity, metric, comparison, limit
    ("health_score_low", "high", "health_score", "below", 0.7),
    ("accuracy_low", "medium", "accuracy", "below", 0.8),
    ("f1_score_low", "medium", "f1_score", "below", 0.7),
    ("drift_alerts_high", "high", "drift_alerts", "above", 5.0),
    ("response_time_high", "medium", "response_time", "above", 1.0),
]
RULES = [  # rule, metric, window, measure, limit
    ("HighErrorRate", "error", "5 minutes", "rate", 0.1),
    ("HighResponseTime", "response", "5 minutes", "p95", 2.0),
    ("HighFraudRate", "fraud", "10 minutes", "rate", 0.1),
    ("ModelPredictionFailure", "failure", "5 minutes", "rate", 0.01),
]


def batch_performance(scored: DataFrame, batch: Column, label: str = "isFraud", prediction: str = "fraud_prediction",
                      score: str = "fraud_score") -> DataFrame:
    """Metrics and fraud rate per batch."""
    return metrics_by(scored.withColumn("batch", batch), ["batch"], label, prediction, score)


def degradation(history: DataFrame, baseline: DataFrame, limit: float = DEGRADATION) -> DataFrame:
    """Batches whose F1, precision or recall fell too far below the baseline's one row."""
    base = baseline.select(F.struct("f1_score", "precision", "recall")).scalar()
    drops = {f"{m}_drop": base[m] - F.col(m) for m in ("f1_score", "precision", "recall")}
    worst = F.greatest(*drops)
    return (
        history.withColumns({**drops, "baseline_f1": base["f1_score"]})
        .filter(worst > limit)
        .withColumn("severity", F.when(worst > SEVERE_DEGRADATION, "high").otherwise("medium"))
    )


def recent(history: DataFrame, n: int = RECENT_RECORDS) -> DataFrame:
    """The last ``n`` records: a bounded top-n, so nothing is sorted whole."""
    return history.orderBy(F.desc("ts")).limit(n)


def drift_alerts(drift: DataFrame, as_of, hours: int = 24) -> DataFrame:
    return since(drift, as_of, hours=hours).agg(F.count_if("is_drift").alias("drift_alerts"))


def prediction_volume(predictions: DataFrame, as_of, hours: int = 1) -> DataFrame:
    return since(predictions, as_of, hours=hours).agg(F.count("*").alias("prediction_volume"))


def health(history: DataFrame, drift: DataFrame, baseline: DataFrame | None, as_of) -> DataFrame:
    """Mean F1 of the last records, less penalties for drift and for falling below baseline;
    1 without history."""
    alerts = drift_alerts(drift, as_of).scalar()
    base = baseline.select("f1_score").scalar() if baseline is not None else F.lit(None).cast("double")
    f1 = F.col("avg_f1")
    drop = F.greatest(F.coalesce(base, f1) - f1, F.lit(0.0))
    scored = recent(history).agg(F.avg("f1_score").alias("avg_f1")).withColumns({
        "drift_alerts": alerts,
        "drift_penalty": F.least(alerts * DRIFT_PENALTY, F.lit(MAX_DRIFT_PENALTY)),
        "drop_penalty": F.least(drop * DROP_FACTOR, F.lit(MAX_DROP_PENALTY)),
    })
    value = F.greatest(f1 - F.col("drift_penalty") - F.col("drop_penalty"), F.lit(0.0))
    return scored.withColumn("health_score", F.coalesce(value, F.lit(1.0)))


def performance_trend(history: DataFrame) -> DataFrame:
    """Slope of F1 over the last records and its verdict."""
    n_before = F.row_number().over(Window.orderBy("ts")) - 1  # at most RECENT_RECORDS rows
    numbered = recent(history).withColumn("x", n_before.cast("double"))
    y, x = F.col("f1_score"), F.col("x")
    fit = numbered.agg(F.count("*").alias("records"), F.regr_slope(y, x).alias("slope"), F.corr(y, x).alias("r"))
    df = F.col("records") - 2
    t = F.abs("r") * F.sqrt(df / (1 - F.col("r") * F.col("r")))
    p = F.when(F.abs("r") >= 1, 0.0).when(F.col("records") > 2, student_t_two_sided(t, df))
    certain = (F.col("records") >= TREND_RECORDS) & (F.col("p_value") < TREND_P)
    verdict = (
        F.when(certain & (F.col("slope") > TREND_SLOPE), "improving")
        .when(certain & (F.col("slope") < -TREND_SLOPE), "degrading").otherwise("stable")
    )
    return fit.withColumn("p_value", p).withColumn("trend", verdict).select("records", "slope", "p_value", "trend")


def running_recent(records: DataFrame, value: str, order: str, key: str, n: int = RECENT_RECORDS, buckets: int | None = None) -> DataFrame:
    """Of every record and the ``n - 1`` before it: ``records``, ``average``, ``slope`` (against the position; null below two).

    ``order`` is a number or a time, ``key`` a column that tells apart records of one instant. The order is cut into range
    buckets; each gets the last ``n - 1`` records before it as a halo, so frames reach across without a window over all.
    """
    kind = dict(records.dtypes)[order]
    place = F.unix_micros(order) if kind.startswith("timestamp") else F.col(order)
    rows = records.where(F.col(order).isNotNull()).select(place.cast("double").alias("_at"), F.col(order), F.col(key), F.col(value).cast("double").alias(value))
    rows = assign_buckets(rows, range_splits(rows, ["_at"], buckets)).withColumn("_halo", F.lit(False))
    back = Window.partitionBy("_at_bucket").orderBy(F.desc(order), F.desc(key))
    last = F.struct(*[F.col(c) for c in ("_at", order, key, value)])
    tails = (rows.withColumn("_r", F.row_number().over(back)).where(F.col("_r") < n).groupBy("_at_bucket")
             .agg(F.array_sort(F.collect_list(F.struct((-F.col("_r")).alias("p"), last.alias("row")))).alias("_tail")))
    # a bucket has a record at least, so the n - 1 buckets before hold the halo; a row a bucket is windowed here
    before = Window.orderBy("_at_bucket").rowsBetween(1 - n, -1)
    halo = F.flatten(F.collect_list("_tail").over(before))
    halo = tails.withColumn("_h", halo).withColumn("_h", F.slice("_h", F.greatest(F.size("_h") - n + 2, F.lit(1)), n - 1))
    halo = halo.select("_at_bucket", F.explode("_h").alias("_e")).select("_e.row.*", "_at_bucket", F.lit(True).alias("_halo"))
    along = Window.partitionBy("_at_bucket").orderBy(order, key)
    frame = along.rowsBetween(1 - n, 0)
    numbered = rows.unionByName(halo).withColumn("_x", F.row_number().over(along).cast("double"))
    slope = F.when(F.count(value).over(frame) > 1, F.regr_slope(F.col(value), F.col("_x")).over(frame))
    return numbered.withColumns({"records": F.count(F.lit(1)).over(frame), "average": F.avg(value).over(frame), "slope": slope}).where(~F.col("_halo")).select(
        order, key, value, "records", "average", "slope")


def summary(history: DataFrame, drift: DataFrame, as_of) -> DataFrame:
    """Record counts, recent averages and drift status as (section, name, value)."""
    history, drift = cut_lineage(history, "history"), cut_lineage(drift, "drift")  # a row a batch or check, read by several parts
    last = recent(history).agg(
        F.avg("f1_score").alias("avg_f1_score"), F.avg("precision").alias("avg_precision"), F.avg("recall").alias("avg_recall"),
        F.sum("total_predictions").cast("double").alias("total_predictions"), F.avg("fraud_rate").alias("avg_fraud_rate"),
    )
    state = drift.agg(
        F.count_if("is_drift").cast("double").alias("total_drift_detections"),
        F.count_distinct("feature").cast("double").alias("features_monitored"),
    )

    def section(df, name):
        return df.unpivot([], df.columns, "name", "value").select(F.lit(name).alias("section"), "name", "value")

    counts = history.agg(F.count("*").cast("double").alias("total_performance_records"))
    return (
        section(counts, "monitoring_status").unionByName(section(last, "recent_performance"))
        .unionByName(section(state, "drift_status"))
        .unionByName(section(drift_alerts(drift, as_of).select(F.col("drift_alerts").cast("double").alias("recent_drift_alerts_24h")), "drift_status"))
    )


def trend_data(history: DataFrame, as_of, days: int = 7) -> DataFrame:
    return since(history, as_of, days=days).select("ts", "f1_score", "precision", "recall", "fraud_rate")


def drift_summary(drift: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Checks, detections, rate and latest result per feature."""
    return since(drift, as_of, days=days).groupBy("feature").agg(
        F.count("*").alias("total_checks"), F.count_if("is_drift").alias("drift_detections"),
        (F.count_if("is_drift") / F.count("*")).alias("drift_rate"),
        F.max_by("drift_score", "ts").alias("latest_drift_score"), F.max_by("p_value", "ts").alias("latest_p_value"),
    )


def drift_overview(per_feature: DataFrame) -> DataFrame:
    return per_feature.agg(
        F.count("*").alias("total_features"), F.count_if(F.col("drift_rate") > 0).alias("features_with_drift"),
        F.count_if(F.col("drift_rate") > HIGH_DRIFT_RATE).alias("high_drift_features"),
    )


def retained(history: DataFrame, as_of, days: int = RETENTION_DAYS) -> DataFrame:
    return since(history, as_of, days=days)


def limit_alerts(current: DataFrame, limits=LIMITS) -> DataFrame:
    """``current`` holds one row with a column per metric; alerts for broken limits."""
    cols = [m for _, _, m, _, _ in limits if m in current.columns]
    long = current.unpivot([], [F.col(c).cast("double").alias(c) for c in cols], "metric", "current_value")
    table = current.sparkSession.createDataFrame(
        limits, "type string, severity string, metric string, comparison string, threshold double"
    )
    v, limit = F.col("current_value"), F.col("threshold")
    broken = F.when(F.col("comparison") == "below", v < limit).otherwise(v > limit)
    return long.join(F.broadcast(table), "metric").filter(broken).select("type", "severity", "metric", "threshold", "current_value")


def current_and_average(history: DataFrame) -> DataFrame:
    """Latest and mean F1, precision and recall."""
    names = ["f1_score", "precision", "recall"]
    stats = history.agg(*[F.max_by(m, "ts").alias(f"c_{m}") for m in names], *[F.avg(m).alias(f"a_{m}") for m in names])
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"c_{m}").alias("current"), F.col(f"a_{m}").alias("average")) for m in names])
    return stats.select(F.inline(rows))


def alert_rates(decision_stats: DataFrame) -> DataFrame:
    n = F.greatest(F.col("total_decisions"), F.lit(1))
    return decision_stats.select(
        (F.col("human_review_rate") * 100).alias("human_review_rate_pct"), (F.col("alerts_generated") / n * 100).alias("alert_rate_pct")
    )


# ---- metric events -------------------------------------------------------------------
def instruments(events: DataFrame) -> DataFrame:
    """Per metric name: counter (sum) and gauge (latest reading)."""
    return events.groupBy("name").agg(
        F.count("*").alias("readings"), F.sum("value").alias("counter"),
        F.max_by("value", F.struct("ts", "event_id")).alias("gauge"),
    )


def histogram_window(events: DataFrame, as_of, hours: float = 24) -> DataFrame:
    """Statistics per name of all readings in the ``hours`` before ``as_of``."""
    return since(events, as_of, hours=hours).groupBy("name").agg(
        F.count("*").alias("readings"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("avg")
    )


def metric_summary(events: DataFrame, window: str = "5 minutes") -> DataFrame:
    """Per name and tumbling window: count, min, max, avg, sum. Works on streams too."""
    return events.groupBy(F.window("ts", window), "name").agg(
        F.count("*").alias("count"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg("value").alias("avg"), F.sum("value").alias("sum"),
    ).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
             "name", "count", "min", "max", "avg", "sum")


def _seconds(window: str) -> int:
    amount, unit = window.split()
    return int(amount) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def rule_alerts(events: DataFrame, rules=RULES, names: Mapping[str, str] | None = None, slide: str = "1 minute") -> DataFrame:
    """Sliding-window rules: events per second, or the 95th percentile of the readings.

    ``names`` maps a rule's metric to the event name that carries it. The percentile is a
    sketch with a relative rank error of 1e-4.
    """
    names = names or {}
    out = None
    for rule, metric, window, measure, limit in rules:
        value = F.count("*") / _seconds(window) if measure == "rate" else F.percentile_approx("value", 0.95, 10000)
        hit = (
            events.filter(F.col("name") == names.get(metric, metric)).groupBy(F.window("ts", window, slide))
            .agg(value.cast("double").alias("value")).filter(F.col("value") > limit)
            .select(F.lit(rule).alias("rule"), F.col("window.start").alias("window_start"), "value")
        )
        out = hit if out is None else out.unionByName(hit)
    return out
