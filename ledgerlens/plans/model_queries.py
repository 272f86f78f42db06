"""Registered queries: evaluation, model comparison, drift and monitoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import round_doubles
from ..operators import drift, evaluation, history, monitoring, reference, retention, timers
from ..schema import MEASURES
from ..sources.driver_tables import drift_pair, metric_events, model_scores, scored, table, transactions
from ..session import shared_folder
from .base import models_sql, query, scored_sql, tx_sql, union_all

EPOCH = 1704067200
AS_OF = "2024-01-25 00:00:00"
RATES = ["accuracy", "precision", "recall", "f1_score", "specificity", "false_positive_rate", "false_negative_rate"]


def metrics_cte(src: str, by: str, y: str, p: str, s: str, name: str = "met") -> str:
    """CTEs ending in ``name``: the metrics of ``src`` per group."""
    return f""",
{name}_c AS (SELECT {by}, count(*) AS n, count(*) FILTER ({y} = 1 AND {p} = 1) AS tp, count(*) FILTER ({y} = 0 AND {p} = 0) AS tn,
  count(*) FILTER ({y} = 0 AND {p} = 1) AS fp, count(*) FILTER ({y} = 1 AND {p} = 0) AS fn FROM {src} GROUP BY {by}),
{name}_r AS (SELECT {by}, sum(r) FILTER (y = 1) AS rp FROM (
  SELECT {by}, {y} AS y, rank() OVER (PARTITION BY {by} ORDER BY {s}) + (count(*) OVER (PARTITION BY {by}, {s}) - 1) / 2.0::DOUBLE AS r FROM {src}) GROUP BY {by}),
{name}_s AS (SELECT {by}, {s} AS s, count(*) FILTER ({y} = 1) AS pos, count(*) AS k FROM {src} GROUP BY {by}, {s}),
{name}_w AS (SELECT *, sum(pos) OVER w AS cp, sum(k) OVER w AS ck FROM {name}_s WINDOW w AS (PARTITION BY {by} ORDER BY s DESC)),
{name}_a AS (SELECT {by}, sum(pos * cp / ck::DOUBLE) / nullif(sum(pos), 0) AS ap FROM {name}_w GROUP BY {by}),
{name} AS (SELECT {by}, tp AS true_positives, tn AS true_negatives, fp AS false_positives, fn AS false_negatives, n AS total_predictions, tp + fn AS positive_samples,
  CASE WHEN tp + fn > 0 AND tn + fp > 0 THEN (rp - (tp + fn) * (tp + fn + 1) / 2.0::DOUBLE) / ((tp + fn) * (tn + fp)::DOUBLE) END AS auc_roc, ap AS average_precision,
  (tp + fn) / n::DOUBLE AS fraud_rate, (tp + tn) / n::DOUBLE AS accuracy, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END AS precision,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0 END AS recall, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE ELSE 0 END AS f1_score,
  CASE WHEN tn + fp > 0 THEN tn / (tn + fp)::DOUBLE ELSE 0 END AS specificity, CASE WHEN tn + fp > 0 THEN fp / (tn + fp)::DOUBLE ELSE 0 END AS false_positive_rate,
  CASE WHEN tp + fn > 0 THEN fn / (tp + fn)::DOUBLE ELSE 0 END AS false_negative_rate
  FROM {name}_c JOIN {name}_r USING ({by}) JOIN {name}_a USING ({by}))"""


COUNTS = ["true_positives", "true_negatives", "false_positives", "false_negatives", "total_predictions", "positive_samples"]
REALS = ["auc_roc", "average_precision", "fraud_rate", *RATES]
ROUNDED = ", ".join(COUNTS + [f"round({c}, 6) AS {c}" for c in REALS])
BY_MODEL = metrics_cte("models", "model", "label", "prediction", "score")
BY_FOLD = metrics_cte("models", "model, fold", "label", "prediction", "score", "folds")


def by_model(spark, sf):
    return evaluation.metrics_by(model_scores(spark, sf), ["model"], "label", "prediction", "score")


def by_fold(spark, sf):
    return evaluation.metrics_by(model_scores(spark, sf), ["model", "fold"], "label", "prediction", "score")


# ---- evaluation -------------------------------------------------------------------
@query("t09_t10_metrics_by_model", models_sql(f"SELECT model, {ROUNDED} FROM met", BY_MODEL))
def _(spark, sf):
    return round_doubles(by_model(spark, sf))


@query("t09_confusion_metrics", models_sql("SELECT model, " + ", ".join(COUNTS[:4] + [f"round({c}, 6) AS {c}" for c in RATES]) + " FROM met", BY_MODEL))
def _(spark, sf):
    return round_doubles(evaluation.confusion_metrics(model_scores(spark, sf), ["model"], "label", "prediction"))


@query("t11_w07_curve_points", models_sql("""
SELECT model, s AS threshold, round(tp / p::DOUBLE, 6) AS tpr, round(fp / n::DOUBLE, 6) AS fpr, round(tp / (tp + fp)::DOUBLE, 6) AS precision, round(tp / p::DOUBLE, 6) AS recall
FROM (SELECT model, s, sum(pos) OVER w AS tp, sum(k - pos) OVER w AS fp, sum(pos) OVER (PARTITION BY model) AS p, sum(k - pos) OVER (PARTITION BY model) AS n
      FROM met_s WINDOW w AS (PARTITION BY model ORDER BY s DESC))""", BY_MODEL))
def _(spark, sf):
    return round_doubles(evaluation.curve_points(model_scores(spark, sf), ["model"], "label", "score"))


@query("t12_confusion_matrix", models_sql("""
SELECT model, label, prediction, count(*) AS rows, round(count(*) / sum(count(*)) OVER (PARTITION BY model, label)::DOUBLE, 6) AS share FROM models GROUP BY model, label, prediction"""))
def _(spark, sf):
    return round_doubles(evaluation.confusion_matrix(model_scores(spark, sf), "label", "prediction", ["model"], "true"))


_CLASSES = """,
cls AS (
  SELECT model, '0' AS class, CASE WHEN tn + fn > 0 THEN tn / (tn + fn)::DOUBLE ELSE 0 END AS precision, tn / (tn + fp)::DOUBLE AS recall, 2 * tn / (2 * tn + fn + fp)::DOUBLE AS f1_score, tn + fp AS support FROM met_c
  UNION ALL SELECT model, '1', CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0 END, tp / (tp + fn)::DOUBLE, 2 * tp / (2 * tp + fn + fp)::DOUBLE, tp + fn FROM met_c)"""


@query("t12_class_report", models_sql("""
SELECT model, class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score, support FROM cls
UNION ALL SELECT model, 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1_score), 6), sum(support)::BIGINT FROM cls GROUP BY model
UNION ALL SELECT model, 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(f1_score * support) / sum(support), 6), sum(support)::BIGINT FROM cls GROUP BY model""", BY_MODEL + _CLASSES))
def _(spark, sf):
    return round_doubles(evaluation.class_report(model_scores(spark, sf), "label", "prediction", ["model"]))


@query("t07_fold_summary", models_sql(union_all(
    [f"SELECT model, '{m}' AS metric, round(avg({m}), 6) AS mean, round(stddev_pop({m}), 6) AS std, count({m}) AS folds FROM folds GROUP BY model"
     for m in evaluation.METRICS]), BY_FOLD))
def _(spark, sf):
    return round_doubles(evaluation.fold_summary(by_fold(spark, sf)))


@query("t13_evaluation_summary", models_sql("""
SELECT count(*) AS evaluations, count(DISTINCT model) AS models, """ + ", ".join(f"round(avg({m}), 6) AS avg_{m}" for m in evaluation.METRICS) + """,
  (SELECT model FROM met ORDER BY f1_score DESC LIMIT 1) AS best_f1_model FROM met""", BY_MODEL))
def _(spark, sf):
    return round_doubles(evaluation.evaluation_summary(by_model(spark, sf)))


@query("t14_w01_comparison_table", models_sql("""
SELECT model, """ + ", ".join(f"CAST(rank() OVER (ORDER BY {m} DESC NULLS LAST) AS INTEGER) AS {m}_rank" for m in ("f1_score", "auc_roc", "precision", "recall")) + " FROM met", BY_MODEL))
def _(spark, sf):
    out = evaluation.comparison_table(by_model(spark, sf))
    return out.select("model", *[c for c in out.columns if c.endswith("_rank")])


@query("t14_w02_gaps_to_best", models_sql("""
SELECT model, CAST(row_number() OVER w AS INTEGER) AS rank, """ + ", ".join(
    f"round(first_value({m}) OVER w - {m}, 6) AS {m}_gap" for m in evaluation.METRICS) + """, row_number() OVER w = 1 AS is_best
FROM met WINDOW w AS (ORDER BY f1_score DESC NULLS LAST, model)""", BY_MODEL))
def _(spark, sf):
    out = evaluation.compare_models(by_model(spark, sf))
    return round_doubles(out.select("model", "rank", *[f"{m}_gap" for m in evaluation.METRICS], "is_best"))


_PAIRS = BY_FOLD + """,
pairs AS (SELECT x.model AS model_a, y.model AS model_b, x.fold, x.auc_roc AS a, y.auc_roc AS b FROM folds x JOIN folds y ON x.fold = y.fold AND x.model <> y.model)"""


@query("t15_j08_paired_t_test", models_sql("""
SELECT model_a, model_b, 'paired_ttest' AS test, round(t, 6) AS statistic, round(1 - sin(atan(abs(t) / 2)) * (1 + cos(atan(abs(t) / 2)) ** 2 / 2), 6) AS p_value,
  1 - sin(atan(abs(t) / 2)) * (1 + cos(atan(abs(t) / 2)) ** 2 / 2) < 0.05 AS significant, round(m / sd, 6) AS effect_size, round(m, 6) AS mean_diff, n AS sample_size
FROM (SELECT model_a, model_b, avg(a - b) AS m, stddev_samp(a - b) AS sd, count(*) AS n, avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))) AS t FROM pairs GROUP BY 1, 2)""", _PAIRS))
def _(spark, sf):
    return round_doubles(evaluation.paired_t_test(by_fold(spark, sf), "auc_roc"))


@query("t15_wilcoxon_test", models_sql("""
SELECT model_a, model_b, 'wilcoxon' AS test, w AS statistic, round(least(2.0 * (SELECT count(*) FROM subsets WHERE s <= w) / 32, 1), 6) AS p_value,
  least(2.0 * (SELECT count(*) FROM subsets WHERE s <= w) / 32, 1) < 0.05 AS significant, NULL::DOUBLE AS effect_size, round(m, 6) AS mean_diff, n AS sample_size
FROM (SELECT model_a, model_b, least(coalesce(sum(r) FILTER (d > 0), 0), coalesce(sum(r) FILTER (d < 0), 0))::DOUBLE AS w, avg(d) AS m, count(*) AS n
  FROM (SELECT *, a - b AS d, rank() OVER (PARTITION BY model_a, model_b ORDER BY abs(a - b)) AS r FROM pairs) GROUP BY 1, 2)""", _PAIRS + """,
subsets AS (SELECT (m & 1) + 2 * ((m >> 1) & 1) + 3 * ((m >> 2) & 1) + 4 * ((m >> 3) & 1) + 5 * ((m >> 4) & 1) AS s FROM range(32) t(m))"""))
def _(spark, sf):
    return round_doubles(evaluation.wilcoxon_test(by_fold(spark, sf), "auc_roc"))


@query("t15_mann_whitney_test", models_sql("""
SELECT model_a, model_b, 'mannwhitney' AS test, u AS statistic, round(least(2.0 * (SELECT count(*) FROM draws WHERE s - 15 <= least(u, 25 - u)) / 252, 1), 6) AS p_value,
  least(2.0 * (SELECT count(*) FROM draws WHERE s - 15 <= least(u, 25 - u)) / 252, 1) < 0.05 AS significant, NULL::DOUBLE AS effect_size, round(m, 6) AS mean_diff, 5::BIGINT AS sample_size
FROM (SELECT p.model_a, p.model_b, sum(CASE WHEN p.a > q.b THEN 1.0::DOUBLE WHEN p.a = q.b THEN 0.5 ELSE 0 END) AS u, avg(p.a) - avg(q.b) AS m
  FROM pairs p JOIN pairs q ON p.model_a = q.model_a AND p.model_b = q.model_b GROUP BY 1, 2)""", _PAIRS + """,
draws AS (SELECT """ + " + ".join(f"{i + 1} * ((m >> {i}) & 1)" for i in range(10)) + """ AS s FROM range(1024) t(m) WHERE bit_count(m) = 5)"""))
def _(spark, sf):
    return round_doubles(evaluation.mann_whitney_test(by_fold(spark, sf), "auc_roc"))


LOW_GATES = {"precision": 0.2, "recall": 0.3, "f1_score": 0.2}
_BEST = BY_MODEL + """,
gated AS (SELECT *, concat_ws(',', CASE WHEN precision < 0.2 THEN 'precision' END, CASE WHEN recall < 0.3 THEN 'recall' END, CASE WHEN f1_score < 0.2 THEN 'f1_score' END) AS failed_thresholds FROM met),
ok AS (SELECT *, precision * 0.3 + recall * 0.4 + f1_score * 0.2 + auc_roc * 0.1 AS bs FROM gated WHERE failed_thresholds = ''),
rk AS (SELECT *, row_number() OVER w AS rank, """ + ", ".join(f"lead({m}) OVER w AS n_{m}" for m in evaluation.BUSINESS_WEIGHTS) + " FROM ok WINDOW w AS (ORDER BY bs DESC, model))"


@query("t16_best_model", models_sql("""
SELECT g.model, g.failed_thresholds, round(bs, 6) AS business_score, CAST(rank AS INTEGER) AS rank, """ + ", ".join(
    f"round(CASE WHEN rank = 1 AND n_{m} > 0 THEN (rk.{m} - n_{m}) / n_{m} * 100 END, 4) AS {m}_advantage_pct" for m in evaluation.BUSINESS_WEIGHTS)
    + " FROM gated g LEFT JOIN rk ON rk.model = g.model", _BEST))
def _(spark, sf):
    out = evaluation.select_best(by_model(spark, sf), minimums=LOW_GATES)
    leads = [F.round(f"{m}_advantage_pct", 4).alias(f"{m}_advantage_pct") for m in evaluation.BUSINESS_WEIGHTS]
    return out.select("model", F.array_join("failed_thresholds", ",").alias("failed_thresholds"),
                      F.round("business_score", 6).alias("business_score"), "rank", *leads)


@query("t17_selection_report")
def _(spark, sf):
    return evaluation.selection_report(by_model(spark, sf))


# ---- drift ---------------------------------------------------------------------------
FEATURES = [*MEASURES]


def _ks_sql(shift):
    parts = union_all([
        f"SELECT '{c}' AS feature, CAST(step <= 372 AS INTEGER) AS ref, {c}{f' * CASE WHEN step > 372 THEN {shift}::DOUBLE ELSE 1 END' if c == 'amount' else ''} AS v FROM tx"
        for c in FEATURES])
    return f""",
vals AS ({parts}),
cnt AS (SELECT feature, v, sum(ref) AS r, sum(1 - ref) AS c FROM vals GROUP BY feature, v),
cdf AS (SELECT feature, sum(r) OVER w AS cr, sum(c) OVER w AS cc, sum(r) OVER (PARTITION BY feature) AS n, sum(c) OVER (PARTITION BY feature) AS m
  FROM cnt WINDOW w AS (PARTITION BY feature ORDER BY v)),
ks AS (SELECT feature, n::BIGINT AS n_reference, m::BIGINT AS n_current, max(abs(cr / n::DOUBLE - cc / m::DOUBLE)) AS d FROM cdf GROUP BY feature, n, m),
tail AS (SELECT *, (sqrt(n_reference::DOUBLE * n_current / (n_reference + n_current)) + 0.12 + 0.11 / sqrt(n_reference::DOUBLE * n_current / (n_reference + n_current))) * d AS x FROM ks),
pv AS (SELECT *, CASE WHEN x < 0.2 THEN 1.0::DOUBLE ELSE greatest(least((SELECT sum((CASE WHEN k % 2 = 1 THEN 2.0::DOUBLE ELSE -2.0 END) * exp(-2.0 * k * k * x * x)) FROM range(1, 101) t(k)), 1), 0) END AS p FROM tail)"""


KS_SELECT = "SELECT feature, n_reference, n_current, round(d, 6) AS drift_score, round(p, 6) AS p_value, p < 0.05 AS is_drift FROM pv"


@query("m03_j07_feature_drift", tx_sql(KS_SELECT, _ks_sql("1.0")))
def _(spark, sf):
    ref, cur = drift_pair(spark, sf)
    return round_doubles(drift.ks_drift(ref, cur, FEATURES))


@query("m03_feature_drift_shifted", tx_sql(KS_SELECT, _ks_sql("1.2")))
def _(spark, sf):
    ref, cur = drift_pair(spark, sf, 1.2)
    return round_doubles(drift.ks_drift(ref, cur, FEATURES))


# ---- monitoring -------------------------------------------------------------------------
BY_DAY = metrics_cte("(SELECT *, step // 24 AS batch FROM scored)", "batch", "isFraud", "fraud_prediction", "fraud_score", "hist")
BASE = metrics_cte("(SELECT *, 1 AS one FROM scored WHERE step <= 372)", "one", "isFraud", "fraud_prediction", "fraud_score", "base")


def performance_history(spark, sf):
    out = monitoring.batch_performance(scored(spark, sf), F.floor(F.col("step") / 24))
    return out.withColumn("ts", F.timestamp_seconds(F.lit(EPOCH) + F.col("batch") * 86400))


def baseline(spark, sf):
    ref = scored(spark, sf).filter("step <= 372")
    return monitoring.metrics_by(ref, [], "isFraud", "fraud_prediction", "fraud_score")


def drift_history(spark, sf):
    """Three checks of the later half against the earlier one, the last two with moved amounts."""
    out = None
    for day, shift in [("2024-01-22", 1.0), ("2024-01-23", 1.2), ("2024-01-24", 1.2)]:
        ref, cur = drift_pair(spark, sf, shift)
        checked = drift.ks_drift(ref, cur, FEATURES).withColumn("ts", F.lit(day).cast("timestamp"))
        out = checked if out is None else out.unionByName(checked)
    return out


def _drift_history_sql():
    """Same history; an unmoved feature gives equal checks."""
    return _ks_sql("1.2").replace("vals AS", "vals2 AS").replace("cnt AS", "cnt2 AS").replace("cdf AS", "cdf2 AS") \
        .replace("ks AS", "ks2 AS").replace("tail AS", "tail2 AS").replace("pv AS", "pv2 AS") \
        .replace("FROM vals ", "FROM vals2 ").replace("FROM cnt ", "FROM cnt2 ").replace("FROM cdf ", "FROM cdf2 ") \
        .replace("FROM ks)", "FROM ks2)").replace("FROM tail)", "FROM tail2)")


_DRIFTS = _ks_sql("1.0") + _drift_history_sql() + """,
drifts AS (
  SELECT feature, d, p, TIMESTAMP '2024-01-22' AS ts FROM pv
  UNION ALL SELECT feature, d, p, TIMESTAMP '2024-01-23' FROM pv2
  UNION ALL SELECT feature, d, p, TIMESTAMP '2024-01-24' FROM pv2)"""


@query("m01_daily_performance", scored_sql(f"SELECT batch, {ROUNDED} FROM hist", BY_DAY))
def _(spark, sf):
    return round_doubles(performance_history(spark, sf).drop("ts"))


def _histograms(spark, sf):
    """Histograms by day, the days after the 15th added later and the 15th written twice."""
    folder, rows, ts = shared_folder(spark, "histograms"), scored(spark, sf), F.timestamp_seconds(F.lit(EPOCH) + F.col("step") * 3600)
    history.add_days(rows.filter("step < 360"), folder, ts)
    history.add_days(rows.filter("step >= 336"), folder, ts)
    return folder


@query("m01_g05_incremental_days", scored_sql(f"SELECT batch, {ROUNDED} FROM hist", BY_DAY))
def _(spark, sf):
    days = history.daily_metrics(spark, _histograms(spark, sf))
    return round_doubles(days.withColumn("batch", F.datediff("held_day", F.lit("2024-01-01").cast("date")).cast("long")).drop("held_day"))


@query("m01_g05_window_of_days", scored_sql(
    f"SELECT {ROUNDED} FROM base", metrics_cte("(SELECT *, 1 AS one FROM scored WHERE step // 24 BETWEEN 10 AND 16)", "one", "isFraud", "fraud_prediction", "fraud_score", "base")))
def _(spark, sf):
    return round_doubles(history.window_metrics(spark, _histograms(spark, sf), "2024-01-11", "2024-01-17"))


_CELLS = ["amount", "oldbalanceOrg", "newbalanceOrig"]
_CELL_SQL = """CASE WHEN abs(v) < 1e-9 THEN 0 ELSE sign(v) * (floor((ln(abs(v)) - ln(1e-9::DOUBLE)) / 0.02::DOUBLE) + 1) END"""


@query("m03_stored_reference", tx_sql("""
SELECT feature, n_reference, n_current, round(max(abs(cr / n_reference - cc / n_current)), 6) AS drift_score,
  round(max(greatest(r / n_reference, c / n_current)), 6) AS most_below
FROM (SELECT *, sum(r) OVER (PARTITION BY feature ORDER BY cell) AS cr, sum(c) OVER (PARTITION BY feature ORDER BY cell) AS cc,
        (sum(r) OVER (PARTITION BY feature))::BIGINT AS n_reference, (sum(c) OVER (PARTITION BY feature))::BIGINT AS n_current FROM cells)
GROUP BY ALL""", ", long AS (" + union_all([f"SELECT '{c}' AS feature, {c}::DOUBLE AS v, step FROM tx WHERE {c} IS NOT NULL" for c in _CELLS])
    + f"""), cells AS (
  SELECT feature, {_CELL_SQL} AS cell, count(*) FILTER (step < 480) AS r, count(*) FILTER (step >= 480 AND step < 504) AS c
  FROM long WHERE step < 504 GROUP BY ALL)"""))
def _(spark, sf):
    """The 21st day against the stored profile of the twenty before it; the days' rows are read once, when each is written."""
    folder, rows, ts = shared_folder(spark, "reference"), transactions(spark, sf), F.timestamp_seconds(F.lit(EPOCH) + F.col("step") * 3600)
    reference.add_days(rows, _CELLS, folder, ts)
    found = reference.distance(reference.merged(spark, folder, "2024-01-01", "2024-01-20"), reference.merged(spark, folder, "2024-01-21", "2024-01-21"))
    return round_doubles(found.drop("p_value", "is_drift"))


@query("m02_baseline", scored_sql(f"SELECT {ROUNDED} FROM base", BASE))
def _(spark, sf):
    return round_doubles(baseline(spark, sf))


@query("m04_degradation", scored_sql("""
SELECT h.batch, round(b.f1_score - h.f1_score, 6) AS f1_score_drop, round(b.precision - h.precision, 6) AS precision_drop, round(b.recall - h.recall, 6) AS recall_drop,
  CASE WHEN greatest(b.f1_score - h.f1_score, b.precision - h.precision, b.recall - h.recall) > 0.2 THEN 'high' ELSE 'medium' END AS severity
FROM hist h, base b WHERE greatest(b.f1_score - h.f1_score, b.precision - h.precision, b.recall - h.recall) > 0.02""", BY_DAY + BASE))
def _(spark, sf):
    out = monitoring.degradation(performance_history(spark, sf), baseline(spark, sf), limit=0.02)
    return round_doubles(out.select("batch", "f1_score_drop", "precision_drop", "recall_drop", "severity"))


_HEALTH = BY_DAY + BASE + _DRIFTS + """,
recent AS (SELECT * FROM hist ORDER BY batch DESC LIMIT 10),
parts AS (SELECT (SELECT avg(f1_score) FROM recent) AS avg_f1, (SELECT count(*) FROM drifts WHERE p < 0.05 AND ts >= TIMESTAMP '2024-01-24' AND ts <= TIMESTAMP '2024-01-25') AS drift_alerts,
  (SELECT f1_score FROM base) AS bf),
pen AS (SELECT *, least(drift_alerts * 0.1, 0.3) AS drift_penalty, least(greatest(bf - avg_f1, 0) * 2, 0.4) AS drop_penalty FROM parts)"""


@query("m05_health", scored_sql("""
SELECT round(avg_f1, 6) AS avg_f1, drift_alerts, round(drift_penalty, 6)::DOUBLE AS drift_penalty, round(drop_penalty, 6) AS drop_penalty,
  round(greatest(avg_f1 - drift_penalty - drop_penalty, 0), 6) AS health_score FROM pen""", _HEALTH))
def _(spark, sf):
    return round_doubles(monitoring.health(performance_history(spark, sf), drift_history(spark, sf), baseline(spark, sf), AS_OF))


_TREND = BY_DAY + """,
last10 AS (SELECT f1_score, row_number() OVER (ORDER BY batch) - 1 AS x FROM (SELECT * FROM hist ORDER BY batch DESC LIMIT 10)),
fit AS (SELECT count(*) AS records, regr_slope(f1_score, x) AS slope, abs(corr(f1_score, x)) AS r FROM last10),
angle AS (SELECT *, atan(r / sqrt(1 - r * r)) AS a FROM fit),
tested AS (SELECT *, 1 - sin(a) * (1 + cos(a) ** 2 / 2 + 3 * cos(a) ** 4 / 8 + 15 * cos(a) ** 6 / 48) AS p FROM angle)"""


@query("m06_w05_performance_trend", scored_sql("""
SELECT records, round(slope, 6) AS slope, round(p, 6) AS p_value,
  CASE WHEN p < 0.05 AND slope > 0.01 THEN 'improving' WHEN p < 0.05 AND slope < -0.01 THEN 'degrading' ELSE 'stable' END AS trend FROM tested""", _TREND))
def _(spark, sf):
    return round_doubles(monitoring.performance_trend(performance_history(spark, sf)))


@query("m06_w05_running_records", scored_sql("""
SELECT batch, count(*) OVER w AS records, round(avg(f1_score) OVER w, 6) AS average, CASE WHEN count(*) OVER w > 1 THEN round(regr_slope(f1_score, x) OVER w, 6) END AS slope
FROM (SELECT *, row_number() OVER (ORDER BY batch) AS x FROM hist) WINDOW w AS (ORDER BY batch ROWS 9 PRECEDING)""", BY_DAY))
def _(spark, sf):
    out = monitoring.running_recent(performance_history(spark, sf), "f1_score", "ts", "batch")
    return round_doubles(out.select("batch", "records", "average", "slope"))


@query("m06_w05_running_events", """
SELECT event_id, count(*) OVER w AS records, round(avg(value) OVER w, 4) AS average
FROM events WINDOW w AS (ORDER BY ts, event_id ROWS 9 PRECEDING)""")
def _(spark, sf):
    out = monitoring.running_recent(metric_events(spark, sf), "value", "ts", "event_id")
    return round_doubles(out.select("event_id", "records", "average"), 4)


@query("m07_recent_volume", scored_sql("""
SELECT (SELECT count(*) FROM drifts WHERE p < 0.05 AND ts >= TIMESTAMP '2024-01-24' AND ts <= TIMESTAMP '2024-01-25') AS drift_alerts,
  (SELECT count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-20 11:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00') AS prediction_volume""", _DRIFTS))
def _(spark, sf):
    volume = monitoring.prediction_volume(metric_events(spark, sf), "2024-01-20 12:00:00")
    return monitoring.drift_alerts(drift_history(spark, sf), AS_OF).withColumn("prediction_volume", volume.scalar())


@query("m08_drift_summary", scored_sql("""
SELECT feature, count(*) AS total_checks, count(*) FILTER (p < 0.05) AS drift_detections, round(count(*) FILTER (p < 0.05) / count(*)::DOUBLE, 6) AS drift_rate,
  round(arg_max(d, ts), 6) AS latest_drift_score, round(arg_max(p, ts), 6) AS latest_p_value FROM drifts GROUP BY feature""", _DRIFTS))
def _(spark, sf):
    return round_doubles(monitoring.drift_summary(drift_history(spark, sf), AS_OF))


@query("m08_performance_trend_data", scored_sql("""
SELECT batch, round(f1_score, 6) AS f1_score, round(fraud_rate, 6) AS fraud_rate FROM hist WHERE batch >= 17 AND batch <= 24""", BY_DAY))
def _(spark, sf):
    out = monitoring.trend_data(performance_history(spark, sf), AS_OF)
    day = ((F.unix_seconds("ts") - EPOCH) / 86400).cast("bigint").alias("batch")
    return round_doubles(out.select(day, "f1_score", "fraud_rate"))


@query("m08_m10_monitoring_summary", scored_sql("""
SELECT 'monitoring_status' AS section, 'total_performance_records' AS name, count(*)::DOUBLE AS value FROM hist
UNION ALL SELECT 'recent_performance', 'avg_f1_score', round(avg(f1_score), 6) FROM recent
UNION ALL SELECT 'recent_performance', 'avg_precision', round(avg(precision), 6) FROM recent
UNION ALL SELECT 'recent_performance', 'avg_recall', round(avg(recall), 6) FROM recent
UNION ALL SELECT 'recent_performance', 'total_predictions', sum(total_predictions)::DOUBLE FROM recent
UNION ALL SELECT 'recent_performance', 'avg_fraud_rate', round(avg(fraud_rate), 6) FROM recent
UNION ALL SELECT 'drift_status', 'total_drift_detections', count(*)::DOUBLE FROM drifts WHERE p < 0.05
UNION ALL SELECT 'drift_status', 'features_monitored', count(DISTINCT feature)::DOUBLE FROM drifts
UNION ALL SELECT 'drift_status', 'recent_drift_alerts_24h', drift_alerts::DOUBLE FROM parts""", _HEALTH))
def _(spark, sf):
    return round_doubles(monitoring.summary(performance_history(spark, sf), drift_history(spark, sf), AS_OF))


@query("m09_retained_history", scored_sql("SELECT count(*) AS rows FROM hist WHERE batch >= 10 AND batch <= 40", BY_DAY))
def _(spark, sf):
    return monitoring.retained(performance_history(spark, sf), "2024-02-10 00:00:00").agg(F.count("*").alias("rows"))


@query("m09_days_left", scored_sql("SELECT CAST(DATE '2024-01-01' + CAST(batch AS INTEGER) AS VARCHAR) AS day, 1::BIGINT AS rows FROM hist WHERE batch >= 11", BY_DAY))
def _(spark, sf):
    folder, at = shared_folder(spark, "history"), F.col("ts")
    retention.write_days(performance_history(spark, sf), folder, at)
    retention.drop_before(spark, folder, "2024-01-11 12:00:00", at)
    return retention.read_days(spark, folder).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("rows"))


@query("m11_limit_alerts", scored_sql("""
SELECT type, severity, metric, threshold, round(current_value, 6) AS current_value FROM (
  SELECT 'accuracy_low' AS type, 'medium' AS severity, 'accuracy' AS metric, 0.8::DOUBLE AS threshold, accuracy AS current_value, accuracy < 0.8 AS hit FROM base
  UNION ALL SELECT 'f1_score_low', 'medium', 'f1_score', 0.7, f1_score, f1_score < 0.7 FROM base
  UNION ALL SELECT 'drift_alerts_high', 'high', 'drift_alerts', 5.0, total_predictions, total_predictions > 5 FROM base
  UNION ALL SELECT 'response_time_high', 'medium', 'response_time', 1.0, 0.1, false FROM base) WHERE hit""", BASE))
def _(spark, sf):
    now = baseline(spark, sf).select("accuracy", "f1_score", F.col("total_predictions").alias("drift_alerts"), F.lit(0.1).alias("response_time"))
    return round_doubles(monitoring.limit_alerts(now))


@query("m12_current_and_average", scored_sql(union_all(
    [f"SELECT '{m}' AS metric, round(arg_max({m}, batch), 6) AS current, round(avg({m}), 6) AS average FROM hist" for m in ("f1_score", "precision", "recall")]), BY_DAY))
def _(spark, sf):
    return round_doubles(monitoring.current_and_average(performance_history(spark, sf)))


@query("m12_drift_overview", scored_sql("""
SELECT count(*) AS total_features, count(*) FILTER (r > 0) AS features_with_drift, count(*) FILTER (r > 0.1) AS high_drift_features
FROM (SELECT feature, count(*) FILTER (p < 0.05) / count(*)::DOUBLE AS r FROM drifts GROUP BY feature)""", _DRIFTS))
def _(spark, sf):
    return monitoring.drift_overview(monitoring.drift_summary(drift_history(spark, sf), AS_OF))


@query("m13_instruments", """
SELECT event_type AS name, count(*) AS readings, round(sum(value), 4) AS counter, arg_max(value, (ts, event_id)) AS gauge FROM events GROUP BY event_type""")
def _(spark, sf):
    return round_doubles(monitoring.instruments(metric_events(spark, sf)), 4)


@query("m13_histogram_window", """
SELECT event_type AS name, count(*) AS readings, min(value) AS min, max(value) AS max, round(avg(value), 4) AS avg
FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY event_type""")
def _(spark, sf):
    return round_doubles(monitoring.histogram_window(metric_events(spark, sf), "2024-01-20 00:00:00", hours=240), 4)


# Clicks start a user's timer, purchases stop it.
TIMERS_SQL = """
WITH moves AS (
  SELECT user_id, event_id, epoch_us(ts) AS us, event_type = 'click' AS is_start FROM events WHERE event_type IN ('click', 'purchase')),
summed AS (SELECT *, sum(CASE WHEN is_start THEN 1 ELSE -1 END) OVER w AS h FROM moves WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
grounded AS (SELECT *, least(0, coalesce(min(h) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS g FROM summed),
placed AS (SELECT *, CAST(CASE WHEN is_start THEN h - g WHEN h < g THEN 0 ELSE h - g + 1 END AS BIGINT) AS depth FROM grounded),
followed AS (SELECT *, lead(event_id) OVER w AS stop_id, lead(us) OVER w AS stop_us FROM placed WINDOW w AS (PARTITION BY user_id, depth ORDER BY us, event_id)),
timers AS (
  SELECT user_id, event_id AS start_id, stop_id, us AS start_us, stop_us, (stop_us - us) / 1000.0::DOUBLE AS duration_ms, depth, 'matched' AS status
  FROM followed WHERE is_start AND stop_us - us <= 43200000000
  UNION ALL SELECT user_id, event_id, NULL, us, NULL, NULL, depth, 'unfinished' FROM followed WHERE is_start AND (stop_us IS NULL OR stop_us - us > 43200000000)
  UNION ALL SELECT user_id, NULL, stop_id, NULL, stop_us, NULL, 0, 'unstarted' FROM followed WHERE is_start AND stop_us - us > 43200000000
  UNION ALL SELECT user_id, NULL, event_id, NULL, us, NULL, 0, 'unstarted' FROM followed WHERE NOT is_start AND depth = 0)"""


def timer_events(events: DataFrame) -> DataFrame:
    kinds = events.where(F.col("event_type").isin("click", "purchase"))
    return kinds.select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "click").alias("is_start"))


@query("m13_timers", TIMERS_SQL + "SELECT * FROM timers")
def _(spark, sf):
    return timers.match_timers(timer_events(table(spark, sf, "events")), ["user_id"], expiry_seconds=12 * 3600)


@query("m13_timer_histogram", TIMERS_SQL + """
SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END || '_duration_ms' AS name, count(*) AS readings, min(duration_ms) AS min, max(duration_ms) AS max,
  round(avg(duration_ms), 4) AS avg FROM timers
WHERE status = 'matched' AND stop_us BETWEEN epoch_us(TIMESTAMP '2024-01-10 00:00:00') AND epoch_us(TIMESTAMP '2024-01-20 00:00:00') GROUP BY 1""")
def _(spark, sf):
    found = timers.match_timers(timer_events(table(spark, sf, "events")), ["user_id"], expiry_seconds=12 * 3600)
    readings = timers.timer_readings(found, F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd"))
    return round_doubles(monitoring.histogram_window(readings, "2024-01-20 00:00:00", hours=240), 4)


METRIC_SUMMARY_SQL = """
SELECT epoch(time_bucket(INTERVAL '5 minutes', ts))::BIGINT AS window_start, event_type AS name, count(*) AS count, min(value) AS min, max(value) AS max,
  round(avg(value), 4) AS avg, round(sum(value), 4) AS sum FROM events GROUP BY 1, 2"""


@query("m14_metric_summary", METRIC_SUMMARY_SQL)
def _(spark, sf):
    out = monitoring.metric_summary(metric_events(spark, sf))
    return round_doubles(out.withColumn("window_start", F.unix_seconds("window_start")).drop("window_end"), 4)


@query("m15_rule_alerts", """
SELECT 'HighErrorRate' AS rule, w AS window_start, round(count(*) / 300.0::DOUBLE, 6) AS value FROM (
  SELECT unnest(range((epoch_us(ts) // 60000000) * 60 - 240, (epoch_us(ts) // 60000000) * 60 + 60, 60)) AS w FROM events WHERE event_type = 'error')
GROUP BY w HAVING count(*) / 300.0 > 0.003 UNION ALL
SELECT 'HighFraudRate', w, round(count(*) / 600.0::DOUBLE, 6) FROM (
  SELECT unnest(range((epoch_us(ts) // 60000000) * 60 - 540, (epoch_us(ts) // 60000000) * 60 + 60, 60)) AS w FROM events WHERE event_type = 'purchase')
GROUP BY w HAVING count(*) / 600.0 > 0.003""")
def _(spark, sf):
    rules = [("HighErrorRate", "error", "5 minutes", "rate", 0.003), ("HighFraudRate", "fraud", "10 minutes", "rate", 0.003)]
    out = monitoring.rule_alerts(metric_events(spark, sf), rules, {"fraud": "purchase"})
    return round_doubles(out.withColumn("window_start", F.unix_seconds("window_start")))


@query("m15_latency_rule", """
SELECT 'HighResponseTime' AS rule, w AS window_start, quantile_disc(value, 0.95) AS value FROM (
  SELECT value, unnest(range((epoch_us(ts) // 60000000) * 60 - 240, (epoch_us(ts) // 60000000) * 60 + 60, 60)) AS w FROM events WHERE event_type = 'view')
GROUP BY w HAVING quantile_disc(value, 0.95) > 100""")
def _(spark, sf):
    rules = [("HighResponseTime", "response", "5 minutes", "p95", 100.0)]
    out = monitoring.rule_alerts(metric_events(spark, sf), rules, {"response": "view"})
    return out.withColumn("window_start", F.unix_seconds("window_start"))


@query("m15_failure_rule", """
SELECT 'ModelPredictionFailure' AS rule, w AS window_start, round(count(*) / 300.0::DOUBLE, 6) AS value FROM (
  SELECT unnest(range((epoch_us(ts) // 60000000) * 60 - 240, (epoch_us(ts) // 60000000) * 60 + 60, 60)) AS w FROM events WHERE event_type = 'signup')
GROUP BY w HAVING count(*) / 300.0 > 0.003""")
def _(spark, sf):
    rules = [("ModelPredictionFailure", "failure", "5 minutes", "rate", 0.003)]
    out = monitoring.rule_alerts(metric_events(spark, sf), rules, {"failure": "signup"})
    return round_doubles(out.withColumn("window_start", F.unix_seconds("window_start")))
