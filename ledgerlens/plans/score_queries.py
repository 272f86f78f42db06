"""Registered queries: scoring, explanations, alerts, decision log."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import risk
from ..functions.columns import round_doubles
from ..operators import alerts, decisions, monitoring, quality, ranges, retention, scoring
from ..session import shared_folder
from ..sources.driver_tables import alert_scores, outcomes, scored, table, transactions
from .base import (
    AMOUNT_RISK_SQL, BALANCE_RISK_SQL, HOUR_RISK_SQL, TYPE_RISK_SQL, events_sql, query, scored_sql, tx_sql,
)

DAY = 86400
SLOW = alerts.with_cooldowns([1 * DAY, 5 * DAY, 15 * DAY])
EVENTS_AS_OF = "2024-01-20 00:00:00"
DECISION_EPOCH = 1704067200
DECISIONS_AS_OF = "2024-01-25 00:00:00"

LEVEL_SQL = "CASE WHEN fraud_score >= 0.8 THEN 'HIGH' WHEN fraud_score >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END"


# ---- scoring ---------------------------------------------------------------------
@query("d01_batch_score", scored_sql(f"""
SELECT tx_id, fraud_score, fraud_prediction, {LEVEL_SQL} AS risk_level FROM scored"""))
def _(spark, sf):
    return scoring.batch_score(transactions(spark, sf)).select("tx_id", "fraud_score", "fraud_prediction", "risk_level")


@query("d03_levels_and_confidence", scored_sql(f"""
SELECT tx_id, {LEVEL_SQL} AS risk_level,
  CASE WHEN fraud_score >= 0.9 THEN 'critical' WHEN fraud_score >= 0.7 THEN 'high' WHEN fraud_score >= 0.3 THEN 'medium' ELSE 'low' END AS decision_level,
  CASE WHEN fraud_score >= 0.9 THEN 'CRITICAL' WHEN fraud_score >= 0.8 THEN 'HIGH' WHEN fraud_score >= 0.6 THEN 'MEDIUM' ELSE 'LOW' END AS alert_level,
  round(least(abs(fraud_score - 0.5) * 2, 1), 6) AS confidence FROM scored"""))
def _(spark, sf):
    s = F.col("fraud_score")
    return scored(spark, sf).select(
        "tx_id", risk.risk_level(s).alias("risk_level"), risk.decision_level(s).alias("decision_level"),
        risk.alert_level(s).alias("alert_level"), F.round(risk.confidence(s), 6).alias("confidence"),
    )


@query("d04_d07_risk_components", tx_sql(f"""
SELECT tx_id, {TYPE_RISK_SQL} AS type_risk, {AMOUNT_RISK_SQL} AS amount_risk, {BALANCE_RISK_SQL} AS balance_risk, {HOUR_RISK_SQL} AS hour_risk FROM tx"""))
def _(spark, sf):
    return scoring.components(transactions(spark, sf)).select("tx_id", "type_risk", "amount_risk", "balance_risk", "hour_risk")


_MONEY = "format('{:,.2f}', amount)"
_FACTORS = f""",
found AS (SELECT *,
  ([CASE WHEN tr > 0.7 THEN 'High-risk transaction type: ' || type END,
   CASE WHEN amount > 200000 THEN 'Large transaction amount: ' || {_MONEY} END,
   CASE WHEN oldbalanceOrg > 0 AND newbalanceOrig = 0 THEN 'Complete balance depletion detected' END]) AS high,
  ([CASE WHEN tr > 0.4 AND tr <= 0.7 THEN 'Medium-risk transaction type: ' || type END,
   CASE WHEN amount > 50000 AND amount <= 200000 THEN 'Moderate transaction amount: ' || {_MONEY} END,
   CASE WHEN oldbalanceOrg = 0 AND newbalanceOrig = 0 THEN 'Zero balance transaction' END,
   CASE WHEN hr > 0.6 THEN 'Transaction at high-risk hour: ' || (step % 24) END]) AS medium,
  ([CASE WHEN nameDest LIKE 'M%' THEN 'Transaction to merchant account'
   WHEN nameOrig NOT LIKE 'M%' THEN 'Customer-to-customer transaction' END]) AS low
  FROM (SELECT *, {TYPE_RISK_SQL} AS tr, {HOUR_RISK_SQL} AS hr FROM scored))"""


def _join(items, sep):
    return f"coalesce(array_to_string({items}, '{sep}'), '')"


@query("d08_risk_factors", scored_sql(f"""
SELECT tx_id, {_join('high', '|')} AS high, {_join('medium', '|')} AS medium, {_join('low', '|')} AS low FROM found""", _FACTORS))
def _(spark, sf):
    found = scored(spark, sf).select("tx_id", risk.factors().alias("f"))
    return found.select("tx_id", *[F.array_join(F.col("f")[n], "|").alias(n) for n in ("high", "medium", "low")])


def _bullets(title, items):
    nl = "' || chr(10) || '"
    return (f"CASE WHEN {_join(items, '|')} <> '' THEN '{nl}{title}' || chr(10) || '• ' || "
            f"replace({_join(items, '|')}, '|', chr(10) || '• ') ELSE '' END")


@query("d09_explanation_text", scored_sql(f"""
SELECT tx_id, {LEVEL_SQL} || ' RISK: This transaction has a ' || printf('%.1f%%', fraud_score * 100) || ' probability of being fraudulent.'
  || {_bullets('Critical risk factors identified:', 'high')} || {_bullets('Moderate risk factors identified:', 'medium')}
  || CASE WHEN fraud_score < 0.5 THEN {_bullets('Low risk indicators:', 'low')} ELSE '' END AS text FROM found""", _FACTORS))
def _(spark, sf):
    return scoring.explain(scored(spark, sf)).select("tx_id", F.col("explanation.text").alias("text"))


@query("d10_recommendations", scored_sql("""
SELECT tx_id, CASE
  WHEN fraud_score >= 0.8 THEN 'IMMEDIATE ACTION REQUIRED: Block transaction and investigate|Contact customer to verify transaction legitimacy|Review account for other suspicious activities|Consider temporary account restrictions'
  WHEN fraud_score >= 0.5 THEN 'Enhanced verification recommended|Request additional authentication from customer|Monitor account for follow-up transactions|Consider manual review by fraud analyst'
  ELSE 'Transaction appears legitimate|Continue normal processing|Maintain standard monitoring' END
  || CASE WHEN amount > 200000 THEN '|Verify large amount with customer via secure channel' ELSE '' END
  || CASE WHEN oldbalanceOrg > 0 AND newbalanceOrig = 0 THEN '|Investigate potential account takeover' ELSE '' END AS recommendations FROM scored"""))
def _(spark, sf):
    out = scoring.explain(scored(spark, sf))
    return out.select("tx_id", F.array_join("explanation.recommendations", "|").alias("recommendations"))


@query("d11_explanation_record", scored_sql(f"""
SELECT tx_id, fraud_score, {LEVEL_SQL} AS risk_level, {TYPE_RISK_SQL} AS type_score, {AMOUNT_RISK_SQL} AS amount_score,
  {BALANCE_RISK_SQL} AS balance_score, {HOUR_RISK_SQL} AS time_score FROM scored"""))
def _(spark, sf):
    e = F.col("explanation")
    scores = e["risk_factors"]["risk_scores"]
    return scoring.explain(scored(spark, sf)).select(
        "tx_id", e["fraud_score"].alias("fraud_score"), e["risk_level"].alias("risk_level"),
        scores["transaction_type"].alias("type_score"), scores["amount"].alias("amount_score"),
        scores["balance_patterns"].alias("balance_score"), scores["time_patterns"].alias("time_score"),
    )


@query("d12_batch_totals", scored_sql("""
SELECT count(*) AS total_transactions, count(*) FILTER (fraud_prediction = 1) AS fraud_detected, count(*) FILTER (fraud_score >= 0.8) AS high_risk,
  count(*) FILTER (fraud_score >= 0.5 AND fraud_score < 0.8) AS medium_risk, count(*) FILTER (fraud_score < 0.5) AS low_risk FROM scored"""))
def _(spark, sf):
    return scoring.totals(scoring.batch_score(transactions(spark, sf)))


@query("d13_moved_thresholds", scored_sql("""
SELECT CASE WHEN fraud_score >= 0.7 THEN 'HIGH' WHEN fraud_score >= 0.4 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level, count(*) AS rows FROM scored GROUP BY 1"""))
def _(spark, sf):
    moved = scoring.Thresholds().updated(risk=0.4, high=0.7)
    return scoring.batch_score(transactions(spark, sf), thresholds=moved).groupBy("risk_level").agg(F.count("*").alias("rows"))


@query("d14_rule_score", scored_sql("SELECT tx_id, fraud_score FROM scored"))
def _(spark, sf):
    return scored(spark, sf).select("tx_id", "fraud_score")


@query("p11_result_filters", scored_sql("SELECT tx_id, fraud_score FROM scored WHERE fraud_score >= 0.5 AND fraud_score < 0.8 AND fraud_prediction = 1"))
def _(spark, sf):
    rows = scoring.batch_score(transactions(spark, sf))
    return scoring.select_results(rows, "MEDIUM", 1).select("tx_id", "fraud_score")


@query("p14_last_hours", events_sql("SELECT tx_id, fraud_score FROM scores WHERE ts >= TIMESTAMP '2024-01-19 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00'"))
def _(spark, sf):
    return quality.since(alert_scores(spark, sf), EVENTS_AS_OF, hours=24).select("tx_id", "fraud_score")


# ---- alerts ----------------------------------------------------------------------
_MATCHED = f""",
matched AS (SELECT *, CASE WHEN fraud_score >= 0.9 THEN 'critical_fraud' WHEN fraud_score >= 0.8 THEN 'high_risk_fraud' ELSE 'medium_risk_fraud' END AS threshold_name,
  CASE WHEN fraud_score >= 0.9 THEN 'CRITICAL' WHEN fraud_score >= 0.8 THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  CASE WHEN fraud_score >= 0.9 THEN {1 * DAY} WHEN fraud_score >= 0.8 THEN {5 * DAY} ELSE {15 * DAY} END AS gap
  FROM scores WHERE fraud_score >= 0.6)"""
_EMITTED = _MATCHED + """,
ordered AS (SELECT *, epoch_us(ts) AS us, row_number() OVER (PARTITION BY threshold_name, nameOrig ORDER BY ts, tx_id) AS r FROM matched),
walk AS (
  SELECT tx_id, threshold_name, nameOrig, r, us AS last, true AS emitted FROM ordered WHERE r = 1
  UNION ALL
  SELECT o.tx_id, o.threshold_name, o.nameOrig, o.r, CASE WHEN o.us - w.last >= o.gap::BIGINT * 1000000 THEN o.us ELSE w.last END, o.us - w.last >= o.gap::BIGINT * 1000000
  FROM walk w JOIN ordered o ON o.threshold_name = w.threshold_name AND o.nameOrig = w.nameOrig AND o.r = w.r + 1),
alerts AS (SELECT m.*, md5(m.threshold_name || '|' || m.tx_id) AS alert_id FROM matched m JOIN walk w ON w.tx_id = m.tx_id WHERE emitted),
acked AS (SELECT *, tx_id % 3 = 0 AS acked FROM alerts)"""


def raised(spark, sf):
    return alerts.raise_alerts(alert_scores(spark, sf), SLOW)


def acknowledged(spark, sf):
    """Alerts of every third event acknowledged, first by one and then by another analyst."""
    out = raised(spark, sf)
    acks = out.filter(F.col("tx_id") % 3 == 0).select("alert_id", F.inline(F.array(
        F.struct(F.lit("first").alias("acknowledged_by"), F.col("ts").alias("acknowledged_at")),
        F.struct(F.lit("second").alias("acknowledged_by"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("acknowledged_at")))))
    return alerts.acknowledge(out, acks)


@query("l01_j03_threshold_use", events_sql("""
SELECT threshold_name, min(severity) AS severity, count(*) AS rows, round(min(fraud_score), 6) AS lowest FROM matched GROUP BY threshold_name""", _MATCHED))
def _(spark, sf):
    used = alerts.match(alert_scores(spark, sf), SLOW).groupBy("threshold_name").agg(
        F.count("*").alias("rows"), F.min("fraud_score").alias("lowest"))
    table = alerts.threshold_table(spark, SLOW).select(F.col("name").alias("threshold_name"), "severity")
    return round_doubles(used.join(F.broadcast(table), "threshold_name"))


@query("l02_changed_thresholds", events_sql("""
SELECT CASE WHEN fraud_score >= 0.95 THEN 'urgent' ELSE 'high_risk_fraud' END AS threshold_name, count(*) AS rows
FROM scores WHERE fraud_score >= 0.95 OR (fraud_score >= 0.7 AND fraud_score < 0.9) GROUP BY 1"""))
def _(spark, sf):
    changed = alerts.remove_threshold(alerts.DEFAULT_THRESHOLDS, "critical_fraud")
    changed = alerts.update_threshold(changed, "high_risk_fraud", low=0.7)
    changed = alerts.update_threshold(changed, "medium_risk_fraud", enabled=False)
    changed = alerts.add_threshold(changed, alerts.Threshold("urgent", 0.95, 1.0, "CRITICAL", 60))
    return alerts.match(alert_scores(spark, sf), changed).groupBy("threshold_name").agg(F.count("*").alias("rows"))


@query("l03_alert_cooldown_batch", events_sql(
    "SELECT tx_id, threshold_name, nameOrig, epoch_us(ts) AS us FROM alerts", _EMITTED, recursive=True))
def _(spark, sf):
    return raised(spark, sf).select("tx_id", "threshold_name", "nameOrig", F.unix_micros("ts").alias("us"))


@query("l03_alert_cooldown_long_runs", events_sql(
    "SELECT tx_id, threshold_name, nameOrig, epoch_us(ts) AS us FROM alerts", _EMITTED, recursive=True))
def _(spark, sf):
    """The same alerts with every run of more than two instants sent through jump tables."""
    out = alerts.raise_alerts(alert_scores(spark, sf), SLOW, fold_rows=2)
    return out.select("tx_id", "threshold_name", "nameOrig", F.unix_micros("ts").alias("us"))


@query("l04_l06_alert_records", events_sql("""
SELECT alert_id, severity, CASE WHEN fraud_score >= 0.9 THEN 'CRITICAL' WHEN fraud_score >= 0.8 THEN 'HIGH' ELSE 'MEDIUM' END AS risk_level,
  'FRAUD ALERT: ' || severity || ' | Score: ' || printf('%.3f', fraud_score) || ' | Transaction: ' || type || ' $' || format('{:,.2f}', amount) || ' | Account: ' || nameOrig AS message
FROM alerts""", _EMITTED, recursive=True))
def _(spark, sf):
    return raised(spark, sf).select("alert_id", "severity", "risk_level", "message")


@query("l05_notification_outbox", events_sql("""
SELECT channel, count(*) AS messages FROM (SELECT unnest(CASE severity WHEN 'CRITICAL' THEN ['EMAIL', 'SMS', 'LOG_ONLY']
  WHEN 'HIGH' THEN ['EMAIL', 'LOG_ONLY'] ELSE ['LOG_ONLY'] END) AS channel FROM alerts) GROUP BY channel""", _EMITTED, recursive=True))
def _(spark, sf):
    return alerts.outbox(raised(spark, sf)).groupBy("channel").agg(F.count("*").alias("messages"))


@query("l07_acknowledged_alerts", events_sql("""
SELECT alert_id, CASE WHEN acked THEN 'ACKNOWLEDGED' ELSE 'PENDING' END AS status, CASE WHEN acked THEN 'second' END AS acknowledged_by FROM acked""", _EMITTED, recursive=True))
def _(spark, sf):
    return acknowledged(spark, sf).select("alert_id", "status", "acknowledged_by")


@query("l08_active_alerts", events_sql("SELECT alert_id, severity FROM acked WHERE NOT acked AND severity = 'HIGH'", _EMITTED, recursive=True))
def _(spark, sf):
    return alerts.active(acknowledged(spark, sf), "HIGH").select("alert_id", "severity")


@query("l08_w06_newest_alerts", events_sql("""
SELECT alert_id, severity, epoch_us(ts) AS us FROM alerts WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00'""", _EMITTED, recursive=True))
def _(spark, sf):
    past = alerts.history(raised(spark, sf), EVENTS_AS_OF, hours=120)
    return alerts.newest_first(past).select("alert_id", "severity", F.unix_micros("ts").alias("us"))


@query("l09_alert_statistics", events_sql("""
SELECT count(*) AS total_alerts, count(*) FILTER (severity = 'CRITICAL') AS critical, count(*) FILTER (severity = 'HIGH') AS high,
  count(*) FILTER (severity = 'MEDIUM') AS medium, count(*) FILTER (severity = 'LOW') AS low, count(*) FILTER (NOT acked) AS active_alerts,
  count(*) FILTER (acked) AS acknowledged_alerts, 0::BIGINT AS failed_alerts, 0.0::DOUBLE AS notification_success_rate, max(epoch_us(ts)) AS last_us FROM acked""", _EMITTED, recursive=True))
def _(spark, sf):
    out = alerts.statistics(acknowledged(spark, sf))
    return out.withColumn("last_us", F.unix_micros("last_alert_time")).drop("last_alert_time")


@query("l10_retained_alerts", events_sql("""
SELECT alert_id FROM alerts WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-02-04 00:00:00'""", _EMITTED, recursive=True))
def _(spark, sf):
    return alerts.retained(raised(spark, sf), "2024-02-04 00:00:00").select("alert_id")


def days_left(spark, df, at, limit, purpose):
    """Rows a day after ``df`` was written by day and the days before ``limit`` were dropped."""
    folder = shared_folder(spark, purpose)
    retention.write_days(df, folder, at)
    retention.drop_before(spark, folder, limit, at)
    return retention.read_days(spark, folder).groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("rows"))


@query("l10_days_left", events_sql("""
SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, count(*) AS rows FROM alerts WHERE ts >= TIMESTAMP '2024-01-11 09:30:00' GROUP BY 1""", _EMITTED, recursive=True))
def _(spark, sf):
    return days_left(spark, raised(spark, sf), F.col("ts"), alerts.oldest_kept("2024-02-10 09:30:00"), "alerts")


@query("l11_severity_share", events_sql("""
SELECT s.severity, count(a.severity) AS alerts, round(count(a.severity) / (SELECT count(*) FROM alerts)::DOUBLE, 6) AS share
FROM (SELECT unnest(['critical', 'high', 'medium', 'low']) AS severity) s LEFT JOIN alerts a ON lower(a.severity) = s.severity GROUP BY s.severity""", _EMITTED, recursive=True))
def _(spark, sf):
    return round_doubles(alerts.severity_share(raised(spark, sf)))


@query("j02_threshold_ranges", events_sql("""
SELECT tx_id, threshold_name, severity FROM matched""", _MATCHED))
def _(spark, sf):
    return alerts.match(alert_scores(spark, sf), SLOW).select("tx_id", "threshold_name", "severity")


@query("j02_l02_range_table", events_sql("""
SELECT tx_id, min(position) AS position FROM scores JOIN ranges ON fraud_score >= low AND fraud_score < high GROUP BY tx_id""", """,
ranges AS (SELECT c_custkey AS position, (c_custkey * 7919 % 10000) / 10000.0::DOUBLE AS low,
  (c_custkey * 7919 % 10000) / 10000.0::DOUBLE + (1 + c_custkey % 40) / 20000.0::DOUBLE AS high FROM customer)"""))
def _(spark, sf):
    """As many ranges as customers."""
    low = F.col("c_custkey") * 7919 % 10000 / F.lit(10000.0)
    held = table(spark, sf, "customer").select(F.col("c_custkey").alias("position"), low.alias("low"), (low + (1 + F.col("c_custkey") % 40) / F.lit(20000.0)).alias("high"))
    return ranges.lowest_match(alert_scores(spark, sf), "fraud_score", "tx_id", held, top=float("inf"))


# ---- decision log ------------------------------------------------------------------
_TS = f"{DECISION_EPOCH} + step * 3600"
_DECISIONS = f""",
decisions AS (SELECT md5(CAST(tx_id AS VARCHAR)) AS decision_id, {_TS} AS ts, tx_id, isFraud, fraud_score, fraud_prediction AS prediction, amount, type,
  CASE WHEN fraud_score >= 0.9 THEN 'critical' WHEN fraud_score >= 0.7 THEN 'high' WHEN fraud_score >= 0.3 THEN 'medium' ELSE 'low' END AS risk_level,
  fraud_score >= 0.7 AS human_review_required, fraud_score >= 0.5 AS alert_generated,
  CASE WHEN tx_id % 3 = 0 THEN isFraud END AS actual_outcome FROM scored)"""
_CUT = 1706140800  # 2024-01-25


def decision_log(spark, sf):
    ts = F.timestamp_seconds(F.lit(DECISION_EPOCH) + F.col("step") * 3600)
    return decisions.decide(scored(spark, sf), ts=ts)


_DEC = "CAST(CAST({} AS DECIMAL(30, 4)) AS VARCHAR)"


@query("g01_g03_decision_records", scored_sql("""
SELECT decision_id, ts AS us, fraud_score, prediction, risk_level, human_review_required, alert_generated FROM decisions""", _DECISIONS))
def _(spark, sf):
    return decision_log(spark, sf).select(
        "decision_id", F.unix_seconds("ts").alias("us"), "fraud_score", "prediction", "risk_level", "human_review_required", "alert_generated")


@query("g02_transaction_hash", tx_sql(f"""
SELECT tx_id, sha256({_DEC.format('amount')} || '|' || {_DEC.format('newbalanceOrig')} || '|' || {_DEC.format('oldbalanceOrg')} || '|' || step || '|' || type) AS transaction_hash FROM tx"""))
def _(spark, sf):
    return transactions(spark, sf).select("tx_id", decisions.transaction_hash().alias("transaction_hash"))


@query("g03_batch_summary", scored_sql("""
SELECT 'nightly' AS batch_id, count(*) AS total_transactions, sum(fraud_prediction)::BIGINT AS fraud_predictions,
  count(*) FILTER (fraud_score >= 0.8) AS high_risk_count, count(*) FILTER (fraud_score >= 0.5 AND fraud_score < 0.8) AS medium_risk_count,
  count(*) FILTER (fraud_score < 0.5) AS low_risk_count, round(avg(fraud_score), 6) AS avg_fraud_score, 0.0::DOUBLE AS processing_time_ms,
  'v1.0.0' AS model_version, 'batch' AS data_source FROM scored"""))
def _(spark, sf):
    return round_doubles(decisions.batch_summary(scoring.batch_score(transactions(spark, sf)), "nightly"))


_STATS_SQL = f"""
SELECT count(*) AS total_decisions, count(*) FILTER (prediction = 1) AS fraud_predictions, round(count(*) FILTER (prediction = 1) / count(*)::DOUBLE, 6) AS fraud_rate,
  count(*) FILTER (risk_level = 'low') AS low_count, count(*) FILTER (risk_level = 'medium') AS medium_count, count(*) FILTER (risk_level = 'high') AS high_count,
  count(*) FILTER (risk_level = 'critical') AS critical_count, round(avg(fraud_score), 6) AS avg_fraud_score, round(avg(fraud_score), 6) AS avg_confidence,
  NULL::DOUBLE AS avg_processing_time_ms, count(*) FILTER (human_review_required) AS human_reviews_required, count(*) FILTER (alert_generated) AS alerts_generated,
  round(count(*) FILTER (human_review_required) / count(*)::DOUBLE, 6) AS human_review_rate FROM decisions WHERE ts >= {_CUT} - 48 * 3600 AND ts <= {_CUT}"""


@query("g04_decision_statistics", scored_sql(_STATS_SQL, _DECISIONS))
def _(spark, sf):
    return round_doubles(decisions.statistics(decision_log(spark, sf), DECISIONS_AS_OF, hours=48))


@query("m12_alert_rates", scored_sql(f"""
SELECT round(human_review_rate * 100, 4) AS human_review_rate_pct, round(alerts_generated * 100.0::DOUBLE / greatest(total_decisions, 1), 4) AS alert_rate_pct
FROM ({_STATS_SQL.replace("round(count(*) FILTER (human_review_required) / count(*)::DOUBLE, 6)", "count(*) FILTER (human_review_required) / count(*)::DOUBLE")}) s""", _DECISIONS))
def _(spark, sf):
    stats = decisions.statistics(decision_log(spark, sf), DECISIONS_AS_OF, hours=48)
    return round_doubles(monitoring.alert_rates(stats), 4)


@query("g05_outcome_feedback", scored_sql(f"""
SELECT tp AS true_positives, tn AS true_negatives, fp AS false_positives, fn AS false_negatives, round((tp + tn)::DOUBLE / n, 6) AS accuracy,
  round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / (tp + fn), 6) AS recall, round(2.0 * tp / (2 * tp + fp + fn), 6) AS f1_score,
  round((rp - p * (p + 1) / 2.0) / (p * (n - p)::DOUBLE), 6) AS auc_roc, round(fp::DOUBLE / (fp + tn), 6) AS false_positive_rate,
  round(fn::DOUBLE / (fn + tp), 6) AS false_negative_rate FROM (
  SELECT count(*) n, count(*) FILTER (y = 1) p, count(*) FILTER (y = 1 AND prediction = 1) tp, count(*) FILTER (y = 0 AND prediction = 0) tn,
    count(*) FILTER (y = 0 AND prediction = 1) fp, count(*) FILTER (y = 1 AND prediction = 0) fn, sum(r) FILTER (y = 1) rp
  FROM (SELECT actual_outcome AS y, prediction, rank() OVER (ORDER BY fraud_score) + (count(*) OVER (PARTITION BY fraud_score) - 1) / 2.0::DOUBLE AS r
        FROM decisions WHERE actual_outcome IS NOT NULL AND ts >= {_CUT} - 7 * 86400 AND ts <= {_CUT}))""", _DECISIONS))
def _(spark, sf):
    out = decisions.feedback(decision_log(spark, sf), outcomes(spark, sf), DECISIONS_AS_OF, days=7)
    return round_doubles(out.drop("specificity", "average_precision", "fraud_rate", "total_predictions", "positive_samples"))


@query("g06_retained_decisions", scored_sql("SELECT count(*) AS rows FROM decisions WHERE 1926979200 - ts <= 2555 * 86400", _DECISIONS))
def _(spark, sf):
    return decisions.retained(decision_log(spark, sf), "2031-01-24 00:00:00").agg(F.count("*").alias("rows"))


@query("g06_days_left", scored_sql("""
SELECT strftime(to_timestamp(ts + 2555 * 86400) AT TIME ZONE 'UTC', '%Y-%m-%d') AS day, count(*) AS rows FROM decisions
WHERE ts + 2555 * 86400 >= epoch(TIMESTAMP '2031-01-24 07:00:00') GROUP BY 1""", _DECISIONS))
def _(spark, sf):
    return days_left(spark, decision_log(spark, sf), decisions.kept_until(), "2031-01-24 07:00:00", "decisions")


@query("j01_latest_outcome_join", scored_sql("SELECT decision_id, prediction, actual_outcome FROM decisions", _DECISIONS))
def _(spark, sf):
    return decisions.with_outcomes(decision_log(spark, sf), outcomes(spark, sf)).select("decision_id", "prediction", "actual_outcome")


@query("s08_decision_export", scored_sql(f"""
SELECT decision_id, ts AS seconds, fraud_score, prediction, fraud_score AS confidence, risk_level, amount AS transaction_amount, type AS transaction_type,
  'v1.0.0' AS model_version, NULL::DOUBLE AS processing_time_ms, human_review_required, alert_generated, actual_outcome
FROM decisions WHERE ts >= {_CUT} - 10 * 86400 AND ts <= {_CUT}""", _DECISIONS))
def _(spark, sf):
    out = decisions.export(decision_log(spark, sf), outcomes(spark, sf), DECISIONS_AS_OF, days=10)
    return out.withColumn("seconds", F.unix_seconds("ts")).drop("ts", "feedback_ts")
