"""Registered queries that run as streams over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import round_doubles
from ..operators import decisions, scoring
from ..sources import driver_tables as tables
from ..session import shared_folder
from ..streaming import cooldown, progress, run, scoring as stream_scoring, timers, windows
from .base import RULE_SCORE_SQL, events_sql, query, scored_sql, tx_sql
from .model_queries import TIMERS_SQL, timer_events
from .score_queries import _DECISIONS, _EMITTED, LEVEL_SQL, SLOW


def _transactions(spark, sf):
    return tables.booked(tables.stream(spark, sf, "orders"), tables.table(spark, sf, "customer"))


def _decisions(spark, sf):
    return decisions.decide(scoring.rule_scorer()(_transactions(spark, sf)), ts=tables.booking_time())


def _closed(sql, end):
    """Windows the watermark has passed when the stream has read everything."""
    return f"SELECT * FROM ({sql}) WHERE {end} <= (SELECT epoch_us(max(ts)) / 1e6 - 600 FROM events)"


@query("d02_stream_score", scored_sql(f"SELECT tx_id, fraud_score, fraud_prediction, {LEVEL_SQL} AS risk_level FROM scored"))
def _(spark, sf):
    out = stream_scoring.score_stream(_transactions(spark, sf))
    return run.drain(out.select("tx_id", "fraud_score", "fraud_prediction", "risk_level"), "score")


# Requests with broken fields; every 43rd comes in a second wave, when most of those are later than ten days.
_REQUESTS = f""",
requests AS (SELECT * REPLACE (CASE WHEN tx_id % 29 = 0 THEN -amount ELSE amount END AS amount, CASE WHEN tx_id % 31 = 0 THEN 'GIFT' ELSE type END AS type) FROM tx),
passed AS (SELECT max(step) - 240 AS until FROM tx WHERE tx_id % 43 <> 0),
judged AS (SELECT *, tx_id % 43 = 0 AND step <= until AS late, concat_ws(',', CASE WHEN tx_id % 29 = 0 THEN 'amount' END,
  CASE WHEN tx_id % 31 = 0 THEN 'type' END) AS errors FROM requests, passed)"""


def _waves(spark, sf):
    """Score the planted requests in two waves; the folder of the outputs and the totals of both runs."""
    tx = tables.transactions(spark, sf)
    k = F.col("tx_id")
    tx = tx.withColumns({"amount": F.when(k % 29 == 0, -F.col("amount")).otherwise(F.col("amount")),
                         "type": F.when(k % 31 == 0, F.lit("GIFT")).otherwise(F.col("type"))})
    folder = shared_folder(spark, "requests")
    runs = []
    with progress.totals(spark) as seen:
        for wave in (k % 43 != 0, k % 43 == 0):
            tx.filter(wave).write.mode("append").parquet(f"{folder}/in")
            stream = stream_scoring.once_each(spark.readStream.schema(tx.schema).parquet(f"{folder}/in"), tables.booking_time(), "10 days")
            scoring_run = stream_scoring.start_scoring(stream, folder, F.col("ts"), once=True)
            scoring_run.awaitTermination()
            runs.append(seen.of(scoring_run))
    return folder, runs


@query("d02_dead_letters", tx_sql(f"""
SELECT tx_id, CASE WHEN errors = '' THEN 'scored' ELSE 'quarantined' END AS status, CASE WHEN errors = '' THEN {RULE_SCORE_SQL} END AS fraud_score, errors
FROM judged WHERE NOT late""", _REQUESTS))
def _(spark, sf):
    folder, _ = _waves(spark, sf)
    scored = run.read_output(spark, folder, "decisions").select(
        F.col("transaction_id").cast("long").alias("tx_id"), F.lit("scored").alias("status"), "fraud_score", F.lit("").alias("errors"))
    broken = run.read_output(spark, folder, "quarantine").select(
        "tx_id", F.lit("quarantined").alias("status"), F.lit(None).cast("double").alias("fraud_score"), F.array_join("errors", ",").alias("errors"))
    return scored.unionByName(broken)


@query("d02_late_rows", tx_sql("SELECT count(*) AS received, count(*) FILTER (late) AS late FROM judged", _REQUESTS))
def _(spark, sf):
    return progress.as_row(spark, _waves(spark, sf)[1])


@query("l03_alert_cooldown_stream", events_sql(
    "SELECT tx_id, threshold_name, nameOrig, epoch_us(ts) AS us FROM alerts", _EMITTED, recursive=True))
def _(spark, sf):
    out = cooldown.alert_stream(tables.alert_scores_of(tables.stream(spark, sf, "events")), SLOW)
    return run.drain(out.select("tx_id", "threshold_name", "nameOrig", "us"), "alerts")


@query("m07_stream_volume", _closed("SELECT epoch(date_trunc('hour', ts))::BIGINT AS window_start, count(*) AS prediction_volume FROM events GROUP BY 1", "window_start + 3600"))
def _(spark, sf):
    out = windows.volume_stream(tables.metric_events_of(tables.stream(spark, sf, "events")))
    return run.drain(out, "volume").withColumn("window_start", F.unix_seconds("window_start"))


@query("m14_stream_metric_summary", _closed("""
SELECT epoch(time_bucket(INTERVAL '5 minutes', ts))::BIGINT AS window_start, event_type AS name, count(*) AS count, min(value) AS min, max(value) AS max,
  round(avg(value), 4) AS avg, round(sum(value), 4) AS sum FROM events GROUP BY 1, 2""", "window_start + 300"))
def _(spark, sf):
    out = windows.metric_summary_stream(tables.metric_events_of(tables.stream(spark, sf, "events")))
    return round_doubles(run.drain(out, "metrics").withColumn("window_start", F.unix_seconds("window_start")).drop("window_end"), 4)


@query("m15_stream_rate_rule", _closed("""
SELECT 'RateRule' AS rule, w AS window_start, round(count(*) / 600.0::DOUBLE, 6) AS value FROM (
  SELECT unnest(range((epoch_us(ts) // 60000000) * 60 - 540, (epoch_us(ts) // 60000000) * 60 + 60, 60)) AS w FROM events WHERE event_type = 'purchase')
GROUP BY w HAVING count(*) / 600.0 > 0.003""", "window_start + 600"))
def _(spark, sf):
    out = windows.rate_rule_stream(tables.metric_events_of(tables.stream(spark, sf, "events")), "purchase", limit=0.003)
    return round_doubles(run.drain(out, "rule").withColumn("window_start", F.unix_seconds("window_start")))


@query("m13_timers_stream", TIMERS_SQL + """,
passed AS (SELECT (epoch_ms(max(ts)) - 600000) * 1000 AS until FROM events WHERE event_type IN ('click', 'purchase'))
SELECT user_id, start_id, stop_id, start_us, stop_us, status, duration_ms FROM timers, passed
WHERE CASE WHEN status = 'unfinished' THEN start_us + 43200000000 <= until ELSE stop_us <= until END""")
def _(spark, sf):
    return run.drain(timers.timer_stream(timer_events(tables.stream(spark, sf, "events")), ["user_id"], expiry_seconds=12 * 3600), "timers")


@query("g04_stream_decision_statistics", scored_sql("""
SELECT ts // 86400 * 86400 AS window_start, count(*) AS total_decisions, count(*) FILTER (prediction = 1) AS fraud_predictions,
  count(*) FILTER (risk_level = 'low') AS low_count, count(*) FILTER (risk_level = 'medium') AS medium_count, count(*) FILTER (risk_level = 'high') AS high_count,
  count(*) FILTER (risk_level = 'critical') AS critical_count, round(avg(fraud_score), 6) AS avg_fraud_score,
  count(*) FILTER (human_review_required) AS human_reviews_required, count(*) FILTER (alert_generated) AS alerts_generated
FROM decisions GROUP BY 1 HAVING ts // 86400 * 86400 + 86400 <= (SELECT max(ts) - 600 FROM decisions)""", _DECISIONS))
def _(spark, sf):
    out = run.drain(windows.decision_statistics_stream(_decisions(spark, sf)), "statistics")
    return round_doubles(out.withColumn("window_start", F.unix_seconds("window_start")))


@query("j01_stream_outcome_join", scored_sql("""
SELECT decision_id, prediction, CASE WHEN v = 1 THEN isFraud ELSE 1 - isFraud END AS actual_outcome, ts + (v + 1) * 86400 AS feedback_seconds
FROM decisions, (SELECT unnest([0, 1]) AS v) WHERE tx_id % 3 = 0""", _DECISIONS))
def _(spark, sf):
    out = windows.outcome_join_stream(_decisions(spark, sf), tables.outcomes_of(_transactions(spark, sf)))
    kept = out.select("decision_id", "prediction", "actual_outcome", F.unix_seconds("feedback_ts").alias("feedback_seconds"))
    return run.drain(kept, "outcomes")
