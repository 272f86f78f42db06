"""Registered queries: tables written and read back through every source and sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decisions
from ..schema import COLUMNS
from ..session import shared_folder
from ..sources import driver_tables, transactions as sources
from ..streaming import run
from .base import query, scored_sql, tx_sql
from .model_queries import BY_DAY, performance_history
from .score_queries import _DECISIONS, decision_log

TEN = ", ".join(COLUMNS)


def _csv(spark, sf, purpose):
    path = f"{shared_folder(spark, purpose)}/rows"
    sources.write_csv(driver_tables.transactions(spark, sf).select(COLUMNS), path)
    return path


@query("s01_s05_csv_round_trip", tx_sql(f"SELECT {TEN} FROM tx"))
def _(spark, sf):
    return sources.read_csv(spark, _csv(spark, sf, "csv"))


@query("s02_csv_increments", tx_sql(f"SELECT {TEN} FROM tx"))
def _(spark, sf):
    """The CSV files read as micro-batches of two files."""
    return run.drain(sources.stream_csv(spark, _csv(spark, sf, "csv-stream"), max_files=2), "increments")


@query("s04_uploaded_flags", tx_sql("SELECT isFraud, isFlaggedFraud, count(*) AS rows FROM tx GROUP BY ALL"))
def _(spark, sf):
    narrowed = sources.narrow_flags(sources.read_csv(spark, _csv(spark, sf, "upload")))
    counts = narrowed.groupBy("isFraud", "isFlaggedFraud").agg(F.count("*").alias("rows"))
    return counts.select(F.col("isFraud").cast("int"), F.col("isFlaggedFraud").cast("int"), "rows")


@query("s06_filtered_scores_csv", scored_sql("SELECT tx_id, fraud_score FROM scored WHERE fraud_prediction = 1"))
def _(spark, sf):
    path = f"{shared_folder(spark, 'scores')}/rows"
    hits = driver_tables.scored(spark, sf).filter("fraud_prediction = 1").select("tx_id", "fraud_score")
    sources.write_csv(hits, path)
    return spark.read.schema(hits.schema).option("header", True).csv(path)


@query("s07_json_logs", scored_sql("""
SELECT 'analytics' AS log, decision_id, risk_level FROM decisions UNION ALL SELECT 'alert', decision_id, risk_level FROM decisions WHERE alert_generated""", _DECISIONS))
def _(spark, sf):
    """Two appends to each of two JSON logs, read back."""
    folder = shared_folder(spark, "logs")
    log = decision_log(spark, sf)
    even = F.pmod(F.xxhash64("decision_id"), F.lit(2)) == 0
    for part in (log.filter(even), log.filter(~even)):
        sources.append_json(decisions.analytics_log(part), f"{folder}/analytics")
        sources.append_json(decisions.alert_log(part), f"{folder}/alert")
    layout = "decision_id string, risk_level string"
    parts = [spark.read.schema(layout).json(f"{folder}/{n}").select(F.lit(n).alias("log"), "*") for n in ("analytics", "alert")]
    return parts[0].unionByName(parts[1])


@query("s09_history_reload", scored_sql("SELECT batch, round(f1_score, 6) AS f1_score FROM hist WHERE batch >= 20", BY_DAY))
def _(spark, sf):
    """Performance history appended by day and reloaded from a date on."""
    path = f"{shared_folder(spark, 'history')}/performance"
    sources.append_table(performance_history(spark, sf), path)
    rows = sources.read_table(spark, path, since="2024-01-21")
    return rows.select("batch", F.round("f1_score", 6).alias("f1_score"))
