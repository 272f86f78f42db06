"""Decision log: records, outcomes, statistics and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.risk import decision_level
from ..schema import DECISION_LEVELS, RETENTION_DAYS_DECISIONS
from .evaluation import metrics_by
from .quality import since


def transaction_hash() -> Column:
    """SHA-256 over the sorted, non-identifying fields; numbers in one fixed format, so
    the hash does not depend on how an engine prints doubles."""
    def number(c):
        return F.col(c).cast("decimal(30,4)").cast("string")

    return F.sha2(F.concat_ws("|", number("amount"), number("newbalanceOrig"), number("oldbalanceOrg"),
                              F.col("step").cast("string"), F.col("type")), 256)


def decide(scored: DataFrame, threshold: float = 0.5, model_name: str = "rules", model_version: str = "v1.0.0",
           ts: Column | None = None, confidence: Column | None = None, id_column: str = "tx_id",
           processing_ms: float | None = None) -> DataFrame:
    """Decision record of every scored row; for batches the confidence is the score."""
    score, prediction = F.col("fraud_score"), F.col("fraud_prediction")
    level = decision_level(score)
    return scored.select(
        F.md5(F.col(id_column).cast("string")).alias("decision_id"),
        (F.current_timestamp() if ts is None else ts).alias("ts"),
        F.lit("fraud_prediction").alias("decision_type"),
        F.col(id_column).cast("string").alias("transaction_id"), transaction_hash().alias("transaction_hash"),
        score.alias("fraud_score"), level.alias("risk_level"), prediction.alias("prediction"),
        (score if confidence is None else confidence).alias("confidence"),
        F.lit(model_version).alias("model_version"), F.lit(model_name).alias("model_name"),
        F.lit(threshold).alias("threshold_used"), F.lit(processing_ms).cast("double").alias("processing_time_ms"),
        F.col("amount").alias("transaction_amount"), F.col("type").alias("transaction_type"),
        ((score >= 0.8) | level.isin("high", "critical")).alias("human_review_required"),
        ((score >= threshold) & (prediction == 1)).alias("alert_generated"),
        F.lit(RETENTION_DAYS_DECISIONS).alias("data_retention_days"),
    )


ANALYTICS = ["decision_id", "ts", "fraud_score", "prediction", "risk_level", "transaction_type",
             "transaction_amount", "model_version", "processing_time_ms"]
ALERT_LOG = ["ts", "decision_id", "fraud_score", "risk_level", "transaction_id", "transaction_amount",
             "transaction_type", "human_review_required"]


def analytics_log(decisions: DataFrame) -> DataFrame:
    return decisions.select(ANALYTICS)


def alert_log(decisions: DataFrame) -> DataFrame:
    return decisions.filter("alert_generated").select(*ALERT_LOG, F.lit("fraud_detection").alias("alert_type"))


def batch_summary(scored: DataFrame, batch_id: str = "batch", model_version: str = "v1.0.0",
                  source: str = "batch", processing_ms: float = 0.0) -> DataFrame:
    """One row per scored batch; levels are the scorer's own."""
    level = F.upper("risk_level")
    return scored.agg(
        F.count("*").alias("total_transactions"), F.sum("fraud_prediction").alias("fraud_predictions"),
        F.count_if(level == "HIGH").alias("high_risk_count"), F.count_if(level == "MEDIUM").alias("medium_risk_count"),
        F.count_if(level == "LOW").alias("low_risk_count"),
        F.coalesce(F.avg("fraud_score"), F.lit(0.0)).alias("avg_fraud_score"),
    ).select(
        F.lit(batch_id).alias("batch_id"), "*", F.lit(processing_ms).alias("processing_time_ms"),
        F.lit(model_version).alias("model_version"), F.lit(source).alias("data_source"),
    )


def latest_outcomes(outcomes: DataFrame) -> DataFrame:
    """Newest feedback per decision; repeated feedback merges before the shuffle."""
    return outcomes.groupBy("decision_id").agg(
        F.max_by("actual_outcome", "ts").alias("actual_outcome"), F.max("ts").alias("feedback_ts")
    )


def with_outcomes(decisions: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Decisions with their latest outcome, null where none came in."""
    return decisions.join(latest_outcomes(outcomes), "decision_id", "left")


def statistics(decisions: DataFrame, as_of=None, hours: int = 24) -> DataFrame:
    """Totals, level counts (zeros kept), averages and rates of the last hours."""
    if as_of is not None:
        decisions = since(decisions, as_of, hours=hours)
    n = F.count("*")
    fraud, review = F.count_if(F.col("prediction") == 1), F.count_if("human_review_required")

    def share(part):
        return F.when(n > 0, part / n).otherwise(0.0)

    return decisions.agg(
        n.alias("total_decisions"), fraud.alias("fraud_predictions"), share(fraud).alias("fraud_rate"),
        *[F.count_if(F.col("risk_level") == lv).alias(f"{lv}_count") for lv in DECISION_LEVELS],
        F.avg("fraud_score").alias("avg_fraud_score"), F.avg("confidence").alias("avg_confidence"),
        F.avg("processing_time_ms").alias("avg_processing_time_ms"), review.alias("human_reviews_required"),
        F.count_if("alert_generated").alias("alerts_generated"), share(review).alias("human_review_rate"),
    )


def feedback(decisions: DataFrame, outcomes: DataFrame, as_of=None, days: int = 7) -> DataFrame:
    """Confusion and metrics of the decisions whose outcome is known."""
    if as_of is not None:
        decisions = since(decisions, as_of, days=days)
    known = with_outcomes(decisions, outcomes).filter(F.col("actual_outcome").isNotNull())
    return metrics_by(known, [], "actual_outcome", "prediction", "fraud_score")


EXPORT = ["decision_id", "ts", "fraud_score", "prediction", "confidence", "risk_level", "transaction_amount",
          "transaction_type", "model_version", "processing_time_ms", "human_review_required", "alert_generated"]


def export(decisions: DataFrame, outcomes: DataFrame | None = None, as_of=None, days: int = 30) -> DataFrame:
    """Columns for external analysis; write with ``sources.transactions.write_csv``."""
    if as_of is not None:
        decisions = since(decisions, as_of, days=days)
    if outcomes is None:
        return decisions.select(EXPORT)
    return with_outcomes(decisions, outcomes).select(*EXPORT, "actual_outcome", "feedback_ts")


def retained(decisions: DataFrame, as_of) -> DataFrame:
    """Rows within their own retention period."""
    age = F.unix_seconds(F.lit(as_of).cast("timestamp")) - F.unix_seconds("ts")
    return decisions.filter(age <= F.col("data_retention_days").cast("bigint") * 86400)


def kept_until() -> Column:
    """The end of a row's own retention period; a table written by it (``retention.write_days``) drops expired days."""
    return F.timestamp_seconds(F.unix_seconds("ts") + F.col("data_retention_days").cast("bigint") * 86400)
