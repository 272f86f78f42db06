"""Windowed metrics, decision statistics and the outcome join on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import monitoring
from ..schema import DECISION_LEVELS
from .run import LATENESS

OUTCOME_DAYS = 30


def metric_summary_stream(events: DataFrame, window: str = "5 minutes", lateness: str = LATENESS) -> DataFrame:
    return monitoring.metric_summary(events.withWatermark("ts", lateness), window)


def volume_stream(predictions: DataFrame, window: str = "1 hour", lateness: str = LATENESS) -> DataFrame:
    """Predictions per tumbling window."""
    return predictions.withWatermark("ts", lateness).groupBy(F.window("ts", window)).agg(
        F.count("*").alias("prediction_volume")
    ).select(F.col("window.start").alias("window_start"), "prediction_volume")


def rate_rule_stream(events: DataFrame, metric: str, window: str = "10 minutes", slide: str = "1 minute",
                     limit: float = 0.1, lateness: str = LATENESS) -> DataFrame:
    """Sliding windows whose events per second exceed the limit."""
    rule = [("RateRule", metric, window, "rate", limit)]
    return monitoring.rule_alerts(events.withWatermark("ts", lateness), rule, slide=slide)


def decision_statistics_stream(decisions: DataFrame, window: str = "1 day", lateness: str = LATENESS) -> DataFrame:
    """Totals, level counts and averages per window."""
    return decisions.withWatermark("ts", lateness).groupBy(F.window("ts", window)).agg(
        F.count("*").alias("total_decisions"), F.count_if(F.col("prediction") == 1).alias("fraud_predictions"),
        *[F.count_if(F.col("risk_level") == lv).alias(f"{lv}_count") for lv in DECISION_LEVELS],
        F.avg("fraud_score").alias("avg_fraud_score"), F.count_if("human_review_required").alias("human_reviews_required"),
        F.count_if("alert_generated").alias("alerts_generated"),
    ).select(F.col("window.start").alias("window_start"), F.col("*")).drop("window")


def outcome_join_stream(decisions: DataFrame, outcomes: DataFrame, days: int = OUTCOME_DAYS, lateness: str = LATENESS,
                        how: str = "inner") -> DataFrame:
    """Decisions with feedback that arrives within ``days``; both sides' state is bounded by
    the watermarks and the interval."""
    left = decisions.withWatermark("ts", lateness)
    right = outcomes.select(
        F.col("decision_id").alias("o_id"), F.col("ts").alias("feedback_ts"), "actual_outcome"
    ).withWatermark("feedback_ts", lateness)
    until = F.col("ts") + F.make_dt_interval(days=F.lit(days))
    on = (F.col("decision_id") == F.col("o_id")) & (F.col("feedback_ts") >= F.col("ts")) & (F.col("feedback_ts") <= until)
    return left.join(right, on, how).drop("o_id")
