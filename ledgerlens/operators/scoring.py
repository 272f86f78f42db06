"""Batch scoring and explanations.

A scorer is any ``DataFrame -> DataFrame`` that adds ``fraud_score`` and
``fraud_prediction``: the rule scorer below, or a fitted model (``models.Model``).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import risk
from ..schema import HIGH_RISK_THRESHOLD, RISK_THRESHOLD
from .quality import fill_missing_columns


class Scorer(Protocol):
    def __call__(self, df: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class Thresholds:
    """Score limits of the risk levels."""

    risk: float = RISK_THRESHOLD
    high: float = HIGH_RISK_THRESHOLD

    def __post_init__(self):
        for v in (self.risk, self.high):
            if not 0 <= v <= 1:
                raise ValueError(f"threshold {v} is not between 0 and 1")

    def updated(self, risk: float | None = None, high: float | None = None) -> Thresholds:
        return Thresholds(self.risk if risk is None else risk, self.high if high is None else high)


def rule_scorer(limit: float = RISK_THRESHOLD) -> Scorer:
    def score(df: DataFrame) -> DataFrame:
        scored = df.withColumn("fraud_score", risk.rule_score())
        return scored.withColumn("fraud_prediction", (F.col("fraud_score") >= limit).cast("int"))

    return score


def batch_score(df: DataFrame, scorer: Scorer | None = None, thresholds: Thresholds = Thresholds(),
                as_of: Column | None = None) -> DataFrame:
    """Score, prediction, risk level, confidence and processing time per transaction."""
    scored = (scorer or rule_scorer(thresholds.risk))(fill_missing_columns(df))
    s = F.col("fraud_score")
    return scored.withColumns(
        {
            "risk_level": risk.risk_level(s, thresholds.risk, thresholds.high),
            "confidence": risk.confidence(s),
            "processed_at": F.current_timestamp() if as_of is None else as_of,
        }
    )


def components(df: DataFrame) -> DataFrame:
    """The four rule components of each transaction."""
    return df.withColumns(
        {
            "type_risk": risk.type_risk(), "amount_risk": risk.amount_risk(),
            "balance_risk": risk.balance_risk(), "hour_risk": risk.hour_risk(),
        }
    )


def explain(scored: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Add ``explanation``: factors, text and recommendations of the score."""
    found = scored.withColumn("_found", risk.factors())
    s, f = F.col("fraud_score"), F.col("_found")
    record = F.struct(
        s.alias("fraud_score"), risk.risk_level(s, thresholds.risk, thresholds.high).alias("risk_level"),
        f.alias("risk_factors"),
        risk.explanation(s, f, thresholds.risk, thresholds.high).alias("text"),
        risk.recommendations(s, f, thresholds.risk, thresholds.high).alias("recommendations"),
    )
    return found.withColumn("explanation", record).drop("_found")


def totals(scored: DataFrame) -> DataFrame:
    """Transactions, predicted fraud and rows per risk level."""
    return scored.agg(
        F.count("*").alias("total_transactions"), F.count_if(F.col("fraud_prediction") == 1).alias("fraud_detected"),
        *[F.count_if(F.col("risk_level") == lv).alias(f"{lv.lower()}_risk") for lv in ("HIGH", "MEDIUM", "LOW")],
    )


def select_results(scored: DataFrame, level: str | None = None, predicted: int | None = None) -> DataFrame:
    """Result filters: by risk level, by prediction."""
    if level is not None:
        scored = scored.filter(F.col("risk_level") == level)
    if predicted is not None:
        scored = scored.filter(F.col("fraud_prediction") == predicted)
    return scored
