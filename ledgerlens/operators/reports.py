"""Report tables: indicators, transaction analysis, model performance, compliance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluation import metrics_by
from .profile import type_distribution
from .quality import since

# ---- fixed values -------------------------------------------------------------------
REPORT_DAYS = {"daily": 1, "weekly": 7, "monthly": 30}
COMPLIANCE_LIMITS = {"accuracy": 0.8, "false_positive_rate": 0.3, "false_negative_rate": 0.3, "f1_score": 0.5}


def _pct(c: str, digits: int) -> Column:
    return F.format_string(f"%.{digits}f%%", F.col(c) * 100)


def _rows(stats: DataFrame, entries: list[tuple], names: list[str]) -> DataFrame:
    items = [F.struct(F.lit(i + 1).alias("position"), *[v.alias(n) for n, v in zip(names, e)]) for i, e in enumerate(entries)]
    return stats.select(F.inline(F.array(*items)))


def _performance(scored: DataFrame, label: str) -> DataFrame:
    return metrics_by(scored, [], label, "fraud_prediction", "fraud_score")


def fraud_summary(scored: DataFrame, label: str = "isFraud") -> DataFrame:
    """The nine indicators, formatted."""
    stats = _performance(scored, label).withColumn("detected", F.col("true_positives") + F.col("false_positives")) \
        .withColumn("detection_rate", F.col("detected") / F.col("total_predictions"))
    entries = [
        ("Total Transactions Processed", F.col("total_predictions").cast("string")),
        ("Fraudulent Transactions Detected", F.col("detected").cast("string")),
        ("Fraud Detection Rate", _pct("detection_rate", 2)), ("Model Accuracy", _pct("accuracy", 1)),
        ("Precision", _pct("precision", 1)), ("Recall", _pct("recall", 1)), ("F1-Score", _pct("f1_score", 1)),
        ("False Positive Rate", _pct("false_positive_rate", 2)), ("False Negative Rate", _pct("false_negative_rate", 2)),
    ]
    return _rows(stats, [(F.lit(m), v) for m, v in entries], ["metric", "value"])


def transaction_analysis(df: DataFrame) -> DataFrame:
    """Rows and formatted share per type."""
    return type_distribution(df).select(
        F.col("type").alias("transaction_type"), F.col("rows").alias("count"),
        F.format_string("%.1f%%", F.col("pct")).alias("percentage"),
    )


def detail_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Every row with the columns of a report's detail sheet, to be written as a table."""
    return df.select(*columns)


def model_performance(scored: DataFrame, label: str = "isFraud") -> DataFrame:
    names = {"Accuracy": "accuracy", "Precision": "precision", "Recall": "recall", "F1-Score": "f1_score", "AUC-ROC": "auc_roc"}
    stats = _performance(scored, label)
    return _rows(stats, [(F.lit(m), F.format_string("%.3f", F.coalesce(F.col(c), F.lit(0.0)))) for m, c in names.items()], ["metric", "value"])


def compliance_audit(scored: DataFrame, label: str = "isFraud", limits: dict | None = None) -> DataFrame:
    """Audit rows; the status compares each value with its limit."""
    limits = {**COMPLIANCE_LIMITS, **(limits or {})}

    def at_least(c, ok, bad):
        return F.when(F.col(c) >= limits[c], ok).otherwise(bad)

    def at_most(c, ok, bad):
        return F.when(F.col(c) <= limits[c], ok).otherwise(bad)

    entries = [
        (F.lit("Total Transactions Monitored"), F.format_number("total_predictions", 0), F.lit("Compliant")),
        (F.lit("Fraud Detection Accuracy"), _pct("accuracy", 1), at_least("accuracy", "Above Threshold", "Below Threshold")),
        (F.lit("False Positive Rate"), _pct("false_positive_rate", 2), at_most("false_positive_rate", "Within Limits", "Over Limit")),
        (F.lit("False Negative Rate"), _pct("false_negative_rate", 2), at_most("false_negative_rate", "Within Limits", "Over Limit")),
        (F.lit("Model Performance"), _pct("f1_score", 1), at_least("f1_score", "Meets Standards", "Below Standards")),
    ]
    return _rows(_performance(scored, label), entries, ["metric", "value", "status"])


def report_period(df: DataFrame, as_of, kind: str = "daily", time_column: str = "ts") -> DataFrame:
    """Rows a daily, weekly or monthly report covers."""
    return since(df, as_of, time_column, days=REPORT_DAYS[kind])


def report_history(runs: DataFrame) -> DataFrame:
    """All report runs, newest first."""
    return runs.orderBy(F.desc("ts"), "report_type")
