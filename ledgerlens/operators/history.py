"""Performance history that grows by days: score histograms kept by day.

A day's histogram (rows per score and confusion cell) is written once, from that day's rows; any window of days is measured
from the sum of its histograms, without the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import retention
from .evaluation import kept_counts, metrics_of_counts


def add_days(scored: DataFrame, folder: str, ts: Column, label: str = "isFraud", prediction: str = "fraud_prediction", score: str = "fraud_score") -> None:
    """Write the histograms of the days that ``scored`` holds; a day written again is replaced."""
    days = scored.withColumn("held_day", F.to_date(ts)).where("held_day is not null")
    retention.write_days(kept_counts(days, ["held_day"], label, prediction, score), folder, F.col("held_day"))


def daily_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """A row a day (``held_day``)."""
    return metrics_of_counts(retention.read_days(spark, folder), ["held_day"])


def window_metrics(spark: SparkSession, folder: str, first, last) -> DataFrame:
    """One row over the days from ``first`` to ``last``; other days are not read."""
    held = retention.read_days(spark, folder).where(F.col(retention.DAY).between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return metrics_of_counts(held, [])
