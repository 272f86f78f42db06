"""Reference profile kept by day: histograms of feature values, from which drift follows without the rows.

A value's cell is the whole number of its logarithm in steps of ``STEP``, negatives mirrored, so a cell spans 2 % of its
value and the cells of a feature are a few thousand whatever the rows. Days are merged by adding counts: the profile of
several days equals that of all their rows. A distance from cells is at most the exact one, and less than it by at most
the largest share of a cell, which is reported beside it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.pvalues import kolmogorov
from . import retention
from .drift import DRIFT_P_VALUE

STEP = 0.02
LEAST = 1e-9  # smaller values are 0
_INFINITE = 100_000.0  # beyond the cell of any finite value


def cell(value: Column, step: float = STEP) -> Column:
    """The cell of a value, ordered as the values are; null for null and NaN."""
    v = value.cast("double")
    size = F.floor(F.least((F.log(F.abs(v)) - F.log(F.lit(LEAST))) / step, F.lit(_INFINITE))) + 1
    return F.when(v.isNull() | F.isnan(v), None).when(F.abs(v) < LEAST, F.lit(0)).when(v < 0, -size).otherwise(size).cast("int")


def profile(df: DataFrame, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Rows per feature and cell."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), cell(F.col(c)).alias("cell")) for c in features])
    long = df.select(*by, F.inline(cells)).where("cell is not null")
    return long.groupBy(*by, "feature", "cell").agg(F.count(F.lit(1)).alias("rows"))


def add_days(df: DataFrame, features: Sequence[str], folder: str, ts: Column) -> None:
    """Write the profiles of the days that ``df`` holds; a day written again is replaced."""
    days = df.withColumn("held_day", F.to_date(ts)).where("held_day is not null")
    retention.write_days(profile(days, features, ["held_day"]), folder, F.col("held_day"))


def merged(spark: SparkSession, folder: str, first, last) -> DataFrame:
    """The profile of the days from ``first`` to ``last``; other days are not read."""
    held = retention.read_days(spark, folder).where(F.col(retention.DAY).between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return held.groupBy("feature", "cell").agg(F.sum("rows").alias("rows"))


def distance(reference: DataFrame, current: DataFrame, p_limit: float = DRIFT_P_VALUE) -> DataFrame:
    """(feature, n_reference, n_current, drift_score, most_below, p_value, is_drift) of two profiles; features of both only."""
    both = reference.select("feature", "cell", F.col("rows").alias("r"), F.lit(0).cast("long").alias("c")).unionByName(
        current.select("feature", "cell", F.lit(0).cast("long").alias("r"), F.col("rows").alias("c")))
    cells = both.groupBy("feature", "cell").agg(F.sum("r").alias("r"), F.sum("c").alias("c"))
    whole = Window.partitionBy("feature")  # the cells of a feature, a bounded number
    below = whole.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    n, m = F.col("n_reference"), F.col("n_current")
    found = cells.withColumns({
        "n_reference": F.sum("r").over(whole), "n_current": F.sum("c").over(whole),
        "cum_r": F.sum("r").over(below), "cum_c": F.sum("c").over(below),
    }).where("n_reference > 0 and n_current > 0").groupBy("feature", "n_reference", "n_current").agg(
        F.max(F.abs(F.col("cum_r") / n - F.col("cum_c") / m)).alias("drift_score"),
        F.max(F.greatest(F.col("r") / n, F.col("c") / m)).alias("most_below"))
    return found.withColumn("p_value", kolmogorov(F.col("drift_score"), n, m)).withColumn("is_drift", F.col("p_value") < p_limit)
