"""Two-sample Kolmogorov-Smirnov drift per feature."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.pvalues import kolmogorov
from .prefix import assign_buckets, range_splits, running_totals

# ---- fixed values -----------------------------------------------------------------
DRIFT_P_VALUE = 0.05


def common_features(reference: DataFrame, current: DataFrame, features: Sequence[str] | None = None) -> list[str]:
    """Columns of both frames (metadata only), in reference order."""
    wanted = features or reference.columns
    return [c for c in wanted if c in reference.columns and c in current.columns]


def ks_drift(reference: DataFrame, current: DataFrame, features: Sequence[str],
             p_limit: float = DRIFT_P_VALUE, buckets: int | None = None) -> DataFrame:
    """(feature, n_reference, n_current, drift_score, p_value, is_drift) per common feature.

    Equal values are merged per feature before the shuffle; cumulative counts come from
    bucketed running totals, so no feature is sorted in one task.
    """
    cols = common_features(reference, current, features)

    def side(df, is_ref):
        return df.select(*[F.col(c).cast("double").alias(c) for c in cols], F.lit(is_ref).alias("_ref"))

    rows = side(reference, 1).unionByName(side(current, 0))
    splits = range_splits(rows.select(cols), cols, buckets)
    bucketed = assign_buckets(rows, splits)
    pairs = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("value"), F.col(f"{c}_bucket").alias("bucket")) for c in cols
    ])
    counts = (
        bucketed.select("_ref", F.inline(pairs)).filter("value is not null").groupBy("feature", "bucket", "value")
        .agg(F.sum("_ref").alias("r"), F.sum(1 - F.col("_ref")).alias("c"))
    )
    cdf = running_totals(counts, ["feature"], "value", {"cum_r": "r", "cum_c": "c"}, "bucket" if any(splits.values()) else None)
    # one row per feature
    sizes = counts.groupBy("feature").agg(F.sum("r").alias("n_reference"), F.sum("c").alias("n_current"))
    n, m = F.col("n_reference"), F.col("n_current")
    apart = F.abs(F.col("cum_r") / n - F.col("cum_c") / m)
    found = cdf.join(F.broadcast(sizes.filter("n_reference > 0 and n_current > 0")), "feature").groupBy(
        "feature", "n_reference", "n_current").agg(F.max(apart).alias("drift_score"))
    p = kolmogorov(F.col("drift_score"), n, m)
    return found.withColumn("p_value", p).withColumn("is_drift", F.col("p_value") < p_limit)
