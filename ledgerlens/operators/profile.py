"""Profiles and summary aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio, report_rows, unpivot
from ..schema import CATEGORICAL, COLUMNS, LARGE_AMOUNT, MEASURES, NUMERIC
from .quality import consistency_report, quality_issues
from .quantiles import quantile_table

DESCRIBE_PROBS = [0.25, 0.5, 0.75]


def describe(df: DataFrame, columns: list[str] = NUMERIC, by: str | None = None) -> DataFrame:
    """count, mean, sample std, min, quartiles, max per column (and per group)."""
    keys = [by] if by else []
    names = ["count", "mean", "std", "min", "max"]
    aggs = []
    for i, c in enumerate(columns):
        x = F.col(c).cast("double")
        found = F.count(x), F.avg(x), F.stddev_samp(x), F.min(x), F.max(x)
        aggs += [v.alias(f"{n}{i}") for n, v in zip(names, found)]
    wide = (df.filter(F.col(by).isNotNull()).groupBy(by) if by else df).agg(*aggs)
    per_column = F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"{n}{i}").alias(n) for n in names]) for i, c in enumerate(columns)
    ])
    moments = wide.select(*keys, F.inline(per_column))
    quart = quantile_table(df, columns, DESCRIBE_PROBS, by).groupBy(*keys, "column").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(f"p{int(p * 100)}") for p in DESCRIBE_PROBS]
    )
    out = moments.join(quart, [*keys, "column"], "left")
    return out.select(*keys, "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


def value_counts(df: DataFrame, columns: list[str] = CATEGORICAL) -> DataFrame:
    """(column, value, rows) of every non-null value; merged before the shuffle."""
    long = unpivot(df, [], columns, dtype="string")
    return long.filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("rows"))


def top_values(df: DataFrame, columns: list[str] = CATEGORICAL, n: int = 10) -> DataFrame:
    """Most frequent values per column; ties by value. Each task forwards its own top
    ``n`` only (Spark limits ranked windows before the shuffle)."""
    w = Window.partitionBy("column").orderBy(F.desc("rows"), F.asc("value"))
    ranked = value_counts(df, columns).withColumn("rank", F.row_number().over(w))
    return ranked.filter(F.col("rank") <= n)


def categorical_summary(df: DataFrame, columns: list[str] = CATEGORICAL) -> DataFrame:
    """Distinct values and the most frequent one (smallest on a tie) per column."""
    counts = value_counts(df, columns)
    top = F.min_by("value", F.struct(-F.col("rows"), F.col("value")))
    return counts.groupBy("column").agg(
        F.count("*").alias("distinct_values"), top.alias("most_frequent"),
        F.max("rows").alias("most_frequent_rows"),
    )


def type_distribution(df: DataFrame) -> DataFrame:
    """Rows and share per type, with the most and least common marked (ties by name)."""
    per_type = df.filter("type is not null").groupBy("type").agg(F.count("*").alias("rows"))
    total = per_type.agg(
        F.struct(
            F.sum("rows").alias("n"), F.count("*").alias("types"),
            F.min_by("type", F.struct(-F.col("rows"), F.col("type"))).alias("most"),
            F.max_by("type", F.struct(-F.col("rows"), F.col("type"))).alias("least"),
        )
    ).scalar()
    return per_type.withColumns(
        {
            "pct": F.col("rows") * 100.0 / total["n"],
            "unique_types": total["types"],
            "is_most_common": F.col("type") == total["most"],
            "is_least_common": F.col("type") == total["least"],
        }
    )


def amount_by_type(df: DataFrame) -> DataFrame:
    """count, mean, median, std, min, max and sum of the amount per type, 2 decimals."""
    stats = df.filter("type is not null").groupBy("type").agg(
        F.count("amount").alias("count"), F.round(F.avg("amount"), 2).alias("mean"),
        F.round(F.stddev_samp("amount"), 2).alias("std"), F.round(F.min("amount"), 2).alias("min"),
        F.round(F.max("amount"), 2).alias("max"), F.round(F.sum("amount"), 2).alias("sum"),
    )
    median = quantile_table(df, ["amount"], [0.5], "type").select("type", F.round("value", 2).alias("median"))
    return stats.join(median, "type")


def fraud_by(df: DataFrame, key: str | Column, name: str = "type") -> DataFrame:
    """Rows, fraud rows and fraud rate per key, null keys dropped."""
    keyed = df.select((F.col(key) if isinstance(key, str) else key).alias(name), "isFraud")
    return keyed.filter(F.col(name).isNotNull()).groupBy(name).agg(
        F.count("isFraud").alias("total_count"), F.sum("isFraud").alias("fraud_count"),
        F.avg("isFraud").alias("fraud_rate"), (F.avg("isFraud") * 100).alias("fraud_rate_pct"),
    )


def amount_distribution(df: DataFrame) -> DataFrame:
    """Counts of zero, negative and large amounts and the upper percentiles."""
    stats = df.agg(
        F.count_if(F.col("amount") == 0).alias("zero_amounts"),
        F.count_if(F.col("amount") < 0).alias("negative_amounts"),
        F.count_if(F.col("amount") > LARGE_AMOUNT).alias("large_transactions"),
    )
    counts = report_rows(
        stats, [(F.lit(c), F.col(c).cast("double")) for c in stats.columns], ["metric", "value"]
    )
    tails = {0.9: "p90", 0.95: "p95", 0.99: "p99", 0.999: "p99.9"}
    names = F.create_map(*[F.lit(x) for kv in tails.items() for x in kv])
    found = quantile_table(df, ["amount"], list(tails))
    return counts.unionByName(found.select(names[F.col("prob")].alias("metric"), "value"))


def fraud_ratio(df: DataFrame) -> DataFrame:
    """Totals, rate and legitimate-to-fraud ratio (infinite without fraud)."""
    n, fraud = F.col("total_transactions"), F.col("fraud_transactions")
    return df.agg(
        F.count("*").alias("total_transactions"),
        F.coalesce(F.sum("isFraud"), F.lit(0)).alias("fraud_transactions"),
    ).withColumns(
        {
            "legitimate_transactions": n - fraud,
            "fraud_rate_pct": F.when(n > 0, fraud * 100.0 / n).otherwise(0.0),
            "class_imbalance_ratio": F.when(fraud > 0, (n - fraud) / fraud).otherwise(F.lit(float("inf"))),
        }
    )


def fraud_by_day(df: DataFrame) -> DataFrame:
    """Daily totals; the day number is ``step // 24 + 1``."""
    return fraud_by(df, F.floor(F.col("step") / 24) + 1, "day_1based")


def daily_extremes(df: DataFrame) -> DataFrame:
    """Spread of the daily fraud counts and the first days with most and least fraud."""
    day, fraud = F.col("day_1based"), F.col("fraud_count")
    return fraud_by_day(df).agg(
        F.count("*").alias("days"), F.avg("fraud_count").alias("mean_fraud"),
        F.stddev_samp("fraud_count").alias("std_fraud"), F.min("fraud_count").alias("min_fraud"),
        F.max("fraud_count").alias("max_fraud"), F.avg("fraud_rate_pct").alias("mean_rate_pct"),
        F.max_by(day, F.struct(fraud, -day)).alias("highest_fraud_day"),
        F.min_by(day, F.struct(fraud, day)).alias("lowest_fraud_day"),
    )


def flag_crosstab(df: DataFrame) -> DataFrame:
    """Flag by fraud with margins (``All``), as a long table."""
    both = df.filter("isFlaggedFraud is not null and isFraud is not null")

    def label(c):
        return F.when(F.grouping(c) == 1, "All").otherwise(F.col(c).cast("string"))

    return both.cube("isFlaggedFraud", "isFraud").agg(
        label("isFlaggedFraud").alias("flagged"), label("isFraud").alias("fraud"),
        F.count("*").alias("rows"),
    ).select("flagged", "fraud", "rows")


def flag_quality(df: DataFrame) -> DataFrame:
    """The business flag judged as a classifier."""
    flagged, fraud = F.col("isFlaggedFraud"), F.col("isFraud")
    return df.agg(
        F.count_if((flagged == 1) & (fraud == 1)).alias("true_positives"),
        F.count_if((flagged == 1) & (fraud == 0)).alias("false_positives"),
        F.count_if((flagged == 0) & (fraud == 1)).alias("false_negatives"),
        F.count_if((flagged == 0) & (fraud == 0)).alias("true_negatives"),
    ).withColumns(
        {
            "precision": ratio("true_positives", F.col("true_positives") + F.col("false_positives")),
            "recall": ratio("true_positives", F.col("true_positives") + F.col("false_negatives")),
        }
    )


def missing_values(df: DataFrame) -> DataFrame:
    """Nulls and share per column, plus rows with and without a null."""
    cols = [c for c in COLUMNS if c in df.columns]
    any_null = F.lit(False)
    for c in cols:
        any_null = any_null | F.col(c).isNull()
    stats = df.agg(
        F.count("*").alias("n"), F.count_if(any_null).alias("with_missing"),
        *[F.count_if(F.col(c).isNull()).alias(f"m_{c}") for c in cols],
    )
    n = F.col("n")

    def pct(v):
        return F.when(n > 0, v * 100.0 / n).otherwise(0.0)

    entries = [(F.lit(c), F.col(f"m_{c}"), pct(F.col(f"m_{c}"))) for c in cols]
    entries += [
        (F.lit("(rows with missing)"), F.col("with_missing"), pct(F.col("with_missing"))),
        (F.lit("(complete rows)"), n - F.col("with_missing"), pct(n - F.col("with_missing"))),
    ]
    return report_rows(stats, entries, ["column", "missing", "pct"])


def missing_patterns(df: DataFrame, n: int = 10) -> DataFrame:
    """Most frequent sets of null columns; complete rows form the empty set."""
    cols = [c for c in COLUMNS if c in df.columns]
    gaps = F.array_join(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in cols])), ",")
    return (
        df.groupBy(gaps.alias("missing_columns")).agg(F.count("*").alias("rows"))
        .orderBy(F.desc("rows"), "missing_columns").limit(n)
    )


def dataset_info(df: DataFrame) -> DataFrame:
    """Shape, column types, nulls, rows per type and label, and the amount's statistics, as
    (section, name, detail, value)."""
    names, types = ["section", "name", "detail", "value"], dict(df.dtypes)
    stats = df.agg(F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])

    def entry(section, name, detail, value):
        return F.lit(section), F.lit(name), F.lit(detail), value.cast("double")

    shape = report_rows(stats, [
        entry("shape", "rows", "", F.col("_n")), entry("shape", "columns", "", F.lit(len(df.columns))),
        *[entry("nulls", c, types[c], F.col(c)) for c in df.columns],
    ], names)
    counts = value_counts(df, ["type", "isFraud"]).select(
        F.when(F.col("column") == "type", "transaction_types").otherwise("fraud_distribution").alias("section"),
        F.col("value").alias("name"), F.lit("").alias("detail"), F.col("rows").cast("double").alias("value"),
    )
    amount = describe(df, ["amount"]).withColumn("count", F.col("count").cast("double")).drop("column")
    amount = amount.unpivot([], amount.columns, "name", "value").select(
        F.lit("amount_stats").alias("section"), "name", F.lit("").alias("detail"), "value")
    return shape.unionByName(counts).unionByName(amount)


def dataset_summary(df: DataFrame) -> DataFrame:
    """One row: step range, types, fraud, and the amount's moments and quartiles."""
    base = df.agg(
        F.count("*").alias("total_transactions"), F.min("step").alias("min_step"),
        F.max("step").alias("max_step"), F.count_distinct("step").alias("unique_steps"),
        F.count_distinct("type").alias("unique_types"), F.sum("isFraud").alias("fraud_count"),
        (F.avg("isFraud") * 100).alias("fraud_rate_pct"), F.avg("amount").alias("amount_mean"),
        F.stddev_samp("amount").alias("amount_std"), F.min("amount").alias("amount_min"),
        F.max("amount").alias("amount_max"),
    )
    probs = {0.25: "amount_q25", 0.5: "amount_median", 0.75: "amount_q75"}
    quart = quantile_table(df, ["amount"], list(probs)).agg(
        F.struct(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for p, n in probs.items()])
    ).scalar()
    return base.withColumns({n: quart[n] for n in probs.values()})


def counts_by_label(df: DataFrame, key: str | Column, name: str) -> DataFrame:
    """Rows per key with one column per label, gaps as 0."""
    keyed = df.select((F.col(key) if isinstance(key, str) else key).alias(name), "isFraud")
    return (
        keyed.filter(F.col(name).isNotNull()).groupBy(name).pivot("isFraud", [0, 1]).count()
        .na.fill(0).withColumnsRenamed({"0": "legitimate", "1": "fraud"})
    )


def histogram(df: DataFrame, column: str = "amount", bins: int = 50, by: str | None = None) -> DataFrame:
    """Equal-width bins over the column's range, the last one closed. One value: one bin
    of width 1 around it."""
    limits = df.agg(
        F.struct(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi"))
    ).scalar()
    same = limits["lo"] == limits["hi"]
    lo = F.when(same, limits["lo"] - 0.5).otherwise(limits["lo"])
    width = F.when(same, 1.0).otherwise(limits["hi"] - limits["lo"]) / bins
    x = F.col(column).cast("double")
    binned = df.filter(F.col(column).isNotNull()).select(
        *([by] if by else []), F.least(F.floor((x - lo) / width), F.lit(bins - 1)).cast("int").alias("bin"),
        lo.alias("_lo"), width.alias("_w"),
    )
    counted = binned.groupBy(*([by] if by else []), "bin").agg(
        F.count("*").alias("rows"), F.min("_lo").alias("_lo"), F.min("_w").alias("_w")
    )
    return counted.select(
        *([by] if by else []), "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("lower"),
        (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("upper"), "rows",
    )


def column_profile(df: DataFrame) -> DataFrame:
    """Type, non-null, null and distinct values per column."""
    types = dict(df.dtypes)
    cols = df.columns
    counts = df.agg(F.count("*").alias("n"), *[F.count(c).alias(f"c_{c}") for c in cols])
    base = report_rows(
        counts, [(F.lit(c), F.lit(types[c]), F.col(f"c_{c}"), F.col("n") - F.col(f"c_{c}")) for c in cols],
        ["column", "type", "non_null", "nulls"],
    )
    distinct = value_counts(df, cols).groupBy("column").agg(F.count("*").alias("distinct_values"))
    return base.join(distinct, "column", "left").na.fill(0, ["distinct_values"])


def volume(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count_distinct("nameOrig").alias("unique_accounts"), F.sum("amount").alias("total_volume"),
        (F.max("step") - F.min("step")).alias("step_span"),
    )


def class_distribution(df: DataFrame, label: str = "isFraud") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("rows"))


def quality_bundle(df: DataFrame) -> DataFrame:
    """Missing values, quality issues and consistency in one long table."""
    return (
        missing_values(df).select(F.lit("missing").alias("section"), F.col("column").alias("name"),
                                  F.col("missing").alias("value"))
        .unionByName(quality_issues(df).select(
            F.lit("issues").alias("section"),
            F.concat_ws(":", "issue", "column").alias("name"), F.col("rows").alias("value")))
        .unionByName(consistency_report(df).select(
            F.lit("consistency").alias("section"), F.col("check").alias("name"), F.col("rows").alias("value")))
    )


def measures_of(df: DataFrame) -> list[str]:
    return [c for c in ["step", *MEASURES] if c in df.columns]
