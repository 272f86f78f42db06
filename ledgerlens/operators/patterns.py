"""Fraud patterns: time series, behaviour and ranked risk factors.

Every factor is (category, name, total_count, fraud_count, fraud_rate). All masks
are counted in one pass; only the keyed factors group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.features import is_merchant
from ..schema import BALANCES, LARGE_AMOUNT
from .profile import fraud_by
from .quantiles import quantiles

# ---- fixed values -------------------------------------------------------------
PERCENTILES = [50, 75, 90, 95, 99]
TOP_HOURS = 5
CATEGORY_ORDER = [
    "transaction_type", "large_transfers", "amount_percentile", "zero_balance",
    "balance_depletion", "account_pattern", "hourly_pattern",
]


def hour() -> Column:
    return F.pmod(F.col("step"), F.lit(24))


def day_index() -> Column:
    return F.floor(F.col("step") / 24)


def fraud_time_series(df: DataFrame, unit: str = "hour", measure: str = "count") -> DataFrame:
    """Fraud per hour of day, day or step, with every period from 0 present."""
    period = {"hour": hour(), "day": day_index(), "step": F.col("step")}[unit].cast("bigint")
    fraud = F.col("isFraud") == 1
    value = {
        "count": F.count_if(fraud).cast("double"),
        "rate": F.count_if(fraud) * 100.0 / F.count("*"),
        "amount": F.coalesce(F.sum(F.when(fraud, F.col("amount"))), F.lit(0.0)),
    }[measure]
    per_period = df.withColumn("period", period).filter("period is not null").groupBy("period").agg(
        value.alias("value")
    )
    if unit == "hour":
        spine = df.sparkSession.range(24).select(F.col("id").alias("period"))
    else:
        last = per_period.agg(F.max("period")).first()[0]
        spine = df.sparkSession.range(0 if last is None else last + 1).select(F.col("id").alias("period"))
    return spine.join(per_period, "period", "left").select(
        "period", F.coalesce("value", F.lit(0.0)).alias("value")
    )


def trend(series: DataFrame) -> DataFrame:
    """Least-squares slope and intercept of a series; null for fewer than three points."""
    y, x = F.col("value"), F.col("period").cast("double")
    enough = F.count("*") > 2
    return series.agg(
        F.count("*").alias("points"), F.when(enough, F.regr_slope(y, x)).alias("slope"),
        F.when(enough, F.regr_intercept(y, x)).alias("intercept"),
    )


def with_unusual_changes(df: DataFrame, deviations: float = 2.0) -> DataFrame:
    """Mark balance changes more than two sample deviations from their mean."""
    changes = df.withColumns(
        {
            "balance_change_orig": F.col("newbalanceOrig") - F.col("oldbalanceOrg"),
            "balance_change_dest": F.col("newbalanceDest") - F.col("oldbalanceDest"),
        }
    )
    sides = ["orig", "dest"]
    stats = changes.agg(
        F.struct(
            *[F.avg(f"balance_change_{s}").alias(f"{s}_mean") for s in sides],
            *[F.stddev_samp(f"balance_change_{s}").alias(f"{s}_std") for s in sides],
        )
    ).scalar()
    return changes.withColumns(
        {
            f"unusual_balance_{s}": F.abs(F.col(f"balance_change_{s}") - stats[f"{s}_mean"])
            > stats[f"{s}_std"] * deviations
            for s in sides
        }
    )


def customer_behavior(df: DataFrame) -> DataFrame:
    """Change statistics and the fraud rate of unusual, merchant and customer rows."""
    fraud = F.col("isFraud")
    to_merchant = is_merchant("nameDest")
    return with_unusual_changes(df).agg(
        F.avg("balance_change_orig").alias("orig_mean"),
        F.stddev_samp("balance_change_orig").alias("orig_std"),
        F.avg("balance_change_dest").alias("dest_mean"),
        F.stddev_samp("balance_change_dest").alias("dest_std"),
        F.count_if("unusual_balance_orig").alias("unusual_rows"),
        F.avg(F.when(F.col("unusual_balance_orig"), fraud)).alias("unusual_balance_fraud_rate"),
        F.avg(F.when(to_merchant, fraud)).alias("merchant_dest_fraud_rate"),
        F.avg(F.when(~to_merchant, fraud)).alias("customer_dest_fraud_rate"),
    )


def _factor(category: str, name: Column) -> list[Column]:
    return [
        F.lit(category).alias("category"), name.alias("name"), F.col("total_count"),
        F.col("fraud_count"), F.col("fraud_rate"),
    ]


def keyed_risk(df: DataFrame) -> DataFrame:
    """Type, account-pattern and hour factors from one scan and one shuffle (grouping sets)."""
    keys = ["transaction_type", "account_pattern", "hourly_pattern"]
    rows = df.select(
        F.col("type").alias(keys[0]), account_pattern().alias(keys[1]), hour().alias(keys[2]), "isFraud"
    )
    sets = rows.groupingSets([[k] for k in keys], *keys).agg(
        F.grouping_id(*keys).alias("set"), F.count("isFraud").alias("total_count"),
        F.sum("isFraud").alias("fraud_count"), F.avg("isFraud").alias("fraud_rate"),
    )
    # the set's own key has grouping bit 0; the first key is the highest of the three bits
    kind = F.when(F.col("set") == 3, keys[0]).when(F.col("set") == 5, keys[1]).otherwise(keys[2])
    name = (
        F.when(F.col("set") == 3, F.col(keys[0])).when(F.col("set") == 5, F.col(keys[1]))
        .otherwise(F.concat(F.lit("Hour "), F.col(keys[2]).cast("string")))
    )
    return sets.select(
        kind.alias("category"), name.alias("name"), F.col(keys[2]).alias("hour"), "total_count", "fraud_count", "fraud_rate"
    ).filter("name is not null")


def type_risk(df: DataFrame) -> DataFrame:
    return fraud_by(df, "type").select(_factor("transaction_type", F.col("type")))


def account_pattern() -> Column:
    def side(c):
        return F.when(is_merchant(c), "Merchant").otherwise("Customer")

    return F.concat(side("nameOrig"), F.lit(" To "), side("nameDest"))


def account_risk(df: DataFrame) -> DataFrame:
    keyed = df.filter("nameOrig is not null and nameDest is not null")
    return fraud_by(keyed, account_pattern(), "pattern").select(_factor("account_pattern", F.col("pattern")))


def hourly_risk(df: DataFrame, top_n: int = TOP_HOURS) -> DataFrame:
    """Hours by fraud rate, earlier hour first on a tie."""
    top = fraud_by(df, hour(), "hour").orderBy(F.desc("fraud_rate"), F.asc("hour")).limit(top_n)
    return top.select(_factor("hourly_pattern", F.concat(F.lit("Hour "), F.col("hour").cast("string"))))


def amount_thresholds(df: DataFrame) -> dict[int, float]:
    found = quantiles(df, ["amount"], [p / 100 for p in PERCENTILES])[(None, "amount")]
    return {p: v for p, v in zip(PERCENTILES, found) if v is not None}


def _masked(df: DataFrame, masks: list[tuple[str, str, Column]]) -> DataFrame:
    """Factors of many row masks from one scan; a mask without rows gives no factor."""
    aggs = []
    for i, (_, _, m) in enumerate(masks):
        hit = F.when(m, F.col("isFraud"))
        aggs += [F.count(hit).alias(f"n{i}"), F.sum(hit).alias(f"f{i}"), F.avg(hit).alias(f"r{i}")]
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("category"), F.lit(n).alias("name"), F.col(f"n{i}").alias("total_count"),
                F.col(f"f{i}").alias("fraud_count"), F.col(f"r{i}").alias("fraud_rate"),
            )
            for i, (c, n, _) in enumerate(masks)
        ]
    )
    return df.agg(*aggs).select(F.inline(rows)).filter("total_count > 0")


def large_transfer_mask() -> list:
    return [("large_transfers", f"Amount > {LARGE_AMOUNT}", F.col("amount") > LARGE_AMOUNT)]


def percentile_masks(thresholds: dict[int, float]) -> list:
    return [
        ("amount_percentile", f"Amount >= {p}th percentile", F.col("amount") >= v)
        for p, v in thresholds.items()
    ]


def zero_balance_masks() -> list:
    return [("zero_balance", f"Zero {c}", F.col(c) == 0) for c in BALANCES]


def depletion_mask() -> list:
    return [("balance_depletion", "Complete balance depletion",
             (F.col("oldbalanceOrg") > 0) & (F.col("newbalanceOrig") == 0))]


def large_transfer_risk(df: DataFrame) -> DataFrame:
    """Large against normal transfers."""
    normal = ("large_transfers", f"Amount <= {LARGE_AMOUNT}", F.col("amount") <= LARGE_AMOUNT)
    return _masked(df, large_transfer_mask() + [normal])


def percentile_risk(df: DataFrame) -> DataFrame:
    return _masked(df, percentile_masks(amount_thresholds(df)))


def zero_balance_risk(df: DataFrame) -> DataFrame:
    return _masked(df, zero_balance_masks())


def depletion_risk(df: DataFrame) -> DataFrame:
    return _masked(df, depletion_mask())


def risk_factors(df: DataFrame, hours: int = TOP_HOURS) -> DataFrame:
    """All factors: the amount quantiles, then one scan for the masks and one for the keys."""
    masks = (
        large_transfer_mask() + percentile_masks(amount_thresholds(df))
        + zero_balance_masks() + depletion_mask()
    )
    keyed = keyed_risk(df)
    top = keyed.filter("category = 'hourly_pattern'").orderBy(F.desc("fraud_rate"), F.asc("hour")).limit(hours)
    return (
        _masked(df, masks).unionByName(keyed.filter("category <> 'hourly_pattern'").drop("hour"))
        .unionByName(top.drop("hour"))
    )


def rank_risk_factors(df: DataFrame, top_n: int = 15) -> DataFrame:
    """Factors by fraud rate, then category order, then name."""
    place = F.array_position(F.array(*[F.lit(c) for c in CATEGORY_ORDER]), F.col("category"))
    return risk_factors(df).orderBy(F.desc("fraud_rate"), place, "name").limit(top_n)


def risk_summary(df: DataFrame, hours: int = 15) -> DataFrame:
    """Per category: factors, highest and unweighted mean rate; the top category marked."""
    place = F.array_position(F.array(*[F.lit(c) for c in CATEGORY_ORDER]), F.col("category"))
    factors = risk_factors(df, hours)
    per = factors.groupBy("category").agg(
        F.count("*").alias("factors"), F.max("fraud_rate").alias("max_fraud_rate"),
        F.avg("fraud_rate").alias("avg_fraud_rate"),
    )
    best = per.agg(F.max_by("category", F.struct("max_fraud_rate", -place))).scalar()
    return per.withColumn("is_highest", F.col("category") == best)


def pattern_bundle(df: DataFrame) -> DataFrame:
    """The whole analysis as one long table (section, name, value)."""
    parts = [
        rank_risk_factors(df).select(
            F.lit("ranked_factors").alias("section"), F.col("name"), F.col("fraud_rate").alias("value")),
        risk_summary(df).select(
            F.lit("category_summary").alias("section"), F.col("category").alias("name"),
            F.col("avg_fraud_rate").alias("value")),
        fraud_time_series(df, "hour").select(
            F.lit("fraud_by_hour").alias("section"), F.col("period").cast("string").alias("name"), "value"),
        fraud_time_series(df, "day").select(
            F.lit("fraud_by_day").alias("section"), F.col("period").cast("string").alias("name"), "value"),
        customer_behavior(df).unpivot(
            [], ["unusual_balance_fraud_rate", "merchant_dest_fraud_rate", "customer_dest_fraud_rate"],
            "name", "value").select(F.lit("behavior").alias("section"), "name", "value"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
