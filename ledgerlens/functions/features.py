"""Row-wise transaction features (all plain column expressions, one projection)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import (
    BALANCE_TOLERANCE, COLUMNS, HIGH_RISK_TYPES, LARGE_AMOUNT, MERCHANT_PREFIX,
    TYPE_CODES, TYPES, UNKNOWN_TYPE_CODE,
)
from .columns import flag, lookup, ratio

GROUPS = ("balance", "ratio", "merchant", "time", "business_rule")


def is_merchant(name: str) -> Column:
    return F.col(name).startswith(MERCHANT_PREFIX)


def normalized_type() -> Column:
    """Both spellings of a transaction type (``CASH-IN``, ``CASH_IN``) as one."""
    return F.translate(F.col("type"), "-", "_")


def balance() -> dict[str, Column]:
    orig = F.col("newbalanceOrig") - F.col("oldbalanceOrg")
    dest = F.col("newbalanceDest") - F.col("oldbalanceDest")
    return {
        "balance_change_orig": orig,
        "balance_change_dest": dest,
        "abs_balance_change_orig": F.abs(orig),
        "abs_balance_change_dest": F.abs(dest),
        "total_balance_change": orig + dest,
    }


def ratios() -> dict[str, Column]:
    return {
        "amount_to_orig_balance_ratio": ratio("amount", "oldbalanceOrg"),
        "amount_to_dest_balance_ratio": ratio("amount", "oldbalanceDest"),
        "amount_to_new_orig_balance_ratio": ratio("amount", "newbalanceOrig"),
        "amount_to_new_dest_balance_ratio": ratio("amount", "newbalanceDest"),
        "orig_to_dest_balance_ratio": ratio("oldbalanceOrg", "oldbalanceDest"),
    }


def merchant() -> dict[str, Column]:
    dest, orig = is_merchant("nameDest"), is_merchant("nameOrig")
    return {
        "is_merchant_dest": flag(dest),
        "is_merchant_orig": flag(orig),
        "is_merchant_to_merchant": flag(dest & orig),
        "involves_merchant": flag(dest | orig),
    }


def _days_before(step: Column) -> Column:
    return F.floor((step - 1) / 24)


def hour_of_day() -> Column:
    return F.pmod(F.col("step"), F.lit(24)).cast("int")


def time() -> dict[str, Column]:
    step, hour = F.col("step"), hour_of_day()
    day = (_days_before(step) + 1).cast("int")
    weekday = F.pmod(_days_before(step), F.lit(7)).cast("int")
    period = (
        F.when(hour <= 6, "Night").when(hour <= 12, "Morning")
        .when(hour <= 18, "Afternoon").when(hour <= 24, "Evening")
    )
    return {
        "hour_of_day": hour,
        "day_of_month": day,
        "week_of_month": (F.floor((day - 1) / 7) + 1).cast("int"),
        "day_of_week": weekday,
        "is_weekend": flag(weekday.isin(0, 6)),
        "is_business_hours": flag(hour.between(9, 17)),
        "time_period": period,
    }


def expected_origin_balance() -> Column:
    """Origin balance after the booking: up for CASH_IN, down for every other type."""
    old, amount = F.col("oldbalanceOrg"), F.col("amount")
    return F.when(F.col("type") == "CASH_IN", old + amount).otherwise(old - amount)


def off_balance(*types: str) -> Column:
    """Booked balance misses the expected one by more than the tolerance."""
    gap = F.abs(expected_origin_balance() - F.col("newbalanceOrig"))
    return F.col("type").isin(*types) & (gap > BALANCE_TOLERANCE)


def business_rule() -> dict[str, Column]:
    amount = F.col("amount")
    large = amount > LARGE_AMOUNT
    return {
        "is_large_transfer": flag(large),
        "is_large_transfer_type": flag(large & (F.col("type") == "TRANSFER")),
        "is_zero_balance_orig": flag(F.col("newbalanceOrig") == 0),
        "is_zero_balance_dest": flag(F.col("newbalanceDest") == 0),
        "is_round_amount": flag(amount % 1000 == 0),
        "is_high_risk_type": flag(F.col("type").isin(*HIGH_RISK_TYPES)),
        "amount_equals_old_balance": flag(F.abs(amount - F.col("oldbalanceOrg")) < 0.01),
        "has_balance_inconsistency": flag(off_balance(*TYPES)),
    }


_BUILDERS = {
    "balance": balance, "ratio": ratios, "merchant": merchant,
    "time": time, "business_rule": business_rule,
}


def engineer(df: DataFrame, groups: tuple[str, ...] = GROUPS) -> DataFrame:
    """Append the features of the chosen groups in one projection."""
    made: dict[str, Column] = {}
    for g in groups:
        made.update(_BUILDERS[g]())
    return df.withColumns(made)


def for_scoring(df: DataFrame) -> DataFrame:
    """The smaller feature set used at scoring time."""
    return df.withColumns(
        {
            "balance_change_orig": F.col("newbalanceOrig") - F.col("oldbalanceOrg"),
            "balance_change_dest": F.col("newbalanceDest") - F.col("oldbalanceDest"),
            "amount_to_balance_ratio": ratio("amount", "oldbalanceOrg"),
            "is_merchant_dest": is_merchant("nameDest"),
            "is_merchant_orig": is_merchant("nameOrig"),
            "is_large_transfer": (F.col("amount") > LARGE_AMOUNT) & (F.col("type") == "TRANSFER"),
            "hour_of_day": hour_of_day(),
            "day_index": F.floor(F.col("step") / 24).cast("int"),
            "type_encoded": lookup(F.col("type"), TYPE_CODES, UNKNOWN_TYPE_CODE),
        }
    )


# ---- fixed values: name parts that place a feature in a category, in test order
_CATEGORY_PARTS = [
    ("balance", ["balance"]),
    ("ratio", ["ratio"]),
    ("merchant", ["merchant"]),
    ("time", ["hour", "day", "week", "time", "business_hours"]),
    ("business_rule", ["large", "zero", "round", "risk", "equals", "inconsistency"]),
]


def category_of(name: str) -> str | None:
    if name in COLUMNS:
        return "original"
    return next((c for c, parts in _CATEGORY_PARTS if any(p in name for p in parts)), None)


def catalogue(df: DataFrame) -> DataFrame:
    """Columns of ``df`` by feature category; reads metadata only."""
    rows = [(category_of(c), c) for c in df.columns]
    return df.sparkSession.createDataFrame(
        [r for r in rows if r[0]], "category string, feature string"
    )


def summary(spark: SparkSession, groups: tuple[str, ...] = GROUPS) -> DataFrame:
    """Features created per group."""
    rows = [(g, len(_BUILDERS[g]()), sorted(_BUILDERS[g]())) for g in groups]
    return spark.createDataFrame(rows, "feature_group string, created int, features array<string>")
