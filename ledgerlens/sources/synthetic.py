"""Seeded transaction generator with a target fraud rate, and hand-made edge cases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import COLUMNS, TRANSACTION

# ---- fixed values: type mix and fraud odds ----------------------------------
TYPE_MIX = [("CASH_IN", 0.15), ("CASH_OUT", 0.20), ("DEBIT", 0.05), ("PAYMENT", 0.45), ("TRANSFER", 0.15)]
TYPE_ODDS = {"CASH_OUT": 0.4, "TRANSFER": 0.3, "PAYMENT": 0.02, "CASH_IN": 0.01, "DEBIT": 0.01}
AMOUNT_ODDS = [(200000, 0.5), (100000, 0.2), (50000, 0.1)]
EMPTY_ODDS, DEPLETED_ODDS, CUSTOMER_TRANSFER_ODDS, MAX_ODDS = 0.3, 0.4, 0.2, 0.9


def _exponential(seed: int, mean: float):
    return -F.log(1 - F.rand(seed)) * mean


def generate(spark: SparkSession, n: int, fraud_rate: float = 0.1, seed: int = 42) -> DataFrame:
    """``n`` transactions; odds are scaled by their mean to hit the fraud rate."""
    u = F.col("u")
    kind, edge = None, 0.0
    for name, share in TYPE_MIX:
        edge += share
        kind = F.when(u < edge, name) if kind is None else kind.when(u < edge, name)
    drawn = spark.range(n).select("id", F.rand(seed).alias("u"))  # one draw, compared several times
    rows = drawn.select(
        "id",
        (F.floor(F.rand(seed + 1) * 744) + 1).alias("step"),
        F.coalesce(kind, F.lit(TYPE_MIX[-1][0])).alias("type"),
        F.exp(F.randn(seed + 2) * 2 + 8).alias("amount"),
        F.concat(F.lit("C"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("nameOrig"),
        _exponential(seed + 3, 10000).alias("oldbalanceOrg"),
        _exponential(seed + 4, 10000).alias("loose_orig"),
        F.when(F.rand(seed + 5) > 0.3, F.concat(F.lit("M"), F.lpad(F.col("id").cast("string"), 9, "0")))
        .otherwise(F.concat(F.lit("C"), F.lpad((F.col("id") + n).cast("string"), 9, "0"))).alias("nameDest"),
        _exponential(seed + 6, 5000).alias("oldbalanceDest"),
        _exponential(seed + 7, 5000).alias("loose_dest"),
        F.rand(seed + 8).alias("draw"),
    )
    old, amount = F.col("oldbalanceOrg"), F.col("amount")
    covered = old >= amount
    booked = (
        F.when(F.col("type") == "CASH_IN", old + amount)
        .when(covered, old - amount).otherwise(F.col("loose_orig"))
    )
    received = F.when((F.col("type") == "TRANSFER") & covered, F.col("oldbalanceDest") + amount)
    odds = F.lit(0.0)
    for name, p in TYPE_ODDS.items():
        odds = odds + F.when(F.col("type") == name, p).otherwise(0.0)
    for limit, p in AMOUNT_ODDS:
        odds = odds + F.when(amount > limit, p).otherwise(0.0)
    odds = odds + F.when((old == 0) & (F.col("loose_orig") == 0), EMPTY_ODDS).otherwise(0.0)
    odds = odds + F.when((old > 0) & (F.col("loose_orig") == 0), DEPLETED_ODDS).otherwise(0.0)
    odds = odds + F.when(
        (F.col("type") == "TRANSFER") & ~F.col("nameDest").startswith("M"), CUSTOMER_TRANSFER_ODDS
    ).otherwise(0.0)
    weighed = rows.withColumn("odds", F.least(odds, F.lit(MAX_ODDS)))
    mean = weighed.agg(F.avg("odds")).first()[0] if n else None
    scale = fraud_rate / mean if mean else 1.0
    return (
        weighed.withColumn("isFraud", (F.col("draw") < F.least(F.col("odds") * scale, F.lit(MAX_ODDS))).cast("int"))
        .withColumns(
            {
                "newbalanceOrig": booked,
                "newbalanceDest": F.coalesce(received, F.col("loose_dest")),
                "isFlaggedFraud": (
                    (F.col("type") == "TRANSFER") & (amount > 200000) & (F.col("isFraud") == 1)
                ).cast("int"),
            }
        )
        .select(COLUMNS)
    )


def edge_cases(spark: SparkSession) -> DataFrame:
    """Zero amount, huge transfer, all-zero balances, negative balance, merchant origin."""
    rows = [
        (1, "PAYMENT", 0.0, "C000000001", 1000.0, 1000.0, "M000000001", 0.0, 0.0, 0, 0),
        (2, "TRANSFER", 1e7, "C000000002", 1e7, 0.0, "C000000003", 0.0, 1e7, 1, 1),
        (3, "CASH_OUT", 5000.0, "C000000004", 0.0, 0.0, "M000000002", 0.0, 0.0, 1, 0),
        (4, "PAYMENT", 1000.0, "C000000005", 500.0, -500.0, "M000000003", 1000.0, 2000.0, 0, 0),
        (5, "TRANSFER", 2000.0, "M000000004", 5000.0, 3000.0, "C000000006", 1000.0, 3000.0, 0, 0),
    ]
    return spark.createDataFrame(rows, TRANSACTION)
