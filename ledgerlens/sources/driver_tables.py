"""Fraud tables derived from the given Parquet tables (orders, customer, events).

Rules are written with expressions Spark and DuckDB evaluate alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.risk import amount_risk, balance_risk, rule_score, type_risk
from ..schema import COLUMNS, RISK_THRESHOLD

PRIORITY_TYPE = [
    ("1-URGENT", "TRANSFER"), ("2-HIGH", "CASH_OUT"), ("3-MEDIUM", "PAYMENT"),
    ("4-NOT SPECIFIED", "DEBIT"), ("5-LOW", "CASH_IN"),
]
DRIFT_STEP = 372
FIRST_SECOND = 1704067200  # 2024-01-01


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a file stream."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parquet*")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction per order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    return booked(orders, table(spark, sf_dir, "customer"))


def booked(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Transactions of an orders table or stream and the customers' balances."""
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    kind = None
    for priority, name in PRIORITY_TYPE:
        hit = F.col("o_orderpriority") == priority
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)

    def account(merchant, number):
        return F.concat(F.when(merchant, "M").otherwise("C"), F.lpad(number.cast("string"), 9, "0"))

    start = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        k.alias("tx_id"),
        (1 + (k * 7) % 744).alias("step"),
        kind.alias("type"),
        F.col("o_totalprice").alias("amount"),
        account(k % 50 == 0, cust).alias("nameOrig"),
        F.when(k % 11 == 0, 0.0).when(k % 17 == 0, F.col("o_totalprice"))
        .otherwise((F.col("c_acctbal") + 1000) * 50).alias("oldbalanceOrg"),
        account(k % 3 == 0, (cust * 31 + 7) % 1500).alias("nameDest"),
        F.when(k % 4 == 0, 0.0).otherwise((cust % 1000).cast("double") * 100).alias("oldbalanceDest"),
    )
    k, amount, old = F.col("tx_id"), F.col("amount"), F.col("oldbalanceOrg")
    moved = F.col("type").isin("TRANSFER", "CASH_OUT")
    is_fraud = (moved & ((k % 5 == 0) | ((amount > 400000) & (k % 2 == 0)))) | (k % 97 == 0)
    flagged = (F.col("type") == "TRANSFER") & (amount > 200000) & ((k % 5 == 0) | (k % 89 == 0))
    return start.withColumns(
        {
            "newbalanceOrig": F.when(k % 13 == 0, old + 1)
            .when(F.col("type") == "CASH_IN", old + amount)
            .otherwise(F.greatest(old - amount, F.lit(0.0))),
            "newbalanceDest": F.when(moved, F.col("oldbalanceDest") + amount)
            .otherwise(F.col("oldbalanceDest")),
            "isFraud": is_fraud.cast("int"),
            "isFlaggedFraud": flagged.cast("int"),
        }
    ).select("tx_id", *COLUMNS)


def transactions_dirty(spark: SparkSession, sf_dir: str, drop_variant: bool = False) -> DataFrame:
    """The same rows with gaps that reach every automatic imputation branch."""
    k = F.col("tx_id")
    gaps = {
        "amount": k % 37 == 0, "newbalanceDest": k % 10 == 0,
        "oldbalanceDest": k % 4 == 1, "type": k % 41 == 0,
    }
    if drop_variant:
        gaps["oldbalanceOrg"] = k % 5 < 3
    return transactions(spark, sf_dir).withColumns({c: F.when(~m, F.col(c)) for c, m in gaps.items()})


def with_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    tx = transactions(spark, sf_dir)
    return tx.unionByName(tx.filter(F.col("tx_id") % 500 == 0))


def alert_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored events: one account per user (some unnamed), score from the event value."""
    return alert_scores_of(table(spark, sf_dir, "events"))


def alert_scores_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("tx_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_id") % 53 != 0, F.concat(F.lit("C"), F.lpad(F.col("user_id").cast("string"), 9, "0"))).alias("nameOrig"),
        F.col("event_type").alias("type"),
        F.col("value").alias("amount"),
        F.least(F.col("value") / 150.0, F.lit(1.0)).alias("fraud_score"),
    )


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.col("fraud_score")
    return transactions(spark, sf_dir).withColumn("fraud_score", rule_score()).withColumn(
        "fraud_prediction", (score >= RISK_THRESHOLD).cast("int")
    )


def booking_time() -> Column:
    """Wall-clock time of a step."""
    return F.timestamp_seconds(F.lit(FIRST_SECOND) + F.col("step") * 3600)


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outcomes_of(transactions(spark, sf_dir))


def outcomes_of(tx: DataFrame) -> DataFrame:
    """Two feedback records for every third transaction: an older wrong one, a newer right one."""
    tx = tx.filter(F.col("tx_id") % 3 == 0)
    version = F.explode(F.array(F.lit(0), F.lit(1)))
    return tx.select(
        F.md5(F.col("tx_id").cast("string")).alias("decision_id"), "isFraud", "step", version.alias("v")
    ).select(
        "decision_id",
        F.timestamp_seconds(F.lit(FIRST_SECOND) + F.col("step") * 3600 + (F.col("v") + 1) * 86400).alias("ts"),
        F.when(F.col("v") == 1, F.col("isFraud")).otherwise(1 - F.col("isFraud")).alias("actual_outcome"),
    )


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of four rule models on every transaction: (model, fold, label, score, prediction).

    The fold is a key residue, so every engine assigns it alike.
    """
    rules = {
        "rules": rule_score(), "type_only": type_risk(),
        "amount_only": amount_risk(), "balance_only": balance_risk(),
    }
    long = F.array(*[F.struct(F.lit(n).alias("model"), s.alias("score")) for n, s in rules.items()])
    return (
        transactions(spark, sf_dir)
        .select((F.col("tx_id") % 5).cast("int").alias("fold"), F.col("isFraud").alias("label"), F.inline(long))
        .withColumn("prediction", (F.col("score") >= 0.65).cast("int"))
    )


def drift_pair(spark: SparkSession, sf_dir: str, shift: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Earlier half as reference, later half (amounts times ``shift``) as current."""
    tx = transactions(spark, sf_dir)
    late = tx.filter(F.col("step") > DRIFT_STEP).withColumn("amount", F.col("amount") * shift)
    return tx.filter(F.col("step") <= DRIFT_STEP), late


def metric_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metric events: event type as metric name, value as reading."""
    return metric_events_of(table(spark, sf_dir, "events"))


def metric_events_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_type").alias("name"), "value", F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id"), F.col("event_id"),
    )
