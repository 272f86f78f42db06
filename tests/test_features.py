import pytest

from ledgerlens.functions import features, risk
from ledgerlens.schema import TRANSACTION
from pyspark.sql import functions as F

ROWS = [
    (1, "CASH_IN", 1000.0, "C1", 2000.0, 3000.0, "C2", 5000.0, 6000.0, 0, 0),
    (2, "CASH_OUT", 500.0, "C3", 1000.0, 500.0, "C4", 0.0, 500.0, 0, 0),
    (3, "TRANSFER", 200000.0, "C5", 250000.0, 50000.0, "C6", 1000.0, 201000.0, 0, 0),
    (24, "PAYMENT", 100.0, "C7", 100.0, 0.0, "M8", 0.0, 0.0, 0, 0),
    (25, "DEBIT", 50.0, "C9", 500.0, 450.0, "M10", 0.0, 0.0, 0, 0),
    (48, "TRANSFER", 300000.0, "M11", 300000.0, 0.0, "M12", 0.0, 300000.0, 1, 1),
    (49, "CASH_OUT", 10.0, "C13", 5.0, 5.0, "C14", 0.0, 0.0, 0, 0),
]


@pytest.fixture(scope="module")
def made(spark):
    return features.engineer(spark.createDataFrame(ROWS, TRANSACTION)).orderBy("step").collect()


def test_balance_and_ratio(made):
    assert [r.balance_change_orig for r in made[:2]] == [1000.0, -500.0]
    assert [r.balance_change_dest for r in made[:2]] == [1000.0, 500.0]
    assert [r.amount_to_orig_balance_ratio for r in made[:3]] == [0.5, 0.5, 0.8]
    assert [r.amount_to_dest_balance_ratio for r in made[:2]] == [0.2, 0.0]
    assert [r.orig_to_dest_balance_ratio for r in made[:2]] == [0.4, 0.0]


def test_time(made):
    by_step = {r.step: r for r in made}
    assert [by_step[s].hour_of_day for s in (1, 24, 25)] == [1, 0, 1]
    assert [by_step[s].day_of_month for s in (1, 24, 25)] == [1, 1, 2]
    assert by_step[24].time_period == "Night" and by_step[24].is_weekend == 1


def test_rules(made):
    by_step = {r.step: r for r in made}
    assert by_step[3].is_large_transfer == 0 and by_step[48].is_large_transfer == 1
    assert by_step[48].is_large_transfer_type == 1 and by_step[48].is_merchant_to_merchant == 1
    assert by_step[1].is_round_amount == 1 and by_step[2].is_round_amount == 0
    assert [by_step[s].is_high_risk_type for s in (2, 3, 24)] == [1, 1, 0]
    assert by_step[24].amount_equals_old_balance == 1
    assert by_step[49].has_balance_inconsistency == 1 and by_step[2].has_balance_inconsistency == 0


def test_step_zero_and_nulls(spark):
    rows = [(0, None, None, None, None, None, None, None, None, None, None)]
    r = features.engineer(spark.createDataFrame(rows, TRANSACTION)).first()
    assert (r.day_of_month, r.day_of_week, r.week_of_month) == (0, 6, 0)
    assert r.amount_to_orig_balance_ratio == 0.0 and r.is_large_transfer == 0 and r.is_merchant_dest == 0


def test_groups_and_catalogue(spark):
    tx = spark.createDataFrame(ROWS, TRANSACTION)
    assert "hour_of_day" not in features.engineer(tx, ("balance",)).columns
    found = {(r.category, r.feature) for r in features.catalogue(features.engineer(tx)).collect()}
    assert ("balance", "is_zero_balance_orig") in found and ("original", "step") in found
    assert ("balance", "amount_to_orig_balance_ratio") in found and ("time", "is_weekend") in found


def test_summary_counts_every_feature(spark, made):
    rows = features.summary(spark).collect()
    assert sum(r.created for r in rows) == len(made[0]) - len(ROWS[0]) == 29


def test_high_risk_explanation(spark):
    tx = spark.createDataFrame([(2, "CASH_OUT", 500000.0, "C1", 500000.0, 0.0, "C2", 0.0, 0.0, 1, 0)], TRANSACTION)
    r = tx.select(risk.factors().alias("f"), risk.rule_score().alias("s")).select(
        "s", "f", risk.explanation(F.lit(0.95), F.col("f")).alias("t"), risk.recommendations(F.lit(0.95), F.col("f")).alias("a")).first()
    assert r.f.high == ["High-risk transaction type: CASH_OUT", "Large transaction amount: 500,000.00", "Complete balance depletion detected"]
    assert r.t.startswith("HIGH RISK: This transaction has a 95.0% probability") and "Low risk" not in r.t
    assert len(r.a) == 6 and 0.8 <= r.s <= 1


def test_hyphenated_types_are_normalised(spark):
    r = spark.createDataFrame([("CASH-OUT",)], "type string").select(features.normalized_type().alias("t")).first()
    assert r.t == "CASH_OUT"
