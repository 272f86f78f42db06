"""Risk components, ladders and explanations as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import (
    FACTOR_WEIGHTS, HIGH_RISK_THRESHOLD, LARGE_AMOUNT, RISK_THRESHOLD, TYPE_RISK,
    UNKNOWN_TYPE_RISK,
)
from .columns import lookup
from .features import hour_of_day, is_merchant


def type_risk() -> Column:
    return lookup(F.col("type"), TYPE_RISK, UNKNOWN_TYPE_RISK)


def amount_risk() -> Column:
    a = F.col("amount")
    return (
        F.when(a > 200000, 0.9).when(a > 100000, 0.7)
        .when(a > 50000, 0.5).when(a > 10000, 0.3).otherwise(0.1)
    )


def _depleted() -> Column:
    return (F.col("oldbalanceOrg") > 0) & (F.col("newbalanceOrig") == 0)


def _empty() -> Column:
    return (F.col("oldbalanceOrg") == 0) & (F.col("newbalanceOrig") == 0)


def balance_risk() -> Column:
    old = F.col("oldbalanceOrg")
    share = F.when(old > 0, F.col("amount") / old)
    return F.when(_depleted(), 0.9).when(_empty(), 0.6).when(share > 0.8, 0.7).otherwise(0.2)


def hour_risk() -> Column:
    """Null where the step is not positive: such rows carry no time component."""
    h = hour_of_day()
    by_hour = F.when((h >= 22) | (h <= 6), 0.7).when(h.between(12, 14), 0.4).otherwise(0.2)
    return F.when(F.col("step") > 0, by_hour)


def rule_score() -> Column:
    """Weighted mean of the four rule components (an extension: the weights are given,
    the combination is ours; components without a rule are left out of the total)."""
    parts = [
        (FACTOR_WEIGHTS["transaction_type"], type_risk()),
        (FACTOR_WEIGHTS["amount_based"], amount_risk()),
        (FACTOR_WEIGHTS["balance_patterns"], balance_risk()),
        (FACTOR_WEIGHTS["time_patterns"], F.coalesce(hour_risk(), F.lit(0.0))),
    ]
    total = sum(w for w, _ in parts)
    score = parts[0][1] * parts[0][0]
    for w, c in parts[1:]:
        score = score + c * w
    return F.round(score / total, 6)


def risk_level(score: Column, medium: float = RISK_THRESHOLD, high: float = HIGH_RISK_THRESHOLD) -> Column:
    return F.when(score >= high, "HIGH").when(score >= medium, "MEDIUM").otherwise("LOW")


def decision_level(score: Column) -> Column:
    return (
        F.when(score >= 0.9, "critical").when(score >= 0.7, "high")
        .when(score >= 0.3, "medium").otherwise("low")
    )


def alert_level(score: Column) -> Column:
    return (
        F.when(score >= 0.9, "CRITICAL").when(score >= 0.8, "HIGH")
        .when(score >= 0.6, "MEDIUM").otherwise("LOW")
    )


def confidence(score: Column) -> Column:
    return F.least(F.abs(score - 0.5) * 2, F.lit(1.0))


def _money(c: Column) -> Column:
    return F.format_number(c, 2)


def _present(*items: Column) -> Column:
    return F.array_compact(F.array(*items))


def factors() -> Column:
    """Struct of the three factor lists and the component scores."""
    amount, kind, risk = F.col("amount"), F.col("type"), type_risk()
    high = _present(
        F.when(risk > 0.7, F.concat(F.lit("High-risk transaction type: "), kind)),
        F.when(amount > LARGE_AMOUNT, F.concat(F.lit("Large transaction amount: "), _money(amount))),
        F.when(_depleted(), F.lit("Complete balance depletion detected")),
    )
    medium = _present(
        F.when((risk > 0.4) & (risk <= 0.7), F.concat(F.lit("Medium-risk transaction type: "), kind)),
        F.when((amount > 50000) & (amount <= LARGE_AMOUNT),
               F.concat(F.lit("Moderate transaction amount: "), _money(amount))),
        F.when(_empty(), F.lit("Zero balance transaction")),
        F.when(hour_risk() > 0.6,
               F.concat(F.lit("Transaction at high-risk hour: "), hour_of_day().cast("string"))),
    )
    to_merchant, from_merchant = is_merchant("nameDest"), is_merchant("nameOrig")
    low = _present(
        F.when(to_merchant, F.lit("Transaction to merchant account"))
        .when(~from_merchant, F.lit("Customer-to-customer transaction")),
    )
    scores = F.map_filter(
        F.create_map(
            F.lit("transaction_type"), risk, F.lit("amount"), amount_risk(),
            F.lit("balance_patterns"), balance_risk(), F.lit("time_patterns"), hour_risk(),
        ),
        lambda _, v: v.isNotNull(),
    )
    return F.struct(
        high.alias("high"), medium.alias("medium"), low.alias("low"), scores.alias("risk_scores")
    )


def _tier(score: Column, medium: float, high: float, values: tuple) -> Column:
    return F.when(score >= high, values[0]).when(score >= medium, values[1]).otherwise(values[2])


def _section(title: str, items: Column) -> Column:
    bullets = F.transform(items, lambda x: F.concat(F.lit("• "), x))
    return F.when(F.size(items) > 0, F.concat(F.array(F.lit(title)), bullets)).otherwise(
        F.array().cast("array<string>")
    )


def explanation(score: Column, found: Column, medium: float = RISK_THRESHOLD,
                high: float = HIGH_RISK_THRESHOLD) -> Column:
    """Headline and factor sections joined by line breaks."""
    tier = _tier(score, medium, high, (F.lit("HIGH"), F.lit("MEDIUM"), F.lit("LOW")))
    headline = F.concat(
        tier, F.lit(" RISK: This transaction has a "), F.format_string("%.1f%%", score * 100),
        F.lit(" probability of being fraudulent."),
    )
    low = F.when(score < medium, F.slice(found["low"], 1, 2)).otherwise(F.array().cast("array<string>"))
    return F.array_join(
        F.concat(
            F.array(headline),
            _section("Critical risk factors identified:", found["high"]),
            _section("Moderate risk factors identified:", found["medium"]),
            _section("Low risk indicators:", low),
        ),
        "\n",
    )


# ---- fixed values: recommendation texts --------------------------------------
BLOCK = [
    "IMMEDIATE ACTION REQUIRED: Block transaction and investigate",
    "Contact customer to verify transaction legitimacy",
    "Review account for other suspicious activities",
    "Consider temporary account restrictions",
]
VERIFY = [
    "Enhanced verification recommended",
    "Request additional authentication from customer",
    "Monitor account for follow-up transactions",
    "Consider manual review by fraud analyst",
]
PASS = [
    "Transaction appears legitimate",
    "Continue normal processing",
    "Maintain standard monitoring",
]


def recommendations(score: Column, found: Column, medium: float = RISK_THRESHOLD,
                    high: float = HIGH_RISK_THRESHOLD) -> Column:
    def texts(items):
        return F.array(*[F.lit(i) for i in items])

    def any_high(part):
        return F.exists(found["high"], lambda f: f.contains(part))

    extra = _present(
        F.when(any_high("Large transaction"), F.lit("Verify large amount with customer via secure channel")),
        F.when(any_high("balance depletion"), F.lit("Investigate potential account takeover")),
    )
    return F.concat(_tier(score, medium, high, (texts(BLOCK), texts(VERIFY), texts(PASS))), extra)
