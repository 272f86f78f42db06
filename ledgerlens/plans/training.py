"""Batch pipeline: clean, derive features, train, score."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import features
from ..operators import cleaning, models, splitting

# Features a model sees: amounts, balances, ratios, flags and time, no ids and no labels.
MODEL_FEATURES = [
    "amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest", "balance_change_orig",
    "balance_change_dest", "amount_to_orig_balance_ratio", "amount_to_dest_balance_ratio", "is_merchant_dest",
    "is_merchant_orig", "hour_of_day", "day_of_month", "is_weekend", "is_business_hours", "is_large_transfer",
    "is_zero_balance_orig", "is_zero_balance_dest", "is_high_risk_type", "amount_equals_old_balance",
    "has_balance_inconsistency",
]


def prepare(raw: DataFrame, strategy: str = "auto") -> DataFrame:
    """Clean rows with engineered features: one projection after the fitted statistics."""
    return features.engineer(cleaning.clean(raw, strategy)[0])


def train_and_hold_out(prepared: DataFrame, spec: models.Spec, key: list[str], **kw) -> tuple[models.FraudModel, DataFrame]:
    """(fitted model, scored test rows) after a stratified split."""
    train, test = splitting.train_test(prepared, "isFraud", key)
    model = models.fit(spec, train, MODEL_FEATURES, "isFraud", key, **kw)
    return model, model(test)
