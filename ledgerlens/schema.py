"""Column layouts, domain values and limits shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# ---- fixed values: transaction layout -------------------------------------
TRANSACTION = T.StructType(
    [
        T.StructField("step", T.LongType()),
        T.StructField("type", T.StringType()),
        T.StructField("amount", T.DoubleType()),
        T.StructField("nameOrig", T.StringType()),
        T.StructField("oldbalanceOrg", T.DoubleType()),
        T.StructField("newbalanceOrig", T.DoubleType()),
        T.StructField("nameDest", T.StringType()),
        T.StructField("oldbalanceDest", T.DoubleType()),
        T.StructField("newbalanceDest", T.DoubleType()),
        T.StructField("isFraud", T.IntegerType()),
        T.StructField("isFlaggedFraud", T.IntegerType()),
    ]
)

COLUMNS = TRANSACTION.fieldNames()
NUMERIC = [
    "step", "amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest",
    "newbalanceDest", "isFraud", "isFlaggedFraud",
]
MEASURES = ["amount", "oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest"]
BALANCES = ["oldbalanceOrg", "newbalanceOrig", "oldbalanceDest", "newbalanceDest"]
CATEGORICAL = ["type", "nameOrig", "nameDest"]
LABELS = ["isFraud", "isFlaggedFraud"]

# ---- fixed values: domains and business limits -----------------------------
TYPES = ["CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT", "TRANSFER"]
TYPE_CODES = {"CASH_IN": 0, "CASH_OUT": 1, "DEBIT": 2, "PAYMENT": 3, "TRANSFER": 4}
UNKNOWN_TYPE_CODE = 3
HIGH_RISK_TYPES = ["CASH_OUT", "TRANSFER"]
MERCHANT_PREFIX = "M"
LARGE_AMOUNT = 200000
FIRST_STEP, LAST_STEP = 1, 744
BALANCE_TOLERANCE = 0.01

# ---- fixed values: scoring ---------------------------------------------------
RISK_THRESHOLD = 0.5
HIGH_RISK_THRESHOLD = 0.8
TYPE_RISK = {"CASH_OUT": 0.8, "TRANSFER": 0.7, "CASH_IN": 0.3, "DEBIT": 0.2, "PAYMENT": 0.1}
UNKNOWN_TYPE_RISK = 0.5
FACTOR_WEIGHTS = {
    "transaction_type": 0.25,
    "amount_based": 0.20,
    "balance_patterns": 0.20,
    "account_patterns": 0.15,
    "time_patterns": 0.10,
    "model_confidence": 0.10,
}

# ---- fixed values: decision log and alerts -----------------------------------
DECISION_LEVELS = ["low", "medium", "high", "critical"]
SEVERITIES = ["CRITICAL", "HIGH", "MEDIUM", "LOW"]
RETENTION_DAYS_DECISIONS = 2555
RETENTION_DAYS_ALERTS = 30

DEFAULTS_FOR_SCORING = {
    "step": 0,
    "type": "PAYMENT",
    "amount": 0.0,
    "nameOrig": "C000000000",
    "oldbalanceOrg": 0.0,
    "newbalanceOrig": 0.0,
    "nameDest": "C000000000",
    "oldbalanceDest": 0.0,
    "newbalanceDest": 0.0,
}
