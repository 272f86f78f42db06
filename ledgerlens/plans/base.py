"""Registry of named queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its SQL counterpart."""
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


# The transaction view, written once for all counterparts.
_TX = """
src AS (
  SELECT o_orderkey AS k, o_custkey AS cu, o_totalprice AS a, o_orderpriority AS p, c_acctbal AS b
  FROM orders JOIN customer ON o_custkey = c_custkey),
opened AS (
  SELECT k, cu, a,
    CASE p WHEN '1-URGENT' THEN 'TRANSFER' WHEN '2-HIGH' THEN 'CASH_OUT' WHEN '3-MEDIUM' THEN 'PAYMENT'
           WHEN '4-NOT SPECIFIED' THEN 'DEBIT' WHEN '5-LOW' THEN 'CASH_IN' END AS t,
    CASE WHEN k % 11 = 0 THEN 0.0::DOUBLE WHEN k % 17 = 0 THEN a ELSE (b + 1000) * 50 END AS ob,
    CASE WHEN k % 4 = 0 THEN 0.0::DOUBLE ELSE CAST(cu % 1000 AS DOUBLE) * 100 END AS od
  FROM src),
tx AS (
  SELECT k AS tx_id, 1 + (k * 7) % 744 AS step, t AS type, a AS amount,
    (CASE WHEN k % 50 = 0 THEN 'M' ELSE 'C' END) || lpad(CAST(cu AS VARCHAR), 9, '0') AS nameOrig,
    ob AS oldbalanceOrg,
    CASE WHEN k % 13 = 0 THEN ob + 1 WHEN t = 'CASH_IN' THEN ob + a ELSE greatest(ob - a, 0.0::DOUBLE) END AS newbalanceOrig,
    (CASE WHEN k % 3 = 0 THEN 'M' ELSE 'C' END) || lpad(CAST((cu * 31 + 7) % 1500 AS VARCHAR), 9, '0') AS nameDest,
    od AS oldbalanceDest,
    CASE WHEN t IN ('TRANSFER', 'CASH_OUT') THEN od + a ELSE od END AS newbalanceDest,
    CAST(((t IN ('TRANSFER', 'CASH_OUT') AND (k % 5 = 0 OR (a > 400000 AND k % 2 = 0))) OR k % 97 = 0) AS INTEGER) AS isFraud,
    CAST((t = 'TRANSFER' AND a > 200000 AND (k % 5 = 0 OR k % 89 = 0)) AS INTEGER) AS isFlaggedFraud
  FROM opened)"""

_DIRTY = """,
dirty AS (
  SELECT tx_id, step, CASE WHEN tx_id % 41 <> 0 THEN type END AS type,
    CASE WHEN tx_id % 37 <> 0 THEN amount END AS amount, nameOrig, oldbalanceOrg, newbalanceOrig, nameDest,
    CASE WHEN tx_id % 4 <> 1 THEN oldbalanceDest END AS oldbalanceDest,
    CASE WHEN tx_id % 10 <> 0 THEN newbalanceDest END AS newbalanceDest, isFraud, isFlaggedFraud
  FROM tx)"""

TYPE_RISK_SQL = (
    "(CASE type WHEN 'CASH_OUT' THEN 0.8::DOUBLE WHEN 'TRANSFER' THEN 0.7 WHEN 'CASH_IN' THEN 0.3 "
    "WHEN 'DEBIT' THEN 0.2 WHEN 'PAYMENT' THEN 0.1 ELSE 0.5 END)"
)
AMOUNT_RISK_SQL = (
    "(CASE WHEN amount > 200000 THEN 0.9::DOUBLE WHEN amount > 100000 THEN 0.7 WHEN amount > 50000 THEN 0.5 "
    "WHEN amount > 10000 THEN 0.3 ELSE 0.1 END)"
)
BALANCE_RISK_SQL = (
    "(CASE WHEN oldbalanceOrg > 0 AND newbalanceOrig = 0 THEN 0.9::DOUBLE "
    "WHEN oldbalanceOrg = 0 AND newbalanceOrig = 0 THEN 0.6 "
    "WHEN oldbalanceOrg > 0 AND amount / oldbalanceOrg > 0.8 THEN 0.7 ELSE 0.2 END)"
)
HOUR_RISK_SQL = (
    "(CASE WHEN step > 0 THEN CASE WHEN step % 24 >= 22 OR step % 24 <= 6 THEN 0.7::DOUBLE "
    "WHEN step % 24 BETWEEN 12 AND 14 THEN 0.4 ELSE 0.2 END END)"
)
RULE_SCORE_SQL = (
    f"round(({TYPE_RISK_SQL} * 0.25 + {AMOUNT_RISK_SQL} * 0.2 + {BALANCE_RISK_SQL} * 0.2 "
    f"+ coalesce({HOUR_RISK_SQL}, 0) * 0.1) / 0.75, 6)"
)

_SCORED = f""",
scored AS (
  SELECT *, CAST(fraud_score >= 0.5 AS INTEGER) AS fraud_prediction
  FROM (SELECT *, {RULE_SCORE_SQL} AS fraud_score FROM tx))"""

_MODELS = f""",
models AS (
  SELECT *, CAST(score >= 0.65 AS INTEGER) AS prediction FROM (
    SELECT 'rules' AS model, CAST(tx_id % 5 AS INTEGER) AS fold, isFraud AS label, {RULE_SCORE_SQL} AS score FROM tx
    UNION ALL SELECT 'type_only', CAST(tx_id % 5 AS INTEGER), isFraud, {TYPE_RISK_SQL} FROM tx
    UNION ALL SELECT 'amount_only', CAST(tx_id % 5 AS INTEGER), isFraud, {AMOUNT_RISK_SQL} FROM tx
    UNION ALL SELECT 'balance_only', CAST(tx_id % 5 AS INTEGER), isFraud, {BALANCE_RISK_SQL} FROM tx))"""

_ALERTS = """
scores AS (
  SELECT event_id AS tx_id, ts,
    CASE WHEN event_id % 53 = 0 THEN 'unknown' ELSE 'C' || lpad(CAST(user_id AS VARCHAR), 9, '0') END AS nameOrig, event_type AS type,
    value AS amount, least(value / 150.0, 1.0::DOUBLE) AS fraud_score FROM events)"""


def tx_sql(body: str, extra: str = "") -> str:
    return f"WITH {_TX}{extra} {body}"


def dirty_sql(body: str, extra: str = "") -> str:
    return f"WITH {_TX}{_DIRTY}{extra} {body}"


def scored_sql(body: str, extra: str = "") -> str:
    return f"WITH {_TX}{_SCORED}{extra} {body}"


def models_sql(body: str, extra: str = "") -> str:
    return f"WITH {_TX}{_MODELS}{extra} {body}"


def events_sql(body: str, extra: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{_ALERTS}{extra} {body}"


def union_all(parts) -> str:
    return " UNION ALL ".join(parts)
