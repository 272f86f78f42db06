"""Validation: reports are long tables from one conditional aggregate per scan."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import coerced, flag, report_rows
from ..functions.features import off_balance
from ..schema import (
    BALANCES, COLUMNS, DEFAULTS_FOR_SCORING, FIRST_STEP, LAST_STEP, TRANSACTION, TYPES,
)
from .quantiles import quantiles


def missing_columns(df: DataFrame) -> list[str]:
    return [c for c in COLUMNS if c not in df.columns]


def require_columns(df: DataFrame) -> DataFrame:
    """Fail on missing columns; extra columns pass."""
    missing = missing_columns(df)
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return df


def column_check(df: DataFrame) -> DataFrame:
    """Every required or extra column with its status and non-null rows."""
    names = COLUMNS + [c for c in df.columns if c not in COLUMNS]
    stats = df.agg(*[F.count(c).alias(f"n_{c}") for c in df.columns])
    entries = []
    for c in names:
        status = "missing" if c not in df.columns else "required" if c in COLUMNS else "extra"
        n = F.col(f"n_{c}") if c in df.columns else F.lit(0).cast("bigint")
        entries.append((F.lit(c), F.lit(status), n))
    return report_rows(stats, entries, ["column", "status", "non_null"])


def invalid_types(df: DataFrame) -> DataFrame:
    """Values of ``type`` outside the domain, with their row counts."""
    bad = df.filter(F.col("type").isNotNull() & ~F.col("type").isin(TYPES))
    return bad.groupBy("type").agg(F.count("*").alias("rows"))


def coercibility(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Non-null values of each column that its target type cannot hold."""
    stats = df.agg(
        *[
            F.count_if(F.col(c).isNotNull() & coerced(c, t).isNull()).alias(c)
            for c, t in types.items()
        ]
    )
    return report_rows(
        stats, [(F.lit(c), F.lit(t), F.col(c)) for c, t in types.items()],
        ["column", "target_type", "failures"],
    )


def out_of_range_steps() -> Column:
    return (F.col("step") < FIRST_STEP) | (F.col("step") > LAST_STEP)


def quality_report(df: DataFrame) -> DataFrame:
    """Row count, nulls per column, step range, negative amounts and fraud rate."""
    cols = [c for c in COLUMNS if c in df.columns]
    n = F.count("*")
    stats = df.agg(
        n.alias("rows"), F.min("step").alias("lo"), F.max("step").alias("hi"),
        F.count_if(F.col("amount") < 0).alias("neg"), F.sum("isFraud").alias("fraud"),
        *[(n - F.count(c)).alias(f"null_{c}") for c in cols],
    )
    rows = F.col("rows")

    def pct(part):
        return F.when(rows > 0, part * 100.0 / rows).otherwise(0.0)

    fraud = F.coalesce(F.col("fraud"), F.lit(0))
    entries = [
        ("row_count", "", rows), ("is_empty", "", flag(rows == 0)),
        ("min_value", "step", F.col("lo")), ("max_value", "step", F.col("hi")),
        ("out_of_range", "step", flag((F.col("lo") < FIRST_STEP) | (F.col("hi") > LAST_STEP))),
        ("negative", "amount", F.col("neg")),
        ("fraud_count", "isFraud", fraud), ("fraud_rate_pct", "isFraud", pct(fraud)),
    ]
    for c in cols:
        entries += [("null_count", c, F.col(f"null_{c}")), ("null_pct", c, pct(F.col(f"null_{c}")))]
    return report_rows(
        stats, [(F.lit(a), F.lit(b), v.cast("double")) for a, b, v in entries],
        ["check", "column", "value"],
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows after the first of each identical group (nulls equal), one-row result.

    Copies meet by a full-row key; equal rows are merged before the shuffle, so a
    row repeated through the whole table costs one record per task.
    """
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("copies"))
    return groups.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicates"))


def balance_violations() -> Column:
    """Cleaner's rule: CASH_IN and CASH_OUT only."""
    return F.count_if(off_balance("CASH_IN", "CASH_OUT"))


def flag_violations() -> Column:
    """Flagged by the business rule but not fraud."""
    return F.count_if((F.col("isFlaggedFraud") == 1) & (F.col("isFraud") == 0))


def consistency_report(df: DataFrame) -> DataFrame:
    """Issues and warnings with counts; two scans (row groups, conditional counts)."""
    unknown = F.col("type").isNotNull() & ~F.col("type").isin(TYPES)
    stats = df.agg(
        F.count_if(unknown).alias("types"), balance_violations().alias("balance"),
        F.count_if(F.col("amount") < 0).alias("negative"),
        F.count_if(out_of_range_steps()).alias("steps"), flag_violations().alias("flags"),
    ).withColumn("duplicates", duplicate_rows(df.select(*COLUMNS)).scalar())
    entries = [
        ("duplicate_rows", "issue", "duplicates"), ("invalid_types", "issue", "types"),
        ("balance_inconsistencies", "issue", "balance"), ("negative_amounts", "warning", "negative"),
        ("invalid_steps", "issue", "steps"), ("flagged_not_fraud", "warning", "flags"),
    ]
    return report_rows(
        stats, [(F.lit(a), F.lit(b), F.col(c)) for a, b, c in entries], ["check", "level", "rows"]
    )


def final_check(df: DataFrame) -> DataFrame:
    """Residual nulls and types against the expected layout."""
    expected = {f.name: f.dataType.simpleString() for f in TRANSACTION.fields}
    actual = dict(df.dtypes)
    cols = [c for c in COLUMNS if c in df.columns]
    stats = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return report_rows(
        stats,
        [(F.lit(c), F.lit(expected[c]), F.lit(expected[c] == actual[c]), F.col(c)) for c in cols],
        ["column", "expected_type", "type_ok", "nulls"],
    )


def iqr_fences(df: DataFrame, columns: list[str], factor: float = 1.5) -> dict[str, tuple]:
    """{column: (lower, upper)} from exact quartiles; columns without values are left out."""
    found = quantiles(df, columns, [0.25, 0.75])
    out = {}
    for c in columns:
        q1, q3 = found[(None, c)]
        if q1 is not None:
            out[c] = (q1 - factor * (q3 - q1), q3 + factor * (q3 - q1))
    return out


def quality_issues(df: DataFrame) -> DataFrame:
    """Duplicates, empty strings, IQR outliers per number, and origin balances that are
    not ``old - amount`` (tested for every type here)."""
    fields = [f for f in df.schema.fields if f.name in COLUMNS]
    text = [f.name for f in fields if isinstance(f.dataType, T.StringType)]
    numbers = [f.name for f in fields if isinstance(f.dataType, T.NumericType)]
    fences = iqr_fences(df, numbers)
    gap = F.abs(F.col("newbalanceOrig") - (F.col("oldbalanceOrg") - F.col("amount")))
    aggs, entries = [], []
    for c in text:
        aggs.append(F.count_if(F.col(c) == "").alias(f"e_{c}"))
        entries.append(("empty_strings", c, f"e_{c}"))
    for c, (lo, hi) in fences.items():
        aggs.append(F.count_if((F.col(c) < lo) | (F.col(c) > hi)).alias(f"o_{c}"))
        entries.append(("outliers", c, f"o_{c}"))
    aggs.append(F.count_if(gap > 0.01).alias("mismatch"))
    entries += [("balance_mismatch", "newbalanceOrig", "mismatch"), ("duplicate_rows", "", "dup")]
    stats = df.agg(*aggs).withColumn("dup", duplicate_rows(df.select(*[f.name for f in fields])).scalar())
    return report_rows(
        stats, [(F.lit(a), F.lit(b), F.col(c)) for a, b, c in entries], ["issue", "column", "rows"]
    )


def request_errors() -> Column:
    """Names of the request rules a row breaks."""
    def bad(c, name):
        return F.when(c, F.lit(name))

    rules = [bad(F.coalesce(F.col("step") < 0, F.lit(True)), "step")]
    rules += [bad(F.coalesce(F.col(c) < 0, F.lit(True)), c) for c in ["amount", *BALANCES]]
    rules.append(bad(F.coalesce(~F.translate("type", "-", "_").isin(TYPES), F.lit(True)), "type"))
    return F.array_compact(F.array(*rules))


def split_requests(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, quarantined rows with their ``errors``)."""
    checked = df.withColumn("errors", request_errors())
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def fill_missing_columns(df: DataFrame) -> DataFrame:
    """Add absent scoring columns with their defaults."""
    types = {f.name: f.dataType for f in TRANSACTION.fields}
    return df.withColumns(
        {c: F.lit(v).cast(types[c]) for c, v in DEFAULTS_FOR_SCORING.items() if c not in df.columns}
    )


def since(df: DataFrame, as_of, time_column: str = "ts", *, hours: float = 0, days: float = 0,
          minutes: float = 0) -> DataFrame:
    """Rows not older than the lookback before ``as_of``; a plain comparison, so it is
    pushed to the scan."""
    seconds = int(hours * 3600 + days * 86400 + minutes * 60)
    t = F.lit(as_of).cast("timestamp")
    return df.filter((F.col(time_column) >= t - F.make_dt_interval(secs=F.lit(seconds))) & (F.col(time_column) <= t))
