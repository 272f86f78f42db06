"""Cleaning: coerce, impute, treat outliers, repair balances.

Fitting gathers a few numbers per column in bounded aggregates; the transform is
a projection (plus a filter where rows are dropped) without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import coerced, report_rows
from ..functions.features import expected_origin_balance, off_balance
from ..schema import COLUMNS, LABELS, TRANSACTION
from .isolation import isolation_scores
from .profile import categorical_summary
from .quality import iqr_fences
from .quantiles import quantiles

STRATEGIES = ("auto", "mean", "median", "mode", "knn", "drop")
TREATMENTS = ("clip", "remove", "transform", "cap")
REPAIRED_TYPES = ("CASH_IN", "CASH_OUT")


def _is_number(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, T.NumericType)


def numbers(df: DataFrame) -> list[str]:
    return [c for c in COLUMNS if c in df.columns and _is_number(df, c)]


def outlier_columns(df: DataFrame) -> list[str]:
    """Numeric columns whose values may be changed: neither labels nor the time index."""
    return [c for c in numbers(df) if c not in LABELS and c != "step"]


# ---- types -------------------------------------------------------------------
def convert_types(df: DataFrame, types: Mapping[str, str] | None = None) -> DataFrame:
    """Cast to the given (default: expected) types; what does not fit becomes null."""
    types = types or {f.name: f.dataType.simpleString() for f in TRANSACTION.fields}
    return df.withColumns(
        {c: coerced(c, t) for c, t in types.items() if c in df.columns and dict(df.dtypes)[c] != t}
    )


def fill_numbers_with_zero(df: DataFrame) -> DataFrame:
    """Null and non-numeric entries of the numeric columns to 0."""
    types = {f.name: f.dataType for f in TRANSACTION.fields}
    return df.withColumns(
        {
            c: F.coalesce(coerced(c, types[c].simpleString()), F.lit(0).cast(types[c]))
            for c in COLUMNS if c in df.columns and isinstance(types[c], T.NumericType)
        }
    )


# ---- missing values ----------------------------------------------------------
@dataclass
class Imputation:
    """Fitted steps in column order: (column, strategy, fill value or None)."""

    steps: list[tuple] = field(default_factory=list)
    handled: int = 0
    rows: int | None = None  # rows left after the fit

    def transform(self, df: DataFrame) -> DataFrame:
        for c, strategy, value in self.steps:
            if strategy == "drop":
                df = df.filter(F.col(c).isNotNull())
            elif value is not None:
                x = F.col(c).cast("double") if isinstance(value, float) else F.col(c)
                df = df.withColumn(c, F.coalesce(x, F.lit(value)))
        return df

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [
            (i, c, s, v if isinstance(v, float) else None, v if isinstance(v, str) else None)
            for i, (c, s, v) in enumerate(self.steps)
        ]
        layout = "position int, column string, strategy string, number double, text string"
        spark.createDataFrame(rows, layout).coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Imputation:
        rows = spark.read.parquet(path).orderBy("position").collect()
        return Imputation([(r.column, r.strategy, r.number if r.text is None else r.text) for r in rows])


def choose_strategy(is_number: bool, missing_pct: float) -> str:
    """Automatic choice by share of missing rows and kind of column."""
    if missing_pct > 50:
        return "drop"
    if not is_number:
        return "mode"
    return "mean" if missing_pct < 5 else "median" if missing_pct < 20 else "knn"


def _survey(df: DataFrame, cols: list[str]) -> tuple[int, dict[str, int], dict[str, float]]:
    """Rows, nulls per column and means of the numbers from one aggregate."""
    nums = [c for c in cols if _is_number(df, c)]
    r = df.agg(
        F.count("*").alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols],
        *[F.avg(c).alias(f"mean_{c}") for c in nums],
    ).first()
    return r["_n"], {c: r[c] for c in cols}, {c: r[f"mean_{c}"] for c in nums}


def _fill_values(df: DataFrame, plan: list[tuple[str, str]], n: int, mean: dict[str, float]) -> dict[str, object]:
    """Fill values of one stretch of columns. A nearest-neighbour fill on one column has
    no distances to go by and equals the mean, or the mode for text."""
    medians, modes = [], []
    out: dict[str, object] = {}
    for c, s in plan:
        if s == "mode" or (s == "knn" and not _is_number(df, c)):
            modes.append(c)
        elif s in ("mean", "knn"):
            out[c] = mean[c]
        elif s == "median":
            medians.append(c)
    if medians:
        found = quantiles(df, medians, [0.5])
        out.update({c: found[(None, c)][0] for c in medians})
    if modes:
        for r in categorical_summary(df, modes).collect():
            v = r["most_frequent"]
            out[r["column"]] = float(v) if _is_number(df, r["column"]) else v
    return out


def fit_imputation(df: DataFrame, strategy: str = "auto") -> Imputation:
    """Fit in column order. Dropping rows changes the shares of later columns, so the
    counts are taken again after a drop, and only then."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    todo = [c for c in COLUMNS if c in df.columns]
    fitted = Imputation()
    while todo:
        n, nulls, mean = _survey(df, todo)
        fitted.rows = n
        plan, dropped = [], None
        for i, c in enumerate(todo):
            if not nulls[c]:
                continue
            s = choose_strategy(_is_number(df, c), nulls[c] * 100.0 / n) if strategy == "auto" else strategy
            fitted.handled += nulls[c]
            plan.append((c, s))
            if s == "drop":
                dropped = i
                break
        fills = _fill_values(df, [p for p in plan if p[1] != "drop"], n, mean)
        fitted.steps += [(c, s, fills.get(c)) for c, s in plan]
        if dropped is None:
            break
        df = df.filter(F.col(todo[dropped]).isNotNull())
        todo = todo[dropped + 1:]
    return fitted


def impute(df: DataFrame, strategy: str = "auto", fitted: Imputation | None = None) -> DataFrame:
    return (fitted or fit_imputation(df, strategy)).transform(df)


# ---- outliers ----------------------------------------------------------------
def outlier_masks(df: DataFrame, columns: list[str] | None = None, method: str = "iqr",
                  threshold: float = 1.5, fences: dict[str, tuple] | None = None) -> dict[str, Column]:
    """A mask per column (null values are no outliers). ``fences`` saves fitting them again."""
    columns = outlier_columns(df) if columns is None else [c for c in columns if c in df.columns]
    if method == "iqr":
        fences = iqr_fences(df, columns, threshold) if fences is None else fences
        return {c: (F.col(c) < lo) | (F.col(c) > hi) for c, (lo, hi) in fences.items()}
    if method == "zscore":
        r = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in columns]).first()
        return {c: F.abs(F.col(c) - r[c]["m"]) / r[c]["s"] > threshold for c in columns if r[c]["s"]}
    if method == "isolation":
        return {c: isolation_scores(df, c).is_outlier for c in columns}
    raise ValueError(f"unknown outlier method {method}")


def outlier_counts(df: DataFrame, columns: list[str] | None = None, method: str = "iqr",
                   threshold: float = 1.5) -> DataFrame:
    """(column, outliers, pct) from one aggregate over all masks."""
    masks = outlier_masks(df, columns, method, threshold)
    stats = df.agg(F.count("*").alias("_n"), *[F.count_if(m).alias(c) for c, m in masks.items()])
    n = F.col("_n")
    return report_rows(
        stats, [(F.lit(c), F.col(c), F.when(n > 0, F.col(c) * 100.0 / n).otherwise(0.0)) for c in masks],
        ["column", "outliers", "pct"],
    )


def clip_to(df: DataFrame, fences: dict[str, tuple]) -> DataFrame:
    """Values moved to the nearer fence; null stays null."""
    return df.withColumns(
        {c: F.when(F.col(c).isNotNull(), F.greatest(F.least(F.col(c), F.lit(hi)), F.lit(lo)))
         for c, (lo, hi) in fences.items()}
    )


def treat_outliers(df: DataFrame, treatment: str = "clip", columns: list[str] | None = None,
                   method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """Clip to the IQR fences, remove rows, log-transform non-negative columns, or cap the
    outliers at the 1% and 99% quantiles. Columns without outliers stay as they are."""
    if treatment not in TREATMENTS:
        raise ValueError(f"unknown treatment {treatment}")
    columns = outlier_columns(df) if columns is None else [c for c in columns if c in df.columns]
    if treatment == "clip" and method == "iqr":  # the identity where nothing is outside
        return clip_to(df, iqr_fences(df, columns, threshold))
    masks = outlier_masks(df, columns, method, threshold)
    if not masks:
        return df
    r = df.agg(*[F.struct(F.count_if(m).alias("n"), F.min(c).alias("lo")).alias(c) for c, m in masks.items()]).first()
    hit = [c for c in masks if r[c]["n"]]
    if not hit:
        return df
    if treatment == "clip":
        return clip_to(df, iqr_fences(df, hit, threshold))
    if treatment == "remove":
        bad = F.lit(False)
        for c in hit:
            bad = bad | F.coalesce(masks[c], F.lit(False))
        return df.filter(~bad)
    if treatment == "transform":
        return df.withColumns({c: F.log1p(c) for c in hit if r[c]["lo"] >= 0})
    caps = quantiles(df, hit, [0.01, 0.99])
    return df.withColumns(
        {
            c: F.when(masks[c], F.greatest(F.least(F.col(c), F.lit(caps[(None, c)][1])), F.lit(caps[(None, c)][0])))
            .otherwise(F.col(c)) for c in hit
        }
    )


# ---- balances ------------------------------------------------------------------
def repair_balances(df: DataFrame) -> DataFrame:
    """Set the origin balance of inconsistent CASH_IN and CASH_OUT rows to the expected one."""
    return df.withColumn(
        "newbalanceOrig",
        F.when(off_balance(*REPAIRED_TYPES), expected_origin_balance()).otherwise(F.col("newbalanceOrig")),
    )


# ---- whole cleaning ------------------------------------------------------------
@dataclass
class _Steps:
    """The filled rows with a mark for each outlier, what becomes of them, and the numbers known from fitting."""

    marked: DataFrame
    counted: dict[str, Column]
    finish: Callable[[DataFrame], DataFrame]
    handled: int
    converted: int

    def counters(self, outliers, violations) -> dict:
        """Names and values of the counters; the two given may be columns or numbers."""
        return {"missing_values_handled": int(self.handled), "outliers_detected": outliers, "outliers_treated": outliers,
                "data_type_conversions": self.converted, "business_rule_violations": violations}


def _steps(df: DataFrame, strategy: str, method: str, threshold: float, fix_balances: bool, imputation: Imputation | None,
           outlier_on: list[str] | None) -> _Steps:
    changed = sum(1 for f in TRANSACTION.fields
                  if f.name in df.columns and df.schema[f.name].dataType != f.dataType)
    typed = convert_types(df)
    imputation = imputation or fit_imputation(typed, strategy)
    filled = imputation.transform(typed)
    columns = outlier_columns(filled) if outlier_on is None else outlier_on
    fences = iqr_fences(filled, columns, threshold)
    masks = outlier_masks(filled, columns, method, threshold, fences)
    marks = F.lit(0).cast("bigint")
    for m in masks.values():
        marks = marks + F.coalesce(m, F.lit(False)).cast("bigint")
    marked = filled.withColumn("_outliers", marks)
    if method == "iqr":
        treated = clip_to(marked, fences)
    else:
        treated = treat_outliers(marked, "clip", columns, method, threshold)
    broken = off_balance(*REPAIRED_TYPES).cast("bigint") if fix_balances else F.lit(0).cast("bigint")
    counted = {"outliers": F.coalesce(F.sum("_outliers"), F.lit(0)).cast("bigint"), "violations": F.coalesce(F.sum(broken), F.lit(0)).cast("bigint")}

    def finish(rows: DataFrame) -> DataFrame:
        return (repair_balances(rows) if fix_balances else rows).drop("_outliers")

    return _Steps(treated, counted, finish, imputation.handled, changed)


def clean(df: DataFrame, strategy: str = "auto", method: str = "iqr", threshold: float = 1.5,
          fix_balances: bool = True, imputation: Imputation | None = None,
          outlier_on: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(clean rows, counters). Give ``imputation`` to reuse fitted fills. The counters are one aggregate of their own;
    ``write_clean`` takes them while it writes."""
    steps = _steps(df, strategy, method, threshold, fix_balances, imputation, outlier_on)
    seen = steps.marked.agg(*[c.alias(n) for n, c in steps.counted.items()])
    named = steps.counters(F.col("outliers"), F.col("violations"))
    return steps.finish(steps.marked), seen.select(*[(v if isinstance(v, Column) else F.lit(v).cast("bigint")).alias(n) for n, v in named.items()])


def write_clean(df: DataFrame, path: str, strategy: str = "auto", method: str = "iqr", threshold: float = 1.5,
                fix_balances: bool = True, imputation: Imputation | None = None,
                outlier_on: list[str] | None = None, mode: str = "error") -> dict[str, int]:
    """Write the clean rows to ``path`` and return the counters, observed while the rows pass by: no scan is added."""
    steps = _steps(df, strategy, method, threshold, fix_balances, imputation, outlier_on)
    seen = Observation()
    steps.finish(steps.marked.observe(seen, *[c.alias(n) for n, c in steps.counted.items()])).write.mode(mode).parquet(path)
    return steps.counters(seen.get["outliers"], seen.get["violations"])
