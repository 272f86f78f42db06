"""Registered queries: cleaning, encoding, scaling, splitting, correlation."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from ..functions.columns import round_doubles
from ..operators import cleaning, correlation, encoding, splitting
from ..schema import COLUMNS, MEASURES
from ..session import shared_folder
from ..sources.driver_tables import transactions, transactions_dirty
from .base import dirty_sql, query, tx_sql, union_all

EXPECTED = "(CASE WHEN type = 'CASH_IN' THEN oldbalanceOrg + amount ELSE oldbalanceOrg - amount END)"
TEN = ", ".join(["tx_id", *COLUMNS])


def _q(c, p, src="tx"):
    return f"(SELECT quantile_cont({c}, {p}) FROM {src})"


# ---- types and missing values ----------------------------------------------------
@query("c02_convert_types", tx_sql("""
SELECT tx_id, CASE WHEN tx_id % 53 <> 0 THEN step END AS step, CASE WHEN tx_id % 37 <> 0 THEN amount END AS amount, isFraud FROM tx"""))
def _(spark, sf):
    k = F.col("tx_id")
    text = transactions(spark, sf).withColumns({
        "step": F.when(k % 53 == 0, "day one").otherwise(F.col("step").cast("string")),
        "amount": F.when(k % 37 == 0, "n/a").otherwise(F.col("amount").cast("string")),
        "isFraud": F.col("isFraud").cast("string"),
    })
    return cleaning.convert_types(text).select("tx_id", "step", "amount", "isFraud")


_IMPUTED = """,
filled AS (SELECT tx_id, step, coalesce(type, (SELECT type FROM dirty WHERE type IS NOT NULL GROUP BY type ORDER BY count(*) DESC, type LIMIT 1)) AS type,
  coalesce(amount, (SELECT avg(amount) FROM dirty)) AS amount, nameOrig, oldbalanceOrg, newbalanceOrig, nameDest,
  coalesce(oldbalanceDest, (SELECT avg(oldbalanceDest) FROM dirty)) AS oldbalanceDest,
  coalesce(newbalanceDest, (SELECT quantile_cont(newbalanceDest, 0.5) FROM dirty)) AS newbalanceDest, isFraud, isFlaggedFraud FROM dirty)"""


@query("c03_c04_impute_auto", dirty_sql("""
SELECT tx_id, type, round(amount, 4) AS amount, round(oldbalanceDest, 4) AS oldbalanceDest, round(newbalanceDest, 4) AS newbalanceDest FROM filled""", _IMPUTED))
def _(spark, sf):
    out = cleaning.impute(transactions_dirty(spark, sf))
    return round_doubles(out.select("tx_id", "type", "amount", "oldbalanceDest", "newbalanceDest"), 4)


@query("c03_impute_median", dirty_sql("""
SELECT tx_id, round(coalesce(amount, (SELECT quantile_cont(amount, 0.5) FROM dirty)), 4) AS amount,
  round(coalesce(oldbalanceDest, (SELECT quantile_cont(oldbalanceDest, 0.5) FROM dirty)), 4) AS oldbalanceDest FROM dirty"""))
def _(spark, sf):
    numbers = transactions_dirty(spark, sf).drop("type", "newbalanceDest")
    return round_doubles(cleaning.impute(numbers, "median").select("tx_id", "amount", "oldbalanceDest"), 4)


@query("c05_drop_mostly_missing", dirty_sql("""
SELECT tx_id, round(coalesce(amount, (SELECT avg(amount) FROM dirty)), 4) AS amount, round(oldbalanceOrg, 4) AS oldbalanceOrg,
  round(coalesce(oldbalanceDest, (SELECT avg(oldbalanceDest) FROM dirty WHERE tx_id % 5 >= 3)), 4) AS oldbalanceDest
FROM dirty WHERE tx_id % 5 >= 3"""))
def _(spark, sf):
    out = cleaning.impute(transactions_dirty(spark, sf, drop_variant=True))
    return round_doubles(out.select("tx_id", "amount", "oldbalanceOrg", "oldbalanceDest"), 4)


@query("c13_fill_with_zero", dirty_sql("""
SELECT tx_id, coalesce(amount, 0) AS amount, coalesce(oldbalanceDest, 0) AS oldbalanceDest, coalesce(newbalanceDest, 0) AS newbalanceDest FROM dirty"""))
def _(spark, sf):
    out = cleaning.fill_numbers_with_zero(transactions_dirty(spark, sf))
    return out.select("tx_id", "amount", "oldbalanceDest", "newbalanceDest")


# ---- outliers --------------------------------------------------------------------
def _outside(c, k="1.5", src="tx"):
    return (f"({c} < {_q(c, .25, src)} - {k} * ({_q(c, .75, src)} - {_q(c, .25, src)}) OR "
            f"{c} > {_q(c, .75, src)} + {k} * ({_q(c, .75, src)} - {_q(c, .25, src)}))")


@query("c06_c09_iqr_outliers", tx_sql(union_all(
    [f"SELECT '{c}' AS \"column\", count(*) FILTER ({_outside(c)}) AS outliers, round(count(*) FILTER ({_outside(c)}) * 100.0 / count(*), 6) AS pct FROM tx"
     for c in MEASURES])))
def _(spark, sf):
    return round_doubles(cleaning.outlier_counts(transactions(spark, sf)))


@query("c07_zscore_outliers", tx_sql(union_all(
    [f"SELECT '{c}' AS \"column\", count(*) FILTER (abs(({c} - m) / s) > 2) AS outliers, round(count(*) FILTER (abs(({c} - m) / s) > 2) * 100.0 / count(*), 6) AS pct "
     f"FROM tx, (SELECT avg({c}) m, stddev_samp({c}) s FROM tx)" for c in MEASURES])))
def _(spark, sf):
    return round_doubles(cleaning.outlier_counts(transactions(spark, sf), method="zscore", threshold=2.0))


@query("c08_isolation_outliers")
def _(spark, sf):
    return cleaning.outlier_counts(transactions(spark, sf), MEASURES, method="isolation")


def _clip(c, k="1.5", src="tx"):
    return (f"greatest(least({c}, {_q(c, .75, src)} + {k} * ({_q(c, .75, src)} - {_q(c, .25, src)})), "
            f"{_q(c, .25, src)} - {k} * ({_q(c, .75, src)} - {_q(c, .25, src)}))")


@query("c10_clip_outliers", tx_sql(
    "SELECT tx_id, " + ", ".join(f"round({_clip(c, '0.5')}, 6) AS {c}" for c in MEASURES) + " FROM tx"))
def _(spark, sf):
    out = cleaning.treat_outliers(transactions(spark, sf), "clip", threshold=0.5)
    return round_doubles(out.select("tx_id", *MEASURES), 6)


@query("c10_remove_outliers", tx_sql(
    "SELECT tx_id, amount FROM tx WHERE NOT (" + " OR ".join(_outside(c, "0.5") for c in MEASURES) + ")"))
def _(spark, sf):
    return cleaning.treat_outliers(transactions(spark, sf), "remove", threshold=0.5).select("tx_id", "amount")


@query("c10_log_outliers", tx_sql(
    "SELECT tx_id, " + ", ".join(
        f"round(CASE WHEN (SELECT count(*) FROM tx WHERE {_outside(c, '0.5')}) > 0 AND (SELECT min({c}) FROM tx) >= 0 "
        f"THEN ln(1 + {c}) ELSE {c} END, 6) AS {c}" for c in ("amount", "newbalanceOrig")) + " FROM tx"))
def _(spark, sf):
    out = cleaning.treat_outliers(transactions(spark, sf), "transform", ["amount", "newbalanceOrig"], threshold=0.5)
    return round_doubles(out.select("tx_id", "amount", "newbalanceOrig"))


@query("c10_cap_outliers", tx_sql(
    "SELECT tx_id, " + ", ".join(
        f"round(CASE WHEN {_outside(c, '0.5')} THEN greatest(least({c}, {_q(c, .99)}), {_q(c, .01)}) ELSE {c} END, 4) AS {c}"
        for c in MEASURES) + " FROM tx"))
def _(spark, sf):
    out = cleaning.treat_outliers(transactions(spark, sf), "cap", threshold=0.5)
    return round_doubles(out.select("tx_id", *MEASURES), 4)


@query("c11_repair_balances", tx_sql(f"""
SELECT tx_id, CASE WHEN type IN ('CASH_IN', 'CASH_OUT') AND abs({EXPECTED} - newbalanceOrig) > 0.01 THEN {EXPECTED} ELSE newbalanceOrig END AS newbalanceOrig FROM tx"""))
def _(spark, sf):
    return cleaning.repair_balances(transactions(spark, sf)).select("tx_id", "newbalanceOrig")


_CLEAN = _IMPUTED + """,
clipped AS (SELECT tx_id, step, type, nameOrig, nameDest, isFraud, isFlaggedFraud, """ + ", ".join(
    f"{_clip(c, '1.5', 'filled')} AS {c}" for c in MEASURES) + " FROM filled)"
_CLEANED_BALANCE = (f"CASE WHEN type IN ('CASH_IN', 'CASH_OUT') AND abs({EXPECTED} - newbalanceOrig) > 0.01 "
                    f"THEN {EXPECTED} ELSE newbalanceOrig END")


@query("c01_clean", dirty_sql(f"""
SELECT tx_id, step, type, round(amount, 4) AS amount, nameOrig, round(oldbalanceOrg, 4) AS oldbalanceOrg, round({_CLEANED_BALANCE}, 4) AS newbalanceOrig,
  nameDest, round(oldbalanceDest, 4) AS oldbalanceDest, round(newbalanceDest, 4) AS newbalanceDest, isFraud, isFlaggedFraud FROM clipped""", _CLEAN))
def clean_transactions(spark, sf):
    return round_doubles(cleaning.clean(transactions_dirty(spark, sf))[0], 4)


_COUNTERS = dirty_sql(f"""
SELECT (SELECT count(*) * 4 - count(amount) - count(type) - count(oldbalanceDest) - count(newbalanceDest) FROM dirty) AS missing_values_handled,
  o AS outliers_detected, o AS outliers_treated, 0::BIGINT AS data_type_conversions,
  (SELECT count(*) FROM clipped WHERE type IN ('CASH_IN', 'CASH_OUT') AND abs({EXPECTED} - newbalanceOrig) > 0.01) AS business_rule_violations
FROM (SELECT {" + ".join(f"count(*) FILTER ({_outside(c, '1.5', 'filled')})" for c in MEASURES)} AS o FROM filled)""", _CLEAN)


@query("c12_cleaning_counters", _COUNTERS)
def _(spark, sf):
    return cleaning.clean(transactions_dirty(spark, sf))[1]


@query("c12_observed_counters", _COUNTERS)
def _(spark, sf):
    found = cleaning.write_clean(transactions_dirty(spark, sf), shared_folder(spark, "clean"))
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{c} bigint" for c in found))


# ---- encoding --------------------------------------------------------------------
@query("e01_detect_types", tx_sql("""
SELECT "column", CASE WHEN d / n < 0.05 AND d < 20 THEN 'categorical' ELSE 'numerical' END AS kind FROM (""" + union_all(
    [f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS d, count(*)::DOUBLE AS n FROM tx"
     for c in ["tx_id", "step", *MEASURES, "isFlaggedFraud"]]) + """)
UNION ALL SELECT unnest(['type', 'nameOrig', 'nameDest']), 'categorical'"""))
def _(spark, sf):
    return encoding.detect_types(transactions(spark, sf), "isFraud")


@query("e02_label_encode", dirty_sql("""
SELECT tx_id, dense_rank() OVER (ORDER BY coalesce(type, 'nan')) - 1 AS type, dense_rank() OVER (ORDER BY nameOrig) - 1 AS nameOrig FROM dirty"""))
def _(spark, sf):
    tx = transactions_dirty(spark, sf).select("tx_id", "type", "nameOrig")
    return encoding.fit_encoder(tx, ["type", "nameOrig"], []).transform(tx)


@query("e03_unknown_labels", tx_sql("""
SELECT tx_id, CASE type WHEN 'CASH_OUT' THEN 1 WHEN 'DEBIT' THEN 2 WHEN 'PAYMENT' THEN 3 ELSE 0 END::BIGINT AS type FROM tx"""))
def _(spark, sf):
    tx = transactions(spark, sf).select("tx_id", "type")
    known = tx.filter("type <> 'TRANSFER'")
    return encoding.fit_encoder(known, ["type"], []).transform(tx)


@query("e04_one_hot", tx_sql("SELECT tx_id, " + ", ".join(
    f"CAST(type = '{t}' AS INTEGER)::DOUBLE AS type_{t}" for t in ("CASH_IN", "CASH_OUT", "DEBIT", "PAYMENT")) + " FROM tx"))
def _(spark, sf):
    tx = transactions(spark, sf).select("tx_id", "type")
    return encoding.fit_encoder(tx.filter("type <> 'TRANSFER'"), ["type"], [], "onehot").transform(tx)


@query("e05_standard_scale", dirty_sql("""
SELECT tx_id, round((a - avg(a) OVER ()) / stddev_pop(a) OVER (), 6) AS amount, round((b - avg(b) OVER ()) / stddev_pop(b) OVER (), 6) AS oldbalanceDest
FROM (SELECT tx_id, coalesce(amount, (SELECT quantile_cont(amount, 0.5) FROM dirty)) AS a,
  coalesce(oldbalanceDest, (SELECT quantile_cont(oldbalanceDest, 0.5) FROM dirty)) AS b FROM dirty)"""))
def _(spark, sf):
    tx = transactions_dirty(spark, sf).select("tx_id", "amount", "oldbalanceDest")
    return round_doubles(encoding.scale(tx, encoding.fit_scalers(tx, ["amount", "oldbalanceDest"])))


@query("e06_minmax_scale", tx_sql("""
SELECT tx_id, round((amount - min(amount) OVER ()) / (max(amount) OVER () - min(amount) OVER ()), 6) AS amount, 0.0::DOUBLE AS constant FROM tx"""))
def _(spark, sf):
    tx = transactions(spark, sf).select("tx_id", "amount", F.lit(7.0).alias("constant"))
    return round_doubles(encoding.scale(tx, encoding.fit_scalers(tx, ["amount", "constant"], "minmax")))


@query("e07_inverse_scale", tx_sql("SELECT tx_id, round(amount, 2) AS amount, round(oldbalanceOrg, 2) AS oldbalanceOrg FROM tx"))
def _(spark, sf):
    tx = transactions(spark, sf).select("tx_id", "amount", "oldbalanceOrg")
    both = encoding.fit_scalers(tx, ["amount"]) + encoding.fit_scalers(tx, ["oldbalanceOrg"], "minmax", feature_range=(-1.0, 1.0))
    return round_doubles(encoding.unscale(encoding.scale(tx, both), both), 2)


_TEXTS = ["type", "nameOrig", "nameDest"]


@query("e08_fit_transform", tx_sql(
    "SELECT tx_id, isFraud, " + ", ".join(f"dense_rank() OVER (ORDER BY {c}) - 1 AS {c}" for c in _TEXTS) + ", "
    + ", ".join(f"round(({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}" for c in ["step", *MEASURES]) + " FROM tx"))
def encoded_transactions(spark, sf):
    """All text columns as codes and all numbers scaled."""
    tx = transactions(spark, sf).select("tx_id", "isFraud", *_TEXTS, "step", *MEASURES)
    return round_doubles(encoding.fit_encoder(tx, _TEXTS, ["step", *MEASURES]).transform(tx))


# ---- splits ------------------------------------------------------------------------
_HASH = "substr(md5(tx_id || '|42'), 1, 13)"


@query("e09_stratified_split", tx_sql(f"""
SELECT tx_id, isFraud, row_number() OVER (PARTITION BY isFraud ORDER BY {_HASH}) <= round(0.2 * count(*) OVER (PARTITION BY isFraud)) AS is_test FROM tx"""))
def _(spark, sf):
    tx = transactions(spark, sf).select("tx_id", "isFraud")
    return splitting.stratified_split(tx, "isFraud", ["tx_id"])


@query("e10_stratified_downsample", tx_sql(f"""
SELECT tx_id, isFraud FROM (
  SELECT tx_id, isFraud, row_number() OVER (PARTITION BY isFraud ORDER BY {_HASH}) AS r, (SELECT floor(1000.0 * sum(isFraud) / count(*)) FROM tx) AS q FROM tx)
WHERE r <= CASE WHEN isFraud = 1 THEN q ELSE 1000 - q END"""))
def _(spark, sf):
    tx = transactions(spark, sf).select("tx_id", "isFraud")
    return splitting.stratified_downsample(tx, "isFraud", ["tx_id"], above=1000, size=1000)


@query("e11_uniform_sample", tx_sql(f"SELECT tx_id FROM tx ORDER BY {_HASH} LIMIT 1000"))
def _(spark, sf):
    return splitting.uniform_sample(transactions(spark, sf).select("tx_id"), ["tx_id"], size=1000)


@query("e12_training_columns", tx_sql(union_all(
    [f"SELECT '{c}' AS feature, round(avg({c}), 4) AS mean FROM tx" for c in ["tx_id", "step", *MEASURES, "isFlaggedFraud"]])))
def _(spark, sf):
    tx = transactions(spark, sf)
    cols = encoding.training_columns(tx)
    return round_doubles(tx.agg(*[F.avg(c).alias(c) for c in cols]).unpivot([], cols, "feature", "mean"), 4)


@query("t07_stratified_folds", tx_sql(f"""
SELECT tx_id, isFraud, CAST((row_number() OVER w - 1) * 5 // count(*) OVER (PARTITION BY isFraud) AS INTEGER) AS fold
FROM tx WINDOW w AS (PARTITION BY isFraud ORDER BY {_HASH})"""))
def _(spark, sf):
    tx = transactions(spark, sf).select("tx_id", "isFraud")
    return splitting.stratified_folds(tx, "isFraud", ["tx_id"])


# ---- correlation ---------------------------------------------------------------------
_PAIRS = list(combinations(["step", *MEASURES], 2))


@query("a15_pearson", dirty_sql(union_all(
    [f"SELECT '{a}' AS x, '{b}' AS y, round(corr({a}::DOUBLE, {b}::DOUBLE), 6) AS r FROM dirty" for a, b in _PAIRS])))
def _(spark, sf):
    return round_doubles(correlation.pearson(transactions_dirty(spark, sf)))


@query("a15_spearman", tx_sql(union_all(
    [f"SELECT '{a}' AS x, '{b}' AS y, round(corr(r_{a}, r_{b}), 6) AS r FROM ranks" for a, b in _PAIRS]),
    ", ranks AS (SELECT " + ", ".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE AS r_{c}" for c in ["step", *MEASURES]) + " FROM tx)"))
def _(spark, sf):
    return round_doubles(correlation.spearman(transactions(spark, sf)))


_KENDALL = ["step", *MEASURES]


@query("a15_kendall", tx_sql(union_all(
    [f"SELECT '{a}' AS x, '{b}' AS y, round(sum(sign(l.{a} - r.{a}) * sign(l.{b} - r.{b})) / sqrt(sum(abs(sign(l.{a} - r.{a}))) * sum(abs(sign(l.{b} - r.{b})))), 6) AS r "
     f"FROM tx l JOIN tx r ON l.tx_id < r.tx_id" for a, b in combinations(_KENDALL, 2)])))
def _(spark, sf):
    return round_doubles(correlation.kendall(transactions(spark, sf), _KENDALL))
