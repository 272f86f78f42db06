"""Registered queries: quality checks, profiles and fraud patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features
from ..functions.columns import report_rows, round_doubles
from ..operators import patterns, profile, quality
from ..schema import CATEGORICAL, COLUMNS, MEASURES, NUMERIC
from ..sources.driver_tables import transactions, transactions_dirty, with_duplicates
from .base import ORACLES, dirty_sql, query, tx_sql, union_all

BIG = "BIGINT"
LIST = ", ".join(COLUMNS)
TYPES_SQL = "('CASH_IN','CASH_OUT','DEBIT','PAYMENT','TRANSFER')"
EXPECTED_SQL = "(CASE WHEN type = 'CASH_IN' THEN oldbalanceOrg + amount ELSE oldbalanceOrg - amount END)"


# ---- features ------------------------------------------------------------------
FEATURES_SQL = tx_sql(f"""
SELECT tx_id, newbalanceOrig - oldbalanceOrg AS balance_change_orig,
  newbalanceDest - oldbalanceDest AS balance_change_dest,
  abs(newbalanceOrig - oldbalanceOrg) AS abs_balance_change_orig,
  abs(newbalanceDest - oldbalanceDest) AS abs_balance_change_dest,
  (newbalanceOrig - oldbalanceOrg) + (newbalanceDest - oldbalanceDest) AS total_balance_change,
  CASE WHEN oldbalanceOrg > 0 THEN amount / oldbalanceOrg ELSE 0 END AS amount_to_orig_balance_ratio,
  CASE WHEN oldbalanceDest > 0 THEN amount / oldbalanceDest ELSE 0 END AS amount_to_dest_balance_ratio,
  CASE WHEN newbalanceOrig > 0 THEN amount / newbalanceOrig ELSE 0 END AS amount_to_new_orig_balance_ratio,
  CASE WHEN newbalanceDest > 0 THEN amount / newbalanceDest ELSE 0 END AS amount_to_new_dest_balance_ratio,
  CASE WHEN oldbalanceDest > 0 THEN oldbalanceOrg / oldbalanceDest ELSE 0 END AS orig_to_dest_balance_ratio,
  CAST(nameDest LIKE 'M%' AS INTEGER) AS is_merchant_dest, CAST(nameOrig LIKE 'M%' AS INTEGER) AS is_merchant_orig,
  CAST(nameDest LIKE 'M%' AND nameOrig LIKE 'M%' AS INTEGER) AS is_merchant_to_merchant,
  CAST(nameDest LIKE 'M%' OR nameOrig LIKE 'M%' AS INTEGER) AS involves_merchant,
  CAST(step % 24 AS INTEGER) AS hour_of_day, CAST((step - 1) // 24 + 1 AS INTEGER) AS day_of_month,
  CAST(((step - 1) // 24) // 7 + 1 AS INTEGER) AS week_of_month, CAST(((step - 1) // 24) % 7 AS INTEGER) AS day_of_week,
  CAST(((step - 1) // 24) % 7 IN (0, 6) AS INTEGER) AS is_weekend,
  CAST(step % 24 BETWEEN 9 AND 17 AS INTEGER) AS is_business_hours,
  CASE WHEN step % 24 <= 6 THEN 'Night' WHEN step % 24 <= 12 THEN 'Morning' WHEN step % 24 <= 18 THEN 'Afternoon'
       ELSE 'Evening' END AS time_period,
  CAST(amount > 200000 AS INTEGER) AS is_large_transfer,
  CAST(amount > 200000 AND type = 'TRANSFER' AS INTEGER) AS is_large_transfer_type,
  CAST(newbalanceOrig = 0 AS INTEGER) AS is_zero_balance_orig, CAST(newbalanceDest = 0 AS INTEGER) AS is_zero_balance_dest,
  CAST(amount % 1000 = 0 AS INTEGER) AS is_round_amount,
  CAST(type IN ('CASH_OUT', 'TRANSFER') AS INTEGER) AS is_high_risk_type,
  CAST(abs(amount - oldbalanceOrg) < 0.01 AS INTEGER) AS amount_equals_old_balance,
  CAST(abs({EXPECTED_SQL} - newbalanceOrig) > 0.01 AS INTEGER) AS has_balance_inconsistency
FROM tx""")


@query("f01_f07_engineered_features", FEATURES_SQL)
def _(spark, sf):
    return features.engineer(transactions(spark, sf)).drop(*COLUMNS)


@query("f08_feature_catalogue_nonzero", tx_sql("""
SELECT 'time' AS category, 'is_weekend' AS feature, count(*) FILTER (((step - 1) // 24) % 7 IN (0, 6)) AS nonzero FROM tx
UNION ALL SELECT 'time', 'is_business_hours', count(*) FILTER (step % 24 BETWEEN 9 AND 17) FROM tx
UNION ALL SELECT 'merchant', 'is_merchant_dest', count(*) FILTER (nameDest LIKE 'M%') FROM tx
UNION ALL SELECT 'balance', 'is_zero_balance_orig', count(*) FILTER (newbalanceOrig = 0) FROM tx
UNION ALL SELECT 'business_rule', 'is_large_transfer', count(*) FILTER (amount > 200000) FROM tx
UNION ALL SELECT 'balance', 'amount_to_orig_balance_ratio', count(*) FILTER (oldbalanceOrg > 0) FROM tx"""))
def _(spark, sf):
    """Catalogue category of some features, with how often each is set."""
    wanted = ["is_weekend", "is_business_hours", "is_merchant_dest", "is_zero_balance_orig",
              "is_large_transfer", "amount_to_orig_balance_ratio"]
    tx = features.engineer(transactions(spark, sf))
    used = tx.agg(*[F.count_if(F.col(c) != 0).alias(c) for c in wanted]).unpivot([], wanted, "feature", "nonzero")
    return features.catalogue(tx).join(used, "feature").select("category", "feature", "nonzero")


@query("f09_scoring_features", tx_sql("""
SELECT tx_id, newbalanceOrig - oldbalanceOrg AS balance_change_orig, newbalanceDest - oldbalanceDest AS balance_change_dest,
  CASE WHEN oldbalanceOrg > 0 THEN amount / oldbalanceOrg ELSE 0 END AS amount_to_balance_ratio,
  nameDest LIKE 'M%' AS is_merchant_dest, nameOrig LIKE 'M%' AS is_merchant_orig,
  amount > 200000 AND type = 'TRANSFER' AS is_large_transfer, CAST(step % 24 AS INTEGER) AS hour_of_day,
  CAST(step // 24 AS INTEGER) AS day_index,
  CASE type WHEN 'CASH_IN' THEN 0 WHEN 'CASH_OUT' THEN 1 WHEN 'DEBIT' THEN 2 WHEN 'TRANSFER' THEN 4 ELSE 3 END AS type_encoded
FROM tx"""))
def _(spark, sf):
    return features.for_scoring(transactions(spark, sf)).drop(*COLUMNS)


@query("f10_unusual_balance_changes", tx_sql("""
SELECT tx_id, abs(o - om) > 2 * os AS unusual_balance_orig, abs(d - dm) > 2 * ds AS unusual_balance_dest
FROM chg, st WHERE abs(o - om) > 2 * os OR abs(d - dm) > 2 * ds""", """,
chg AS (SELECT tx_id, newbalanceOrig - oldbalanceOrg AS o, newbalanceDest - oldbalanceDest AS d FROM tx),
st AS (SELECT avg(o) om, stddev_samp(o) os, avg(d) dm, stddev_samp(d) ds FROM chg)"""))
def _(spark, sf):
    marked = patterns.with_unusual_changes(transactions(spark, sf))
    return marked.filter("unusual_balance_orig or unusual_balance_dest").select(
        "tx_id", "unusual_balance_orig", "unusual_balance_dest"
    )


# ---- validation ------------------------------------------------------------------
@query("p01_required_columns", dirty_sql(union_all(
    [f"SELECT '{c}' AS \"column\", 'required' AS status, count({c}) AS non_null FROM dirty"
     for c in COLUMNS if c != "isFlaggedFraud"]
    + ["SELECT 'isFlaggedFraud', 'missing', 0::BIGINT", "SELECT 'tx_id', 'extra', count(tx_id) FROM dirty"])))
def _(spark, sf):
    return quality.column_check(transactions_dirty(spark, sf).drop("isFlaggedFraud"))


@query("p02_invalid_types", tx_sql("""
SELECT CASE WHEN tx_id % 82 = 0 THEN 'WIRE' ELSE 'CHEQUE' END AS type, count(*) AS rows
FROM tx WHERE tx_id % 41 = 0 GROUP BY 1"""))
def _(spark, sf):
    k = F.col("tx_id")
    odd = F.when(k % 82 == 0, "WIRE").when(k % 41 == 0, "CHEQUE").otherwise(F.col("type"))
    return quality.invalid_types(transactions(spark, sf).withColumn("type", odd))


@query("p03_numeric_coercibility", tx_sql("""
SELECT 'amount' AS "column", 'double' AS target_type, count(*) FILTER (tx_id % 37 = 0) AS failures FROM tx
UNION ALL SELECT 'step', 'bigint', count(*) FILTER (tx_id % 53 = 0) FROM tx"""))
def _(spark, sf):
    k = F.col("tx_id")
    text = transactions(spark, sf).withColumns({
        "amount": F.when(k % 37 == 0, "n/a").otherwise(F.col("amount").cast("string")),
        "step": F.when(k % 53 == 0, "day one").when(k % 59 != 0, F.col("step").cast("string")),
    })
    return quality.coercibility(text, {"amount": "double", "step": "bigint"})


def _null_rows(select):
    return union_all([select.format(c=c) for c in COLUMNS])


@query("p04_quality_report", dirty_sql(f"""
SELECT 'row_count' AS "check", '' AS "column", count(*)::DOUBLE AS value FROM dirty
UNION ALL SELECT 'is_empty', '', 0
UNION ALL SELECT 'min_value', 'step', min(step) FROM dirty UNION ALL SELECT 'max_value', 'step', max(step) FROM dirty
UNION ALL SELECT 'out_of_range', 'step', 0 UNION ALL SELECT 'negative', 'amount', count(*) FILTER (amount < 0) FROM dirty
UNION ALL SELECT 'fraud_count', 'isFraud', sum(isFraud) FROM dirty
UNION ALL SELECT 'fraud_rate_pct', 'isFraud', round(sum(isFraud) * 100.0 / count(*), 6) FROM dirty
UNION ALL {_null_rows("SELECT 'null_count', '{c}', count(*) - count({c}) FROM dirty")}
UNION ALL {_null_rows("SELECT 'null_pct', '{c}', round((count(*) - count({c})) * 100.0 / count(*), 6) FROM dirty")}"""))
def _(spark, sf):
    return round_doubles(quality.quality_report(transactions_dirty(spark, sf)))


@query("p05_p07_consistency_report", tx_sql(f"""
SELECT 'duplicate_rows' AS "check", 'issue' AS level, count(*) FILTER (tx_id % 500 = 0) AS rows FROM tx
UNION ALL SELECT 'invalid_types', 'issue', count(*) FILTER (type NOT IN {TYPES_SQL}) FROM twice
UNION ALL SELECT 'balance_inconsistencies', 'issue', count(*) FILTER (type IN ('CASH_IN', 'CASH_OUT') AND abs({EXPECTED_SQL} - newbalanceOrig) > 0.01) FROM twice
UNION ALL SELECT 'negative_amounts', 'warning', count(*) FILTER (amount < 0) FROM twice
UNION ALL SELECT 'invalid_steps', 'issue', count(*) FILTER (step < 1 OR step > 744) FROM twice
UNION ALL SELECT 'flagged_not_fraud', 'warning', count(*) FILTER (isFlaggedFraud = 1 AND isFraud = 0) FROM twice""",
    ", twice AS (SELECT * FROM tx UNION ALL SELECT * FROM tx WHERE tx_id % 500 = 0)"))
def _(spark, sf):
    return quality.consistency_report(with_duplicates(spark, sf))


@query("p08_final_check", dirty_sql(union_all(
    [f"SELECT '{c}' AS \"column\", '{t}' AS expected_type, true AS type_ok, count(*) - count({c}) AS nulls FROM dirty"
     for c, t in [("step", "bigint"), ("type", "string"), ("amount", "double"), ("nameOrig", "string"),
                  ("oldbalanceOrg", "double"), ("newbalanceOrig", "double"), ("nameDest", "string"),
                  ("oldbalanceDest", "double"), ("newbalanceDest", "double"), ("isFraud", "int"),
                  ("isFlaggedFraud", "int")]])))
def _(spark, sf):
    return quality.final_check(transactions_dirty(spark, sf))


_FENCE = ("SELECT 'outliers', '{c}', count(*) FILTER (x.{c} < q1 - 1.5 * (q3 - q1) OR x.{c} > q3 + 1.5 * (q3 - q1)) "
          "FROM twice x, (SELECT quantile_cont({c}, 0.25) q1, quantile_cont({c}, 0.75) q3 FROM twice)")


@query("p09_quality_issues", tx_sql(
    union_all([f"SELECT 'empty_strings' AS issue, '{c}' AS \"column\", count(*) FILTER ({c} = '') AS rows FROM twice"
               for c in CATEGORICAL] + [_FENCE.format(c=c) for c in NUMERIC])
    + """ UNION ALL SELECT 'balance_mismatch', 'newbalanceOrig', count(*) FILTER (abs(newbalanceOrig - (oldbalanceOrg - amount)) > 0.01) FROM twice
UNION ALL SELECT 'duplicate_rows', '', count(*) FILTER (tx_id % 500 = 0) FROM tx""",
    ", twice AS (SELECT * FROM tx UNION ALL SELECT * FROM tx WHERE tx_id % 500 = 0)"))
def _(spark, sf):
    return quality.quality_issues(with_duplicates(spark, sf))


@query("p10_row_masks", tx_sql("""
SELECT 'fraud' AS mask, count(*) AS rows, sum(isFraud)::BIGINT AS fraud FROM tx WHERE isFraud = 1
UNION ALL SELECT 'legitimate', count(*), sum(isFraud)::BIGINT FROM tx WHERE isFraud = 0
UNION ALL SELECT 'large', count(*), sum(isFraud)::BIGINT FROM tx WHERE amount > 200000
UNION ALL SELECT 'above_p95', count(*), sum(isFraud)::BIGINT FROM tx, (SELECT quantile_cont(amount, 0.95) q FROM tx) WHERE amount >= q
UNION ALL SELECT 'zero_origin', count(*), sum(isFraud)::BIGINT FROM tx WHERE oldbalanceOrg = 0
UNION ALL SELECT 'depleted', count(*), sum(isFraud)::BIGINT FROM tx WHERE oldbalanceOrg > 0 AND newbalanceOrig = 0
UNION ALL SELECT 'to_merchant', count(*), sum(isFraud)::BIGINT FROM tx WHERE nameDest LIKE 'M%'"""))
def _(spark, sf):
    tx = transactions(spark, sf)
    p95 = patterns.amount_thresholds(tx)[95]
    masks = {
        "fraud": F.col("isFraud") == 1, "legitimate": F.col("isFraud") == 0, "large": F.col("amount") > 200000,
        "above_p95": F.col("amount") >= p95, "zero_origin": F.col("oldbalanceOrg") == 0,
        "depleted": (F.col("oldbalanceOrg") > 0) & (F.col("newbalanceOrig") == 0),
        "to_merchant": features.is_merchant("nameDest"),
    }
    stats = tx.agg(*[a for n, m in masks.items() for a in (
        F.count_if(m).alias(f"n_{n}"), F.sum(F.when(m, F.col("isFraud"))).alias(f"f_{n}"))])
    return report_rows(stats, [(F.lit(n), F.col(f"n_{n}"), F.col(f"f_{n}")) for n in masks], ["mask", "rows", "fraud"])


@query("p12_request_validation", tx_sql("""
SELECT error, count(*) AS rows FROM (
  SELECT unnest([CASE WHEN tx_id % 29 = 0 THEN 'amount' END, CASE WHEN tx_id % 41 = 0 THEN 'type' END,
    CASE WHEN tx_id % 31 = 0 AND oldbalanceDest > 0 THEN 'oldbalanceDest' END]) AS error FROM tx)
WHERE error IS NOT NULL GROUP BY error UNION ALL
SELECT '(accepted)', count(*) FROM tx WHERE tx_id % 29 <> 0 AND tx_id % 41 <> 0 AND NOT (tx_id % 31 = 0 AND oldbalanceDest > 0)"""))
def _(spark, sf):
    k = F.col("tx_id")
    requests = transactions(spark, sf).withColumns({
        "amount": F.when(k % 29 == 0, -F.col("amount")).otherwise(F.col("amount")),
        "type": F.when(k % 41 == 0, "WIRE").otherwise(F.translate("type", "_", "-")),
        "oldbalanceDest": F.when(k % 31 == 0, -F.col("oldbalanceDest")).otherwise(F.col("oldbalanceDest")),
    })
    good, bad = quality.split_requests(requests)
    errors = bad.select(F.explode("errors").alias("error")).groupBy("error").agg(F.count("*").alias("rows"))
    return errors.unionByName(good.agg(F.count("*").alias("rows")).select(F.lit("(accepted)").alias("error"), "rows"))


@query("p13_default_columns", tx_sql("""
SELECT tx_id, 0::BIGINT AS step, type, amount, 'C000000000' AS nameDest FROM tx"""))
def _(spark, sf):
    partial = transactions(spark, sf).drop("step", "nameDest")
    return quality.fill_missing_columns(partial).select("tx_id", "step", "type", "amount", "nameDest")


# ---- profile ------------------------------------------------------------------
def _describe_sql(c, src="tx", keys="", group=""):
    return (f"SELECT {keys}'{c}' AS \"column\", count({c}) AS count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, "
            f"min({c})::DOUBLE AS min, round(quantile_cont({c}, 0.25)::DOUBLE, 4) AS p25, round(quantile_cont({c}, 0.5)::DOUBLE, 4) AS p50, "
            f"round(quantile_cont({c}, 0.75)::DOUBLE, 4) AS p75, max({c})::DOUBLE AS max FROM {src}{group}")


@query("a01_numeric_describe", dirty_sql(union_all([_describe_sql(c, "dirty") for c in NUMERIC])))
def _(spark, sf):
    return round_doubles(profile.describe(transactions_dirty(spark, sf)), 4).select(
        "column", "count", "mean", "std", "min", "p25", "p50", "p75", "max")


@query("a02_categorical_summary", dirty_sql(union_all([
    f"SELECT '{c}' AS \"column\", (SELECT count(DISTINCT {c}) FROM dirty) AS distinct_values, {c} AS most_frequent, n AS most_frequent_rows "
    f"FROM (SELECT {c}, count(*) n FROM dirty WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, {c} LIMIT 1)" for c in CATEGORICAL])))
def _(spark, sf):
    return profile.categorical_summary(transactions_dirty(spark, sf))


@query("a02_top_values", dirty_sql("""
SELECT "column", value, rows, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY rows DESC, value) AS rank FROM (
    SELECT 'type' AS "column", type AS value, count(*) AS rows FROM dirty WHERE type IS NOT NULL GROUP BY type
    UNION ALL SELECT 'nameOrig', nameOrig, count(*) FROM dirty GROUP BY nameOrig
    UNION ALL SELECT 'nameDest', nameDest, count(*) FROM dirty GROUP BY nameDest)) WHERE rank <= 10"""))
def _(spark, sf):
    return profile.top_values(transactions_dirty(spark, sf))


@query("a03_type_distribution", dirty_sql("""
SELECT type, rows, round(rows * 100.0 / sum(rows) OVER (), 6) AS pct, count(*) OVER () AS unique_types,
  row_number() OVER (ORDER BY rows DESC, type) = 1 AS is_most_common,
  row_number() OVER (ORDER BY rows, type) = 1 AS is_least_common
FROM (SELECT type, count(*) AS rows FROM dirty WHERE type IS NOT NULL GROUP BY type)"""))
def _(spark, sf):
    return round_doubles(profile.type_distribution(transactions_dirty(spark, sf)))


@query("a04_amount_by_type", tx_sql("""
SELECT type, count(amount) AS count, round(avg(amount), 2) AS mean, round(median(amount), 2) AS median,
  round(stddev_samp(amount), 2) AS std, round(min(amount), 2) AS min, round(max(amount), 2) AS max,
  round(sum(amount), 2) AS sum FROM tx GROUP BY type"""))
def _(spark, sf):
    return profile.amount_by_type(transactions(spark, sf))


@query("a05_fraud_by_type", tx_sql("""
SELECT type, count(*) AS total_count, sum(isFraud)::BIGINT AS fraud_count, round(avg(isFraud), 6) AS fraud_rate,
  round(avg(isFraud) * 100, 6) AS fraud_rate_pct FROM tx GROUP BY type"""))
def _(spark, sf):
    return round_doubles(profile.fraud_by(transactions(spark, sf), "type"))


@query("a06_amount_distribution", tx_sql("""
SELECT 'zero_amounts' AS metric, count(*) FILTER (amount = 0)::DOUBLE AS value FROM tx
UNION ALL SELECT 'negative_amounts', count(*) FILTER (amount < 0) FROM tx
UNION ALL SELECT 'large_transactions', count(*) FILTER (amount > 200000) FROM tx
UNION ALL SELECT 'p90', round(quantile_cont(amount, 0.9), 4) FROM tx UNION ALL SELECT 'p95', round(quantile_cont(amount, 0.95), 4) FROM tx
UNION ALL SELECT 'p99', round(quantile_cont(amount, 0.99), 4) FROM tx UNION ALL SELECT 'p99.9', round(quantile_cont(amount, 0.999), 4) FROM tx"""))
def _(spark, sf):
    return round_doubles(profile.amount_distribution(transactions(spark, sf)), 4)


@query("a06_amount_by_label", tx_sql(_describe_sql("amount", "tx", "isFraud, ", " GROUP BY isFraud")))
def _(spark, sf):
    return round_doubles(profile.describe(transactions(spark, sf), ["amount"], "isFraud"), 4)


@query("a07_fraud_ratio", tx_sql("""
SELECT n AS total_transactions, f AS fraud_transactions, n - f AS legitimate_transactions, round(f * 100.0 / n, 6) AS fraud_rate_pct,
  round((n - f)::DOUBLE / f, 6) AS class_imbalance_ratio FROM (SELECT count(*) n, sum(isFraud)::BIGINT f FROM tx)"""))
def _(spark, sf):
    return round_doubles(profile.fraud_ratio(transactions(spark, sf)))


_DAYS = ", days AS (SELECT step // 24 + 1 AS d, count(*) n, sum(isFraud)::BIGINT f, avg(isFraud) r FROM tx GROUP BY 1)"


@query("a08_fraud_by_day", tx_sql(
    "SELECT d AS day_1based, n AS total_count, f AS fraud_count, round(r, 6) AS fraud_rate, round(r * 100, 6) AS fraud_rate_pct FROM days", _DAYS))
def _(spark, sf):
    return round_doubles(profile.fraud_by_day(transactions(spark, sf)))


@query("a08_daily_extremes", tx_sql("""
SELECT count(*) AS days, round(avg(f), 6) AS mean_fraud, round(stddev_samp(f), 6) AS std_fraud, min(f) AS min_fraud, max(f) AS max_fraud,
  round(avg(r * 100), 6) AS mean_rate_pct, (SELECT d FROM days ORDER BY f DESC, d LIMIT 1) AS highest_fraud_day,
  (SELECT d FROM days ORDER BY f, d LIMIT 1) AS lowest_fraud_day FROM days""", _DAYS))
def _(spark, sf):
    return round_doubles(profile.daily_extremes(transactions(spark, sf)))


@query("a09_flag_crosstab_cube", tx_sql("""
SELECT coalesce(CAST(isFlaggedFraud AS VARCHAR), 'All') AS flagged, coalesce(CAST(isFraud AS VARCHAR), 'All') AS fraud, count(*) AS rows
FROM tx GROUP BY CUBE (isFlaggedFraud, isFraud)"""))
def _(spark, sf):
    return profile.flag_crosstab(transactions(spark, sf))


@query("a09_flag_quality", tx_sql("""
SELECT tp AS true_positives, fp AS false_positives, fn AS false_negatives, tn AS true_negatives,
  round(tp::DOUBLE / (tp + fp), 6) AS precision, round(tp::DOUBLE / (tp + fn), 6) AS recall FROM (
  SELECT count(*) FILTER (isFlaggedFraud = 1 AND isFraud = 1) tp, count(*) FILTER (isFlaggedFraud = 1 AND isFraud = 0) fp,
    count(*) FILTER (isFlaggedFraud = 0 AND isFraud = 1) fn, count(*) FILTER (isFlaggedFraud = 0 AND isFraud = 0) tn FROM tx)"""))
def _(spark, sf):
    return round_doubles(profile.flag_quality(transactions(spark, sf)))


_ANY = " OR ".join(f"{c} IS NULL" for c in COLUMNS)


@query("a10_missing_values", dirty_sql(union_all(
    [f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, round((count(*) - count({c})) * 100.0 / count(*), 6) AS pct FROM dirty"
     for c in COLUMNS]
    + [f"SELECT '(rows with missing)', count(*) FILTER ({_ANY}), round(count(*) FILTER ({_ANY}) * 100.0 / count(*), 6) FROM dirty",
       f"SELECT '(complete rows)', count(*) FILTER (NOT ({_ANY})), round(count(*) FILTER (NOT ({_ANY})) * 100.0 / count(*), 6) FROM dirty"])))
def _(spark, sf):
    return round_doubles(profile.missing_values(transactions_dirty(spark, sf)))


@query("a10_missing_patterns", dirty_sql(f"""
SELECT concat_ws(',', {", ".join(f"CASE WHEN {c} IS NULL THEN '{c}' END" for c in COLUMNS)}) AS missing_columns, count(*) AS rows
FROM dirty GROUP BY 1 ORDER BY rows DESC, missing_columns LIMIT 10"""))
def _(spark, sf):
    return profile.missing_patterns(transactions_dirty(spark, sf))


@query("a11_quality_bundle", f"""
SELECT 'issues' AS section, concat_ws(':', issue, "column") AS name, rows AS value FROM ({ORACLES["p09_quality_issues"]})
UNION ALL SELECT 'consistency', "check", rows FROM ({ORACLES["p05_p07_consistency_report"]})
UNION ALL SELECT 'missing', unnest([{", ".join(f"'{c}'" for c in COLUMNS)}, '(rows with missing)']), 0
UNION ALL SELECT 'missing', '(complete rows)', (SELECT n FROM ({tx_sql("SELECT count(*) AS n FROM tx")}))
  + (SELECT rows FROM ({ORACLES["p05_p07_consistency_report"]}) WHERE "check" = 'duplicate_rows')""")
def _(spark, sf):
    return profile.quality_bundle(with_duplicates(spark, sf))


@query("a12_dataset_summary", tx_sql("""
SELECT count(*) AS total_transactions, min(step) AS min_step, max(step) AS max_step, count(DISTINCT step) AS unique_steps,
  count(DISTINCT type) AS unique_types, sum(isFraud)::BIGINT AS fraud_count, round(avg(isFraud) * 100, 4) AS fraud_rate_pct,
  round(avg(amount), 4) AS amount_mean, round(stddev_samp(amount), 4) AS amount_std, min(amount) AS amount_min, max(amount) AS amount_max,
  round(quantile_cont(amount, 0.25), 4) AS amount_q25, round(quantile_cont(amount, 0.5), 4) AS amount_median,
  round(quantile_cont(amount, 0.75), 4) AS amount_q75 FROM tx"""))
def _(spark, sf):
    return round_doubles(profile.dataset_summary(transactions(spark, sf)), 4)


@query("a13_counts_by_type_and_label", tx_sql("""
SELECT type, count(*) FILTER (isFraud = 0) AS legitimate, count(*) FILTER (isFraud = 1) AS fraud FROM tx GROUP BY type"""))
def _(spark, sf):
    return profile.counts_by_label(transactions(spark, sf), "type", "type")


@query("a13_counts_by_hour_and_label", tx_sql("""
SELECT step % 24 AS hour, count(*) FILTER (isFraud = 0) AS legitimate, count(*) FILTER (isFraud = 1) AS fraud FROM tx GROUP BY 1"""))
def _(spark, sf):
    return profile.counts_by_label(transactions(spark, sf), patterns.hour(), "hour")


def _hist(by, bins):
    keys = f"{by}, " if by else ""
    return f"""
SELECT {keys}bin, round(lo + bin * w, 6) AS lower, round(lo + (bin + 1) * w, 6) AS upper, rows FROM (
  SELECT {keys}CAST(least(floor((amount - lo) / w), {bins - 1}) AS INTEGER) AS bin, count(*) AS rows, min(lo) lo, min(w) w
  FROM tx, (SELECT min(amount) lo, (max(amount) - min(amount)) / {bins} w FROM tx) GROUP BY ALL)"""


@query("a14_amount_histogram", tx_sql(_hist("", 50)))
def _(spark, sf):
    return round_doubles(profile.histogram(transactions(spark, sf)))


@query("a14_amount_histogram_by_label", tx_sql(_hist("isFraud", 30)))
def _(spark, sf):
    return round_doubles(profile.histogram(transactions(spark, sf), bins=30, by="isFraud"))


@query("a16_column_profile", dirty_sql(union_all(
    [f"SELECT '{c}' AS \"column\", '{t}' AS type, count({c}) AS non_null, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values FROM dirty"
     for c, t in [("tx_id", "bigint"), ("step", "bigint"), ("type", "string"), ("amount", "double"), ("nameOrig", "string"),
                  ("oldbalanceOrg", "double"), ("newbalanceOrig", "double"), ("nameDest", "string"), ("oldbalanceDest", "double"),
                  ("newbalanceDest", "double"), ("isFraud", "int"), ("isFlaggedFraud", "int")]])))
def _(spark, sf):
    return profile.column_profile(transactions_dirty(spark, sf))


@query("a17_volume", tx_sql("""
SELECT count(DISTINCT nameOrig) AS unique_accounts, round(sum(amount), 2) AS total_volume, max(step) - min(step) AS step_span FROM tx"""))
def _(spark, sf):
    return round_doubles(profile.volume(transactions(spark, sf)), 2)


@query("a18_duplicate_rows", tx_sql("SELECT count(*) AS duplicates FROM tx WHERE tx_id % 500 = 0"))
def _(spark, sf):
    return quality.duplicate_rows(with_duplicates(spark, sf))


@query("a19_class_distribution", tx_sql("SELECT isFraud, count(*) AS rows FROM tx GROUP BY isFraud"))
def _(spark, sf):
    return profile.class_distribution(transactions(spark, sf))


_KINDS = {"tx_id": "bigint", "step": "bigint", "type": "string", "nameOrig": "string", "nameDest": "string",
          "isFraud": "int", "isFlaggedFraud": "int"}


@query("s03_dataset_info", dirty_sql("""
SELECT 'shape' AS section, 'rows' AS name, '' AS detail, count(*)::DOUBLE AS value FROM dirty UNION ALL SELECT 'shape', 'columns', '', 12
UNION ALL SELECT 'transaction_types', type, '', count(*) FROM dirty WHERE type IS NOT NULL GROUP BY type
UNION ALL SELECT 'fraud_distribution', CAST(isFraud AS VARCHAR), '', count(*) FROM dirty GROUP BY isFraud UNION ALL """
    + union_all([f"SELECT 'nulls', '{c}', '{_KINDS.get(c, 'double')}', count(*) - count({c}) FROM dirty" for c in ["tx_id", *COLUMNS]]
    + [f"SELECT 'amount_stats', '{n}', '', round({v}, 4) FROM dirty" for n, v in [
        ("count", "count(amount)"), ("mean", "avg(amount)"), ("std", "stddev_samp(amount)"), ("min", "min(amount)"), ("max", "max(amount)"),
        ("p25", "quantile_cont(amount, 0.25)"), ("p50", "quantile_cont(amount, 0.5)"), ("p75", "quantile_cont(amount, 0.75)")]])))
def _(spark, sf):
    return round_doubles(profile.dataset_info(transactions_dirty(spark, sf)), 4)


# ---- patterns ------------------------------------------------------------------
def _series(period, value, last):
    return tx_sql(f"""
SELECT CAST(s.p AS BIGINT) AS period, round(coalesce(v, 0)::DOUBLE, 4) AS value
FROM (SELECT unnest(range(0, {last} + 1)) AS p) s
LEFT JOIN (SELECT {period} AS p, {value} AS v FROM tx GROUP BY 1) t ON s.p = t.p""")


for _unit, _period, _last in [("hour", "step % 24", "23"), ("day", "step // 24", "(SELECT max(step // 24) FROM tx)"),
                              ("step", "step", "(SELECT max(step) FROM tx)")]:
    for _measure, _value in [("count", "count(*) FILTER (isFraud = 1)"), ("rate", "avg(isFraud) * 100"),
                             ("amount", "sum(amount) FILTER (isFraud = 1)")]:
        if (_unit, _measure) in {("hour", "count"), ("day", "rate"), ("day", "amount"), ("step", "count")}:
            @query(f"r01_fraud_series_{_unit}_{_measure}", _series(_period, _value, _last))
            def _(spark, sf, unit=_unit, measure=_measure):
                return round_doubles(patterns.fraud_time_series(transactions(spark, sf), unit, measure), 4)


@query("r02_fraud_trend_by_day", tx_sql("""
SELECT count(*) AS points, round(regr_slope(v, p), 6) AS slope, round(regr_intercept(v, p), 6) AS intercept FROM (
  SELECT s.p, coalesce(v, 0)::DOUBLE AS v FROM (SELECT unnest(range(0, (SELECT max(step // 24) FROM tx) + 1)) AS p) s
  LEFT JOIN (SELECT step // 24 AS p, count(*) FILTER (isFraud = 1) AS v FROM tx GROUP BY 1) t ON s.p = t.p)"""))
def _(spark, sf):
    return round_doubles(patterns.trend(patterns.fraud_time_series(transactions(spark, sf), "day")))


@query("r03_customer_behavior", tx_sql("""
SELECT round(min(om), 4) AS orig_mean, round(min(os), 4) AS orig_std, round(min(dm), 4) AS dest_mean, round(min(ds), 4) AS dest_std,
  count(*) FILTER (abs(o - om) > 2 * os) AS unusual_rows, round(avg(isFraud) FILTER (abs(o - om) > 2 * os), 4) AS unusual_balance_fraud_rate,
  round(avg(isFraud) FILTER (m), 4) AS merchant_dest_fraud_rate, round(avg(isFraud) FILTER (NOT m), 4) AS customer_dest_fraud_rate
FROM chg, (SELECT avg(o) om, stddev_samp(o) os, avg(d) dm, stddev_samp(d) ds FROM chg)""", """,
chg AS (SELECT isFraud, nameDest LIKE 'M%' AS m, newbalanceOrig - oldbalanceOrg AS o, newbalanceDest - oldbalanceDest AS d FROM tx)"""))
def _(spark, sf):
    return round_doubles(patterns.customer_behavior(transactions(spark, sf)), 4)


_STATS = "count(*) AS total_count, sum(isFraud)::BIGINT AS fraud_count, avg(isFraud) AS fraud_rate FROM tx"
_R4 = f"SELECT 'transaction_type' AS category, type AS name, {_STATS} GROUP BY type"
_R5 = f"SELECT 'large_transfers' AS category, 'Amount > 200000' AS name, {_STATS} WHERE amount > 200000"
_R5N = f"SELECT 'large_transfers' AS category, 'Amount <= 200000' AS name, {_STATS} WHERE amount <= 200000"
_R6 = union_all([
    f"SELECT 'amount_percentile' AS category, 'Amount >= {p}th percentile' AS name, {_STATS} "
    f"WHERE amount >= (SELECT quantile_cont(amount, {p / 100}) FROM tx)" for p in (50, 75, 90, 95, 99)])
_R7 = union_all([f"SELECT 'zero_balance' AS category, 'Zero {c}' AS name, {_STATS} WHERE {c} = 0" for c in MEASURES[1:]])
_R8 = f"SELECT 'balance_depletion' AS category, 'Complete balance depletion' AS name, {_STATS} WHERE oldbalanceOrg > 0 AND newbalanceOrig = 0"
_R9 = (f"SELECT 'account_pattern' AS category, (CASE WHEN nameOrig LIKE 'M%' THEN 'Merchant' ELSE 'Customer' END) || ' To ' || "
       f"(CASE WHEN nameDest LIKE 'M%' THEN 'Merchant' ELSE 'Customer' END) AS name, {_STATS} GROUP BY 2")


def _r10(n):
    return (f"SELECT 'hourly_pattern' AS category, 'Hour ' || h AS name, total_count, fraud_count, fraud_rate FROM "
            f"(SELECT step % 24 AS h, {_STATS} GROUP BY 1 ORDER BY fraud_rate DESC, h LIMIT {n})")


def _factors(body):
    return tx_sql(f"SELECT category, name, total_count, fraud_count, round(fraud_rate, 6) AS fraud_rate FROM ({body})")


for _name, _fn, _sql in [
    ("r04_type_risk", patterns.type_risk, _R4),
    ("r05_large_transfer_risk", patterns.large_transfer_risk, f"{_R5} UNION ALL {_R5N}"),
    ("r06_amount_percentile_risk", patterns.percentile_risk, _R6),
    ("r07_zero_balance_risk", patterns.zero_balance_risk, _R7),
    ("r08_balance_depletion_risk", patterns.depletion_risk, _R8),
    ("r09_account_pattern_risk", patterns.account_risk, _R9),
    ("r10_hourly_risk", patterns.hourly_risk, _r10(5)),
]:
    @query(_name, _factors(_sql))
    def _(spark, sf, fn=_fn):
        return round_doubles(fn(transactions(spark, sf)))

_PLACE = ("list_position(['transaction_type','large_transfers','amount_percentile','zero_balance','balance_depletion',"
          "'account_pattern','hourly_pattern'], category)")


def _all_factors(hours):
    return union_all([_R4, _R5, _R6, _R7, _R8, _R9, _r10(hours)])


@query("r11_ranked_risk_factors", tx_sql(f"""
SELECT category, name, total_count, fraud_count, round(fraud_rate, 6) AS fraud_rate FROM ({_all_factors(5)})
ORDER BY fraud_rate DESC, {_PLACE}, name LIMIT 15"""))
def ranked_risk_factors(spark, sf):
    return round_doubles(patterns.rank_risk_factors(transactions(spark, sf)))


@query("r12_risk_category_summary", tx_sql(f"""
SELECT category, factors, round(m, 6) AS max_fraud_rate, round(a, 6) AS avg_fraud_rate,
  row_number() OVER (ORDER BY m DESC, {_PLACE}) = 1 AS is_highest
FROM (SELECT category, count(*) AS factors, max(fraud_rate) m, avg(fraud_rate) a FROM ({_all_factors(15)}) GROUP BY category)"""))
def _(spark, sf):
    return round_doubles(patterns.risk_summary(transactions(spark, sf)))


@query("r13_pattern_analysis_bundle", f"""
SELECT 'ranked_factors' AS section, name, round(fraud_rate, 4) AS value FROM ({ORACLES["r11_ranked_risk_factors"]})
UNION ALL SELECT 'category_summary', category, round(avg_fraud_rate, 4) FROM ({ORACLES["r12_risk_category_summary"]})
UNION ALL SELECT 'fraud_by_hour', CAST(period AS VARCHAR), value FROM ({ORACLES["r01_fraud_series_hour_count"]})
UNION ALL SELECT 'fraud_by_day', CAST(period AS VARCHAR), value FROM ({tx_sql('''
SELECT s.p AS period, coalesce(v, 0)::DOUBLE AS value FROM (SELECT unnest(range(0, (SELECT max(step // 24) FROM tx) + 1)) AS p) s
LEFT JOIN (SELECT step // 24 AS p, count(*) FILTER (isFraud = 1) AS v FROM tx GROUP BY 1) t ON s.p = t.p''')})
UNION ALL SELECT 'behavior', name, value FROM (UNPIVOT (SELECT unusual_balance_fraud_rate, merchant_dest_fraud_rate, customer_dest_fraud_rate
  FROM ({ORACLES["r03_customer_behavior"]})) ON COLUMNS(*) INTO NAME name VALUE value)""")
def _(spark, sf):
    """The parts' rates to six and then four digits, as their counterparts report them."""
    return round_doubles(round_doubles(patterns.pattern_bundle(transactions(spark, sf))), 4)
