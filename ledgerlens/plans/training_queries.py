"""Registered queries: trained models, model runs, report tables."""

from __future__ import annotations

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import features
from ..functions.columns import round_doubles
from ..operators import evaluation, models, registry, reports
from ..session import cut_lineage, shared_folder
from ..sources.driver_tables import scored, transactions
from .base import models_sql, query, scored_sql, tx_sql, union_all
from .model_queries import BASE, BY_DAY, BY_FOLD, by_fold
from .training import MODEL_FEATURES, train_and_hold_out

def featured(spark, sf):
    return features.engineer(transactions(spark, sf))


def _trained(spark, sf, kind, **kw):
    """Trained with the default parameters of its kind, and its scored test rows."""
    return train_and_hold_out(featured(spark, sf), models.Spec(kind), ["tx_id"], **kw)


# What a trained model must satisfy whatever its weights: every query below reports such facts.
_HELD = tx_sql("SELECT isFraud, rows, rows AS cells, 0.0::DOUBLE AS auc_gap, true AS better_than_chance FROM held",
               ", held AS (SELECT isFraud, floor(0.2 * count(*) + 0.5)::BIGINT AS rows FROM tx GROUP BY isFraud)")


def _held_out_facts(spark, sf, kind, **kw):
    """Test rows and confusion cells per class, and the distance of the area under the ROC to MLlib's own."""
    test = cut_lineage(_trained(spark, sf, kind, **kw)[1].select("isFraud", "fraud_prediction", "fraud_score"), "held-out")
    auc = evaluation.metrics_by(test, [], "isFraud", "fraud_prediction", "fraud_score").first()["auc_roc"]
    library = BinaryClassificationEvaluator(rawPredictionCol="fraud_score", labelCol="isFraud", numBins=0).evaluate(test)
    cells = sum(F.col(c) for c in ("true_positives", "true_negatives", "false_positives", "false_negatives"))
    counted = evaluation.confusion_metrics(test, ["isFraud"], "isFraud", "fraud_prediction").select("isFraud", cells.alias("cells"))
    rows = test.groupBy("isFraud").agg(F.count("*").alias("rows"))
    return rows.join(counted, "isFraud").select(
        "isFraud", "rows", "cells", F.lit(round(abs(auc - library), 6)).alias("auc_gap"), F.lit(auc > 0.5).alias("better_than_chance"))


@query("t02_logistic_regression", _HELD)
def _(spark, sf):
    return _held_out_facts(spark, sf, "logistic")


@query("t03_random_forest", _HELD)
def _(spark, sf):
    return _held_out_facts(spark, sf, "forest")


@query("t03_tree_votes", tx_sql("""
SELECT isFraud, floor(0.2 * count(*) + 0.5)::BIGINT AS rows, 100 AS least_votes, 100 AS most_votes, 0.0::DOUBLE AS share_gap FROM tx GROUP BY isFraud"""))
def _(spark, sf):
    model, test = _trained(spark, sf, "forest")
    fraud = F.size(F.filter("votes", lambda v: v == 1))
    return model.tree_votes(test).groupBy("isFraud").agg(
        F.count("*").alias("rows"), F.min(F.size("votes")).alias("least_votes"), F.max(F.size("votes")).alias("most_votes"),
        F.round(F.max(F.abs(F.col("vote_share") - fraud / F.size("votes"))), 6).alias("share_gap"))


@query("t04_t05_boosting_early_stop", _HELD)
def _(spark, sf):
    return _held_out_facts(spark, sf, "boosting", early_stopping=True)


@query("t06_grid_search", tx_sql("""
SELECT 36 AS points, 1 AS chosen, 0.0::DOUBLE AS best_gap, true AS in_range, true AS finished, count(*) AS rows,
  sum(isFraud)::BIGINT AS frauds FROM tx"""))
def _(spark, sf):
    """The whole default grid: 36 points on five folds."""
    model, found = models.grid_search(models.Spec("logistic"), featured(spark, sf), MODEL_FEATURES)
    best, meta = F.max(F.when(F.col("is_best"), F.col("f1_score"))), model.metadata
    return found.agg(F.count("*").cast("int").alias("points"), F.count_if("is_best").cast("int").alias("chosen"),
                     (F.max("f1_score") - best).alias("best_gap"), ((F.min("f1_score") >= 0) & (F.max("f1_score") <= 1)).alias("in_range"),
                     F.lit(meta["unfinished"] == 0).alias("finished"), F.lit(meta["training_rows"]).cast("long").alias("rows"),
                     F.lit(meta["class_distribution"]["1"]).cast("long").alias("frauds"))


@query("t08_w03_forest_importance", f"SELECT {len(MODEL_FEATURES)} AS features, 1.0::DOUBLE AS total, true AS ranked")
def _(spark, sf):
    found = _trained(spark, sf, "forest")[0].importance(spark)
    falls = F.lag("importance").over(Window.orderBy("rank")) >= F.col("importance")  # one row a feature
    return found.withColumn("falls", F.coalesce(falls, F.lit(True))).agg(
        F.count("*").cast("int").alias("features"), F.round(F.sum("importance"), 6).alias("total"), F.bool_and("falls").alias("ranked"))


@query("t18_linear_attribution", tx_sql("""
SELECT isFraud, floor(0.2 * count(*) + 0.5)::BIGINT AS rows, true AS adds_up FROM tx GROUP BY isFraud"""))
def _(spark, sf):
    model, test = _trained(spark, sf, "logistic")
    total = F.aggregate(F.map_values("contributions"), F.col("base_value"), lambda a, v: a + v)
    gap = F.abs(1 / (1 + F.exp(-total)) - F.col("fraud_score"))
    return model.attributions(test).groupBy("isFraud").agg(F.count("*").alias("rows"), (F.max(gap) < 1e-6).alias("adds_up"))


_ADDS_UP = tx_sql("SELECT isFraud, floor(0.2 * count(*) + 0.5)::BIGINT AS rows, true AS adds_up FROM tx GROUP BY isFraud")


def _tree_attribution(spark, sf, kind, link, **kw):
    """Whether base value and contributions of every held-out row give its score."""
    model, test = _trained(spark, sf, kind, **kw)
    margin = F.aggregate(F.map_values("contributions"), F.col("base_value"), lambda a, v: a + v)
    gap = F.abs(link(margin) - F.col("fraud_score"))
    return model.attributions(test).groupBy("isFraud").agg(F.count("*").alias("rows"), (F.max(gap) < 1e-9).alias("adds_up"))


@query("t18_forest_attribution", _ADDS_UP)
def _(spark, sf):
    return _tree_attribution(spark, sf, "forest", lambda m: m)


@query("t18_boosting_attribution", _ADDS_UP)
def _(spark, sf):
    return _tree_attribution(spark, sf, "boosting", lambda m: 1 / (1 + F.exp(-2 * m)), early_stopping=True)


@query("t18_permutation_importance", f"SELECT {len(MODEL_FEATURES)} AS features, 0.0::DOUBLE AS baseline_gap, true AS consistent")
def _(spark, sf):
    model, test = _trained(spark, sf, "forest")
    f1 = evaluation.confusion_metrics(test, [], "isFraud", "fraud_prediction").first()["f1_score"]
    found = models.permutation_importance(model, test.drop("fraud_score", "fraud_prediction"))
    same = F.abs(F.col("baseline") - F.col("permuted") - F.col("importance")) < 1e-12
    return found.agg(F.count("*").cast("int").alias("features"), F.round(F.max(F.abs(F.col("baseline") - f1)), 9).alias("baseline_gap"),
                     F.bool_and(same).alias("consistent"))


@query("t19_save_and_load", tx_sql("""
SELECT isFraud, floor(0.2 * count(*) + 0.5)::BIGINT AS rows, 0.0::DOUBLE AS score_gap FROM tx GROUP BY isFraud"""))
def _(spark, sf):
    """A model written to the shared folder and read back scores the test rows alike."""
    model, test = _trained(spark, sf, "logistic")
    folder = shared_folder(spark, "model")
    model.save(spark, folder)
    again = models.FraudModel.load(spark, folder)(test.withColumnRenamed("fraud_score", "before").drop("fraud_prediction"))
    return again.groupBy("isFraud").agg(F.count("*").alias("rows"), F.max(F.abs(F.col("fraud_score") - F.col("before"))).alias("score_gap"))


@query("t21_aligned_importance", f"SELECT {len(MODEL_FEATURES)} AS features, 0.0::DOUBLE AS logistic_gap, 0.0::DOUBLE AS forest_gap")
def _(spark, sf):
    parts = [_trained(spark, sf, kind)[0].importance(spark).withColumn("model", F.lit(kind)) for kind in ("logistic", "forest")]
    both = cut_lineage(parts[0].unionByName(parts[1]), "importance")
    wide = models.aligned_importance(both, ["logistic", "forest"], n=len(MODEL_FEATURES))
    sums = {r["model"]: r["s"] for r in both.groupBy("model").agg(F.sum("importance").alias("s")).collect()}
    return wide.agg(F.count("*").cast("int").alias("features"), *[
        F.round(F.abs(F.sum(m) - sums[m]), 6).alias(f"{m}_gap") for m in ("logistic", "forest")])


# ---- model runs: every fold of a rule model counts as one registered run ------------------
_RUNS = BY_FOLD + """,
runs AS (SELECT model || '_' || fold AS model_id, model AS model_name, CASE WHEN model = 'rules' THEN 'weighted' ELSE 'single' END AS model_type, fold + 1 AS v,
  CASE fold WHEN 4 THEN 'production' WHEN 3 THEN 'staging' ELSE 'archived' END AS status, fold AS created, true_positives * 100 AS size_bytes, f1_score FROM folds)"""


def model_runs(spark, sf):
    f = F.col("fold")
    return by_fold(spark, sf).select(
        F.concat_ws("_", "model", f.cast("string")).alias("model_id"), F.col("model").alias("model_name"),
        F.when(F.col("model") == "rules", "weighted").otherwise("single").alias("model_type"),
        F.concat(F.lit("v"), (f + 1).cast("string"), F.lit(".0.0")).alias("version"),
        F.when(f == 4, "production").when(f == 3, "staging").otherwise("archived").alias("status"),
        F.when(f == 4, F.array(F.lit("nightly"), F.lit("best"))).otherwise(F.array(F.lit("nightly"))).alias("tags"),
        F.timestamp_seconds(F.lit(1704067200) + f * 86400).alias("created_at"), (F.col("true_positives") * 100).alias("size_bytes"),
        F.create_map(F.lit("f1_score"), F.col("f1_score")).alias("metrics"),
    )


@query("t20_next_version", models_sql("SELECT model_name, 'v' || (max(v) + 1) || '.0.0' AS next_version FROM runs GROUP BY model_name", _RUNS))
def _(spark, sf):
    return registry.next_versions(model_runs(spark, sf))


@query("t20_tagged_runs", models_sql("SELECT model_id, status, round(f1_score, 6) AS f1_score FROM runs WHERE status = 'production'", _RUNS))
def _(spark, sf):
    rows = registry.list_models(model_runs(spark, sf), tags=["nightly", "best"])
    return rows.select("model_id", "status", F.round(F.col("metrics")["f1_score"], 6).alias("f1_score"))


@query("t20_w06_latest_runs", models_sql("SELECT model_name, model_name || '_2' AS model_id FROM runs WHERE v = 3", _RUNS))
def _(spark, sf):
    return registry.latest(model_runs(spark, sf), "archived").select("model_name", "model_id")


@query("t20_run_statistics", models_sql("""
SELECT 'status' AS section, s AS name, (SELECT count(*) FROM runs WHERE status = s) AS value FROM (SELECT unnest(['training', 'validation', 'staging', 'production', 'archived', 'deprecated']) AS s)
UNION ALL SELECT 'type', model_type, count(*) FROM runs GROUP BY model_type UNION ALL SELECT 'total', 'total_models', count(*) FROM runs
UNION ALL SELECT 'total', 'total_size_bytes', sum(size_bytes)::BIGINT FROM runs""", _RUNS))
def _(spark, sf):
    return registry.statistics(model_runs(spark, sf))


# ---- reports ---------------------------------------------------------------------------
_WHOLE = BASE.replace(" WHERE step <= 372", "")


@query("o01_fraud_summary", scored_sql(union_all([
    "SELECT 1 AS position, 'Total Transactions Processed' AS metric, CAST(total_predictions AS VARCHAR) AS value FROM base",
    "SELECT 2, 'Fraudulent Transactions Detected', CAST(true_positives + false_positives AS VARCHAR) FROM base",
    "SELECT 3, 'Fraud Detection Rate', printf('%.2f%%', (true_positives + false_positives) * 100.0 / total_predictions) FROM base"] + [
    f"SELECT {i}, '{m}', printf('%.{d}f%%', {c} * 100) FROM base" for i, m, c, d in [
        (4, "Model Accuracy", "accuracy", 1), (5, "Precision", "precision", 1), (6, "Recall", "recall", 1), (7, "F1-Score", "f1_score", 1),
        (8, "False Positive Rate", "false_positive_rate", 2), (9, "False Negative Rate", "false_negative_rate", 2)]]), _WHOLE))
def _(spark, sf):
    return reports.fraud_summary(scored(spark, sf))


@query("o02_transaction_analysis", tx_sql("""
SELECT type AS transaction_type, count(*) AS count, printf('%.1f%%', count(*) * 100.0::DOUBLE / (SELECT count(*) FROM tx)) AS percentage FROM tx GROUP BY type"""))
def _(spark, sf):
    return reports.transaction_analysis(transactions(spark, sf))


@query("o02_w04_detail_rows", tx_sql("SELECT tx_id, type, amount FROM tx"))
def _(spark, sf):
    return reports.detail_rows(transactions(spark, sf), ["tx_id", "type", "amount"])


@query("o03_model_performance", scored_sql(union_all([
    f"SELECT {i} AS position, '{m}' AS metric, printf('%.3f', {c}) AS value FROM base" for i, m, c in [
        (1, "Accuracy", "accuracy"), (2, "Precision", "precision"), (3, "Recall", "recall"), (4, "F1-Score", "f1_score"), (5, "AUC-ROC", "auc_roc")]]), _WHOLE))
def _(spark, sf):
    return reports.model_performance(scored(spark, sf))


@query("o04_compliance_audit", scored_sql(union_all([
    "SELECT 1 AS position, 'Total Transactions Monitored' AS metric, format('{:,}', total_predictions) AS value, 'Compliant' AS status FROM base",
    "SELECT 2, 'Fraud Detection Accuracy', printf('%.1f%%', accuracy * 100), CASE WHEN accuracy >= 0.8 THEN 'Above Threshold' ELSE 'Below Threshold' END FROM base",
    "SELECT 3, 'False Positive Rate', printf('%.2f%%', false_positive_rate * 100), CASE WHEN false_positive_rate <= 0.3 THEN 'Within Limits' ELSE 'Over Limit' END FROM base",
    "SELECT 4, 'False Negative Rate', printf('%.2f%%', false_negative_rate * 100), CASE WHEN false_negative_rate <= 0.3 THEN 'Within Limits' ELSE 'Over Limit' END FROM base",
    "SELECT 5, 'Model Performance', printf('%.1f%%', f1_score * 100), CASE WHEN f1_score >= 0.5 THEN 'Meets Standards' ELSE 'Below Standards' END FROM base"]), _WHOLE))
def _(spark, sf):
    return reports.compliance_audit(scored(spark, sf))


def _dated(spark, sf):
    return scored(spark, sf).withColumn("ts", F.timestamp_seconds(F.lit(1704067200) + F.col("step") * 3600))


@query("o05_weekly_report", scored_sql("""
SELECT type AS transaction_type, count(*) AS count, printf('%.1f%%', count(*) * 100.0::DOUBLE / (SELECT count(*) FROM week)) AS percentage FROM week GROUP BY type""",
    ", week AS (SELECT * FROM scored WHERE step >= 408 AND step <= 576)"))
def _(spark, sf):
    return reports.transaction_analysis(reports.report_period(_dated(spark, sf), "2024-01-25 00:00:00", "weekly"))


@query("o06_report_history", scored_sql("""
SELECT batch, 'fraud_summary' AS report_type, total_predictions AS rows FROM hist""", BY_DAY))
def _(spark, sf):
    """One report run per day of data."""
    runs = _dated(spark, sf).groupBy(F.floor(F.col("step") / 24).alias("batch")).agg(F.count("*").alias("rows"), F.max("ts").alias("ts"))
    return reports.report_history(runs.withColumn("report_type", F.lit("fraud_summary"))).drop("ts")
