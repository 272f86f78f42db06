"""Classifier evaluation from one table of score counts.

Rows are counted per (group, score) first; running totals over the scores then give
confusion, ROC, PR and ranking measures. Groups are models, folds or batches.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from ..functions.pvalues import normal_two_sided, rank_sum_exact, signed_rank_exact, student_t_two_sided
from ..session import cut_lineage
from .prefix import assign_buckets, range_splits, running_totals

METRICS = ["accuracy", "precision", "recall", "f1_score", "auc_roc"]

# ---- fixed values: model selection -------------------------------------------------
BUSINESS_WEIGHTS = {"precision": 0.3, "recall": 0.4, "f1_score": 0.2, "auc_roc": 0.1}
MINIMUMS = {"precision": 0.5, "recall": 0.6, "f1_score": 0.5}
NOTABLE_ADVANTAGE_PCT, WIDE_F1_RANGE = 5.0, 0.1


def _counts() -> list[Column]:
    y, p = F.col("_y"), F.col("_p")
    return [
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"), F.count_if((y == 1) & (p == 0)).alias("fn"),
    ]


def _rates() -> dict[str, Column]:
    tp, tn, fp, fn = (F.col(c) for c in ("true_positives", "true_negatives", "false_positives", "false_negatives"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {
        "accuracy": ratio(tp + tn, tp + tn + fp + fn), "precision": precision, "recall": recall,
        "f1_score": ratio(2 * tp, 2 * tp + fp + fn), "specificity": ratio(tn, tn + fp),
        "false_positive_rate": ratio(fp, fp + tn), "false_negative_rate": ratio(fn, fn + tp),
    }


def score_counts(df: DataFrame, by: Sequence[str], label: str, score: str, prediction: str | None = None,
                 buckets: int | None = None) -> tuple[DataFrame, str | None]:
    """Confusion counts per (group, score) in a written table, and the bucket column if the scores need one."""
    p = F.col(prediction) if prediction else (F.col(score) >= 0.5).cast("int")
    rows = df.select(*by, F.col(score).cast("double").alias("_s"), F.col(label).cast("int").alias("_y"),
                     p.cast("int").alias("_p"))
    # the rows are read here only; a filter before the write would be moved below joins, where the score is computed once more
    counted = cut_lineage(rows.groupBy(*by, "_s").agg(*_counts(), F.count("_y").alias("_n")), "score-counts")
    counted = counted.filter("_s is not null and _n > 0").drop("_n").withColumns({"pos": F.col("tp") + F.col("fn"), "neg": F.col("tn") + F.col("fp")})
    splits = range_splits(counted, ["_s"], buckets)
    return assign_buckets(counted, splits), ("_s_bucket" if splits["_s"] else None)


def _swept(df, by, label, score, prediction, buckets):
    counted, bucket = score_counts(df, by, label, score, prediction, buckets)
    return running_totals(counted, by, "_s", {"cum_tp": "pos", "cum_fp": "neg"}, bucket, descending=True)


def metrics_by(df: DataFrame, by: Sequence[str], label: str, prediction: str, score: str,
               buckets: int | None = None) -> DataFrame:
    """Confusion, rates, AUC (ties averaged) and average precision per group. One class
    only: AUC is null."""
    by = list(by)
    return _measured(_swept(df, by, label, score, prediction, buckets), by)


def kept_counts(df: DataFrame, by: Sequence[str], label: str, prediction: str, score: str) -> DataFrame:
    """(by, score, tp, tn, fp, fn): a histogram that can be added up, from which ``metrics_of_counts`` takes every measure."""
    rows = df.select(*by, F.col(score).cast("double").alias("score"), F.col(label).cast("int").alias("_y"), F.col(prediction).cast("int").alias("_p"))
    return rows.filter("score is not null and _y is not null").groupBy(*by, "score").agg(*_counts())


def metrics_of_counts(counts: DataFrame, by: Sequence[str], buckets: int | None = None) -> DataFrame:
    """``metrics_by`` of the rows that were counted, over any union of their histograms."""
    by = list(by)
    whole = counts.groupBy(*by, F.col("score").alias("_s")).agg(*[F.sum(c).alias(c) for c in ("tp", "tn", "fp", "fn")])
    whole = whole.withColumns({"pos": F.col("tp") + F.col("fn"), "neg": F.col("tn") + F.col("fp")})
    splits = range_splits(whole, ["_s"], buckets)
    swept = running_totals(assign_buckets(whole, splits), by, "_s", {"cum_tp": "pos", "cum_fp": "neg"}, "_s_bucket" if splits["_s"] else None, descending=True)
    return _measured(swept, by)


def _measured(swept: DataFrame, by: list[str]) -> DataFrame:
    pos, neg, cum = F.col("pos").cast("double"), F.col("neg").cast("double"), F.col("cum_tp").cast("double")
    area = F.sum(neg * (cum - pos / 2))
    step = F.sum(pos * cum / (cum + F.col("cum_fp")))
    wins, losses = F.sum("pos").cast("double"), F.sum("neg").cast("double")
    grouped = swept.groupBy(*by).agg(
        F.sum("tp").alias("true_positives"), F.sum("tn").alias("true_negatives"),
        F.sum("fp").alias("false_positives"), F.sum("fn").alias("false_negatives"),
        F.sum(F.col("pos") + F.col("neg")).alias("total_predictions"), F.sum("pos").alias("positive_samples"),
        F.when((wins > 0) & (losses > 0), area / (wins * losses)).alias("auc_roc"),
        F.when(wins > 0, step / wins).alias("average_precision"),
        ratio(wins, wins + losses).alias("fraud_rate"),
    )
    return grouped.withColumns(_rates())


def confusion_metrics(df: DataFrame, by: Sequence[str], label: str, prediction: str) -> DataFrame:
    """Counts and rates without ranking measures: one conditional aggregate."""
    rows = df.select(*by, F.col(label).cast("int").alias("_y"), F.col(prediction).cast("int").alias("_p"))
    names = {"tp": "true_positives", "tn": "true_negatives", "fp": "false_positives", "fn": "false_negatives"}
    return rows.groupBy(*by).agg(*_counts()).withColumnsRenamed(names).withColumns(_rates())


def curve_points(df: DataFrame, by: Sequence[str], label: str, score: str,
                 buckets: int | None = None) -> DataFrame:
    """(threshold, tpr, fpr, precision, recall) at every distinct score per group: a table that can be as
    long as the input."""
    by = list(by)
    swept = _swept(df, by, label, score, None, buckets)
    whole = swept.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    tied = swept.join(whole, by) if by else swept.withColumns(
        {c: whole.select(c).scalar() for c in ("_p", "_n")}
    )
    tp, fp = F.col("cum_tp"), F.col("cum_fp")
    return tied.select(
        *by, F.col("_s").alias("threshold"), ratio(tp, F.col("_p")).alias("tpr"), ratio(fp, F.col("_n")).alias("fpr"),
        ratio(tp, tp + fp).alias("precision"), ratio(tp, F.col("_p")).alias("recall"),
    )


def confusion_matrix(df: DataFrame, label: str, prediction: str, by: Sequence[str] = (), normalize: str | None = None) -> DataFrame:
    """Rows per (label, prediction), raw or as shares of the true row, predicted column or all."""
    by = list(by)
    cells = df.groupBy(*by, F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("rows"))
    if normalize is None:
        return cells
    part = {"true": [*by, "label"], "pred": [*by, "prediction"], "all": by}[normalize]
    return cells.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy(*part)))


def class_report(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class with macro and weighted averages."""
    by = list(by)
    m = confusion_metrics(df, by, label, prediction)
    tp, tn, fp, fn = (F.col(c) for c in ("true_positives", "true_negatives", "false_positives", "false_negatives"))

    def row(name, hit, false, miss):
        return F.struct(
            F.lit(name).alias("class"), ratio(hit, hit + false).alias("precision"), ratio(hit, hit + miss).alias("recall"),
            ratio(2 * hit, 2 * hit + false + miss).alias("f1_score"), (hit + miss).alias("support"),
        )

    classes = m.select(*by, F.inline(F.array(row("0", tn, fn, fp), row("1", tp, fp, fn))))
    names = ["precision", "recall", "f1_score"]
    macro = classes.groupBy(*by).agg(*[F.avg(c).alias(c) for c in names], F.sum("support").alias("support"))
    weighted = classes.groupBy(*by).agg(
        *[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in names], F.sum("support").alias("support")
    )
    out = [*by, "class", *names, "support"]
    return classes.select(out).unionByName(macro.withColumn("class", F.lit("macro avg")).select(out)).unionByName(
        weighted.withColumn("class", F.lit("weighted avg")).select(out)
    )


def fold_summary(fold_metrics: DataFrame, model: str = "model", metrics: Sequence[str] = tuple(METRICS)) -> DataFrame:
    """Mean and population deviation of every metric over a model's folds."""
    long = fold_metrics.unpivot([model, "fold"], list(metrics), "metric", "value")
    return long.groupBy(model, "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), F.count("value").alias("folds")
    )


# ---- comparison of a few models (one row per model) ----------------------------------
def comparison_table(model_metrics: DataFrame, metrics: Sequence[str] = ("f1_score", "auc_roc", "precision", "recall")) -> DataFrame:
    """Add ``<metric>_rank``: descending, equal values share the best rank, nulls last."""
    return model_metrics.withColumns(
        {f"{m}_rank": F.rank().over(Window.orderBy(F.desc_nulls_last(m))) for m in metrics}
    )


def compare_models(model_metrics: DataFrame, primary: str = "f1_score", model: str = "model") -> DataFrame:
    """Row-number rank by the primary metric and each metric's gap to the best model."""
    w = Window.orderBy(F.desc_nulls_last(primary), F.asc(model))
    best = {m: F.first(m).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for m in METRICS}
    return model_metrics.withColumn("rank", F.row_number().over(w)).withColumns(
        {f"{m}_gap": best[m] - F.col(m) for m in METRICS}
    ).withColumn("is_best", F.col("rank") == 1)


def evaluation_summary(model_metrics: DataFrame, model: str = "model") -> DataFrame:
    return model_metrics.agg(
        F.count("*").alias("evaluations"), F.count_distinct(model).alias("models"),
        *[F.avg(m).alias(f"avg_{m}") for m in METRICS], F.max_by(model, "f1_score").alias("best_f1_model"),
    )


def _pairs(fold_metrics: DataFrame, metric: str, model: str) -> DataFrame:
    one = fold_metrics.select(F.col(model).alias("model_a"), "fold", F.col(metric).alias("a"))
    two = fold_metrics.select(F.col(model).alias("model_b"), "fold", F.col(metric).alias("b"))
    both = one.join(two, "fold").filter("model_a <> model_b")
    return both.filter("a is not null and b is not null and not isnan(a) and not isnan(b)")


def _described(test: str, statistic, p, alpha, effect=None):
    s, pv = F.col(statistic), F.col(p)
    return [
        "model_a", "model_b", F.lit(test).alias("test"), s.alias("statistic"), pv.alias("p_value"),
        (pv < alpha).alias("significant"), (effect if effect is not None else F.lit(None).cast("double")).alias("effect_size"),
        "mean_diff", "sample_size",
    ]


def paired_t_test(fold_metrics: DataFrame, metric: str = "f1_score", model: str = "model", alpha: float = 0.05) -> DataFrame:
    """Every ordered pair of models over their common folds."""
    d = F.col("a") - F.col("b")
    stats = _pairs(fold_metrics, metric, model).groupBy("model_a", "model_b").agg(
        F.count("*").alias("sample_size"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd")
    ).filter("sample_size >= 2")
    t = F.when(F.col("sd") > 0, F.col("mean_diff") / (F.col("sd") / F.sqrt("sample_size")))
    effect = F.when(F.col("sd") > 0, F.col("mean_diff") / F.col("sd")).otherwise(0.0)
    tested = stats.withColumn("t", t).withColumn(
        "p", F.when(F.col("t").isNotNull(), student_t_two_sided(F.col("t"), F.col("sample_size") - 1)))
    return tested.select(_described("paired_ttest", "t", "p", alpha, effect))


def wilcoxon_test(fold_metrics: DataFrame, metric: str = "f1_score", model: str = "model", alpha: float = 0.05) -> DataFrame:
    """Signed-rank test: exact to 50 differences without ties, else the normal approximation."""
    pairs = _pairs(fold_metrics, metric, model).withColumn("d", F.col("a") - F.col("b"))
    mean = pairs.groupBy("model_a", "model_b").agg(F.avg("d").alias("mean_diff"), F.count("*").alias("sample_size"))
    w = Window.partitionBy("model_a", "model_b")
    size = F.abs("d")
    ranked = pairs.filter("d <> 0").withColumns(
        {"ties": F.count("*").over(w.partitionBy("model_a", "model_b", size)), "low": F.rank().over(w.orderBy(size))}
    )
    rank = F.col("low") + (F.col("ties") - 1) / 2
    t = F.col("ties").cast("double")
    sums = ranked.groupBy("model_a", "model_b").agg(
        F.count("*").alias("n"), F.sum(F.when(F.col("d") > 0, rank).otherwise(0.0)).alias("plus"),
        F.sum(F.when(F.col("d") < 0, rank).otherwise(0.0)).alias("minus"), F.max("ties").alias("most"),
        F.sum(t * t - 1).alias("tied"),
    )
    n = F.col("n").cast("double")
    stat = F.least("plus", "minus")
    sd = F.sqrt(n * (n + 1) * (2 * n + 1) / 24 - F.col("tied") / 48)
    exact = (F.col("n") <= 50) & (F.col("most") == 1)
    p = F.when(exact, signed_rank_exact(stat, F.col("n"))).otherwise(normal_two_sided((stat - n * (n + 1) / 4) / sd))
    tested = sums.withColumns({"stat": stat, "p": p}).join(mean, ["model_a", "model_b"])
    return tested.select(_described("wilcoxon", "stat", "p", alpha))


def mann_whitney_test(fold_metrics: DataFrame, metric: str = "f1_score", model: str = "model", alpha: float = 0.05) -> DataFrame:
    """Rank-sum test: exact for up to 8 scores a side without ties, else the normal approximation."""
    pairs = _pairs(fold_metrics, metric, model)
    mean = pairs.groupBy("model_a", "model_b").agg((F.avg("a") - F.avg("b")).alias("mean_diff"), F.count("*").alias("sample_size"))
    sides = pairs.select("model_a", "model_b", F.inline(F.array(
        F.struct(F.lit(1).alias("side"), F.col("a").alias("v")), F.struct(F.lit(0).alias("side"), F.col("b").alias("v")))))
    w = Window.partitionBy("model_a", "model_b")
    ranked = sides.withColumns({"ties": F.count("*").over(Window.partitionBy("model_a", "model_b", "v")), "low": F.rank().over(w.orderBy("v"))})
    rank = F.col("low") + (F.col("ties") - 1) / 2
    t = F.col("ties").cast("double")
    sums = ranked.groupBy("model_a", "model_b").agg(
        F.count_if(F.col("side") == 1).alias("n"), F.count_if(F.col("side") == 0).alias("m"),
        F.sum(F.when(F.col("side") == 1, rank).otherwise(0.0)).alias("r"), F.max("ties").alias("most"), F.sum(t * t - 1).alias("tied"),
    )
    n, m = F.col("n").cast("double"), F.col("m").cast("double")
    u = F.col("r") - n * (n + 1) / 2
    sd = F.sqrt(n * m / 12 * ((n + m + 1) - F.col("tied") / ((n + m) * (n + m - 1))))
    exact = ((F.col("n") <= 8) | (F.col("m") <= 8)) & (F.col("n") <= 50) & (F.col("m") <= 50) & (F.col("most") == 1)
    z = (F.greatest(u, n * m - u) - n * m / 2 - 0.5) / sd
    p = F.when(exact, rank_sum_exact(u, F.col("n"), F.col("m"))).otherwise(F.least(normal_two_sided(z), F.lit(1.0)))
    tested = sums.withColumns({"u": u, "p": F.when(exact | (sd > 0), p).otherwise(1.0)}).join(mean, ["model_a", "model_b"])
    return tested.select(_described("mannwhitney", "u", "p", alpha))


def select_best(model_metrics: DataFrame, weights: Mapping[str, float] = BUSINESS_WEIGHTS,
                minimums: Mapping[str, float] = MINIMUMS, model: str = "model") -> DataFrame:
    """Gate, score and rank models. Qualified ones get a rank by business score and, for
    rank 1, the percentage lead over rank 2 per metric; others list the gates they fail."""
    failed = F.array_compact(F.array(*[
        F.when(F.col(m).isNull() | (F.col(m) < v), F.lit(m)) for m, v in minimums.items()
    ]))
    score = F.lit(0.0)
    for m, weight in weights.items():
        score = score + F.coalesce(F.col(m), F.lit(0.0)) * weight
    gated = model_metrics.withColumn("failed_thresholds", failed).withColumn("qualified", F.size("failed_thresholds") == 0)
    scored = gated.withColumn("business_score", F.when(F.col("qualified"), score))
    w = Window.orderBy(F.desc_nulls_last("business_score"), F.asc(model))
    ranked = scored.withColumn("rank", F.when(F.col("qualified"), F.row_number().over(w)))
    second_ok = F.lead("qualified").over(w)
    leads = {}
    for m in weights:
        nxt = F.lead(m).over(w)
        leads[f"{m}_advantage_pct"] = F.when(
            (F.col("rank") == 1) & second_ok & (nxt > 0), (F.col(m) - nxt) / nxt * 100
        )
    return ranked.withColumns(leads)


def selection_report(model_metrics: DataFrame, model: str = "model") -> DataFrame:
    """Insight texts of the model selection, in order."""
    chosen = select_best(model_metrics, model=model)
    best = chosen.filter("rank = 1")
    name = F.col(model)
    headline = best.select(F.lit(1).alias("position"), F.concat(
        F.lit("Best model: "), name, F.lit(" with business score of "), F.format_string("%.3f", F.col("business_score"))).alias("insight"))
    leads = best.select(name.alias("_name"), *[f"{m}_advantage_pct" for m in BUSINESS_WEIGHTS]).unpivot(
        ["_name"], [f"{m}_advantage_pct" for m in BUSINESS_WEIGHTS], "metric", "lead"
    ).filter(F.col("lead") > NOTABLE_ADVANTAGE_PCT).select(F.lit(2).alias("position"), F.concat(
        F.col("_name"), F.lit(" shows "), F.format_string("%.1f%%", F.col("lead")), F.lit(" improvement in "),
        F.regexp_replace("metric", "_advantage_pct", ""), F.lit(" over second-best model")).alias("insight"))
    out = chosen.agg(F.count_if(~F.col("qualified")).alias("n")).filter("n > 0").select(F.lit(3).alias("position"), F.concat(
        F.col("n").cast("string"), F.lit(" models failed to meet minimum thresholds")).alias("insight"))
    spread = F.col("hi") - F.col("lo")
    wide = chosen.agg(F.max("f1_score").alias("hi"), F.min("f1_score").alias("lo"), F.count("*").alias("n")).filter("n > 1").select(
        F.lit(4).alias("position"), F.when(spread > WIDE_F1_RANGE, F.concat(
            F.lit("Large performance variation: F1-score range of "), F.format_string("%.3f", spread)))
        .otherwise("Models show similar performance levels").alias("insight"))
    return headline.unionByName(leads).unionByName(out).unionByName(wide)
