"""Classifiers on MLlib: logistic regression, random forest, gradient boosting.

A fitted ``FraudModel`` is a scorer: ``model(df)`` adds ``fraud_score`` and
``fraud_prediction``. Class imbalance is handled by row weights.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RISK_THRESHOLD
from ..session import cut_lineage, ensure_checkpoint_folder
from . import attribution, elastic, forest
from .evaluation import confusion_metrics
from .splitting import stratified_folds, stratified_split

KINDS = ("logistic", "forest", "boosting")
FEATURES, WEIGHT, LABEL, VALIDATION = "_features", "_weight", "_label", "_validation"

# ---- fixed values: default parameters ------------------------------------------------
DEFAULTS = {
    "logistic": {"C": 1.0, "max_iter": 1000, "elastic_net": 0.0},
    "forest": {"trees": 100, "max_depth": 10, "min_rows": 1, "features": "sqrt"},
    "boosting": {"rounds": 100, "learning_rate": 0.1, "max_depth": 6, "row_share": 1.0, "features": "all"},
}


@dataclass
class Spec:
    """What to train: kind, parameters, seed."""

    kind: str
    name: str = ""
    params: dict = field(default_factory=dict)
    seed: int = 42

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown model kind {self.kind}")
        unknown = set(self.params) - set(DEFAULTS[self.kind])
        if unknown:
            raise ValueError(f"unknown parameters {sorted(unknown)}")
        self.name = self.name or self.kind
        self.params = {**DEFAULTS[self.kind], **self.params}


def class_counts(df: DataFrame, label: str) -> dict[int, int]:
    return {int(r[label]): r["n"] for r in df.groupBy(label).agg(F.count("*").alias("n")).collect() if r[label] is not None}


def row_weight(kind: str, counts: dict[int, int], label: str) -> Column:
    """Balanced ``n / (2 n_class)`` weights; boosting weighs positives by negatives / positives."""
    pos, neg = counts.get(1, 0), counts.get(0, 0)
    if kind == "boosting":
        return F.when(F.col(label) == 1, neg / pos if pos else 1.0).otherwise(1.0)
    other, fraud = class_weights(counts)[:2]
    return F.when(F.col(label) == 1, fraud).otherwise(other)


def class_weights(counts: dict[int, int]) -> list[float]:
    """The balanced weight of each class."""
    pos, neg = counts.get(1, 0), counts.get(0, 0)
    n = pos + neg
    other = n / (2.0 * neg) if neg else 1.0
    return [other, n / (2.0 * pos) if pos else 1.0] + [other] * (max(counts, default=1) - 1)


def _estimator(spec: Spec, n: int, validated: bool = False):
    p = spec.params
    common = {"featuresCol": FEATURES, "labelCol": LABEL, "weightCol": WEIGHT}
    if spec.kind == "logistic":
        return LogisticRegression(
            **common, maxIter=p["max_iter"], regParam=1.0 / (p["C"] * max(n, 1)),
            elasticNetParam=p["elastic_net"], standardization=False,
        )
    if spec.kind == "forest":
        return RandomForestClassifier(
            **common, numTrees=p["trees"], maxDepth=p["max_depth"], minInstancesPerNode=p["min_rows"],
            featureSubsetStrategy=p["features"], seed=spec.seed,
        )
    est = GBTClassifier(
        **common, maxIter=p["rounds"], stepSize=p["learning_rate"], maxDepth=p["max_depth"],
        subsamplingRate=p["row_share"], featureSubsetStrategy=p["features"], seed=spec.seed,
    )
    return est.setValidationIndicatorCol(VALIDATION) if validated else est


def _prepared(df: DataFrame, features: Sequence[str], label: str, kind: str) -> tuple[DataFrame, dict[int, int]]:
    check_features(df, features)
    counts = class_counts(df, label)
    rows = df.filter(F.col(label).isNotNull()).withColumns({
        **{c: F.col(c).cast("double") for c in features},
        LABEL: F.col(label).cast("double"), WEIGHT: row_weight(kind, counts, label),
    })
    return rows, counts


def _balanced(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Training rows in even partitions by key (one per core at least, else as many as the cluster's
    shuffles have): one shuffle, then dozens of passes over them."""
    session = rows.sparkSession
    parts = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, *key)


def check_features(df: DataFrame, features: Sequence[str]) -> None:
    missing = [c for c in features if c not in df.columns]
    if missing:
        raise ValueError(f"missing features: {missing}")


@dataclass
class FraudModel:
    spec: Spec
    pipeline: PipelineModel
    features: list[str]
    metadata: dict

    @property
    def core(self):
        return self.pipeline.stages[-1]

    def __call__(self, df: DataFrame, threshold: float = RISK_THRESHOLD) -> DataFrame:
        check_features(df, self.features)
        work = {f"_f{i}": F.col(c).cast("double") for i, c in enumerate(self.features)}
        out = self.pipeline.transform(df.withColumns(work))
        score = vector_to_array("probability")[1]
        return out.withColumn("fraud_score", score).withColumn(
            "fraud_prediction", (F.col("fraud_score") >= threshold).cast("int")
        ).drop(FEATURES, "rawPrediction", "probability", "prediction", *work)

    def _weights(self) -> np.ndarray:
        if self.spec.kind == "logistic":
            return np.abs(self.core.coefficients.toArray())
        return self.core.featureImportances.toArray()

    def importance(self, spark: SparkSession, top: int | None = None) -> DataFrame:
        """(rank, feature, importance) by size: absolute coefficients or impurity decrease."""
        ranked = sorted(zip(self.features, self._weights()), key=lambda x: (-x[1], x[0]))[:top]
        rows = [(i + 1, f, float(v)) for i, (f, v) in enumerate(ranked)]
        return spark.createDataFrame(rows, "rank int, feature string, importance double")

    def coefficients(self, spark: SparkSession) -> DataFrame:
        if self.spec.kind != "logistic":
            raise ValueError("only linear models have coefficients")
        rows = list(zip(self.features, [float(v) for v in self.core.coefficients]))
        return spark.createDataFrame(sorted(rows, key=lambda r: -abs(r[1])), "feature string, coefficient double")

    def importance_std(self, spark: SparkSession) -> DataFrame:
        """Spread of the importances over the trees of a forest."""
        if self.spec.kind != "forest":
            raise ValueError("only forests have one importance per tree")
        per_tree = np.array([t.featureImportances.toArray() for t in self.core.trees])
        rows = [(f, float(s)) for f, s in zip(self.features, per_tree.std(axis=0))]
        return spark.createDataFrame(rows, "feature string, importance_std double")

    def tree_votes(self, df: DataFrame) -> DataFrame:
        """Add ``votes``, the class each tree of a forest chooses, and their fraud share."""
        if self.spec.kind != "forest":
            raise ValueError("only forests vote")
        check_features(df, self.features)
        work = {f"_f{i}": F.col(c).cast("double") for i, c in enumerate(self.features)}
        out = self.pipeline.stages[0].transform(df.withColumns(work))
        names = []
        for i, tree in enumerate(self.core.trees):
            names.append(f"_t{i}")
            out = tree.setFeaturesCol(FEATURES).setPredictionCol(names[-1]).setRawPredictionCol("").setProbabilityCol("").transform(out)
        votes = F.array(*[F.col(c).cast("int") for c in names])
        return out.withColumn("votes", votes).withColumn(
            "vote_share", F.aggregate("votes", F.lit(0.0), lambda a, v: a + v) / len(names)
        ).drop(FEATURES, *names, *work)

    def attributions(self, df: DataFrame) -> DataFrame:
        """Exact additive contributions: ``base_value`` plus one part per feature.

        Of a linear model ``coefficient * (value - mean)``, adding up to the log-odds; of trees the parts along their paths,
        adding up to the probability (forest) or half the log-odds (boosting).
        """
        if self.spec.kind != "logistic":
            check_features(df, self.features)
            return attribution.attribute(df, self.core, self.spec.kind, self.features)
        means = df.agg(*[F.avg(F.col(c).cast("double")).alias(c) for c in self.features]).first()
        coefs = dict(zip(self.features, [float(v) for v in self.core.coefficients]))
        base = float(self.core.intercept) + sum(coefs[c] * (means[c] or 0.0) for c in self.features)
        parts = F.create_map(*[
            x for c in self.features
            for x in (F.lit(c), F.lit(coefs[c]) * (F.col(c).cast("double") - F.lit(means[c] or 0.0)))
        ])
        return df.withColumns({"base_value": F.lit(base), "contributions": parts})

    def mean_attribution(self, df: DataFrame) -> DataFrame:
        """Mean absolute contribution per feature."""
        long = self.attributions(df).select(F.explode("contributions").alias("feature", "v"))
        return long.groupBy("feature").agg(F.avg(F.abs("v")).alias("importance"))

    def save(self, spark: SparkSession, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        doc = {"kind": self.spec.kind, "name": self.spec.name, "params": self.spec.params, "seed": self.spec.seed,
               "features": self.features, "metadata": self.metadata}
        spark.createDataFrame([(json.dumps(doc),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")

    @staticmethod
    def load(spark: SparkSession, path: str) -> FraudModel:
        doc = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
        spec = Spec(doc["kind"], doc["name"], doc["params"], doc["seed"])
        return FraudModel(spec, PipelineModel.load(f"{path}/pipeline"), doc["features"], doc["metadata"])


def _assembler(features: Sequence[str]) -> VectorAssembler:
    """Features come in as ``_f0.._fn`` so that casting them leaves the caller's columns alone."""
    return VectorAssembler(inputCols=[f"_f{i}" for i in range(len(features))], outputCol=FEATURES, handleInvalid="keep")


def fit(spec: Spec, df: DataFrame, features: Sequence[str], label: str = "isFraud",
        key: Sequence[str] = ("tx_id",), early_stopping: bool = False, validation_share: float = 0.2) -> FraudModel:
    """Train one model. ``early_stopping`` (boosting) holds out a stratified share by key and
    stops once its loss no longer falls."""
    features = list(features)
    start = time.time()
    rows, counts = _prepared(df, features, label, spec.kind)
    rows = rows.withColumns({f"_f{i}": F.col(c) for i, c in enumerate(features)})
    validated = early_stopping and spec.kind == "boosting"
    if validated:
        rows = stratified_split(rows, label, list(key), validation_share, spec.seed).withColumnRenamed("is_test", VALIDATION)
    if spec.kind == "boosting":
        ensure_checkpoint_folder(df.sparkSession)
    n = sum(counts.values())
    inputs = [f"_f{i}" for i in range(len(features))]
    if spec.kind == "forest":
        core = forest.fit(_estimator(spec, n), rows, inputs, LABEL, class_weights(counts))
        pipeline = PipelineModel([_assembler(features), core])
    else:
        rows = _balanced(rows.select(*inputs, LABEL, WEIGHT, *([VALIDATION] if validated else []), *key), key)
        pipeline = Pipeline(stages=[_assembler(features), _estimator(spec, n, validated)]).fit(rows)
    meta = {
        "training_seconds": time.time() - start, "training_rows": n, "feature_count": len(features),
        "class_distribution": {str(k): v for k, v in counts.items()},
    }
    return FraudModel(spec, pipeline, features, meta)


# ---- fixed values: search grids of the parameters MLlib has --------------------------
GRIDS = {
    "logistic": {"C": [0.001, 0.01, 0.1, 1.0, 10.0, 100.0], "elastic_net": [0.0, 0.1, 0.5, 0.7, 0.9, 1.0]},
    "forest": {"trees": [50, 100, 200], "max_depth": [10, 20, 30], "min_rows": [1, 2, 4], "features": ["sqrt", "log2", "all"]},
    "boosting": {"rounds": [100, 200, 300], "learning_rate": [0.01, 0.1, 0.2], "max_depth": [3, 6, 9], "row_share": [0.8, 0.9, 1.0],
                 "features": ["0.8", "0.9", "1.0"]},
}


def grid_search(spec: Spec, df: DataFrame, features: Sequence[str], label: str = "isFraud", key: Sequence[str] = ("tx_id",),
                grid: dict | None = None, folds: int = 5, parallelism: int = 4) -> tuple[FraudModel, DataFrame]:
    """(best model, results): stratified folds, F1 of the fraud class. All logistic models of a search are fitted together
    (``elastic``); the models of other kinds in parallel."""
    features, grid = list(features), grid or GRIDS[spec.kind]
    rows, counts = _prepared(df, features, label, spec.kind)
    rows = rows.withColumns({f"_f{i}": F.col(c) for i, c in enumerate(features)})
    rows = stratified_folds(rows, label, list(key), folds, spec.seed)
    inputs = [f"_f{i}" for i in range(len(features))]
    n = sum(counts.values())
    rows = _balanced(rows.select(*inputs, LABEL, WEIGHT, "fold", *key), key)
    rows = cut_lineage(rows, "training")  # read by every fold and point
    search = _logistic_points if spec.kind == "logistic" else _separate_points
    tried, scores, pipeline, more = search(spec, rows, inputs, grid, folds, n, parallelism)
    best = int(np.argmax(scores))
    results = df.sparkSession.createDataFrame(
        [(i, json.dumps(t, sort_keys=True), float(s), i == best) for i, (t, s) in enumerate(zip(tried, scores))],
        "position int, parameters string, f1_score double, is_best boolean",
    )
    chosen = Spec(spec.kind, spec.name, {**spec.params, **tried[best]}, spec.seed)
    if pipeline is None:
        pipeline = Pipeline(stages=[_assembler(features), _estimator(chosen, n)]).fit(rows)
    meta = {"training_rows": n, "best_score": float(scores[best]), "best_params": tried[best],
            "class_distribution": {str(k): v for k, v in counts.items()}, "feature_count": len(features), **more}
    return FraudModel(chosen, pipeline, features, meta), results


def _logistic_points(spec: Spec, rows: DataFrame, inputs: list[str], grid: dict, folds: int, n: int, parallelism: int):
    """Every point on every fold, all in the same passes over the rows."""
    tried = [dict(zip(grid, values)) for values in product(*grid.values())]
    full = [{**spec.params, **t} for t in tried]
    without = [f for _ in full for f in range(folds)]
    fits = elastic.fit_all(
        rows, inputs, LABEL, WEIGHT, "fold", [1.0 / (p["C"] * max(n, 1)) for p in full for _ in range(folds)],
        [p["elastic_net"] for p in full for _ in range(folds)], without, max(p["max_iter"] for p in full))
    scores = elastic.held_out_f1(rows, inputs, LABEL, "fold", fits, without).reshape(len(full), folds).mean(axis=1)
    return tried, scores, None, {"passes": fits.rounds + 1, "unfinished": int((~fits.converged).sum())}


def _separate_points(spec: Spec, rows: DataFrame, inputs: list[str], grid: dict, folds: int, n: int, parallelism: int):
    """A training run for each point and fold."""
    est = _estimator(spec, n)
    params = {
        "trees": ("numTrees", int), "max_depth": ("maxDepth", int), "min_rows": ("minInstancesPerNode", int),
        "features": ("featureSubsetStrategy", str), "rounds": ("maxIter", int), "learning_rate": ("stepSize", float),
        "row_share": ("subsamplingRate", float),
    }
    build, back = ParamGridBuilder(), {}
    for name, values in grid.items():
        attr, convert = params[name]
        build = build.addGrid(getattr(est, attr), [convert(v) for v in values])
        back[attr] = {convert(v): (name, v) for v in values}
    points = build.build()
    evaluator = MulticlassClassificationEvaluator(labelCol=LABEL, metricName="fMeasureByLabel", metricLabel=1.0)
    cv = CrossValidator(
        estimator=Pipeline(stages=[_assembler(inputs), est]), estimatorParamMaps=points, evaluator=evaluator,
        numFolds=folds, foldCol="fold", parallelism=parallelism, seed=spec.seed,
    ).fit(rows)
    tried = [dict(back[p.name][v] for p, v in point.items()) for point in points]
    return tried, cv.avgMetrics, cv.bestModel, {}


def cross_validate(spec: Spec, df: DataFrame, features: Sequence[str], label: str = "isFraud",
                   key: Sequence[str] = ("tx_id",), folds: int = 5) -> DataFrame:
    """Held-out scores of every row: (fold, label, score, prediction), for ``metrics_by``."""
    marked = stratified_folds(df, label, list(key), folds, spec.seed)
    out = None
    for k in range(folds):
        model = fit(spec, marked.filter(F.col("fold") != k).drop("fold"), features, label, key)
        held = model(marked.filter(F.col("fold") == k)).select(
            F.lit(spec.name).alias("model"), "fold", F.col(label).alias("label"),
            F.col("fraud_score").alias("score"), F.col("fraud_prediction").alias("prediction"))
        out = held if out is None else out.unionByName(held)
    return out


def permutation_importance(model: FraudModel, df: DataFrame, label: str = "isFraud", key: Sequence[str] = ("tx_id",),
                           metric: str = "f1_score", seed: int = 42) -> DataFrame:
    """(feature, baseline, permuted, importance): the metric's fall when a feature is shuffled.

    Rows are spread by key hash and each Arrow batch permutes within itself, so no rows are
    paired by a join. All shuffled copies are scored and counted in one job.
    """
    names = model.features
    spread = df.select(label, *key, *[F.col(c).cast("double").alias(c) for c in names]).repartition(
        F.xxhash64(*key, F.lit(seed))).sortWithinPartitions(F.xxhash64(*key, F.lit(seed + 1)))

    def shuffled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for number, pdf in enumerate(batches):
            rng = np.random.default_rng([seed, number])
            base = pdf[[label, *names]]
            yield base.assign(shuffled="")
            for c in names:
                yield base.assign(shuffled=c, **{c: rng.permutation(base[c].to_numpy())})

    types = dict(df.dtypes)
    layout = ", ".join([f"{label} {types[label]}", *[f"{c} double" for c in names], "shuffled string"])
    scored = model(spread.mapInPandas(shuffled, layout))
    per = confusion_metrics(scored, ["shuffled"], label, "fraud_prediction").select("shuffled", metric)
    baseline = per.filter("shuffled = ''").select(metric).scalar()
    return per.filter("shuffled <> ''").select(
        F.col("shuffled").alias("feature"), baseline.alias("baseline"), F.col(metric).alias("permuted"),
        (baseline - F.col(metric)).alias("importance"),
    )


def aligned_importance(importances: DataFrame, models: Sequence[str], n: int = 10) -> DataFrame:
    """(feature, one column per model): importances (model, feature, importance) side by side,
    0 where a model lacks a feature; features by their largest value."""
    wide = importances.groupBy("feature").pivot("model", list(models)).agg(F.first("importance")).na.fill(0.0)
    top = F.greatest(*[F.col(m) for m in models]) if len(models) > 1 else F.col(models[0])
    return wide.orderBy(F.desc(top), "feature").limit(n)
