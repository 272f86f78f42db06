import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import features
from ledgerlens.operators import models
from ledgerlens.plans.training import MODEL_FEATURES, prepare
from ledgerlens.sources import driver_tables, synthetic, transactions as sources

from .conftest import SF

COLS = ["amount", "oldbalanceOrg", "newbalanceOrig", "is_high_risk_type", "hour_of_day"]


@pytest.fixture(scope="module")
def data(spark):
    return features.engineer(driver_tables.transactions(spark, SF)).cache()


@pytest.fixture(scope="module")
def linear(data):
    return models.fit(models.Spec("logistic", params={"max_iter": 50}), data, COLS)


@pytest.fixture(scope="module")
def forest(data):
    return models.fit(models.Spec("forest", params={"trees": 5, "max_depth": 4}), data, COLS)


def test_save_and_load(spark, data, linear, tmp_path):
    linear.save(spark, str(tmp_path / "m"))
    back = models.FraudModel.load(spark, str(tmp_path / "m"))
    assert back.features == COLS and back.metadata["class_distribution"] == linear.metadata["class_distribution"]
    a, b = (m(data).agg(F.sum("fraud_score")).first()[0] for m in (linear, back))
    assert a == pytest.approx(b)


def test_missing_feature(data, linear):
    with pytest.raises(ValueError):
        linear(data.drop("amount"))


def test_scoring_keeps_columns(data, linear):
    assert set(linear(data).columns) == set(data.columns) | {"fraud_score", "fraud_prediction"}


def test_attributions_add_up_to_log_odds(data, linear):
    total = F.aggregate(F.map_values("contributions"), F.col("base_value"), lambda a, v: a + v)
    rows = linear.attributions(linear(data)).select(total.alias("t"), F.log(F.col("fraud_score") / (1 - F.col("fraud_score"))).alias("o")).limit(50).collect()
    assert np.allclose([r.t for r in rows], [r.o for r in rows], atol=1e-6)


def test_forest_votes_and_importance(spark, data, forest):
    r = forest.tree_votes(data).select("votes", "vote_share").first()
    assert len(r.votes) == 5 and r.vote_share == sum(r.votes) / 5
    imp = forest.importance(spark, top=3).collect()
    assert [i.rank for i in imp] == [1, 2, 3] and imp[0].importance >= imp[1].importance
    assert forest.importance_std(spark).count() == len(COLS)


def test_permutation_importance(data, forest):
    got = {r.feature: r for r in models.permutation_importance(forest, data).collect()}
    assert set(got) == set(COLS) and got["is_high_risk_type"].importance > got["hour_of_day"].importance


def test_early_stopping_uses_fewer_rounds(data):
    spec = models.Spec("boosting", params={"rounds": 30, "max_depth": 3, "learning_rate": 0.5})
    m = models.fit(spec, data, COLS, early_stopping=True)
    assert 1 <= len(m.core.trees) <= 30


def test_grid_search(data):
    spec = models.Spec("forest", params={"trees": 3})
    best, results = models.grid_search(spec, data, COLS, grid={"max_depth": [2, 4]}, folds=2)
    rows = results.collect()
    assert len(rows) == 2 and sum(r.is_best for r in rows) == 1
    assert best.spec.params["max_depth"] in (2, 4) and best.metadata["best_score"] == max(r.f1_score for r in rows)


def test_cross_validation_scores_every_row(data):
    held = models.cross_validate(models.Spec("forest", params={"trees": 2, "max_depth": 2}), data, COLS, folds=2)
    assert held.count() == data.count() and {r.fold for r in held.select("fold").distinct().collect()} == {0, 1}


def test_unknown_settings():
    with pytest.raises(ValueError):
        models.Spec("svm")
    with pytest.raises(ValueError):
        models.Spec("forest", params={"depth": 3})


def test_whole_pipeline_from_csv(spark, tmp_path):
    raw = synthetic.generate(spark, 1500, 0.15)
    sources.write_csv(raw, str(tmp_path / "csv"))
    made = prepare(sources.read_csv(spark, str(tmp_path / "csv")))
    m = models.fit(models.Spec("forest", params={"trees": 3, "max_depth": 3}), made, MODEL_FEATURES, key=["nameOrig"])
    assert m(made).filter("fraud_score between 0 and 1").count() == 1500
