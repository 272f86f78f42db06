import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from ledgerlens.functions import features
from ledgerlens.operators import elastic, models
from ledgerlens.operators.splitting import stratified_folds
from ledgerlens.session import cut_lineage
from ledgerlens.sources import driver_tables

from .conftest import SF

COLS = ["amount", "oldbalanceOrg", "newbalanceOrig", "is_high_risk_type", "hour_of_day", "always"]
POINTS = [(1e-4, 0.0), (1e-3, 0.5), (1e-2, 1.0), (1e-6, 0.9)]


@pytest.fixture(scope="module")
def rows(spark):
    made = features.engineer(driver_tables.transactions(spark, SF)).withColumn("always", F.lit(7.0))
    ready, _ = models._prepared(made, COLS, "isFraud", "logistic")
    return cut_lineage(stratified_folds(ready, "isFraud", ["tx_id"], 3).select(*COLS, models.LABEL, models.WEIGHT, "fold", "tx_id"))


def objective(pdf, coefficients, intercept, strength, l1):
    margin = pdf[COLS].to_numpy() @ coefficients + intercept
    y, w = pdf[models.LABEL].to_numpy(), pdf[models.WEIGHT].to_numpy()
    loss = (w * (np.logaddexp(0, margin) - y * margin)).sum() / w.sum()
    return loss + strength * (l1 * np.abs(coefficients).sum() + (1 - l1) / 2 * (coefficients ** 2).sum())


def test_no_worse_than_separate_fits(rows):
    """Every model's objective on its rows is at most that of a fit of its own."""
    folds = [-1, 0, 1, 2]
    fits = elastic.fit_all(rows, COLS, models.LABEL, models.WEIGHT, "fold", [s for s, _ in POINTS], [a for _, a in POINTS], folds)
    assert fits.converged.all()
    for k, ((strength, l1), out) in enumerate(zip(POINTS, folds)):
        mine = rows.filter(F.col("fold") != out)
        est = models._estimator(models.Spec("logistic", params={"elastic_net": l1}), 1).setRegParam(strength)
        work = mine.withColumns({f"_f{i}": F.col(c) for i, c in enumerate(COLS)})
        own = Pipeline(stages=[models._assembler(COLS), est]).fit(work).stages[-1]
        pdf = mine.toPandas()
        ours = objective(pdf, fits.coefficients[k], fits.intercepts[k], strength, l1)
        assert ours == pytest.approx(fits.objective[k], abs=1e-9)
        assert ours <= objective(pdf, own.coefficients.toArray(), own.intercept, strength, l1) + 1e-9
        assert fits.coefficients[k][COLS.index("always")] == 0


def test_strong_absolute_penalty_leaves_the_intercept(rows):
    fits = elastic.fit_all(rows, COLS, models.LABEL, models.WEIGHT, "fold", [1e9], [1.0], [-1])
    assert not fits.coefficients.any() and fits.intercepts[0] == pytest.approx(0.0, abs=1e-6)  # balanced weights


def test_most_rounds_are_of_one_model_a_fold(rows, monkeypatch):
    """The grid starts from the first models, and models at the same point count once."""
    made, real = [], elastic._sums

    def sums(*a):
        out = real(*a)
        made.append(len(out))
        return out

    monkeypatch.setattr(elastic, "_sums", sums)
    points = [(s, a) for s in (1e-6, 1e-5, 1e-4, 1e-3) for a in (0.0, 0.5, 1.0)]
    fits = elastic.fit_all(rows, COLS, models.LABEL, models.WEIGHT, "fold", [s for s, _ in points for _ in range(3)],
                           [a for _, a in points for _ in range(3)], [f for _ in points for f in range(3)])
    assert fits.converged.all() and len(made) == fits.rounds
    assert made[0] == 3 and sum(made) < 36 * fits.rounds / 2


def test_held_out_scores(rows):
    fits = elastic.fit_all(rows, COLS, models.LABEL, models.WEIGHT, "fold", [1e-4] * 3, [0.5] * 3, [0, 1, 2])
    got = elastic.held_out_f1(rows, COLS, models.LABEL, "fold", fits, [0, 1, 2])
    pdf = rows.toPandas()
    for k in range(3):
        part = pdf[pdf.fold == k]
        said = part[COLS].to_numpy() @ fits.coefficients[k] + fits.intercepts[k] > 0
        real = part[models.LABEL].to_numpy() == 1
        assert got[k] == pytest.approx(2 * (said & real).sum() / (said.sum() + real.sum()))


def test_broken_values_and_no_rows(rows):
    with pytest.raises(ValueError):
        elastic.fit_all(rows.withColumn("amount", F.lit(None).cast("double")), COLS, models.LABEL, models.WEIGHT, "fold", [1.0], [0.0], [-1])
    none = elastic.fit_all(rows.limit(0), COLS, models.LABEL, models.WEIGHT, "fold", [1.0], [0.5], [-1])
    assert not none.coefficients.any()


def test_whole_logistic_grid(rows):
    best, results = models.grid_search(models.Spec("logistic"), rows.withColumn("isFraud", F.col(models.LABEL).cast("int")), COLS[:5])
    found = results.collect()
    assert len(found) == 36 and sum(r.is_best for r in found) == 1 and best.metadata["unfinished"] == 0
    assert best.metadata["best_score"] == max(r.f1_score for r in found) and best.core.coefficients.size == 5
