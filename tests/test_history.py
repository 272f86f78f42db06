from pathlib import Path

from pyspark.sql import functions as F

from ledgerlens.operators import evaluation, history, retention
from ledgerlens.sources.driver_tables import booking_time, scored

from .conftest import SF

NAMES = ("isFraud", "fraud_prediction", "fraud_score")


def test_histograms_give_the_metrics_of_all_rows(spark, tmp_path):
    rows, folder = scored(spark, SF), str(tmp_path / "h")
    history.add_days(rows.where("step < 500"), folder, booking_time())
    kept = {str(p): p.stat().st_mtime_ns for p in Path(folder).rglob("part-*") if "day=2024-01-2" not in str(p) and "day=2024-01-3" not in str(p)}
    history.add_days(rows.where("step >= 480"), folder, booking_time())
    assert kept and all(Path(f).stat().st_mtime_ns == t for f, t in kept.items())
    held = len(retention.days_held(spark, folder))
    want = evaluation.metrics_by(rows, [], *NAMES).first().asDict()
    got = history.window_metrics(spark, folder, "2024-01-01", "2024-12-31").first().asDict()
    assert held >= 31 and got.keys() == want.keys()
    assert all(got[c] == want[c] or abs(got[c] - want[c]) < 1e-12 for c in want)
    few = history.window_metrics(spark, folder, "2024-01-05", "2024-01-06")
    assert few.first().asDict()["total_predictions"] == rows.withColumn("d", F.to_date(booking_time())).where("d between '2024-01-05' and '2024-01-06'").count()
