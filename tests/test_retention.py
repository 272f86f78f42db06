import datetime
from pathlib import Path

from pyspark.sql import functions as F

from ledgerlens.operators import retention




def table(spark, days=10, per_day=4):
    rows = [(i, f"2024-01-{1 + i // per_day:02d} {6 * (i % per_day):02d}:30:00") for i in range(days * per_day)]
    return spark.createDataFrame(rows, "id long, s string").select("id", F.col("s").cast("timestamp").alias("ts"))


def files(folder):
    return {str(p): (p.stat().st_mtime_ns, p.stat().st_size) for p in Path(folder).rglob("part-*") if not p.name.startswith(".")}


def test_old_days_leave_the_disk_and_others_are_untouched(spark, tmp_path):
    folder, at = str(tmp_path / "t"), F.col("ts")
    retention.write_days(table(spark), folder, at)
    before = files(folder)
    gone = retention.drop_before(spark, folder, "2024-01-04 07:00:00", at)
    after = files(folder)
    assert [str(d) for d in gone] == ["2024-01-01", "2024-01-02", "2024-01-03"]
    assert sorted(r.id for r in retention.read_days(spark, folder).collect()) == list(range(14, 40))
    assert not any(f"day={d}/" in f for f in after for d in gone)
    later = [f for f in before if f.split("day=")[1][:10] > "2024-01-04"]
    assert later and all(after[f] == before[f] for f in later)
    assert retention.drop_before(spark, folder, "2024-01-04 07:00:00", at) == []
    assert retention.drop_before(spark, folder, "2024-01-04 23:00:00", at) == []  # nothing of the day is left
    assert retention.days_held(spark, folder)[0] == datetime.date(2024, 1, 5)


def test_a_day_written_again_leaves_no_copies(spark, tmp_path):
    folder, at = str(tmp_path / "t"), F.col("ts")
    retention.write_days(table(spark), folder, at)
    before = files(folder)
    again = table(spark).where("ts < '2024-01-02'").where("id > 1")
    retention.write_days(again, folder, at)
    assert retention.read_days(spark, folder).count() == 38
    assert {f: v for f, v in before.items() if "day=2024-01-01" not in f}.items() <= files(folder).items()


def test_reading_one_day_prunes_the_others(spark, tmp_path):
    folder = str(tmp_path / "t")
    retention.write_days(table(spark), folder, F.col("ts"))
    one = retention.read_days(spark, folder).where("day = '2024-01-03'")
    assert len(one.inputFiles()) > 1 and one.count() == 4
    scan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in scan


def test_rows_without_a_time_stay(spark, tmp_path):
    folder, at = str(tmp_path / "t"), F.col("ts")
    rows = table(spark, 2).union(table(spark, 1, 1).withColumn("ts", F.lit(None).cast("timestamp")))
    retention.write_days(rows, folder, at)
    retention.drop_before(spark, folder, "2025-01-01", at)
    assert [r.ts for r in retention.read_days(spark, folder).collect()] == [None]
    assert retention.drop_before(spark, str(tmp_path / "none"), "2025-01-01", at) == []
