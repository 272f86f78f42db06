import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import monitoring, timers
from ledgerlens.streaming import run
from ledgerlens.streaming import timers as stream_timers

EXPIRY = 3000
T0 = 1_700_000_000


def plain(rows, expiry=EXPIRY):
    """rows: (key, second, id, is_start). Timers by a stack for each key."""
    out, stacks = [], {}
    for key, t, id, is_start in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        stack = stacks.setdefault(key, [])
        while stack and stack[0][0] + expiry < t:
            out.append((key, stack.pop(0)[1], None, "unfinished"))
        if is_start:
            stack.append((t, id))
        else:
            out.append((key, stack.pop()[1], id, "matched") if stack else (key, None, id, "unstarted"))
    return out + [(key, id, None, "unfinished") for key, s in stacks.items() for _, id in s]


def rows_of(seed, n, keys=4, span=20000):
    rng = random.Random(seed)
    return [(rng.choice([*range(keys), 0, 0, None]), rng.randrange(span), i, rng.random() < 0.55) for i in range(n)]


def frame(spark, rows):
    made = spark.createDataFrame(rows, "user_id int, s long, event_id long, is_start boolean")
    return made.select("user_id", "event_id", "is_start", F.timestamp_seconds(F.col("s") + T0).alias("ts"))


def found(df):
    return sorted(((r.user_id, r.start_id, r.stop_id, r.status) for r in df.collect()), key=str)


@pytest.mark.parametrize("cell", [30, 1000, 10 ** 6])
def test_timers_are_those_of_a_stack(spark, cell):
    rows = rows_of(cell, 600)
    got = timers.match_timers(frame(spark, rows), ["user_id"], EXPIRY, cell)
    assert found(got) == sorted(plain(rows), key=str)
    for r in got.where("status = 'matched'").collect():
        assert r.duration_ms * 1000 == r.stop_us - r.start_us <= EXPIRY * 1e6 and r.depth >= 1


def test_no_events_and_no_times(spark):
    assert timers.match_timers(frame(spark, []), ["user_id"]).collect() == []
    some = frame(spark, [(1, 5, 1, True), (1, 6, 2, False)])
    bad = some.withColumn("ts", F.lit(None).cast("timestamp")).union(some.withColumn("is_start", F.lit(None).cast("boolean")))
    assert found(timers.match_timers(some.union(bad), ["user_id"])) == [(1, 1, 2, "matched")]


def test_readings_feed_the_histograms(spark):
    got = timers.timer_readings(timers.match_timers(frame(spark, [(1, 5, 1, True), (1, 7, 2, False), (1, 9, 3, True)]), ["user_id"]), F.lit("load"))
    row = monitoring.histogram_window(got, "2023-11-15 00:00:00", hours=24).first()
    assert (row["name"], row["readings"], row["max"]) == ("load_duration_ms", 1, 2000.0)


def test_a_stream_in_many_batches_gives_the_same_timers(spark, tmp_path):
    """Events reach the stream out of order, within the lateness; a last event moves the watermark past all of them."""
    rows = sorted(rows_of(8, 400), key=lambda r: r[1] + random.Random(r[2]).randrange(500))
    end = [(9, 10 ** 6, 10 ** 6, True)]
    for i in range(5):
        part = rows[i * 80:(i + 1) * 80] + (end if i == 4 else [])
        frame(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = frame(spark, rows[:1]).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run.drain(stream_timers.timer_stream(stream, ["user_id"], EXPIRY, "10 minutes"), "timers")
    assert found(got) == sorted(plain(rows), key=str)


def test_events_wait_for_the_watermark():
    pending = np.array([[30, 3, 0], [10, 1, 1], [20, 2, 1]], np.int64)
    opened = []
    out, rest = stream_timers.match_in_order(pending, opened, 25, 100)
    assert out == [] and rest.tolist() == [[30, 3, 0]] and opened == [(10, 1), (20, 2)]
    out, rest = stream_timers.match_in_order(rest, opened, 110, 100)
    assert out == [(2, 3, 20, 30, "matched"), (1, None, 10, None, "unfinished")] and not len(rest) and opened == []
