import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import monitoring, ranges


def test_lowest_of_many_ranges(spark):
    rng = random.Random(1)
    given = [(i, round(rng.random(), 3), 0.0) for i in range(400)]
    given = [(i, a, round(a + 2.0 ** -rng.randrange(1, 12), 4)) for i, a, _ in given]
    given += [(1000, 0.0, 1.0), (1001, 0.5, 0.5), (1002, 0.6, 0.4), (1003, None, 1.0), (1004, float("nan"), 1.0), (1005, -3.5, -1.25)]
    values = [(i, round(rng.random(), 3)) for i in range(500)] + [(600, 0.0), (601, 1.0), (602, None), (603, float("nan")), (604, -2.0), (605, 7.0)]
    table = spark.createDataFrame(given, "position int, low double, high double")
    got = ranges.lowest_match(spark.createDataFrame(values, "id int, v double"), "v", "id", table)
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()

    def holds(lo, hi, v):
        return lo is not None and lo == lo and lo < hi and (lo <= v < hi or v == hi >= 1)

    want = {}
    for i, v in values:
        hits = [p for p, lo, hi in given if v is not None and holds(lo, hi, v)]
        if hits:
            want[i] = min(hits)
    assert {r.id: r.position for r in got.collect()} == want
    none = ranges.lowest_match(spark.createDataFrame(values, "id int, v double"), "v", "id", table.limit(0))
    assert none.collect() == []


def test_a_hundred_thousand_ranges(spark):
    table = spark.range(100_000).select(F.col("id").alias("position"), (F.col("id") / 100_000.0).alias("low"), ((F.col("id") + 1.5) / 100_000.0).alias("high"))
    rows = spark.range(20_000).select("id", ((F.col("id") * 5 + 0.25) / 100_000.0).alias("v"))
    got = ranges.lowest_match(rows, "v", "id", table)
    assert got.where("position <> greatest(id * 5 - 1, 0)").count() == 0 and got.count() == 20_000


@pytest.mark.parametrize("buckets", [1, 3, 40])
def test_running_records_across_buckets(spark, buckets):
    rng = random.Random(2)
    rows = [(i, rng.randrange(60), float(rng.randrange(100))) for i in range(150)]
    got = monitoring.running_recent(spark.createDataFrame(rows, "id int, t int, v double").repartition(3), "v", "t", "id", n=10, buckets=buckets)
    got = {r.id: r for r in got.collect()}
    order = sorted(rows, key=lambda r: (r[1], r[0]))
    assert len(got) == 150
    for i, (id, _, _) in enumerate(order):
        frame = [r[2] for r in order[max(0, i - 9): i + 1]]
        assert got[id].records == len(frame) and abs(got[id].average - sum(frame) / len(frame)) < 1e-9
        if len(frame) > 1:
            mx, my = (len(frame) - 1) / 2, sum(frame) / len(frame)
            slope = sum((x - mx) * (y - my) for x, y in enumerate(frame)) / sum((x - mx) ** 2 for x in range(len(frame)))
            assert abs(got[id].slope - slope) < 1e-9
        else:
            assert got[id].slope is None
