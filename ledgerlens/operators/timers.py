"""Timers: start and stop events paired into durations.

Starts may be nested: a stop ends the latest start of its key that is still open. The pairing is
a running match over the order of a key's events. Time is cut into cells, so no key's history is
one window: running depths are taken inside (key, cell) and moved by the cells before, and
only what a cell leaves open, at most a stop and a start for each depth, meets across cells.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

EXPIRY_SECONDS = 24 * 3600
CELL_SECONDS = 3600
MATCHED, UNFINISHED, UNSTARTED = "matched", "unfinished", "unstarted"


def _with_depth(events: DataFrame, key: Sequence[str], cell_us: int) -> DataFrame:
    """``depth`` of each event (outermost 1); a stop without an open start has 0."""
    step = F.when(F.col("is_start"), 1).otherwise(-1).cast("long")
    rows = events.withColumns({"_step": step, "_cell": F.floor(F.col("us") / cell_us)})
    inside = Window.partitionBy(*key, "_cell").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*key, "_cell").orderBy("us", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_sum", F.sum("_step").over(inside))
    rows = rows.withColumns({"_low": F.min("_sum").over(inside), "_low_before": F.min("_sum").over(earlier)})
    rows = cut_lineage(rows, "timers")
    cells = rows.groupBy(*key, "_cell").agg(F.sum("_step").alias("_total"), F.min("_low").alias("_least"))
    past = Window.partitionBy(*key).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("_base", F.coalesce(F.sum("_total").over(past), F.lit(0)))
    cells = cells.withColumn("_floor", F.least(F.lit(0), F.coalesce(F.min(F.col("_base") + F.col("_least")).over(past), F.lit(0))))
    same = F.lit(True)
    for c in [*key, "_cell"]:
        same = same & F.col(f"e.{c}").eqNullSafe(F.col(f"c.{c}"))
    joined = rows.alias("e").join(cells.alias("c"), same).select("e.*", "_base", "_floor")
    height = F.col("_base") + F.col("_sum")
    ground_before = F.least("_floor", F.coalesce(F.col("_base") + F.col("_low_before"), F.col("_floor")))
    depth = F.when(F.col("is_start"), height - ground_before).when(height < ground_before, 0).otherwise(height - ground_before + 1)
    return joined.withColumn("depth", depth).drop("_step", "_sum", "_low", "_low_before", "_base", "_floor")


def match_timers(events: DataFrame, key: Sequence[str], expiry_seconds: int = EXPIRY_SECONDS, cell_seconds: int = CELL_SECONDS) -> DataFrame:
    """One row per timer: key, ``start_id``, ``stop_id``, ``start_us``, ``stop_us``, ``duration_ms``, ``depth``, ``status``.

    ``events`` has the key, ``event_id``, ``ts`` and ``is_start``; events at one instant follow their ids. A start without a
    stop within ``expiry_seconds`` is ``unfinished``, a stop without an open start ``unstarted`` (depth 0).
    """
    key = list(key)
    given = events.where(F.col("ts").isNotNull() & F.col("is_start").isNotNull())
    rows = _with_depth(given.select(*key, "event_id", "is_start", F.unix_micros("ts").alias("us")), key, cell_seconds * 1_000_000)
    rows = rows.withColumn("_level", F.col("depth"))
    near = Window.partitionBy(*key, "_level", "_cell").orderBy("us", "event_id")
    follow = F.lead(F.struct("event_id", "us")).over(near)
    rows = rows.withColumns({"_next": F.when(F.col("is_start"), follow), "_first": F.row_number().over(near) == 1})
    rows = cut_lineage(rows, "timers")
    loose = (F.col("depth") > 0) & F.when(F.col("is_start"), F.col("_next").isNull()).otherwise(F.col("_first"))
    far = Window.partitionBy(*key, "_level").orderBy("us", "event_id")
    across = rows.where(loose).withColumn("_next", F.when(F.col("is_start"), F.lead(F.struct("event_id", "us")).over(far)))
    # of matched timers only the start goes on, with its stop beside it
    whole = rows.where(~loose & (F.col("is_start") | (F.col("depth") == 0))).unionByName(across.where("is_start"))
    limit = expiry_seconds * 1_000_000
    return whole.select(*key, F.inline(_timers(limit))).select(
        *key, "start_id", "stop_id", "start_us", "stop_us", ((F.col("stop_us") - F.col("start_us")) / 1000.0).alias("duration_ms"), "depth", "status")


def _timers(limit: int) -> Column:
    none = F.lit(None).cast("long")

    def timer(start: Column, stop: Column, begun: Column, ended: Column, depth: Column, status: str) -> Column:
        return F.struct(start.alias("start_id"), stop.alias("stop_id"), begun.alias("start_us"), ended.alias("stop_us"), depth.cast("long").alias("depth"),
                        F.lit(status).alias("status"))

    id, us, depth = F.col("event_id"), F.col("us"), F.col("depth")
    stop, ended = F.col("_next.event_id"), F.col("_next.us")
    unfinished = timer(id, none, us, none, depth, UNFINISHED)
    return (
        F.when(~F.col("is_start"), F.array(timer(none, id, none, us, F.lit(0), UNSTARTED)))
        .when(stop.isNull(), F.array(unfinished))
        .when(ended - us > limit, F.array(unfinished, timer(none, stop, none, ended, F.lit(0), UNSTARTED)))
        .otherwise(F.array(timer(id, stop, us, ended, depth, MATCHED)))
    )


def timer_readings(timers: DataFrame, operation: Column) -> DataFrame:
    """Matched timers as metric events (``name``, ``value``, ``ts``, ``event_id``) that the histograms take."""
    return timers.where(F.col("status") == MATCHED).select(
        F.concat(operation, F.lit("_duration_ms")).alias("name"), F.col("duration_ms").alias("value"),
        F.timestamp_micros("stop_us").alias("ts"), F.col("stop_id").alias("event_id"))
