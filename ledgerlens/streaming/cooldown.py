"""Greedy alert cooldown as a stateful stream.

Accounts are dealt into ``BUCKETS`` by hash, since Python's cost is per group and not per row: a group is a threshold and
a bucket. Its state holds the time of the last emitted alert of each of its accounts until the watermark has passed the
cooldown. A task sees only the rows of one group in one micro-batch, so the trigger's size bounds its memory.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.alerts import DEFAULT_THRESHOLDS, Threshold, describe_alerts, match
from .run import LATENESS

COLUMNS = ["threshold_name", "nameOrig", "tx_id", "us", "type", "amount", "fraud_score", "severity", "cooldown_seconds"]
LAYOUT = ("threshold_name string, nameOrig string, tx_id bigint, us bigint, type string, amount double, "
          "fraud_score double, severity string, cooldown_seconds bigint")
BUCKETS = 1024  # per threshold; fixed for the life of a checkpoint


def _emit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    rows = pd.concat(list(batches)).sort_values(["us", "tx_id"])
    gap = int(rows["cooldown_seconds"].iloc[0]) * 1_000_000
    last = dict(zip(*state.get)) if state.exists else {}
    keep = []
    for i, (account, t) in enumerate(zip(rows["nameOrig"].tolist(), rows["us"].tolist())):
        before = last.get(account)
        if before is None or t - before >= gap:
            keep.append(i)
            last[account] = t
    now = state.getCurrentWatermarkMs()
    last = {account: t for account, t in last.items() if (t + gap) // 1000 >= now}
    if last:
        state.update((list(last), list(last.values())))
        state.setTimeoutTimestamp(max((max(last.values()) + gap) // 1000, now + 1))
    elif state.exists:
        state.remove()
    yield rows.iloc[keep][COLUMNS]


def alert_stream(scores: DataFrame, thresholds: Sequence[Threshold] = DEFAULT_THRESHOLDS, lateness: str = LATENESS) -> DataFrame:
    """Emitted alerts of a stream with ``ts``, ``nameOrig``, ``tx_id`` and ``fraud_score``; rows without ``ts`` raise none."""
    timed = match(scores.withWatermark("ts", lateness).filter("ts is not null"), thresholds).withColumn("us", F.unix_micros("ts"))
    bucket = F.pmod(F.xxhash64("nameOrig"), F.lit(BUCKETS)).alias("bucket")
    emitted = timed.select(*COLUMNS, "ts", bucket).groupBy("threshold_name", "bucket").applyInPandasWithState(
        _emit, LAYOUT, "accounts array<string>, last array<bigint>", "append", GroupStateTimeout.EventTimeTimeout
    )
    channels = None
    for t in thresholds:
        made = F.array(*[F.lit(c) for c in t.channels])
        hit = F.col("threshold_name") == t.name
        channels = F.when(hit, made) if channels is None else channels.when(hit, made)
    return describe_alerts(emitted.withColumns({"ts": F.timestamp_micros("us"), "channels": channels}))
