"""Timers on a stream: keyed state with an event-time timeout.

The state of a key holds the events the watermark has not passed yet and the starts still open.
Events are matched in order of time once the watermark has passed them, whatever order they came in;
a start whose stop does not come within the expiry is given out as unfinished and forgotten, so
the state is bounded by the events of one expiry.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.timers import EXPIRY_SECONDS, MATCHED, UNFINISHED, UNSTARTED
from .run import LATENESS


def match_in_order(pending: np.ndarray, opened: list[tuple[int, int]], until: int, expiry: int) -> tuple[list[tuple], np.ndarray]:
    """Match events (``us``, ``event_id``, 1 for a start) up to ``until``; ``opened`` is changed, events after it are returned.

    Timers are (start id, stop id, start, stop, status).
    """
    pending = pending[np.lexsort((pending[:, 1], pending[:, 0]))]
    due = int(np.searchsorted(pending[:, 0], until, side="right"))
    out, gone = [], 0  # the oldest open starts expire first and stand at the bottom

    def expire(before: int) -> None:
        nonlocal gone
        while gone < len(opened) and opened[gone][0] + expiry < before:
            us, id = opened[gone]
            out.append((id, None, us, None, UNFINISHED))
            gone += 1

    for us, id, is_start in pending[:due].tolist():
        expire(us)
        if is_start:
            opened.append((us, id))
        elif len(opened) > gone:
            begun, start = opened.pop()
            out.append((start, id, begun, us, MATCHED))
        else:
            out.append((None, id, None, us, UNSTARTED))
    expire(until + 1)
    del opened[:gone]
    return out, pending[due:]


def _emit(names: Sequence[str], expiry: int) -> Callable:
    columns = [*names, "start_id", "stop_id", "start_us", "stop_us", "status"]

    def emit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, opened = state.get if state.exists else (b"", b"")
        parts = [np.frombuffer(waiting, np.int64).reshape(-1, 3)]
        if not state.hasTimedOut:
            parts += [b[["us", "event_id", "is_start"]].to_numpy(np.int64) for b in batches]
        opened = [tuple(x) for x in np.frombuffer(opened, np.int64).reshape(-1, 2).tolist()]
        now = state.getCurrentWatermarkMs()
        out, rest = match_in_order(np.concatenate(parts), opened, now * 1000, expiry)
        if len(rest) or opened:
            state.update((rest.tobytes(), np.array(opened, np.int64).tobytes()))
            due = min([*rest[:1, 0].tolist(), *(us + expiry for us, _ in opened[:1])])
            state.setTimeoutTimestamp(max(-(-due // 1000) - 1, now + 1))
        else:
            state.remove()
        if out:
            rows = pd.DataFrame(out, columns=columns[len(names):]).astype({c: "Int64" for c in columns[len(names):-1]})
            for name, value in zip(names, key):
                rows[name] = value
            yield rows[columns]

    return emit


def timer_stream(events: DataFrame, key: Sequence[str], expiry_seconds: int = EXPIRY_SECONDS, lateness: str = LATENESS) -> DataFrame:
    """Timers of a stream with the key, ``event_id``, ``ts`` and ``is_start``, given out when they end or expire."""
    key = list(key)
    layout = ", ".join([*(f"{c} {events.schema[c].dataType.simpleString()}" for c in key),
                        "start_id bigint, stop_id bigint, start_us bigint, stop_us bigint, status string"])
    rows = events.where(F.col("ts").isNotNull() & F.col("is_start").isNotNull()).withWatermark("ts", lateness).select(
        *key, "event_id", "ts", F.unix_micros("ts").alias("us"), F.col("is_start").cast("long").alias("is_start"))
    out = rows.groupBy(*key).applyInPandasWithState(_emit(key, expiry_seconds * 1_000_000), layout, "waiting binary, opened binary", "append",
                                                    GroupStateTimeout.EventTimeTimeout)
    return out.withColumn("duration_ms", (F.col("stop_us") - F.col("start_us")) / 1000.0)
