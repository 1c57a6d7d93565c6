"""Debouncing by event time: a burst of changes applies once.

* Trailing edge (`quiet_bursts`): the changes of a key that follow each other within the quiet time are one burst, a session
  window. It comes out once the watermark has passed its end, with its last change, so it waits for changes that arrive out of
  order by up to `late`.
* Leading edge (`leading_edges`): the first change applies, and those within `gap` after an applied one do not. Which ones
  apply depends on their order, so changes wait in the key's state until the watermark has passed them; an event-time timer
  wakes the key for the next of them.

Times are event times, so a replay gives the same result whatever the speed and the batches. Changes that come more than `late` behind the
newest one of the batches before are dropped once Spark's watermark has passed them; `dropped_late` counts them. State holds one row a burst, or the waiting times of a key and the last applied one.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

MICROS = 1_000_000


def quiet_bursts(changes: DataFrame, key: str, at: str, quiet: str, late: str) -> DataFrame:
    """(key, first, last, n, change): bursts with their ends, their number of changes, and the last change as a struct; ties by a hash of the row."""
    own = F.struct(*[F.col(c) for c in changes.columns])
    latest = F.max_by(own, F.struct(F.col(at), F.xxhash64(*changes.columns)))
    grouped = changes.withWatermark(at, late).groupBy(key, F.session_window(at, quiet).alias("_w"))
    return grouped.agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n"), latest.alias("change")).drop("_w")


def leading_edges(changes: DataFrame, key: str, at: str, gap: timedelta, late: str) -> DataFrame:
    """(key, at): the times of the changes that apply."""
    step = gap // timedelta(microseconds=1)
    kind = changes.schema[key].dataType.simpleString()

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, waiting = state.get if state.exists else (None, [])
        for frame in frames:
            waiting = [*waiting, *frame["us"].tolist()]
        waiting = sorted(waiting)
        seen = state.getCurrentWatermarkMs() * 1000
        ready, waiting = [t for t in waiting if t < seen], [t for t in waiting if t >= seen]
        out = []
        for t in ready:
            if last is None or t >= last + step:
                out.append(t)
                last = t
        state.update((last, waiting))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0] // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        elif state.hasTimedOut:
            state.setTimeoutTimestamp(state.getCurrentWatermarkMs() + max(1, step // 1000))
        yield pd.DataFrame({key: [keys[0]] * len(out), "us": pd.Series(out, dtype="int64")})

    timed = changes.withWatermark(at, late).select(key, at, F.unix_micros(at).alias("us"))
    found = timed.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, us long", "last long, waiting array<long>", "append", GroupStateTimeout.EventTimeTimeout)
    return found.select(key, F.timestamp_micros("us").alias(at))


def dropped_late(query: StreamingQuery) -> int:
    """Rows behind the watermark that a finished query has dropped, as far as its progress is kept."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
