"""Smoothed progress of running extractions as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_speed(events: DataFrame, keep: float = 0.3) -> DataFrame:
    """(signal_id, at, speed) from (signal_id, processed, at): one small state per series."""

    def update(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, when, speed = state.get if state.exists else (None, None, 0.0)
        rows = pd.concat(batches).sort_values("at")
        out = []
        for done, at in zip(rows["processed"], rows["at"]):
            if last is None or done <= 0 or done < last:
                speed = 0.0
            elif done > last:
                now = (done - last) / (at - when) if at > when else None
                speed = 0.0 if now is None else round(keep * speed + (1 - keep) * now if speed > 0 else now, 2)
            last, when = float(done), float(at)
            out.append((key[0], when, speed))
        state.update((last, when, speed))
        yield pd.DataFrame(out, columns=["signal_id", "at", "speed"])

    return events.groupBy("signal_id").applyInPandasWithState(
        update,
        "signal_id long, at double, speed double",
        "last double, at double, speed double",
        "append",
        GroupStateTimeout.NoTimeout,
    )
