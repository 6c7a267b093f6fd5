"""A rule that waits for a timer: the clean clock."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from driftgate import fixed_values as V

_HOUR_MS = 3_600_000


class _CleanClock(StatefulProcessor):
    """Time of the last hard divergence and counts; reports when the window has passed without one."""

    def __init__(self, hours: float, start_ms: int):
        self.window_ms = int(hours * _HOUR_MS)
        self.start_ms = start_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("clock", "last_a_ms bigint, a bigint, b bigint, c bigint, total bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows))
        last, a, b, c, total = self.state.get() if self.state.exists() else (None, 0, 0, 0, 0)
        newest = batch["last_a_ms"].max()
        restarted = not pd.isna(newest) and (last is None or int(newest) > last)
        first = last is None and total == 0
        if restarted:
            last = int(newest)
        a, b, c = (int(x + batch[n].sum()) for x, n in ((a, "class_a"), (b, "class_b"), (c, "class_c")))
        total = int(total + batch["total"].sum())
        self.state.update((last, a, b, c, total))
        if restarted or first:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(max(last or 0, self.start_ms) + self.window_ms)
            yield self._row(key, "restarted" if restarted else "started", last, a, b, c, total)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, a, b, c, total = self.state.get()
        yield self._row(key, "window_complete", last, a, b, c, total)

    def _row(self, key, event, last, a, b, c, total) -> pd.DataFrame:
        rate = (a + b) / total if total else 0.0
        frame = pd.DataFrame([(key[0], event, last, a, b, c, total, rate)])
        frame.columns = ["stream_id", "event", "last_a_ms", "class_a", "class_b", "class_c", "total", "error_rate"]
        return frame.astype({"last_a_ms": "Int64"})

    def close(self) -> None:
        pass


def clean_clock_stream(
    comparisons: DataFrame, ts: str, start_ms: int, hours: float = V.CLEAN_WINDOW_HOURS, step: str = "10 minutes", lateness: str = "1 minute"
) -> DataFrame:
    """Start, restart and completion of the clean window of a stream of comparisons.

    Comparisons (stream_id, divergence_class, ts) are first counted per
    ``step``, so the stateful part sees a row per step however many there are.
    """
    kind = F.col("divergence_class")
    counted = (
        comparisons.withWatermark(ts, lateness).groupBy("stream_id", F.window(ts, step).alias("window")).agg(
            F.max(F.when(kind == "A", F.unix_millis(F.col(ts)))).alias("last_a_ms"), F.count_if(kind == "A").alias("class_a"),
            F.count_if(kind == "B").alias("class_b"), F.count_if(kind == "C").alias("class_c"), F.count(F.lit(1)).alias("total"),
        )
    )
    rows = counted.select("stream_id", F.col("window.end").alias("at"), "last_a_ms", "class_a", "class_b", "class_c", "total")
    schema = (
        "stream_id string, event string, last_a_ms bigint, class_a bigint, class_b bigint, class_c bigint, total bigint, error_rate double"
    )
    return rows.groupBy("stream_id").transformWithStateInPandas(_CleanClock(hours, start_ms), schema, "append", "eventTime")
