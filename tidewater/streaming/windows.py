"""First-occurrence windows as a stateful streaming operator: deduplication and work buffers over event time."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tidewater.functions.model import WindowConfig

OUT = "key string, start_ms bigint, n bigint, first_id bigint, last_id bigint, closed string"


class FirstOccurrence(StatefulProcessor):
    """State: (start_ms, n, first_id, last_id). Rows: (key, ms, id, closes). Emits a row when a window closes: FULL, CLOSER or TIME."""

    def __init__(self, duration_ms: int, max_size: int):
        self.duration, self.most = duration_ms, max_size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("window", "start_ms bigint, n bigint, first_id bigint, last_id bigint")

    def _out(self, key, s, why: str) -> Row:
        return Row(key=key[0], start_ms=s[0], n=s[1], first_id=s[2], last_id=s[3], closed=why)

    def _shut(self, s) -> None:
        self.handle.deleteTimer(s[0] + self.duration)
        self.state.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        s = tuple(self.state.get()) if self.state.exists() else None
        for r in sorted(rows, key=lambda r: (r.ms, r.id)):
            if s and r.ms >= s[0] + self.duration:
                yield self._out(key, s, "TIME")
                self._shut(s)
                s = None
            if s is None:
                s = (r.ms, 1, r.id, r.id)
                self.handle.registerTimer(r.ms + self.duration)
            else:
                s = (s[0], s[1] + 1, s[2], r.id)
            if r.closes or s[1] >= self.most:
                yield self._out(key, s, "CLOSER" if r.closes else "FULL")
                self._shut(s)
                s = None
        if s:
            self.state.update(s)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.state.exists():
            s = tuple(self.state.get())
            if s[0] + self.duration <= expiredTimerInfo.getExpiryTimeInMs():
                yield self._out(key, s, "TIME")
                self.state.clear()

    def close(self) -> None:
        pass


def first_occurrence(stream: DataFrame, config: WindowConfig, watermark: str = "0 seconds") -> DataFrame:
    """stream: (key, ts timestamp, id, closes). Needs the RocksDB state store; an arrival later than the watermark is dropped by Spark."""
    x = stream.withWatermark("ts", watermark).select(F.col("key").cast("string").alias("key"), F.unix_millis("ts").alias("ms"), "id", "closes", "ts")
    p = FirstOccurrence(int(config.duration.total_seconds() * 1000), config.max_size or 1 << 60)
    return x.groupBy("key").transformWithState(statefulProcessor=p, outputStructType=OUT, outputMode="Append", timeMode="EventTime")
