"""Quality of service in a stream: rows that wait for their permit, and keys that fall silent."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


#: Rows that wait for their permit, in one value of the state: what a task holds of them.
CHUNK = 1000


def _ms(us: int) -> int:
    return -(-us // 1000)


def _plain(x):
    """Rows as tuples, at any depth: a Row within a value is not taken by the state's writer."""
    if isinstance(x, tuple):
        return tuple(_plain(y) for y in x)
    if isinstance(x, list):
        return [_plain(y) for y in x]
    return {k: _plain(v) for k, v in x.items()} if isinstance(x, dict) else x


class Limiter(StatefulProcessor):
    """Gives each row of a limiter its time, `out_us`, and holds it back until then."""

    def __init__(self, schema: T.StructType, us: str, tie: str, permits_per_second: float, burst: bool):
        self.schema, self.row, self.us, self.tie = schema, Row(*schema.names), us, tie
        self.gap, self.most = round(1_000_000 / permits_per_second), permits_per_second if burst else 0.0

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.permits = handle.getValueState("permits", "free_us bigint, stored double, first bigint, next bigint")
        chunk = T.StructType([T.StructField("rows", T.ArrayType(self.schema))])
        self.waiting = handle.getMapState("waiting", "n bigint", chunk)  # chunks first to next - 1, in order of their rows' times

    def _at(self, n: int) -> list[Row]:
        return [self.row(*x) for x in self.waiting.getValue((n,))[0]]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        free, stored, first, n = self.permits.get() if self.permits.exists() else (None, 0.0, 0, 0)
        held, idle = [], first == n
        for r in sorted(rows, key=lambda r: (r[self.us], r[self.tie])):
            t = r[self.us]
            if free is None:
                free = t
            if t > free:  # permits that nobody took are stored, as many as the burst holds
                stored, free = min(self.most, stored + (t - free) / self.gap), t
            if idle:
                self.handle.registerTimer(_ms(free))
                idle = False
            held.append((*(_plain(r[c]) for c in self.schema.names[:-1]), free))
            used = min(1.0, stored)
            stored, free = stored - used, free + round((1 - used) * self.gap)
            if len(held) == CHUNK:
                self.waiting.updateValue((n,), (held,))
                n, held = n + 1, []
        if held:
            self.waiting.updateValue((n,), (held,))
            n += 1
        self.permits.update((free, stored, first, n))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        free, stored, first, n = self.permits.get()
        while first < n:
            held = self._at(first)
            due = next((i for i, x in enumerate(held) if _ms(x[-1]) > now), len(held))
            yield from held[:due]
            if due < len(held):
                if due:
                    self.waiting.updateValue((first,), ([_plain(x) for x in held[due:]],))
                self.handle.registerTimer(_ms(held[due][-1]))
                break
            self.waiting.removeKey((first,))
            first += 1
        self.permits.update((free, stored, first, n))

    def close(self) -> None:
        pass


def rate_limited(stream: DataFrame, permits_per_second: float, limiter: str, us: str = "us", tie: str = "event_id", burst: bool = False, watermark: str | None = "0 seconds") -> DataFrame:
    """The stream's rows with `out_us`, when each may pass, one permit apart for each limiter; a row comes out once event time has
    reached it. The stream itself where permits are not positive.

    burst: up to a second's unused permits are stored and spent at once. Permits are given in order of arrival (us, tie); rows later
    than the watermark (None: the stream has one) are dropped by Spark. What waits of a limiter is in its state, as much as came faster than it may pass; a task
    holds CHUNK rows of it, and a limiter's new rows of one micro-batch.
    """
    if permits_per_second <= 0:
        return stream
    row = T.StructType([*(T.StructField(f.name, f.dataType, True) for f in stream.schema.fields), T.StructField("out_us", T.LongType())])
    x = stream if watermark is None else stream.withColumn("_ts", F.timestamp_micros(us)).withWatermark("_ts", watermark)
    p = Limiter(row, us, tie, permits_per_second, burst)
    return x.groupBy(limiter).transformWithState(statefulProcessor=p, outputStructType=row, outputMode="Append", timeMode="EventTime")


def silent(stream: DataFrame, key: str, max_inactivity_us: int, interval_us: int, us: str = "us", watermark: str = "0 seconds") -> DataFrame:
    """A stream (key, last_us, noticed_us), a row each time that a key has been silent too long: its last arrival, and the first check,
    every interval after that, that notices. An empty stream of that kind where max_inactivity is not positive.

    A key's silence is told once, when event time has passed the check. What lies between two silences is a session of the key, so state is
    a row for each session that has not ended, kept and merged in the JVM: a batch sends what its tasks' rows of a key sum up to, and costs no
    call to Python a key. A row later than the watermark counts while its check is not past; others are dropped by Spark.
    """
    if max_inactivity_us <= 0:
        return stream.where(F.lit(False)).select(key, F.col(us).alias("last_us"), F.col(us).alias("noticed_us"))
    after = (max_inactivity_us // interval_us + 1) * interval_us
    x = stream.select(key, us, F.timestamp_micros(us).alias("_ts")).withWatermark("_ts", watermark)
    x = x.groupBy(key, F.session_window("_ts", f"{after} microseconds")).agg(F.max(us).alias("last_us"))
    return x.select(key, "last_us", (F.col("last_us") + after).alias("noticed_us"))


def raised(stream: DataFrame) -> DataFrame:
    """A stream of silences that fails with its first row: what ends a pipeline whose key must not fall silent."""
    error = F.concat(F.lit("silent too long since "), F.col("last_us").cast("string"))
    return stream.withColumn("noticed_us", F.when(F.col("noticed_us").isNotNull(), F.raise_error(error)).cast("bigint"))
