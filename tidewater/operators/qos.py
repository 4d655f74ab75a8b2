"""Quality of service: rate limits, inactivity, restarts."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import timedelta
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.model import RESUBSCRIBE_DELAY
from tidewater.operators.prefix import by_block, few, numbered


def rate_limit(df: DataFrame, permits_per_second: float, limiter: str, us: str = "us", tie: str = "event_id") -> DataFrame:
    """`out_us`: when each element passes, one permit apart for each limiter; df itself where permits are not positive.

    out(k) = max over j <= k of (in(j) - j * gap) + k * gap: a running maximum, by blocks, in place of a loop.
    """
    if permits_per_second <= 0:
        return df
    gap = round(1_000_000 / permits_per_second)
    if few(df):
        by = Window.partitionBy(limiter).orderBy(us, tie)
        x = df.withColumn("_k", F.row_number().over(by).cast("bigint"))
        most = F.max(F.col(us) - F.col("_k") * gap).over(by.rowsBetween(Window.unboundedPreceding, 0))
        return x.withColumn("out_us", most + F.col("_k") * gap).drop("_k")
    x = numbered(df, limiter, [us, tie], "_k").withColumn("_m", F.col(us) - F.col("_k") * gap)
    x, w = by_block(x, limiter, "_k", {"_most": F.max("_m")}, {"_most": F.max("_most")})
    return x.withColumn("out_us", F.greatest("_most", F.max("_m").over(w)) + F.col("_k") * gap).drop("_k", "_m", "_b", "_most")


def rate_limit_burst(df: DataFrame, permits_per_second: float, limiter: str, us: str = "us", tie: str = "event_id") -> DataFrame:
    """As rate_limit, but up to a second's unused permits are stored and spent at once. Walked in order, in bounded memory."""
    import pyarrow as pa

    if permits_per_second <= 0:
        return df
    gap, most = round(1_000_000 / permits_per_second), permits_per_second

    def go(batches):
        key, free, stored = object(), 0, 0.0
        for b in batches:
            out = []
            for k, t in zip(b.column(limiter).to_pylist(), b.column(us).to_pylist(), strict=True):
                if k != key:
                    key, free, stored = k, t, 0.0
                if t > free:
                    stored, free = min(most, stored + (t - free) / gap), t
                out.append(max(t, free))
                use = min(1.0, stored)
                stored -= use
                free += round((1 - use) * gap)
            yield b.append_column("out_us", pa.array(out, pa.int64()))

    schema = df.withColumn("out_us", F.lit(0).cast("bigint")).schema
    return df.repartition(F.col(limiter)).sortWithinPartitions(limiter, us, tie).mapInArrow(go, schema)


def inactivity(df: DataFrame, key: str, max_inactivity_us: int, interval_us: int, us: str = "us", tie: str = "event_id", until_us: int | None = None) -> DataFrame:
    """Where a key was silent too long: after which element, until when, and the first check, every interval after it, that notices.

    until_us: a key that is silent up to then counts too; its next_us is null.
    """
    if max_inactivity_us <= 0:
        return df.limit(0).select(key, F.col(us).alias("last_us"), F.col(us).alias("next_us"), F.col(us).alias("noticed_us"))
    # a silence that is noticed is longer than `after`: it is between the last element in one interval of that length and the first in the
    # key's next interval that has any. So nothing is sorted but a key's intervals, and elements are summed up before they are shuffled.
    after = (max_inactivity_us // interval_us + 1) * interval_us
    span = F.expr(f"(`{us}` - pmod(`{us}`, {after})) div {after}")
    x = df.groupBy(key, span.alias("_n")).agg(F.min(us).alias("_first"), F.max(us).alias("last_us"))
    x = x.select(key, "last_us", F.lead("_first").over(Window.partitionBy(key).orderBy("_n")).alias("next_us")).withColumn("noticed_us", F.col("last_us") + after)
    return x.where(F.coalesce("next_us", F.lit(until_us).cast("bigint")) > F.col("noticed_us"))


def resubscribing(start: Callable[[], object], delay: timedelta = RESUBSCRIBE_DELAY, restarts: int | None = None, sleep=time.sleep) -> int:
    """Runs a streaming query to its end, again after each failure and a delay, from its checkpoint; a negative delay: fail at once.

    Returns how many restarts it took; `restarts` bounds them (None: without end).
    """
    n = 0
    while True:
        try:
            start().awaitTermination()
            return n
        except Exception:
            if delay < timedelta(0) or n == restarts:
                raise
            sleep(delay.total_seconds())
            n += 1


@dataclass(frozen=True)
class QosConfig:
    """All parts are off by default."""

    max_inactivity: timedelta = timedelta(0)
    check_delay: timedelta = timedelta(minutes=1)
    check_interval: timedelta = timedelta(minutes=1)
    resubscribe_delay: timedelta = timedelta(seconds=-1)
    permits_per_second: float = 0


class Enforced:
    """A running query that ends with TimeoutError when it has read nothing for too long; checked after a delay and then each interval."""

    def __init__(self, query: Any, config: QosConfig, clock: Callable[[], float] = time.monotonic):
        self.query, self.config, self.clock, self._seen, self._active = query, config, clock, None, clock()

    def _look(self) -> None:
        p = self.query.lastProgress
        if p is not None and p["numInputRows"] and p["batchId"] != self._seen:
            self._seen, self._active = p["batchId"], self.clock()

    def awaitTermination(self) -> None:
        wait = self.config.check_delay
        while not self.query.awaitTermination(max(wait.total_seconds(), 0.001)):
            wait = self.config.check_interval
            self._look()
            silent = self.clock() - self._active
            if silent > self.config.max_inactivity.total_seconds():
                self.query.stop()
                raise TimeoutError(f"query read nothing for {silent:.1f} s, more than {self.config.max_inactivity}")


def quality_of_service(df: DataFrame, config: QosConfig, limiter: str = "part") -> DataFrame:
    """The part that acts on rows; it is the outermost: activity, then restarts, then rate."""
    return rate_limit(df, config.permits_per_second, limiter)


def run(start: Callable[[], Any], config: QosConfig, restarts: int | None = None, sleep=time.sleep, clock: Callable[[], float] = time.monotonic) -> int:
    """Runs a query to its end under the parts that act on it: silence ends it, and an end by failure starts it again."""
    watched = start if config.max_inactivity <= timedelta(0) else lambda: Enforced(start(), config, clock)
    return resubscribing(watched, config.resubscribe_delay, restarts, sleep)
