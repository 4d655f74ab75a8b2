"""Acknowledgement algebra: when each record's acknowledgement takes effect, and what may be committed.

Entries have a group, a position, `done_us` (null: pending) and an outcome (ACK or NACK).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.prefix import by_block


def ordered(entries: DataFrame, group: str = "part", pos: str = "off", immediate_errors: bool = False) -> DataFrame:
    """`executed_us`: not before all earlier entries of the group are done; with immediate errors a NACK takes effect at once, while
    its slot is still freed in order (`drained_us`)."""
    open_, last = F.count_if(F.col("done_us").isNull()), F.max("done_us")
    x, w = by_block(entries, group, pos, {"_open": open_, "_last": last}, {"_open": F.sum("_open"), "_last": F.max("_last")})
    drained = F.when(F.coalesce("_open", F.lit(0)) + open_.over(w) == 0, F.greatest("_last", last.over(w)))
    out = x.withColumn("drained_us", drained).drop("_b", "_open", "_last")
    return out.withColumn("executed_us", F.when(F.lit(immediate_errors) & (F.col("outcome") == "NACK"), F.col("done_us")).otherwise(F.col("drained_us")))


def cumulative(entries: DataFrame, group: str = "part", pos: str = "off", seq: str = "event_id") -> DataFrame:
    """`executed_us` and `executed_as`: the first completion of this or a later entry, ties to the smaller sequence number."""
    first = F.min(F.when(F.col("done_us").isNotNull(), F.struct("done_us", seq, "outcome")))
    x, w = by_block(entries, group, pos, {"_f": first}, {"_f": F.min("_f")}, descending=True)
    x = x.withColumn("_f", F.least("_f", first.over(w)))
    return x.withColumns({"executed_us": F.col("_f.done_us"), "executed_as": F.col("_f.outcome")}).drop("_f", "_b")


def settled(signals: DataFrame, group: str = "part", pos: str = "off", seq: str = "event_id") -> DataFrame:
    """`settled_us` and `settled_as` of deliveries: the first signal that covers one, be it its own or a later delivery's `multiple`,
    which speaks for all before it. Signals have done_us (null: none), outcome and multiple."""
    said = F.when(F.col("done_us").isNotNull(), F.struct("done_us", seq, "outcome"))
    wide = F.min(F.when(F.col("multiple"), said))
    x, w = by_block(signals, group, pos, {"_f": wide}, {"_f": F.min("_f")}, descending=True)
    x = x.withColumn("_f", F.least("_f", wide.over(w), said))
    return x.withColumns({"settled_us": F.col("_f.done_us"), "settled_as": F.col("_f.outcome")}).drop("_f", "_b")


def strategy(kind: str, max_in_flight: int | None = None) -> Callable[[DataFrame], DataFrame]:
    """How acknowledgements of records turn into committed positions: ORDERED, or MULTIPLE, where one speaks for all before it; the
    latter does nothing where records in flight are not bounded."""
    if kind == "ORDERED":
        return lambda entries: ordered(entries, immediate_errors=True)
    if kind == "MULTIPLE":
        return cumulative if max_in_flight is not None else lambda entries: entries
    raise ValueError(kind)


def committable(entries: DataFrame, group: str = "part", pos: str = "off") -> DataFrame:
    """`commit_off`: per group, the next position to read after a restart: that of the first entry not acknowledged. Minima
    and maxima only, so combined before the shuffle."""
    open_ = F.min(F.when(F.col("done_us").isNull() | (F.col("outcome") == "NACK"), F.col(pos)))
    return entries.groupBy(group).agg(F.coalesce(open_, F.max(pos) + 1).alias("commit_off"), F.count("*").alias("n"))


def replay(entries: DataFrame, group: str = "part", pos: str = "off") -> DataFrame:
    """The entries that a restart delivers again: from the committed position on, whatever became of them."""
    return entries.join(committable(entries, group, pos).select(group, "commit_off"), group).where(F.col(pos) >= F.col("commit_off"))


def flatten(children: DataFrame, parent: str, parents: DataFrame) -> DataFrame:
    """Parents' `status` and `status_us` from their children's first signals: NACK at the first NACK, ACK when all are, at once
    (`us`) where there are none, else PENDING."""
    n = children.groupBy(parent).agg(F.count("*").alias("n"), F.count("done_us").alias("n_done"), F.min(F.when(F.col("outcome") == "NACK", F.col("done_us"))).alias("nack_us"), F.max("done_us").alias("last_us"))
    x = parents.join(n, parent, "left")
    status = F.when(F.col("n").isNull(), "ACK").when(F.col("nack_us").isNotNull(), "NACK").when(F.col("n") == F.col("n_done"), "ACK").otherwise("PENDING")
    at = F.when(F.col("n").isNull(), F.col("us")).when(F.col("nack_us").isNotNull(), F.col("nack_us")).when(F.col("n") == F.col("n_done"), F.col("last_us"))
    return x.select(parent, F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"), at.alias("status_us"))


def publish(flattened: DataFrame, inner_done: Column) -> DataFrame:
    """As flatten, but an ACK waits for the inner stream's end as well."""
    return flattened.withColumn("status_us", F.when(F.col("status") == "ACK", F.greatest("status_us", inner_done)).otherwise(F.col("status_us")))


def auto_commits(records: DataFrame, interval_us: int, delay_us: int) -> DataFrame:
    """Per epoch-aligned interval and partition, the position committed at the interval's end plus the delay."""
    end = (F.expr(f"us div {interval_us}") + 1) * interval_us
    return records.groupBy("part", end.alias("window_end")).agg((F.max("off") + 1).alias("commit_off"), F.count("*").alias("n")).withColumn("ack_us", F.col("window_end") + delay_us)


def auto_last(records: DataFrame, interval_us: int, order: list[str], value: str) -> DataFrame:
    """(window_end, value): the last record of each epoch-aligned interval, which a multiple acknowledgement answers for all."""
    end = (F.expr(f"us div {interval_us}") + 1) * interval_us
    return records.groupBy(end.alias("window_end")).agg(F.max_by(value, F.struct(*order)).alias(value))


def correlate(sent: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """What each sent record's result does to its acknowledgement: ACK, NACK where the result has an error, OPEN where there is none yet.
    `results` has the keys, once each, and `error`."""
    known = results.select(*keys, F.struct("error").alias("_r"))
    status = F.when(F.col("_r").isNull(), "OPEN").when(F.col("_r.error").isNull(), "ACK").otherwise("NACK")
    return sent.join(known, keys, "left").withColumns({"status": status, "error": F.col("_r.error")}).drop("_r")


class AckQueue:
    """Sequential model of one group's queue, for admission control on the driver and for tests."""

    def __init__(self, cumulative: bool = False, immediate_errors: bool = False):
        self.cumulative, self.immediate, self.entries, self.executed = cumulative, immediate_errors, [], []

    def add(self, name: str) -> None:
        self.entries.append([name, None, False])

    def complete(self, name: str, error: str | None = None) -> int:
        """Completes an entry, the first time only; returns how many slots are freed."""
        at = next((i for i, e in enumerate(self.entries) if e[0] == name), None)
        if at is None or self.entries[at][1] is not None:
            return 0
        for e in self.entries[: at + 1] if self.cumulative else [self.entries[at]]:
            if e[1] is None:
                e[1] = (error,)
        e = self.entries[at]
        if error and self.immediate and not self.cumulative:
            self.executed.append((e[0], error))
            e[2] = True
        freed = 0
        while self.entries and self.entries[0][1] is not None:
            name, (err,), said = self.entries.pop(0)
            if not said:
                self.executed.append((name, err))
            freed += 1
        return freed


class Admission:
    """At most max_in_flight entries over all groups; capacity returns with freed slots."""

    def __init__(self, max_in_flight: int, group=lambda x: None, **kind):
        self.free, self.group, self.kind, self.queues, self.waiting, self.emitted = max_in_flight, group, kind, {}, [], []

    def offer(self, *names: str) -> None:
        self.waiting += names
        self._drain()

    def complete(self, name: str, error: str | None = None) -> None:
        self.free += self.queues[self.group(name)].complete(name, error)
        self._drain()

    def _drain(self) -> None:
        while self.free and self.waiting:
            x = self.waiting.pop(0)
            self.queues.setdefault(self.group(x), AckQueue(**self.kind)).add(x)
            self.emitted.append(x)
            self.free -= 1
