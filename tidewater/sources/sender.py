"""Sending with a result for each record, and what results do to acknowledgements.

A batch's records are sent by tasks, a group's in order, each under an id made of batch, group and position. A task that runs again
sends the same ids again, so a target that knows an id writes its record once. A bounded number of records of a task wait for their
confirmation at a time. The results of a batch are written once; a batch that is tried again after that is not sent again.
"""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator, Mapping
from datetime import timedelta
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.sources.kafka import sender_settings

SENT, FAILED, UNSENT = "SENT", "FAILED", "UNSENT"
IN_FLIGHT = 256


class Target:
    """Where a task sends records. One is made, opened and closed in each task."""

    def open(self) -> None:
        pass

    def submit(self, send_id: str, record: dict[str, Any]) -> Callable[[], None]:
        """Starts to send a record; what is returned waits for its confirmation, and raises if it is refused. Sending an id that was
        confirmed before must do nothing."""
        raise NotImplementedError

    def close(self) -> None:
        pass


class _Task:
    def __init__(self, target: Target, settings: dict[str, Any], attempts: int | None, delay: float):
        self.target, self.attempts, self.delay = target, attempts, delay
        self.stop, self.again, self.bound = settings["stop_on_error"], settings["resubscribe"], settings["max_in_flight"] or IN_FLIGHT
        self.stopped: set = set()

    def _settle(self, send_id: str, record: dict, confirm: Callable[[], None]) -> tuple[str, int, str | None]:
        """(result, attempts, error): an error that would stop the sender makes it start again from its record, if it may."""
        n = 1
        while True:
            try:
                confirm()
                return SENT, n, None
            except Exception as e:  # noqa: BLE001
                if not (self.stop and self.again) or n == self.attempts:
                    return FAILED, n, f"{type(e).__name__}: {e}"
                time.sleep(self.delay)
                n, confirm = n + 1, self._begun(send_id, record)

    def _begun(self, send_id: str, record: dict) -> Callable[[], None]:
        try:
            return self.target.submit(send_id, record)
        except Exception as e:  # noqa: BLE001
            error = e

            def refused() -> None:
                raise error

            return refused

    def results(self, rows: Iterator[tuple[Any, str, dict]]) -> Iterator[tuple[str, str, int, str | None]]:
        waiting: deque = deque()
        for group, send_id, record in rows:
            if group in self.stopped:
                yield send_id, UNSENT, 0, None
                continue
            waiting.append((group, send_id, record, self._begun(send_id, record)))
            # to stop at an error, the next record must wait for this one's confirmation
            while waiting and (self.stop or len(waiting) >= self.bound):
                yield self._done(*waiting.popleft())
        while waiting:
            yield self._done(*waiting.popleft())

    def _done(self, group: Any, send_id: str, record: dict, confirm: Callable[[], None]) -> tuple[str, str, int, str | None]:
        result, n, error = self._settle(send_id, record, confirm)
        if result == FAILED and self.stop:
            self.stopped.add(group)
        return send_id, result, n, error


def send(records: DataFrame, batch_id: int, make_target: Callable[[], Target], config: Mapping[str, Any], group: str = "part", pos: str = "off", attempts: int | None = None, delay: timedelta = timedelta(seconds=1)) -> DataFrame:
    """(group, pos, send_id, result, attempts, error) of each record: SENT, FAILED, or UNSENT after a failure that stops its group.

    config is a sender's (sender_settings): how many records of a task wait for confirmation, whether headers are sent, whether an error
    stops the group, and whether the sender then starts again from that record; attempts bounds how often (None: without end).
    Sends each time that it is evaluated: write its rows before using them twice.
    """
    settings = sender_settings(config)
    if not settings["headers"] and "headers" in records.columns:
        records = records.drop("headers")
    x = records.withColumn("_id", F.concat_ws("-", F.lit(batch_id), F.coalesce(F.col(group).cast("string"), F.lit("null")), F.col(pos).cast("string")))
    x = x.repartition(F.col(group)).sortWithinPartitions(group, pos)
    out = T.StructType([records.schema[group], records.schema[pos], *T.StructType.fromDDL("send_id string, result string, attempts int, error string").fields])

    def go(batches):
        target = make_target()
        target.open()
        task = _Task(target, settings, attempts, delay.total_seconds())
        places = {}

        def rows():
            for b in batches:
                for r in b.to_pylist():
                    send_id = r.pop("_id")
                    places[send_id] = (r[group], r[pos])
                    yield r[group], send_id, r

        def table(some: list) -> pa.RecordBatch:
            cols = list(zip(*((*places.pop(i), i, *rest) for i, *rest in some), strict=True)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, f) for c, f in zip(cols, kinds, strict=True)], out.names)

        try:
            some = []
            for r in task.results(rows()):
                some.append(r)
                if len(some) == 1000:
                    yield table(some)
                    some = []
            yield table(some)
        finally:
            target.close()

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in out.fields]
    return x.mapInArrow(go, out)


class RecordSink:
    """For foreachBatch: sends a batch and writes its results under the folder, in a store that all executors share."""

    def __init__(self, folder: str, make_target: Callable[[], Target], config: Mapping[str, Any] = {}, on_results: Callable[[DataFrame, int], Any] | None = None, **how: Any):  # noqa: B006
        self.folder, self.make_target, self.config, self.on_results, self.how = folder.rstrip("/"), make_target, dict(config), on_results, how

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark, path = batch.sparkSession, f"{self.folder}/batch-{batch_id}"
        done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            send(batch, batch_id, self.make_target, self.config, **self.how).write.mode("overwrite").parquet(path)
        if self.on_results:
            self.on_results(spark.read.parquet(path), batch_id)


def correlated(sent: DataFrame, results: DataFrame, keys: list[str], sent_at: str, result_at: str, within: timedelta, watermark: str = "0 seconds") -> DataFrame:
    """Streams of sends and of their results as one of sends with `status` and `error`: ACKED or NACKED by the result's error, and NACKED
    where none came within the time. Each send comes out once: with its result, or when event time has left its time behind.

    results has the keys, once each, and `error`. Both times are timestamps. A result that comes too late finds nothing. State holds the
    sends that wait and the results of sends to come, for as long as `within`.
    """
    r = results.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("error").alias("_error"), F.col(result_at).alias("_at")).withWatermark("_at", watermark)
    s = sent.withWatermark(sent_at, watermark)
    on = [F.col(k) == F.col(f"_{k}") for k in keys]
    wait = F.expr(f"interval '{within.total_seconds():f}' second")
    x = s.join(r, [*on, F.col("_at") >= F.col(sent_at), F.col("_at") <= F.col(sent_at) + wait], "leftOuter")
    none = F.col("_at").isNull()
    error = F.when(none, F.lit("no result in time")).otherwise(F.col("_error"))
    return x.select(*sent.columns, F.when(error.isNull(), "ACKED").otherwise("NACKED").alias("status"), error.alias("error"))
