"""Sources that acknowledge by themselves: what has been consumed is acknowledged an interval at a time, after a delay, whatever was made
of it; and a stream that starts again begins where acknowledgement, not consumption, had come to.

The log of acknowledgements is a folder of its own, in a store that all executors share, and knows nothing of the query's checkpoint. A
run of the source has a folder in it: `base`, the positions that earlier runs acknowledged; `consumed`, a row for each partition and
interval of each batch; `marks`, the moments up to which intervals are acknowledged. Files are written once and not changed; a
batch that is consumed again writes its own rows again. A new run sums up the one before, and what that had consumed but not
acknowledged is delivered again.

Any source that can be read again from a position serves: files by a filter on positions, which is pushed down to them; Kafka by
`starting_offsets`. A queue whose deliveries are numbered is a source of one partition, where acknowledging a position speaks for
all deliveries before it.
"""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable
from datetime import timedelta
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions.model import AUTO_ACK, micros
from tidewater.sources.messages import safely

class AckLog:
    """What of a source is acknowledged: for each partition the next position to read.

    interval and delay: an interval of the arrival time `us`, aligned to the epoch, is acknowledged when the clock is `delay` past its
    end, to the last position consumed in it. part may be of any type; positions are numbers. A log serves one run at a time.
    """

    def __init__(self, spark: SparkSession, folder: str, interval: timedelta = AUTO_ACK[0], delay: timedelta = AUTO_ACK[1], part: str = "part", pos: str = "off", us: str = "us", part_type: str = "bigint"):
        self.spark, self.folder, self.part, self.pos, self.us, self.part_type = spark, folder.rstrip("/"), part, pos, us, part_type
        self.interval, self.delay = max(1, micros(interval)), micros(delay)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(path)
        runs = sorted(int(s.getPath().getName().split("-")[1]) for s in self._fs.listStatus(path) if s.getPath().getName().startswith("run-"))
        # a run counts once its base is whole
        self.run = next((n for n in reversed(runs) if self._there(f"run-{n}/base/_SUCCESS")), 0)
        base = self.committed() if self.run else spark.createDataFrame([], self._schema("commit_off bigint"))
        after = max(runs, default=0) + 1
        base.coalesce(1).write.parquet(f"{self.folder}/run-{after}/base")
        for n in runs:
            self._fs.delete(self._path(f"run-{n}"), True)
        self.run = after

    def _path(self, name: str) -> Any:
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _there(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def _schema(self, rest: str) -> T.StructType:
        return T.StructType.fromDDL(f"`{self.part}` {self.part_type}, {rest}")

    def _read(self, name: str, schema: T.StructType) -> DataFrame:
        path = f"{self.folder}/run-{self.run}/{name}"
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path) if self._there(f"run-{self.run}/{name}") else self.spark.createDataFrame([], schema)

    def consumed(self, batch: DataFrame, batch_id: int) -> None:
        """Notes what a batch held: a row for each partition and interval."""
        end = (F.expr(f"`{self.us}` div {self.interval}") + 1) * self.interval
        rows = batch.groupBy(F.col(self.part).cast(self.part_type).alias(self.part), end.alias("window_end")).agg((F.max(self.pos) + 1).alias("commit_off"), F.count("*").alias("n"))
        rows.write.mode("overwrite").parquet(f"{self.folder}/run-{self.run}/consumed/batch-{batch_id}")

    def acknowledge(self, now_us: int) -> None:
        """Acknowledges every interval whose end is the delay past."""
        self.spark.createDataFrame([(now_us - self.delay,)], "until_us bigint").coalesce(1).write.mode("append").parquet(f"{self.folder}/run-{self.run}/marks")

    def commits(self) -> DataFrame:
        """This run's acknowledged intervals: (part, window_end, commit_off, n, ack_us)."""
        until = self._read("marks", T.StructType.fromDDL("until_us bigint")).agg(F.max("until_us")).first()[0]
        rows = self._read("consumed", self._schema("window_end bigint, commit_off bigint, n bigint"))
        rows = rows.where(F.col("window_end") <= F.lit(until).cast("bigint")).groupBy(self.part, "window_end").agg(F.max("commit_off").alias("commit_off"), F.sum("n").alias("n"))
        return rows.withColumn("ack_us", F.col("window_end") + self.delay)

    def committed(self) -> DataFrame:
        """(part, commit_off): the next position of each partition that a new run reads."""
        rows = self._read("base", self._schema("commit_off bigint")).unionByName(self.commits().select(self.part, "commit_off"))
        return rows.groupBy(self.part).agg(F.max("commit_off").alias("commit_off"))

    def unacknowledged(self, records: DataFrame) -> DataFrame:
        """The records, streaming or not, that were not acknowledged when this run began. Spark broadcasts the positions, a row a
        partition, if they are few enough. A null partition is one like others."""
        base = self._read("base", self._schema("commit_off bigint")).select(F.col(self.part).alias("_part"), F.col("commit_off").alias("_from"))
        x = records.join(base, records[self.part].cast(self.part_type).eqNullSafe(base["_part"]), "left")
        return x.where(F.col(self.pos) >= F.coalesce("_from", F.lit(0))).drop("_part", "_from")

    def starting_offsets(self, topic: str) -> str:
        """What Kafka's `startingOffsets` takes; partitions without a position start at the earliest."""
        return json.dumps({topic: {str(r[0]): r[1] for r in self._read("base", self._schema("commit_off bigint")).collect()}})


class Timer(threading.Thread):
    """Acknowledges an interval after another until it is stopped. A failure is logged and told, and the next interval tries again."""

    def __init__(self, acks: AckLog, clock: Callable[[], int] = lambda: time.time_ns() // 1000, on_error: Callable[[Exception], None] = lambda e: None):
        super().__init__(daemon=True)
        self.acks, self.clock, self.on_error, self._over = acks, clock, on_error, threading.Event()

    def run(self) -> None:
        while not self._over.wait(self.acks.interval / 1e6):
            safely(lambda: self.acks.acknowledge(self.clock()), self.on_error)

    def stop(self) -> None:
        self._over.set()
        self.join()


class AutoReceiver:
    """A streaming query over records that acknowledge themselves.

    records is a stream; consume gets each batch and its number, as for foreachBatch; pregroup sees the stream before. The clock is the
    arrival time that has been read, or with `clock`, the time of a timer of its own. stop() acknowledges at once all that was
    consumed, as the end of the stream does; a query that fails, or whose process dies, leaves what its last interval left.
    """

    def __init__(self, records: DataFrame, acks: AckLog, consume: Callable[[DataFrame, int], Any], checkpoint: str, clock: Callable[[], int] | None = None, pregroup: Callable[[DataFrame], DataFrame] = lambda df: df, **trigger: Any):
        self.acks, self.consume, self._timer = acks, consume, Timer(acks, clock) if clock else None
        w = pregroup(acks.unacknowledged(records)).writeStream.foreachBatch(self._each).option("checkpointLocation", f"{checkpoint.rstrip('/')}/run-{acks.run}")
        self.query = (w.trigger(**trigger) if trigger else w).start()
        if self._timer:
            self._timer.start()

    def _each(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            self.consume(batch, batch_id)
            self.acks.consumed(batch, batch_id)
            if not self._timer:
                now = batch.agg(F.max(self.acks.us)).first()[0]
                if now is not None:
                    self.acks.acknowledge(now)
        finally:
            batch.unpersist()

    def awaitTermination(self, timeout: float | None = None) -> Any:
        return self.query.awaitTermination(timeout)

    def stop(self) -> None:
        if self._timer:
            self._timer.stop()
        self.query.stop()
        self.acks.acknowledge(1 << 62)


def receive_auto(records: DataFrame, folder: str, consume: Callable[[DataFrame, int], Any], checkpoint: str, interval: timedelta = AUTO_ACK[0], delay: timedelta = AUTO_ACK[1], **how: Any) -> AutoReceiver:
    """Consumes a stream of (part, off, us, ...) that acknowledges itself; begins where the log in `folder` says."""
    return AutoReceiver(records, AckLog(records.sparkSession, folder, interval, delay), consume, checkpoint, **how)


def receive_auto_grouped(records: DataFrame, folder: str, consume: Callable[[DataFrame, int], Any], checkpoint: str, interval: timedelta = AUTO_ACK[0], delay: timedelta = AUTO_ACK[1], pregroup: Callable[[DataFrame], DataFrame] = lambda df: df, **how: Any) -> AutoReceiver:
    """As receive_auto, with the records of each topic's partition together in a batch's tasks."""
    from tidewater.sources.kafka import grouped

    return receive_auto(records, folder, consume, checkpoint, interval, delay, pregroup=lambda df: grouped(df, pregroup), **how)
