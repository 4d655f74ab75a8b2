"""Named topics within an application, timers, and literal sources."""

from __future__ import annotations

import threading
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Topic:
    """Every subscriber gets every element that is sent after it subscribed; the first also what was sent before.

    Elements are written under the topic's folder, in a store that all executors share, so a query that restarts from its
    checkpoint reads them again. Sends are numbered, one after another, and the folder keeps the numbers: an application that
    starts again counts on, and its later subscribers get nothing old.
    """

    def __init__(self, spark: SparkSession, name: str, folder: str, schema: str):
        self.spark, self.name, self.path, self.schema = spark, name, f"{folder.rstrip('/')}/{name}", schema
        self._subscribers, self._lock = 0, threading.Lock()
        spark.createDataFrame([], schema).withColumn("_sent", F.lit(0)).write.mode("append").parquet(self.path)
        self._sent = spark.read.schema(f"{schema}, _sent int").parquet(self.path).agg(F.max("_sent")).first()[0] or 0

    def send(self, df: DataFrame, batch_id: int | None = None) -> None:
        """Sends a batch; fits foreachBatch."""
        with self._lock:  # who subscribes meanwhile comes after it
            df.withColumn("_sent", F.lit(self._sent + 1)).write.mode("append").parquet(self.path)
            self._sent += 1

    def receive(self) -> DataFrame:
        """A stream of the elements for a new subscriber."""
        with self._lock:
            after = self._sent if self._subscribers else 0
            self._subscribers += 1
        stream = self.spark.readStream.schema(f"{self.schema}, _sent int").parquet(self.path)
        return stream.where(F.col("_sent") > after).drop("_sent")


class Topics:
    """Topics by name; the first use of a name makes it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._topics, self._lock = spark, folder, {}, threading.Lock()

    def named(self, name: str, schema: str = "value string") -> Topic:
        with self._lock:
            if name not in self._topics:
                self._topics[name] = Topic(self.spark, name, self.folder, schema)
            return self._topics[name]


def timer(spark: SparkSession, per_second: int = 10) -> DataFrame:
    """A stream of numbers from 0, so many a second: (timestamp, value)."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load()


def ranged(spark: SparkSession, start: int, count: int) -> DataFrame:
    return spark.range(start, start + count).withColumnRenamed("id", "value")


def literals(spark: SparkSession, values: Iterable, kind: str = "string") -> DataFrame:
    """(pos, value): the values in their order."""
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"pos bigint, value {kind}")
