"""Recycling: a failed work goes back to the topic that it came from, with its count, and the same query reads it again."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import timedelta
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.model import micros
from tidewater.operators.windows import recyclable, recycle


@dataclass(frozen=True)
class RecycleConfig:
    """How long after its inception a work may go round (zero: ever), how often (None: without end), and which errors rule it out."""

    expiration: timedelta = timedelta(days=2)
    max_count: int | None = None
    unrecyclable: tuple[str, ...] = ()

    def recyclable(self, now_ms: int) -> Any:
        return recyclable(F.lit(now_ms), micros(self.expiration) // 1000, self.max_count, list(self.unrecyclable), F.col("error"))


class RecyclingLoop:
    """A streaming query over a topic of works, a folder of Parquet files in a store that all executors share.

    process gets a batch of works and gives them with `error`, null where it succeeded. Its outcome is written once a batch, under
    `outcomes`, with `outcome` DONE, RECYCLED or DROPPED; a batch that is tried again writes it again, before anything follows from it.
    Works that are RECYCLED are then written into the topic, as RETRY with one count more, and a later batch reads them. So each
    try of a work is one row of outcomes, and the loop comes to rest when every work is done or dropped.
    """

    def __init__(self, spark: SparkSession, topic: str, schema: str, process: Callable[[DataFrame], DataFrame], config: RecycleConfig, folder: str, now_ms: Callable[[], int] = lambda: time.time_ns() // 1_000_000):
        self.spark, self.topic, self.schema, self.process, self.config, self.folder, self.now_ms = spark, topic.rstrip("/"), schema, process, config, folder.rstrip("/"), now_ms
        self._query: Any = None

    def publish(self, works: DataFrame) -> None:
        works.write.mode("append").parquet(f"{self.topic}/published")

    def outcomes(self) -> DataFrame:
        return self.spark.read.option("recursiveFileLookup", "true").parquet(f"{self.folder}/outcomes")

    def _each(self, batch: DataFrame, batch_id: int) -> None:
        columns = batch.columns
        bad = F.col("error").isNotNull()
        outcome = F.when(~bad, "DONE").when(self.config.recyclable(self.now_ms()), "RECYCLED").otherwise("DROPPED")
        path = f"{self.folder}/outcomes/batch-{batch_id}"
        self.process(batch).withColumn("outcome", outcome).write.mode("overwrite").parquet(path)
        again = self.spark.read.parquet(path).where("outcome = 'RECYCLED'")
        if again.limit(1).count():  # a batch without any makes no file, or the loop would feed itself for ever
            recycle(again).select(*columns).write.mode("overwrite").parquet(f"{self.topic}/recycled/batch-{batch_id}")

    def start(self, most_files: int = 1000) -> Any:
        s = self.spark.readStream.schema(self.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", most_files).parquet(self.topic)
        self._query = s.writeStream.foreachBatch(self._each).option("checkpointLocation", f"{self.folder}/checkpoint").start()
        return self._query

    def rest(self) -> None:
        """Waits until no work is on its way."""
        self._query.processAllAvailable()

    def stop(self) -> None:
        self._query.stop()
