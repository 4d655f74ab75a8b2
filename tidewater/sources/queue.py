"""Queues: a streaming source with acknowledgement, a sink, and negative-acknowledgement policies.

The queue is a folder of JSON-lines files, one record a line, in a store that all executors share; a file, once there, does not
change, and new ones have later names. An offset is a file, a line in it, and how many records came before; a batch reads on
from there. Spark's checkpoint is the acknowledgement, so what a failed batch held is delivered again.
"""

from __future__ import annotations

import itertools
import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, SimpleDataSourceStreamReader, WriterCommitMessage

SCHEMA = "topic string, key string, value string, seq bigint"


class QueueReader(SimpleDataSourceStreamReader):
    def __init__(self, path: str, most: int):
        self.path, self.most = path, most

    def initialOffset(self):
        return {"file": "", "line": 0, "n": 0}

    def _from(self, at: dict):
        """Records from an offset on, each with the offset after it; files before it are not opened."""
        n = at["n"]
        for name in sorted(x for x in os.listdir(self.path) if x.endswith(".jsonl") and x >= at["file"]):
            skip = at["line"] if name == at["file"] else 0
            with open(os.path.join(self.path, name), encoding="utf-8") as f:
                for i, line in enumerate(f):
                    if i >= skip:
                        r = json.loads(line)
                        yield (r.get("topic"), r.get("key"), r.get("value"), n), {"file": name, "line": i + 1, "n": n + 1}
                        n += 1

    def read(self, start):
        rows, end = [], start
        for row, after in self._from(start):
            rows.append(row)
            end = after
            if len(rows) >= self.most:
                break
        return iter(rows), end

    def readBetweenOffsets(self, start, end):
        return iter([row for row, after in itertools.takewhile(lambda x: x[1]["n"] <= end["n"], self._from(start))])

    def commit(self, end):
        tmp = os.path.join(self.path, f"_acked.{uuid.uuid4().hex}")
        with open(tmp, "w", encoding="utf-8") as f:
            json.dump(end, f)
        os.replace(tmp, os.path.join(self.path, "_acked"))


class QueueWriter(DataSourceStreamWriter):
    """Each task writes a hidden file; the commit of a batch makes its files visible, once."""

    def __init__(self, path: str):
        self.path = path

    def write(self, rows):
        name = f"part-{uuid.uuid4().hex}"
        with open(os.path.join(self.path, f"_{name}"), "w", encoding="utf-8") as f:
            for r in rows:
                f.write(json.dumps({k: v for k, v in r.asDict().items() if k != "seq"}, default=str) + "\n")
        return Written(name)

    def commit(self, messages, batchId):
        for i, m in enumerate(m for m in messages if m):
            os.replace(os.path.join(self.path, f"_{m.name}"), os.path.join(self.path, f"{batchId:012d}-{i:05d}.jsonl"))

    def abort(self, messages, batchId):
        for m in messages:
            if m and os.path.exists(os.path.join(self.path, f"_{m.name}")):
                os.remove(os.path.join(self.path, f"_{m.name}"))


class Written(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name


class QueueSource(DataSource):
    """format("queue") with options path and maxPerBatch (the bound on records in flight)."""

    @classmethod
    def name(cls):
        return "queue"

    def schema(self):
        return SCHEMA

    def simpleStreamReader(self, schema):
        return QueueReader(self.options["path"], int(self.options.get("maxPerBatch", "1000")))

    def streamWriter(self, schema, overwrite):
        os.makedirs(self.options["path"], exist_ok=True)
        return QueueWriter(self.options["path"])


def consume(spark: SparkSession, path: str, most: int = 256) -> DataFrame:
    """A stream of the queue's messages, so many a batch at most."""
    spark.dataSource.register(QueueSource)
    return spark.readStream.format("queue").option("path", path).option("maxPerBatch", str(most)).load()


def consume_body(spark: SparkSession, path: str, most: int = 256) -> DataFrame:
    """The messages' bodies; what has none is done with."""
    return consume(spark, path, most).where("value is not null").select("value", "seq")


def send_bodies(bodies: DataFrame, path: str, checkpoint: str, create: Callable[[Column], Column]):
    """A writer of a stream's `value` as messages, as `create` makes them of it: topic is the routing key, after the exchange and
    a slash if it has a name."""
    spark = bodies.sparkSession
    spark.dataSource.register(QueueSource)
    m = bodies.select(create(F.col("value")).alias("m")).select("m.*")
    topic = F.when(F.col("exchange") == "", F.col("routing_key")).otherwise(F.concat_ws("/", "exchange", "routing_key"))
    out = m.select(topic.alias("topic"), F.col("properties.message_id").alias("key"), F.col("body").cast("string").alias("value"), F.lit(0).cast("bigint").alias("seq"))
    return out.writeStream.format("queue").option("path", path).option("checkpointLocation", checkpoint)


def split_outcomes(batch: DataFrame, policy: str = "DISCARD") -> tuple[DataFrame, DataFrame]:
    """(acknowledged, negatively acknowledged) rows by `outcome`; the latter marked for the dead-letter queue or to go back."""
    if policy not in ("DISCARD", "REQUEUE"):
        raise ValueError(policy)
    bad = F.col("outcome") == "NACK"
    return batch.where(~bad), batch.where(bad).withColumn("target", F.lit("dead-letter" if policy == "DISCARD" else "source"))
