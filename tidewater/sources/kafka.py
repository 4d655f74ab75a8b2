"""Kafka by Spark's own connector, where its jar is present."""

from __future__ import annotations

import itertools
import logging
import time
from collections import defaultdict
from collections.abc import Callable, Mapping
from datetime import timedelta
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.config import instantiate
from tidewater.functions.model import AUTO_ACK
from tidewater.operators.envelope import acknowledgeable

# Settings of senders and receivers, each with its older name first.
SENDER_IN_FLIGHT = ("max.in.flight", "sender.max.in.flight.per.send")
RECEIVER_IN_FLIGHT = ("max.in.flight.per.topic.partition", "receiver.max.in.flight.per.subscription")
HEADERS_ENABLED, STOP_ON_ERROR, RESUBSCRIBE_ON_ERROR = "headers.enabled", "stop.on.error", "resubscribe.on.error"
_clients: dict[str, Any] = defaultdict(lambda: itertools.count(1))

REQUIRED = ("kafka.bootstrap.servers",)


def check(options: dict[str, str]) -> None:
    if missing := [k for k in REQUIRED if not options.get(k)]:
        raise ValueError(f"missing options: {', '.join(missing)}")


def unique_client_id(client_id: str) -> str:
    """The id with a number that no earlier client of that id has."""
    return f"{client_id}-{next(_clients[client_id])}"


def in_flight(config: Mapping[str, Any], names: tuple[str, str]) -> int | None:
    """The bound on records in flight, None without; the older name wins."""
    found = [int(config[n]) for n in names if config.get(n) is not None]
    return found[0] if found else None


def sender_settings(config: Mapping[str, Any]) -> dict[str, Any]:
    """How a sender behaves: headers are stripped, errors do not stop it and it starts again, unless configured otherwise."""
    flag = lambda name, default: str(config.get(name, default)).lower() == "true"
    return {"max_in_flight": in_flight(config, SENDER_IN_FLIGHT), "headers": flag(HEADERS_ENABLED, False), "stop_on_error": flag(STOP_ON_ERROR, False), "resubscribe": flag(RESUBSCRIBE_ON_ERROR, True)}


#: Fixed value: the setting that names what makes rows of records acknowledgeable.
FACTORY = "acknowledgeable.factory"


def record_factory(config: Mapping[str, Any]) -> Callable[[DataFrame], DataFrame]:
    """What makes records acknowledgeable: as the configuration names it, a dotted path, a class or an instance, with `create(df)` and
    maybe `configure(config)`; else their rows with nothing said of them yet."""
    made = config.get(FACTORY)
    if made is None:
        return acknowledgeable
    made = instantiate(made)
    if hasattr(made, "configure"):
        made.configure(dict(config))
    return made.create


class LoggingInterceptor:
    """Logs records where they are, in the tasks, one line each: as they are sent and received, their results and commits. Rows pass as
    they are. handler makes a handler for a worker's logger, which by default writes to the executor's standard error."""

    def __init__(self, name: str = __name__, handler: Callable[[], logging.Handler] | None = None):
        self.name, self.handler = name, handler

    def _told(self, df: DataFrame, line: Callable[[dict], tuple[int, str]]) -> DataFrame:
        def go(batches):
            logger, handler = logging.getLogger(self.name), self.handler() if self.handler else logging.StreamHandler()
            logger.setLevel(logging.INFO)
            logger.addHandler(handler)
            try:
                for b in batches:
                    for r in b.to_pylist():
                        logger.log(*line(r))
                    yield b
            finally:
                logger.removeHandler(handler)
                handler.close()

        return df.mapInArrow(go, df.schema)

    def on_send(self, records: DataFrame) -> DataFrame:
        return self._told(records, lambda r: (logging.INFO, f"Sending: topic={r.get('topic')} part={r.get('part')} key={r.get('key')}"))

    def on_result(self, results: DataFrame) -> DataFrame:
        return self._told(results, lambda r: (logging.WARNING, f"Not sent: topic={r.get('topic')} error={r['error']}") if r.get("error") else (logging.INFO, f"Sent: topic={r.get('topic')} part={r.get('part')} off={r.get('off')}"))

    def on_receive(self, records: DataFrame) -> DataFrame:
        return self._told(records, lambda r: (logging.INFO, f"Received: topic={r.get('topic')} part={r.get('part')} off={r.get('off')} key={r.get('key')}"))

    def on_commit(self, commits: DataFrame) -> DataFrame:
        return self._told(commits, lambda r: (logging.INFO, f"Committed: part={r.get('part')} off={r.get('commit_off')}"))


def outbound(df: DataFrame, topic: Column | str, key: Column, value: Column, headers: Column | None = None, keep_headers: bool = False) -> DataFrame:
    """(topic, key, value, headers) and the columns of df that have other names; headers are empty unless kept."""
    none = F.create_map().cast("map<string,string>")
    out = {"topic": F.lit(topic) if isinstance(topic, str) else topic, "key": key.cast("string"), "value": value, "headers": headers if keep_headers and headers is not None else none}
    return df.select(*(c.alias(n) for n, c in out.items()), *(c for c in df.columns if c not in out))


def sent(records: DataFrame, failed: Column, group: str, pos: str, stop_on_error: bool = False) -> DataFrame:
    """`result` of each record: SENT or FAILED; if an error stops the sender, what comes after a group's first is UNSENT. That is a
    minimum a group, combined before it is shuffled."""
    x = records.withColumn("_failed", F.coalesce(failed, F.lit(False)))
    done = F.when(F.col("_failed"), "FAILED").otherwise("SENT")
    if not stop_on_error:
        return x.withColumn("result", done).drop("_failed")
    first = x.where("_failed").groupBy(group).agg(F.min(pos).alias("_first"))
    return x.join(first, group, "left").withColumn("result", F.when(F.col(pos) > F.col("_first"), "UNSENT").otherwise(done)).drop("_failed", "_first")


def await_assignment(query: Any, timeout: float = 60, sleep=time.sleep) -> bool:
    """Waits until a started query has made its first progress, so that it has been given its partitions."""
    end = time.monotonic() + timeout
    while query.lastProgress is None:
        if not query.isActive or time.monotonic() > end:
            return False
        sleep(0.05)
    return True


def receive(spark: SparkSession, topics: list[str], options: dict[str, str], max_in_flight: int | None = None) -> DataFrame:
    """Records of the topics; offsets are kept in the query's checkpoint. max_in_flight bounds a micro-batch."""
    check(options)
    r = spark.readStream.format("kafka").options(**options).option("subscribe", ",".join(topics)).option("includeHeaders", "true")
    return (r.option("maxOffsetsPerTrigger", str(max_in_flight)) if max_in_flight else r).load()


def receive_grouped(spark: SparkSession, topics: list[str], options: dict[str, str], max_in_flight: int | None = None, pregroup=lambda df: df) -> DataFrame:
    """The records of each topic's partition together, in tasks of their own."""
    return grouped(receive(spark, topics, options, max_in_flight), pregroup, "partition")


def auto_trigger(interval: timedelta = AUTO_ACK[0]) -> dict[str, str]:
    """For `writeStream.trigger`: positions are committed once an interval, when its batch has been written, whatever was made of it."""
    return {"processingTime": f"{max(interval.total_seconds(), 0):g} seconds"}


def send(df: DataFrame, options: dict[str, str], checkpoint: str, headers: bool = False):
    """Writes (topic, key, value[, headers]); headers are stripped unless asked for."""
    check(options)
    df = df if headers or "headers" not in df.columns else df.drop("headers")
    return df.writeStream.format("kafka").options(**options).option("checkpointLocation", checkpoint).option("includeHeaders", str(headers).lower()).start()


def values(df: DataFrame) -> DataFrame:
    """Records with a value; what has none is done with."""
    return df.where("value is not null")


def grouped(records: DataFrame, pregroup=lambda df: df, partition: str = "part", n: int | None = None) -> DataFrame:
    """Records dealt by topic and partition after `pregroup` has seen them; so operators with a state by partition find them together."""
    keys = [F.col("topic"), F.col(partition)]
    return pregroup(records).repartition(*([n] if n else []), *keys)
