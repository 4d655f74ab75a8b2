"""Messages to exchanges and queues: creation, interceptors, bodies, kinds of acknowledgement. Messages are struct columns."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable, Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.config import instantiate, to_collection

# The properties of a plain persistent message, the setting that names interceptors, kinds of negative acknowledgement
# as (requeue, multiple).
PERSISTENT_BASIC = {"content_type": "application/octet-stream", "delivery_mode": 2, "priority": 0}
INTERCEPTORS = "send-interceptor-classes"
NACKS = {"DISCARD_SINGLE": (False, False), "DISCARD_MULTIPLE": (False, True), "REQUEUE_SINGLE": (True, False), "REQUEUE_MULTIPLE": (True, True)}

Extractor = str | Column
Interceptor = Callable[[Column], Column]
log = logging.getLogger(__name__)


def _text(x: Extractor) -> Column:
    """A constant, or what a column says; null as the text "null"."""
    return F.lit(x) if isinstance(x, str) else F.coalesce(x.cast("string"), F.lit("null"))


def to_exchange(body: Column, exchange: Extractor, routing_key: Extractor, properties: Mapping[str, Any] = PERSISTENT_BASIC, headers: Column | None = None, message_id: Column | None = None) -> Column:
    """A message struct(exchange, routing_key, properties, body), with an id of its own."""
    none = F.lit(None).cast("map<string,string>")
    props = F.struct(
        (F.uuid() if message_id is None else message_id).alias("message_id"), F.lit(properties.get("content_type")).cast("string").alias("content_type"),
        F.lit(properties.get("delivery_mode")).cast("int").alias("delivery_mode"), F.lit(properties.get("priority")).cast("int").alias("priority"), (none if headers is None else headers).alias("headers"),
    )
    return F.struct(_text(exchange).alias("exchange"), _text(routing_key).alias("routing_key"), props.alias("properties"), body.alias("body"))


def to_queue(body: Column, queue: Extractor, properties: Mapping[str, Any] = PERSISTENT_BASIC, headers: Column | None = None, message_id: Column | None = None) -> Column:
    """To the exchange without a name, which hands a message to the queue that its key names."""
    return to_exchange(body, "", queue, properties, headers, message_id)


def intercepted(message: Column, interceptors: Iterable[Interceptor]) -> Column:
    """The message as the interceptors, in their order, make it."""
    return reduce(lambda m, f: f(m), interceptors, message)


def interceptors(config: Mapping[str, Any]) -> list[Interceptor]:
    """Those that the configuration names, made and configured in order."""
    out = [x if callable(x) and not isinstance(x, type) else instantiate(x) for x in to_collection(config.get(INTERCEPTORS))]
    for x in out:
        if hasattr(x, "configure"):
            x.configure(dict(config))
    return out


def bodies(messages: DataFrame, message: str = "message") -> tuple[DataFrame, DataFrame]:
    """(messages with their body as a column, messages without one, which are acknowledged)."""
    body = F.col(message)["body"]
    return messages.where(body.isNotNull()).withColumn("body", body), messages.where(body.isNull()).withColumn("status", F.lit("ACKED"))


def flags(nack: Column) -> Column:
    """struct(requeue, multiple) of a kind of negative acknowledgement; null for another."""
    out = F.lit(None).cast("struct<requeue:boolean,multiple:boolean>")
    for name, (requeue, multiple) in NACKS.items():
        out = F.when(nack == name, F.struct(F.lit(requeue).alias("requeue"), F.lit(multiple).alias("multiple"))).otherwise(out)
    return out


def confirmed(results: DataFrame, acked: Column) -> DataFrame:
    """`status` of sends by the broker's confirmation: what it did not take is NACKED."""
    return results.withColumn("status", F.when(F.coalesce(acked, F.lit(False)), "ACKED").otherwise("NACKED"))


def safely(signal: Callable[[], None], emit_error: Callable[[Exception], None]) -> None:
    """Signals to a broker; its failure goes into the stream instead of being raised where nobody sees it."""
    try:
        signal()
    except Exception as e:  # noqa: BLE001
        log.error("Could not acknowledge", exc_info=e)
        emit_error(e)
