"""Work types, and ISO-8601 durations with an explicit empty value."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Work types by growing relevance.
WORK_TYPES = ("INTENT", "RETRY", "CANCEL", "COMMIT")
CANCEL, COMMIT = 2, 3

RECORD = "topic string, part bigint, off bigint, us bigint, key string, value string, headers map<string,string>"
WORK = "type string, marker string, subject string, inception_ms bigint, recycle_count bigint, prepared boolean"
SEND_RESULT = "topic string, key string, value string, headers map<string,string>, error string"
AMQP_MESSAGE = "exchange string, routing_key string, properties struct<message_id:string,content_type:string,delivery_mode:int,headers:map<string,string>>, body binary"


def work_type_rank(c: str | Column) -> Column:
    """Relevance; an unknown type counts as INTENT."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.lit(0)
    for i, t in enumerate(WORK_TYPES):
        out = F.when(c == t, i).otherwise(out)
    return out


_ISO = re.compile(r"^([-+]?)P(?:([-+]?\d+)D)?(?:T(?=[-+\d])(?:([-+]?\d+)H)?(?:([-+]?\d+)M)?(?:([-+]?\d+(?:\.\d+)?)S)?)?$", re.I)


def duration(text: str) -> timedelta | None:
    """An ISO-8601 duration of days to seconds; None for EMPTY. Raises ValueError otherwise."""
    if text == "EMPTY":
        return None
    m = _ISO.match(text)
    if not m or not any(m.groups()[1:]):
        raise ValueError(f"not a duration: {text!r}")
    d, h, mi, s = (float(x or 0) for x in m.groups()[1:])
    out = timedelta(days=d, hours=h, minutes=mi, seconds=s)
    return -out if m[1] == "-" else out


def micros(d: timedelta) -> int:
    return (d.days * 86_400 + d.seconds) * 1_000_000 + d.microseconds


@dataclass(frozen=True)
class WindowConfig:
    """How long a window stays open after its first element, and how many it holds at most (None: any number)."""

    duration: timedelta = timedelta(seconds=1)
    max_size: int | None = None

    @property
    def enabled(self) -> bool:
        return self.duration > timedelta(0)


DEDUPLICATION = WindowConfig()
WORK_BUFFER = WindowConfig(timedelta(seconds=10), 8)
AUTO_ACK = (timedelta(seconds=5), timedelta(seconds=5))
RESUBSCRIBE_DELAY = timedelta(seconds=20)
