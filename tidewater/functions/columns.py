"""Scalar functions over columns: headers, names, predicates, codecs. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that names in metrics are recognised by.
UUID = r"-?[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}"
STREAM_THREAD = r"^(?:(.+?)-)??StreamThread-(\d+)(?:-(.+))??$"
AVRO_MAGIC = "00"


# headers
def last_wins(entries: Column) -> Column:
    """array<struct<key, value>> as a map in which the last of equal keys counts."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"].alias("value"))))


def put_unique(headers: Column, key: str, value: Column) -> Column:
    return F.map_concat(F.map_filter(headers, lambda k, v: k != key), F.create_map(F.lit(key), value))


def baggage(headers: Column, reserved: list[str]) -> Column:
    """Headers that are neither tags nor span context."""
    return F.map_filter(headers, lambda k, v: ~k.isin(reserved))


def header_tags(headers: Column, wanted: list[str]) -> Column:
    return F.map_filter(headers, lambda k, v: k.isin(wanted) & v.isNotNull())


def stringify_value(c: Column, kind: str) -> Column:
    """A header value as text: decimals plain, dates in ISO form in UTC, bytes as UTF-8; collections and maps are dropped (null)."""
    if kind in ("array", "map", "struct"):
        return F.lit(None).cast("string")
    if kind == "timestamp":
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    return F.decode(c, "UTF-8") if kind == "binary" else c.cast("string")


def render_map(m: Column) -> Column:
    """A map as text, by sorted key: k=v,k=v."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


# names
def strip_uuid(c: Column) -> Column:
    return F.regexp_replace(c, UUID, "")


def after_last(c: Column, mark: str) -> Column:
    return F.substring_index(c, mark, -1)


def sanitize_client_id(c: Column) -> Column:
    return F.regexp_replace(c, r"-\d+$", "")


def stream_thread(c: Column) -> list[Column]:
    """(prefix, thread number, client type) of a stream thread's client id, each null where it is missing or the id is of another kind."""
    return [F.when(c.rlike(STREAM_THREAD), F.nullif(F.regexp_extract(c, STREAM_THREAD, i), F.lit(""))) for i in (1, 2, 3)]


def client_tags(c: Column) -> Column:
    """The tags of a client id: without UUIDs, of a stream thread its prefix (the whole id if it has none), number and client type."""
    prefix, thread, kind = stream_thread(c)
    tags = {"client-id": strip_uuid(F.coalesce(prefix, c)), "stream-thread": thread, "client-type": kind}
    return F.map_filter(F.create_map(*(x for k, v in tags.items() for x in (F.lit(k), v))), lambda k, v: v.isNotNull())


def tagged_name(name: Column, tags: Column) -> Column:
    return F.when(F.size(tags) > 0, F.concat(name, F.lit(".("), render_map(tags), F.lit(")"))).otherwise(name)


# numbers and predicates
def finite_or_zero(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")) | c.isNull(), 0.0).otherwise(c)


def numeric_or_nan(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(float("nan")))


def metric_reported(name: Column, names: list[str], whitelist: bool) -> Column:
    return F.lit(whitelist) == name.isin(names)


def is_prime(n: Column) -> Column:
    limit = F.floor(F.sqrt(n.cast("double"))).cast("bigint")
    return (n >= 2) & ((n < 4) | ~F.exists(F.sequence(F.lit(2).cast("bigint"), F.greatest(limit, F.lit(2))), lambda i: n % i == 0))


def always(value: bool = True) -> Column:
    return F.lit(value)


def since_inception(now_ms: Column, inception_ms: Column) -> Column:
    return now_ms - inception_ms


def incepted_after(a_ms: Column, b_ms: Column) -> Column:
    """Strictly: of two works incepted at the same time neither is after the other."""
    return a_ms > b_ms


# codecs
def avro_frame(payload: Column, schema_id: Column) -> Column:
    """The wire frame: a zero byte, the schema's number in four bytes, the payload."""
    return F.unhex(F.concat(F.lit(AVRO_MAGIC), F.lpad(F.hex(schema_id), 8, "0"), F.hex(payload)))


def avro_unframe(frame: Column) -> tuple[Column, Column, Column]:
    """(valid, schema id, payload); empty and null frames are null, a wrong first byte is not valid."""
    ok = F.hex(F.substring(frame, 1, 1)) == AVRO_MAGIC
    return ok, F.when(ok, F.conv(F.hex(F.substring(frame, 2, 4)), 16, 10).cast("bigint")), F.when(ok, F.substring(frame, F.lit(6), F.greatest(F.octet_length(frame), F.lit(1))))


def born_encode(ms: Column) -> Column:
    return F.unhex(F.lpad(F.hex(ms), 16, "0"))


def born_decode(b: Column) -> Column:
    """Eight big-endian bytes as a signed number; any other length is none."""
    half = lambda at: F.conv(F.hex(F.substring(b, at, 4)), 16, 10).cast("bigint")
    return F.when(F.octet_length(b) == 8, F.shiftleft(half(1), 32).bitwiseOR(half(5)))


def to_json(c: Column) -> Column:
    return F.to_json(c, {"ignoreNullFields": "false"})


def from_json(c: Column, schema: str = "map<string,string>") -> Column:
    """Unknown properties are ignored; broken or null input is null."""
    return F.from_json(c, schema)


def to_xml(c: Column, row_tag: str) -> Column:
    return F.to_xml(c, {"rowTag": row_tag, "indent": ""})


def from_xml(c: Column, schema: str, row_tag: str) -> Column:
    return F.from_xml(c, schema, {"rowTag": row_tag})
