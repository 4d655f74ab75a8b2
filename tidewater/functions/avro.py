"""Avro records in the registry's wire frame: schemas from Spark types, binary coding, reading under another schema.

Spark's own Avro functions need a jar that may be absent; these code Arrow batches in Python workers.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Schema = Any  # an Avro schema as read from JSON

# The frame's first byte, the primitive types, what a written type may be read as, and class tags of arrays.
MAGIC = b"\0"
PRIMITIVES = {"string": "string", "binary": "bytes", "int": "int", "bigint": "long", "float": "float", "double": "double", "boolean": "boolean", "smallint": "int", "tinyint": "int"}
PROMOTED = {"int": {"long", "float", "double"}, "long": {"float", "double"}, "float": {"double"}, "string": {"bytes"}, "bytes": {"string"}}
CLASS, SET, SORTED_SET = "java-class", "java.util.Set", "java.util.SortedSet"


# schema algebra
def kind(schema: Schema) -> str:
    return "union" if isinstance(schema, list) else schema["type"] if isinstance(schema, dict) else schema


def is_null(schema: Schema) -> bool:
    return kind(schema) == "null"


def is_nullable(schema: Schema) -> bool:
    return kind(schema) == "union" and any(map(is_null, schema))


def make_nullable(schema: Schema) -> Schema:
    if is_null(schema) or is_nullable(schema):
        return schema
    return ["null", *(schema if kind(schema) == "union" else [schema])]


def reduce_non_null(schema: Schema) -> Schema | None:
    """A union's first type that is not null; a null schema has none."""
    if kind(schema) == "union":
        return next((s for s in schema if not is_null(s)), "null")
    return None if is_null(schema) else schema


def schema_of(t: T.DataType, name: str = "Record", nullable: bool = False, metadata: dict | None = None) -> Schema:
    """The Avro schema of a Spark type. An array whose field has `java-class` in its metadata keeps that tag."""
    if isinstance(t, T.StructType):
        out: Schema = {"type": "record", "name": name, "fields": [{"name": f.name, "type": schema_of(f.dataType, f"{name}_{f.name}", f.nullable, f.metadata), **({"default": None} if f.nullable else {})} for f in t]}
    elif isinstance(t, T.ArrayType):
        out = {"type": "array", "items": schema_of(t.elementType, f"{name}_item", t.containsNull)} | ({CLASS: metadata[CLASS]} if metadata and CLASS in metadata else {})
    elif isinstance(t, T.MapType):
        out = {"type": "map", "values": schema_of(t.valueType, f"{name}_value", t.valueContainsNull)}
    elif t.simpleString() in PRIMITIVES:
        out = PRIMITIVES[t.simpleString()]
    else:
        raise ValueError(f"no Avro type for {t.simpleString()}")
    return make_nullable(out) if nullable else out


# binary coding
def _long(n: int) -> bytes:
    n, out = (n << 1) ^ (n >> 63), bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def encode(v: Any, schema: Schema) -> bytes:
    """A value's payload. Of a union the first branch is taken that fits a null or other value."""
    k = kind(schema)
    if k == "union":
        at = next(i for i, s in enumerate(schema) if is_null(s) == (v is None))
        return _long(at) + encode(v, schema[at])
    if k == "null":
        return b""
    if v is None:
        raise ValueError(f"null where {k} is written")
    if k == "record":
        return b"".join(encode(v.get(f["name"]), f["type"]) for f in schema["fields"])
    if k == "array":
        return (_long(len(v)) + b"".join(encode(x, schema["items"]) for x in v) if v else b"") + b"\0"
    if k == "map":
        pairs = list(v.items() if isinstance(v, dict) else v)
        return (_long(len(pairs)) + b"".join(encode(a, "string") + encode(b, schema["values"]) for a, b in pairs) if pairs else b"") + b"\0"
    if k in ("int", "long"):
        return _long(int(v))
    if k in ("float", "double"):
        return struct.pack("<f" if k == "float" else "<d", v)
    if k == "boolean":
        return b"\1" if v else b"\0"
    raw = v.encode() if isinstance(v, str) else bytes(v)
    return _long(len(raw)) + raw


class Reader:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.raw):
            raise ValueError("payload ends early")
        self.at += n
        return self.raw[self.at - n : self.at]

    def long(self) -> int:
        n = shift = 0
        while True:
            b = self.take(1)[0]
            n |= (b & 0x7F) << shift
            if b < 0x80:
                return (n >> 1) ^ -(n & 1)
            shift += 7

    def blocks(self):
        while n := self.long():
            if n < 0:
                self.long()
            yield from range(abs(n))

    def value(self, schema: Schema) -> Any:
        k = kind(schema)
        if k == "union":
            return self.value(schema[self.long()])
        if k == "record":
            return {f["name"]: self.value(f["type"]) for f in schema["fields"]}
        if k == "array":
            return [self.value(schema["items"]) for _ in self.blocks()]
        if k == "map":
            return {self.value("string"): self.value(schema["values"]) for _ in self.blocks()}
        if k in ("int", "long"):
            return self.long()
        if k in ("float", "double"):
            return struct.unpack("<f" if k == "float" else "<d", self.take(4 if k == "float" else 8))[0]
        if k == "boolean":
            return self.take(1) == b"\1"
        if k == "null":
            return None
        raw = self.take(self.long())
        return raw.decode() if k == "string" else raw


def resolve(v: Any, writer: Schema, reader: Schema) -> Any:
    """A written value as the reader's schema sees it: fields that it lacks are ignored, those that only it has take their default;
    arrays that it tags as sets are distinct, as sorted sets sorted too."""
    if v is None:
        if is_null(reader) or is_nullable(reader):
            return None
        raise ValueError("null where the reader has none")
    w, r = reduce_non_null(writer), reduce_non_null(reader)
    kw, kr = kind(w), kind(r)
    if kr != kw and kr not in PROMOTED.get(kw, ()):
        raise ValueError(f"{kw} cannot be read as {kr}")
    if kr == "record":
        written, out = {f["name"]: f["type"] for f in w["fields"]}, {}
        for f in r["fields"]:
            if f["name"] in written:
                out[f["name"]] = resolve(v[f["name"]], written[f["name"]], f["type"])
            elif "default" in f or is_nullable(f["type"]):
                out[f["name"]] = f.get("default")
            else:
                raise ValueError(f"no value for {f['name']}")
        return out
    if kr == "array":
        items = [resolve(x, w["items"], r["items"]) for x in v]
        tag = r.get(CLASS) if isinstance(r, dict) else None
        if tag in (SET, SORTED_SET):
            items = list(dict.fromkeys(items))
        return sorted(items) if tag == SORTED_SET else items
    if kr == "map":
        return {a: resolve(b, w["values"], r["values"]) for a, b in v.items()}
    if kr in ("float", "double"):
        return float(v)
    return v.encode() if kr == "bytes" and kw == "string" else v.decode() if kr == "string" and kw == "bytes" else v


def default_instance(schema: Schema) -> Any:
    return {f["name"]: f.get("default") for f in schema["fields"]} if kind(schema) == "record" else None


# registry and subjects
def topic_subject(topic: str, is_key: bool = False) -> str:
    return f"{topic}-{'key' if is_key else 'value'}"


def topic_class_subject(topic: str, class_name: str | None, is_key: bool = False) -> str:
    """The topic's subject and the class's name as it prints itself, that of "nothing" for no class."""
    return f"{topic_subject(topic, is_key)}-class {class_name or 'java.lang.Void'}"


class Registry:
    """Schemas by number; equal ones of one subject have one number. Lives on the driver; workers get a copy with a plan."""

    def __init__(self):
        self.by_id: dict[int, Schema] = {}
        self.by_subject: dict[str, dict[str, int]] = {}
        self._written: dict[tuple[str, str], Schema] = {}

    def register(self, subject: str, schema: Schema) -> int:
        known, text = self.by_subject.setdefault(subject, {}), json.dumps(schema, sort_keys=True)
        if text not in known:
            known[text] = next((i for i, s in self.by_id.items() if json.dumps(s, sort_keys=True) == text), len(self.by_id) + 1)
            self.by_id[known[text]] = schema
        return known[text]

    def versions(self, subject: str) -> list[Schema]:
        return [json.loads(x) for x in self.by_subject.get(subject, {})]

    def writer_schema(self, topic: str, is_key: bool, class_name: str, load: Callable[[], Schema], caching: bool = False) -> Schema:
        """Loaded for each use, or, with caching, once for a class and subject."""
        at = (topic_subject(topic, is_key), class_name)
        if not caching or at not in self._written:
            self._written[at] = load()
        return self._written[at]


# columns
def serialize(c: Column, schema: Schema, schema_id: int) -> Column:
    """A struct as a framed record; null stays null."""

    @F.arrow_udf("binary")
    def run(rows: pa.Array) -> pa.Array:
        head = MAGIC + schema_id.to_bytes(4, "big")
        return pa.array([None if v is None else head + encode(v, schema) for v in rows.to_pylist()], pa.binary())

    return run(c)


def deserialize(c: Column, out: T.DataType, schemas: dict[int, Schema], load_reader: Callable[[Schema], Schema] | None = None, read_null_on_failure: bool = False, empty_is_default: bool = False) -> Column:
    """Framed records read under the schema that `load_reader` makes of the writer's, or, if it fails or is missing, the writer's own.

    Null and empty frames are null. An unknown number is an error. So is any other failure, unless it is to be read as null.
    empty_is_default: a frame without payload is a record of defaults.
    """
    schemas = dict(schemas)

    @F.arrow_udf(out)
    def run(frames: pa.Array) -> pa.Array:
        readers: dict[int, Schema] = {}

        def reader_of(number: int) -> Schema:
            if number not in readers:
                try:
                    readers[number] = load_reader(schemas[number]) if load_reader else schemas[number]
                except Exception:  # noqa: BLE001  as its writer meant it
                    readers[number] = schemas[number]
            return readers[number]

        def one(raw: bytes | None) -> Any:
            if not raw:
                return None
            number = int.from_bytes(raw[1:5], "big")
            try:
                if raw[:1] != MAGIC or len(raw) < 5:
                    raise ValueError("unknown magic byte")
                if number in schemas:
                    reader = reader_of(number)
                    return default_instance(reader) if empty_is_default and len(raw) == 5 else resolve(Reader(raw[5:]).value(schemas[number]), schemas[number], reader)
            except Exception:
                if read_null_on_failure:
                    return None
                raise
            raise LookupError(f"no schema with number {number}")

        from pyspark.sql.pandas.types import to_arrow_type

        plain = lambda v: {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else v
        return pa.array([plain(one(x)) for x in frames.to_pylist()], to_arrow_type(out))

    return run(c)
