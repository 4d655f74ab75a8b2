"""Schema evolution: whether rows written under one schema can be read under another, and against all registered versions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import types as T

# What a written type may be read as, besides itself.
PROMOTIONS = {
    "int": {"bigint", "float", "double"},
    "bigint": {"float", "double"},
    "float": {"double"},
    "string": {"binary"},
    "binary": {"string"},
}


class UnknownSubject(LookupError):
    """The registry has no such subject."""


class RegistryError(RuntimeError):
    """The registry refused to answer."""


def can_read(reader: T.DataType, writer: T.DataType) -> bool:
    """Written fields that the reader lacks are ignored; a field that only the reader has must be nullable."""
    if isinstance(reader, T.StructType) and isinstance(writer, T.StructType):
        written = {f.name: f for f in writer}
        return all(f.nullable if f.name not in written else _field(f.dataType, f.nullable, written[f.name].dataType, written[f.name].nullable) for f in reader)
    if isinstance(reader, T.ArrayType) and isinstance(writer, T.ArrayType):
        return _field(reader.elementType, reader.containsNull, writer.elementType, writer.containsNull)
    if isinstance(reader, T.MapType) and isinstance(writer, T.MapType):
        return can_read(reader.keyType, writer.keyType) and _field(reader.valueType, reader.valueContainsNull, writer.valueType, writer.valueContainsNull)
    return reader == writer or reader.simpleString() in PROMOTIONS.get(writer.simpleString(), ())


def _field(reader: T.DataType, reader_null: bool, writer: T.DataType, writer_null: bool) -> bool:
    return (reader_null or not writer_null) and can_read(reader, writer)


def compatible(schema: T.StructType, versions: Callable[[], Iterable[T.StructType]]) -> bool:
    """Whether schema reads every registered version. An unknown subject has none, so all is compatible; a registry that refuses
    makes it incompatible; any other failure to ask is not held against the schema."""
    try:
        known = list(versions())
    except UnknownSubject:
        return True
    except RegistryError:
        return False
    except Exception:  # noqa: BLE001
        return True
    return all(can_read(schema, v) for v in known)
