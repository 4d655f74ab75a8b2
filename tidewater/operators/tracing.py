"""Traces: a tree of spans for what happens to a record, from its production over headers to the rows that are made of it.

A traced row has `span`, a struct of the trace's id, its own and its parent's, a name, a start, tags and logs. Ids are digests of the
ids above them, of the name and of a position, so that a task that runs again gives the same span again, once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.columns import header_tags, put_unique

# The headers that carry a span's context.
TRACE_ID, SPAN_ID = "trace-id", "span-id"
SPAN = "trace_id string, span_id string, parent_id string, name string, start_us bigint, tags map<string,string>, logs array<struct<event:string,us:bigint>>"
FINISHED = ("trace_id", "span_id", "parent_id", "name", "start_us", "end_us", "error", "tags", "logs")


def _span(trace: Column, parent: Column, name: Column, pos: Column, at: Column, tags: Column | None) -> Column:
    own = F.md5(F.concat_ws("/", F.coalesce(parent, trace), name, pos.cast("string")).cast("binary"))
    none = F.create_map().cast("map<string,string>")
    parts = {"trace_id": trace, "span_id": own, "parent_id": parent, "name": name, "start_us": at, "tags": none if tags is None else tags, "logs": F.array().cast("array<struct<event:string,us:bigint>>")}
    return F.struct(*(c.alias(n) for n, c in parts.items()))


def extracted(headers: Column) -> Column:
    """The context struct(trace_id, span_id) that headers carry; null without both."""
    there = headers[TRACE_ID].isNotNull() & headers[SPAN_ID].isNotNull()
    return F.when(there, F.struct(headers[TRACE_ID].alias("trace_id"), headers[SPAN_ID].alias("span_id")))


def injected(headers: Column, span: Column) -> Column:
    """The headers with the span's context in place of any other; null headers count as none."""
    none = F.create_map().cast("map<string,string>")
    return put_unique(put_unique(F.coalesce(headers, none), TRACE_ID, span["trace_id"]), SPAN_ID, span["span_id"])


def begun(df: DataFrame, name: str, key: Column, at: Column, headers: str = "headers", tags: list[str] = (), reference_parent: bool = True) -> DataFrame:
    """df with a span for each row: a child of the one that its headers tell of, else, or if parents are not to be referenced, the root
    of a trace of its own, known by `key`. Headers named in `tags` are the span's tags."""
    up = extracted(F.col(headers)) if reference_parent else F.lit(None).cast("struct<trace_id:string,span_id:string>")
    trace = F.coalesce(up["trace_id"], F.md5(key.cast("string").cast("binary")))
    kept = header_tags(F.coalesce(F.col(headers), F.create_map().cast("map<string,string>")), list(tags)) if tags else None
    return df.withColumn("span", _span(trace, up["span_id"], F.lit(name), F.lit(0), at, kept))


def child(df: DataFrame, name: str, pos: Column, at: Column) -> DataFrame:
    """df with a child of each row's span in its place: what a row is mapped, flat-mapped or published to, by position."""
    return df.withColumn("span", _span(F.col("span.trace_id"), F.col("span.span_id"), F.lit(name), pos, at, F.col("span.tags")))


def logged(df: DataFrame, event: str, at: Column) -> DataFrame:
    """df with an event more in its span's logs, in the order of calls."""
    entry = F.struct(F.lit(event).alias("event"), at.alias("us"))
    return df.withColumn("span", F.col("span").withField("logs", F.concat("span.logs", F.array(entry))))


def finished(df: DataFrame, end: Column, error: Column) -> DataFrame:
    """The rows' spans (trace_id, span_id, parent_id, name, start_us, end_us, error, tags, logs), closed by what became of their
    acknowledgement; end_us is null while that is open."""
    return df.select("span.*", end.alias("end_us"), error.alias("error")).select(*FINISHED)
