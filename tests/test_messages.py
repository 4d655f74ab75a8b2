"""Messages, topics, adapters, senders, Avro records and configuration providers."""

import logging
import threading
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions import avro, config
from tidewater.operators import envelope
from tidewater.sources import adapters, kafka, messages
from tidewater.sources.topics import Topics, timer


def test_message_defaults(spark):
    m = spark.range(2).select(messages.to_queue(F.lit("x"), "q").alias("m")).collect()
    assert [(r.m.exchange, r.m.routing_key, r.m.properties.content_type, r.m.properties.delivery_mode, r.m.properties.priority, r.m.body) for r in m] == [("", "q", "application/octet-stream", 2, 0, "x")] * 2
    assert len({r.m.properties.message_id for r in m}) == 2


class Upper:
    def configure(self, c):
        self.tail = c["tail"]

    def __call__(self, m):
        return m.withField("body", F.concat(F.upper(m["body"]), F.lit(self.tail)))


def test_interceptors_by_configuration(spark):
    chain = messages.interceptors({messages.INTERCEPTORS: "tests.test_messages.Upper", "tail": "!"})
    m = spark.range(1).select(messages.intercepted(messages.to_queue(F.lit("x"), "q"), chain).alias("m")).first().m
    assert m.body == "X!" and messages.interceptors({}) == []


def test_safe_acknowledgement():
    seen = []
    messages.safely(lambda: seen.append("acked"), seen.append)
    messages.safely(lambda: 1 / 0, seen.append)
    assert seen[0] == "acked" and isinstance(seen[1], ZeroDivisionError)


def test_topic_reaches_every_subscriber(spark, tmp_path):
    topics = Topics(spark, str(tmp_path / "topics"))
    t = topics.named("t")
    assert topics.named("t") is t
    frame = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    t.send(frame("a", "b"))
    first = t.receive()
    t.send(frame("c"))
    second = t.receive()
    t.send(frame("d"), 7)
    for n, (stream, want) in enumerate([(first, "abcd"), (second, "d")]):
        got = []
        adapters.synchronous(lambda: stream.writeStream.foreachBatch(adapters.each_row(lambda r: got.append(r.value))).option("checkpointLocation", f"{tmp_path}/ck{n}").trigger(availableNow=True).start(), timedelta(seconds=60))  # noqa: B023
        assert "".join(sorted(got)) == want


def test_synchronous_times_out(spark, tmp_path):
    q = lambda: timer(spark).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/ck").start()
    with pytest.raises(TimeoutError):
        adapters.synchronous(q, timedelta(seconds=0.2))


def test_consumers(spark, caplog):
    df, seen = spark.createDataFrame([(1, None), (2, "bad")], "id long, error string"), []

    def fail(batch, n):
        raise ValueError("no")

    adapters.consuming(fail, lambda b, n: seen.append([r.error for r in b.collect()]))(df, 1)
    adapters.consuming(lambda b, n: seen.append(b.count()), fail)(df, 1)
    assert seen == [["ValueError: no"] * 2, 2]
    with caplog.at_level(logging.INFO):
        adapters.ack_on_terminate(fail)(df, 3)
        adapters.logging_results()(df, 1)
        adapters.logging_outcomes()(df.withColumn("status", F.lit("ACKED")).limit(1), 1)
    assert "batch 3 is done with" in caplog.text and caplog.text.count("Result has an error") == 1 and "ACKED: Row" in caplog.text


def test_senders_are_kept(spark):
    made = []

    def make():
        made.append(1)
        return lambda b: len(made)

    send, each = adapters.sending(make), adapters.sending_per_thread(make)
    assert (send(None), send(None)) == (1, 1)
    each(None)
    t = threading.Thread(target=lambda: (each(None), each(None)))
    t.start()
    t.join()
    assert len(made) == 3


def test_sender_settings():
    assert kafka.sender_settings({}) == {"max_in_flight": None, "headers": False, "stop_on_error": False, "resubscribe": True}
    s = kafka.sender_settings({"sender.max.in.flight.per.send": 8, "max.in.flight": "4", "stop.on.error": "true", "resubscribe.on.error": False, "headers.enabled": True})
    assert s == {"max_in_flight": 4, "headers": True, "stop_on_error": True, "resubscribe": False}
    assert kafka.in_flight({"receiver.max.in.flight.per.subscription": "5"}, kafka.RECEIVER_IN_FLIGHT) == 5
    a, b = kafka.unique_client_id("c"), kafka.unique_client_id("c")
    assert a == "c-1" and b == "c-2" and kafka.unique_client_id("d") == "d-1"


def test_outbound_headers(spark):
    df = spark.createDataFrame([(1, {"a": "b"})], "id long, headers map<string,string>")
    out = lambda keep: kafka.outbound(df, "t", F.col("id"), F.lit("v"), F.col("headers"), keep).first()
    assert out(False).headers == {} and out(True).headers == {"a": "b"} and out(True).key == "1" and out(True).topic == "t"


class Given:
    def __init__(self, **x):
        self.x = x

    def __call__(self, specifier):
        return {**self.x, "from": specifier}


class Named:
    def configure(self, c):
        self.c = c

    def __call__(self, specifier):
        return {"seen": self.c["a"], "b": "named"}


def test_providers_replace_what_is_there():
    got = config.create({"specifier": "x", "a": "0", "b": "1", "providers": [Given(a="given", b="first"), Given(b="second"), "tests.test_messages.Named"]}, required=("seen",))
    assert (got["a"], got["b"], got["from"], got["seen"]) == ("given", "named", "x", "0") and "providers" in got
    got = config.create({"specifier": "x", "providers": [Given(a="given")]}, environment={"config.override.a": "over", "config.override.x.b": "new"})
    assert got["a"] == "over" and got["b"] == "new"


def test_avro_values():
    s = avro.schema_of(T.StructType.fromDDL("a int, b array<string>, c map<string,bigint>, d struct<x:boolean>, e binary, f float"))
    v = {"a": -1234567, "b": ["x", "é", None], "c": {"k": 1 << 40}, "d": {"x": True}, "e": b"\0\1", "f": 0.5}
    raw = avro.encode(v, s)
    assert avro.Reader(raw).value(s) == v and avro.resolve(v, s, s) == v
    assert avro.encode(64, "long") == b"\x80\x01" and avro.encode(-1, "int") == b"\x01" and avro.encode("foo", "string") == b"\x06foo"
    assert avro.Reader(b"\x01\x04\x02\x00").value({"type": "array", "items": "long"}) == [1]  # a block that gives its size
    with pytest.raises(ValueError):
        avro.Reader(raw[:5]).value(s)
    with pytest.raises(ValueError):
        avro.encode(None, "string")


def test_avro_resolution_and_algebra():
    w = {"type": "record", "name": "R", "fields": [{"name": "x", "type": "int"}, {"name": "y", "type": ["null", "string"]}]}
    field = lambda *f: {"type": "record", "name": "R", "fields": list(f)}
    v = {"x": 3, "y": None}
    assert avro.resolve(v, w, field({"name": "x", "type": "double"}, {"name": "z", "type": ["null", "int"]})) == {"x": 3.0, "z": None}
    for bad in (field({"name": "x", "type": "string"}), field({"name": "z", "type": "int"}), field({"name": "y", "type": "string"})):
        with pytest.raises(ValueError):
            avro.resolve(v, w, bad)
    assert avro.make_nullable("int") == ["null", "int"] and avro.make_nullable(["null", "int"]) == ["null", "int"] and avro.make_nullable("null") == "null"
    assert avro.reduce_non_null(["null", "int"]) == "int" and avro.reduce_non_null("null") is None and avro.reduce_non_null("int") == "int"
    tag = avro.schema_of(T.StructType([T.StructField("s", T.ArrayType(T.StringType(), False), False, {avro.CLASS: avro.SET})]))
    assert tag["fields"][0]["type"][avro.CLASS] == avro.SET
    assert avro.resolve({"s": ["b", "a", "b"]}, tag, tag) == {"s": ["b", "a"]}


def test_avro_registry_and_subjects():
    r, loads = avro.Registry(), []
    assert r.register("a", "int") == r.register("a", "int") == r.register("b", "int") == 1 and r.register("a", "long") == 2
    assert r.versions("a") == ["int", "long"] and r.versions("none") == []
    for _ in range(2):
        r.writer_schema("t", False, "C", lambda: loads.append(1) or "int", caching=True)
        r.writer_schema("t", True, "C", lambda: loads.append(1) or "int")
    assert len(loads) == 3
    assert avro.topic_subject("t") == "t-value" and avro.topic_class_subject("t", "x.Y", True) == "t-key-class x.Y" and avro.topic_class_subject("t", None) == "t-value-class java.lang.Void"


def test_avro_frames(spark):
    out = T.StructType.fromDDL("a int")
    schema = avro.schema_of(out)
    frames = spark.createDataFrame([(1, b"\0\0\0\0\x01" + avro.encode({"a": 5}, schema)), (2, None), (3, b""), (4, b"\0\0\0\0\x01"), (5, b"\0\0\0\0\x09\x00"), (6, b"\x01\0\0\0\x01\x00")], "id int, f binary")
    read = lambda ids, **kw: [r.a and r.a.a for r in frames.where(F.col("id").isin(ids)).orderBy("id").select(avro.deserialize(F.col("f"), out, {1: schema}, **kw).alias("a")).collect()]
    assert read([1, 2, 3]) == [5, None, None] and read([4], empty_is_default=True) == [None]
    assert read([1, 6], read_null_on_failure=True) == [5, None]
    for bad, kw in (([6], {}), ([4], {}), ([5], {"read_null_on_failure": True})):
        with pytest.raises(Exception, match="magic|early|no schema"):
            read(bad, **kw)


def test_scheduling(spark):
    df = spark.range(100, numPartitions=6)
    n = lambda kind, p=None: envelope.scheduled(df, kind, p).rdd.getNumPartitions()
    assert (n("IMMEDIATE"), n("SINGLE"), n("PARALLEL", 3)) == (6, 1, 3) and n("BOUNDED_ELASTIC", 10_000) == 80
    with pytest.raises(ValueError):
        envelope.scheduled(df, "OTHER")


def test_murmur(spark):
    from tidewater.functions import murmur
    from tidewater.operators import grouping

    known = {b"": 0, b"test": 0xBA6BD213, b"Hello, world!": 0xC0363E43, b"The quick brown fox jumps over the lazy dog": 0x2E4FF723}
    assert [int(h) & 0xFFFFFFFF for h in murmur.hashes(list(known))] == list(known.values())
    df = spark.createDataFrame([("a\u00e9\U0001f600",), (None,), ("null",)], "s string")
    got = [r.h for r in df.select(murmur.murmur3_text(F.col("s")).alias("h")).collect()]
    assert got == murmur.hashes(["a\u00e9\U0001f600".encode("utf-16-le"), "null".encode("utf-16-le")]).tolist() + got[1:2]
    u = spark.createDataFrame([("01020304-0506-0708-090a-0b0c0d0e0f10",), (None,)], "u string")
    assert [r.h for r in u.select(murmur.murmur3_uuid(F.col("u")).alias("h")).collect()] == murmur.hashes([bytes(range(1, 17)), bytes(16)]).tolist()
    groups = spark.range(2000).select(grouping.murmur_group(F.col("id"), 16).alias("g")).groupBy("g").count().collect()
    assert {r.g for r in groups} == set(range(16)) and max(r["count"] for r in groups) < 200
    assert grouping.groups_or_default(3, spark) == 3 and grouping.groups_or_default(0, spark) == grouping.groups_or_default(None, spark) == spark.sparkContext.defaultParallelism


def test_bodies_through_a_queue(spark, tmp_path):
    from tidewater.sources import queue

    spark.createDataFrame([("a",), ("b",)], "value string").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("value string").parquet(f"{tmp_path}/in")
    create = lambda v: messages.to_exchange(F.upper(v), "x", "k", message_id=F.concat(F.lit("id-"), v))
    adapters.synchronous(lambda: queue.send_bodies(stream, f"{tmp_path}/q", f"{tmp_path}/ck", create).trigger(availableNow=True).start(), timedelta(seconds=60))
    got = []
    q = queue.consume(spark, f"{tmp_path}/q").writeStream.foreachBatch(lambda df, n: got.extend((r.topic, r.key, r.value) for r in df.collect())).option("checkpointLocation", f"{tmp_path}/ck2").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(got) == [("x/k", "id-a", "A"), ("x/k", "id-b", "B")]


def test_progress_metrics():
    from types import SimpleNamespace as N

    from tidewater.streaming.pipeline import progress_metrics

    p = N(name="q", sources=[N(description="s", metrics={"lag": "3", "state": "up"})])
    tags = {"description": "s", "query": "q"}
    assert progress_metrics(p, ["state"]) == [("source", "lag", tags, 3.0)] and progress_metrics(p, ["lag"], True) == [("source", "lag", tags, 3.0)]
    assert [v for _, n, _, v in progress_metrics(p, ["lag"]) if n == "state"][0] != 0
