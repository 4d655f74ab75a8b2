"""Spans over headers, inner streams with ends of their own, interceptors and factories of records."""

import logging

import pytest
from pyspark.sql import functions as F

from tidewater.operators import envelope, publishing, tracing
from tidewater.sources import kafka


def test_spans_over_headers(spark):
    """A parent in the headers is the parent, or its trace is left; injecting again replaces the context; tags and logs stay."""
    df = spark.createDataFrame([(1, {"a": "x", "b": "y"}, 10), (2, None, 20), (3, {"trace-id": "t"}, 30), (4, {"trace-id": "t", "span-id": "s"}, 40)], "id long, headers map<string,string>, us long")
    x = tracing.begun(df, "produce", F.col("id"), F.col("us"), tags=["a", "c"])
    by = {r.id: r.span for r in x.collect()}
    assert by[4].trace_id == "t" and by[4].parent_id == "s" and by[3].parent_id is None and by[3].trace_id != "t" and by[1].tags == {"a": "x"} and by[2].tags == {}
    sent = x.withColumn("headers", tracing.injected(F.col("headers"), F.col("span")))
    got = tracing.begun(sent, "consume", F.lit("other"), F.col("us") + 1)
    for r in got.collect():
        assert (r.span.trace_id, r.span.parent_id) == (by[r.id].trace_id, by[r.id].span_id) and r.headers.get("a") == ("x" if r.id == 1 else None)
    alone = tracing.begun(sent, "consume", F.col("id"), F.col("us"), reference_parent=False).collect()
    assert all(r.span.parent_id is None for r in alone) and len({r.span.trace_id for r in alone}) == 4
    two = tracing.child(got, "map", F.lit(0), F.col("us")).unionByName(tracing.child(got, "map", F.lit(1), F.col("us")))
    two = tracing.logged(tracing.logged(two, "start-map", F.col("us")), "finish-map", F.col("us") + 2)
    spans = tracing.finished(two, F.col("us") + 5, F.when(F.col("id") == 1, "bad")).collect()
    assert len({r.span_id for r in spans}) == 8 and {r.error for r in spans} == {None, "bad"} and [e.event for e in spans[0].logs] == ["start-map", "finish-map"]
    assert sorted(map(repr, tracing.finished(two, F.col("us") + 5, F.lit(None).cast("string")).collect())) == sorted(map(repr, tracing.finished(two, F.col("us") + 5, F.lit(None).cast("string")).collect()))


def test_inner_streams(spark):
    """Elements before an error leave; an empty stream has an end; the ack waits for the end and for all elements."""
    df = spark.createDataFrame([(1, "a b"), (2, "a !b c"), (3, ""), (4, None), (5, "!")], "id long, text string")

    def mapper(text):
        for w in text.split():
            if w[0] == "!":
                raise ValueError(w)
            yield w

    out = publishing.published(df, "id", "text", mapper)
    got = {}
    for r in out.orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append((r.pos, r.value, r.end, r.error))
    assert got[1] == [(0, "a", None, None), (1, "b", None, None), (2, None, "COMPLETE", None)] and got[3] == [(0, None, "COMPLETE", None)]
    assert got[2] == [(0, "a", None, None), (1, None, "ERROR", "ValueError: !b")] and got[5] == [(0, None, "ERROR", "ValueError: !")] and got[4][0][2] == "ERROR"
    parents = spark.createDataFrame([(i,) for i in range(8)], "id long")
    ch = spark.createDataFrame([(0, 5, "ACK", None), (0, 9, "ACK", None), (1, 5, "ACK", None), (2, 5, "ACK", None), (2, None, "NACK", "x"), (3, 7, "NACK", "x"), (3, 6, "NACK", "y"), (4, 3, "ACK", None), (5, 8, "NACK", "x")], "id long, done_us long, outcome string, error string")
    ends = spark.createDataFrame([(0, "COMPLETE", 7, None), (1, "COMPLETE", 70, None), (2, "COMPLETE", 1, None), (3, "COMPLETE", 1, None), (4, "COMPLETE", None, None), (5, "ERROR", 4, "inner"), (6, "COMPLETE", 2, None)], "id long, end string, end_us long, error string")
    got = {r.id: tuple(r)[1:] for r in publishing.acknowledged(ch, ends, parents, "id").collect()}
    assert got == {0: (2, "ACK", 9, None), 1: (1, "ACK", 70, None), 2: (2, "PENDING", None, None), 3: (2, "NACK", 6, "y"), 4: (1, "PENDING", None, None), 5: (1, "NACK", 4, "inner"), 6: (0, "ACK", 2, None), 7: (0, "PENDING", None, None)}


class Named:
    def configure(self, config):
        self.name = config["name"]

    def create(self, df):
        return df.withColumn("made_by", F.lit(self.name))


def test_record_factories(spark):
    df = spark.range(3)
    assert kafka.record_factory({})(df).columns == envelope.acknowledgeable(df).columns
    for named in (Named, Named(), f"{__name__}.Named"):
        assert {r.made_by for r in kafka.record_factory({kafka.FACTORY: named, "name": "x"})(df).collect()} == {"x"}


def test_logging_interceptor(spark, tmp_path):
    path = f"{tmp_path}/log"
    i = kafka.LoggingInterceptor("records", lambda: logging.FileHandler(path))
    df = spark.createDataFrame([("t", 1, 7, "k", None), ("t", 2, 8, None, "refused")], "topic string, part long, off long, key string, error string").coalesce(1)
    for f in (i.on_send, i.on_receive, i.on_result):
        assert f(df).collect() == df.collect()
    assert i.on_commit(df.select("part", F.col("off").alias("commit_off"))).count() == 2
    lines = open(path).read().splitlines()
    assert lines[:2] == ["Sending: topic=t part=1 key=k", "Sending: topic=t part=2 key=None"] and "Received: topic=t part=2 off=8 key=None" in lines
    assert "Not sent: topic=t error=refused" in lines and "Sent: topic=t part=1 off=7" in lines


def test_failing_acknowledgement_is_told():
    from tidewater.sources.auto import Timer

    class Broken:
        interval = 1_000

        def acknowledge(self, now):
            raise OSError("no store")

    told = []
    t = Timer(Broken(), on_error=told.append)
    t.start()
    while len(told) < 3:
        pass
    t.stop()
    assert all(isinstance(e, OSError) for e in told)


def test_small_faults(spark):
    """The born codec with its top bit; works whose error is not known go round; a topic counts on in another application."""
    from tidewater.functions import columns as C
    from tidewater.operators import windows

    x = spark.createDataFrame([(-1,), (0,), (2**63 - 1,), (-(2**63),), (1_700_000_000_000,)], "n long").select("n", C.born_decode(C.born_encode(F.col("n"))).alias("m"))
    assert all(r.n == r.m for r in x.collect())
    w = spark.createDataFrame([(0, 0, None), (0, 0, "E1")], "inception_ms long, recycle_count long, error string")
    assert [r[0] for r in w.select(windows.recyclable(F.lit(1), 0, None, ["E1"], F.col("error"))).collect()] == [True, False]


@pytest.mark.parametrize("name", ["a"])
def test_topic_after_a_restart(spark, tmp_path, name):
    from tidewater.sources.topics import Topics

    def read(stream, ck):
        got = []
        stream.writeStream.foreachBatch(lambda df, n: got.extend(r.value for r in df.collect())).option("checkpointLocation", f"{tmp_path}/{ck}").trigger(availableNow=True).start().awaitTermination()
        return sorted(got)

    send = lambda t, *v: t.send(spark.createDataFrame([(x,) for x in v], "value string"))
    t = Topics(spark, f"{tmp_path}/t").named(name)
    send(t, "one", "two")
    t = Topics(spark, f"{tmp_path}/t").named(name)
    first, second = t.receive(), t.receive()
    send(t, "three")
    assert read(first, "x") == ["one", "three", "two"] and read(second, "y") == ["three"]
