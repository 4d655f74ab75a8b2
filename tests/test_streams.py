"""Streaming forms give the rows of the batch forms over the same table."""

import itertools
import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tidewater.functions.model import WindowConfig
from tidewater.operators import ack, qos, windows
from tidewater.plans import catalog
from tidewater.plans import views as V
from tidewater.sources.auto import AckLog, receive_auto, receive_auto_grouped
from tidewater.streaming import acks, buffers
from tidewater.streaming import qos as stream_qos

SF = "/root/testdata/sf0.001"
HOUR = 3_600_000_000
END = 1_893_456_000_000_000
_names = itertools.count()


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def fed(spark, folder, rows, schema, cuts):
    """A stream that gives rows[i:j] of the cuts in a batch each."""
    bounds = [0, *sorted(cuts), len(rows)]
    for i, j in zip(bounds[:-1], bounds[1:], strict=True):
        if i < j:
            spark.createDataFrame(rows[i:j], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def ran(spark, stream, folder):
    """The rows of a stream that is read to its end."""
    name = f"stream_{next(_names)}"
    stream.writeStream.format("memory").queryName(name).option("checkpointLocation", folder).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).collect()


@pytest.fixture(scope="module")
def completions(spark):
    c = V.completions(spark, SF).where("done_us is not null").select("part", "off", "done_us", "outcome", F.col("event_id").alias("seq"))
    return c.schema, [tuple(r) for r in c.orderBy("done_us", "seq").collect()]


def test_ordered_acknowledgement(spark, completions, tmp_path):
    """Completions in any order and any batches; then what is kept is what is completed beyond an open record."""
    schema, rows = completions
    rng = random.Random(1)
    rows = rng.sample(rows, len(rows))
    s = fed(spark, f"{tmp_path}/in", rows, schema, rng.sample(range(len(rows)), 4))
    whole = ack.ordered(V.completions(spark, SF), immediate_errors=True).collect()
    got = ran(spark, acks.acknowledged(s, immediate_errors=False), f"{tmp_path}/a")
    want = {(r.part, r.off): r.drained_us for r in whole if r.drained_us is not None}
    assert {(r.part, r.off): r.executed_us for r in got} == want and len(got) == len(want) > 100
    assert all(r.executed_us == r.drained_us for r in got)
    by = {}
    for r in got:
        by.setdefault(r.part, []).append(r.off)
    kept = spark.read.format("statestore").option("stateVarName", "beyond").load(f"{tmp_path}/a").count()
    assert kept == sum((r.part, r.off) not in want and r.done_us is not None for r in whole)
    got = ran(spark, acks.acknowledged(s), f"{tmp_path}/b")
    said, freed = [r for r in got if r.executed_us is not None], [r for r in got if r.drained_us is not None]
    assert {(r.part, r.off): r.executed_us for r in said} == {(r.part, r.off): r.executed_us for r in whole if r.executed_us is not None}
    assert {(r.part, r.off): r.drained_us for r in freed} == want and len(freed) == len(want)


def test_cumulative_acknowledgement(spark, completions, tmp_path):
    schema, rows = completions
    s = fed(spark, f"{tmp_path}/in", rows, schema, random.Random(2).sample(range(len(rows)), 4))
    got = ran(spark, acks.acknowledged(s, "MULTIPLE"), f"{tmp_path}/ck")
    want = {(r.part, r.off): (r.executed_us, r.executed_as) for r in ack.cumulative(V.completions(spark, SF)).collect() if r.executed_us is not None}
    assert {(r.part, r.off): (r.executed_us, r.outcome) for r in got} == want and len(got) == len(want)


def test_first_completion_counts(spark, tmp_path):
    """Goldens of the queue: a second completion is ignored, whether in the same batch, later, or after the slot was freed."""
    rows = [("a", 1, 10, "ACK", 0), ("a", 1, 11, "NACK", 1), ("a", 2, 12, "NACK", 2), ("a", 2, 13, "ACK", 3), ("a", 0, 20, "ACK", 4), ("a", 0, 21, "NACK", 5), ("a", 1, 22, "NACK", 6), ("a", 3, 23, "ACK", 7)]
    s = fed(spark, f"{tmp_path}/in", rows, "part string, off long, done_us long, outcome string, seq long", [3, 5])
    got = [tuple(r) for r in ran(spark, acks.acknowledged(s), f"{tmp_path}/ck")]
    assert got == [("a", 2, "NACK", 12, None), ("a", 0, "ACK", 20, 20), ("a", 1, "ACK", 20, 20), ("a", 2, "NACK", None, 20), ("a", 3, "ACK", 23, 23)]
    with pytest.raises(ValueError, match="other"):
        acks.acknowledged(s, "other")


def test_work_buffers(spark, tmp_path):
    """Buffers, their folds and their translation; nothing is left but what came last."""
    works = V.works(spark, SF)
    rows = [tuple(r) for r in works.orderBy("us", "event_id").collect()]
    far = [(10**9 + i, -1, "INTENT", "m", END + i * HOUR, 0, 0, False, False, 0) for i in range(2)]
    assert works.columns == ["event_id", "subject", "type", "marker", "us", "inception_ms", "recycle_count", "prepared", "fails", "rank"]
    s = fed(spark, f"{tmp_path}/in", rows + far, works.schema, [100, 101, 400, 700, len(rows), len(rows) + 1])
    x = buffers.translate(buffers.work_buffers(s, catalog.BUFFER), F.col("work.fails"), F.col("work.rank") == 1)
    x = buffers.fold(x.withColumnRenamed("work", "best"), windows.later_work)
    got = [r for r in ran(spark, x, f"{tmp_path}/ck") if r.subject != -1]
    batch = {n: catalog.queries()[n](spark, SF).collect() for n in ("work_buffer", "translate_ack_outcome", "translate_ok", "buffer_fold")}
    each = {(w.event_id, r.subject, r.window, r.window_start) for r in got for w in r.works}
    assert each == {tuple(r) for r in batch["work_buffer"]} and sum(len(r.works) for r in got) == len(rows)
    assert all([(w.us, w.event_id) for w in r.works] == sorted((w.us, w.event_id) for w in r.works) for r in got)
    assert {(r.subject, r.window, r.state, r.fate, r.n, r.n_kept) for r in got} == {tuple(r) for r in batch["translate_ack_outcome"]}
    assert {(r.subject, r.window, r.best.event_id) for r in got if r.state == "TRANSLATED"} == {tuple(r) for r in batch["translate_ok"]}
    assert {(r.subject, r.window, r.work.event_id if r.work else None) for r in got} == {tuple(r) for r in batch["buffer_fold"]}
    assert {r.closed for r in got} == {"TIME", "CLOSER"} | ({"FULL"} if any(len(r.works) == 8 and r.works[-1].type != "COMMIT" for r in got) else set())


def test_buffer_goldens(spark, tmp_path):
    """A lone commit leaves at once; a commit takes those before it along; the size cap closes at its element; null is a key."""
    rows = [("a", 0, 0, True), ("b", 1, 1, False), ("b", 2, 2, True), (None, 3, 3, False), (None, 4, 4, False), (None, 5, 5, False), ("b", 6, 6, False), ("z", 90_000_000, 7, False), ("z", 190_000_000, 8, False)]
    rows = [(k, 10**9 + us, i, c) for k, us, i, c in rows]  # a watermark begins at the epoch
    s = fed(spark, f"{tmp_path}/in", rows, "key string, us long, event_id long, commit boolean", [1, 4, 7, 8])
    x = buffers.buffered(s, "key", WindowConfig(timedelta(seconds=10), 3), F.col("commit"))
    got = [(r.key, r.window, [w.event_id for w in r.works], r.closed) for r in ran(spark, x, f"{tmp_path}/ck")]
    assert sorted(got, key=repr) == sorted([("a", 0, [0], "CLOSER"), ("b", 0, [1, 2], "CLOSER"), (None, 0, [3, 4, 5], "FULL"), ("b", 1, [6], "TIME"), ("z", 0, [7], "TIME")], key=repr)


def test_grouped_pipeline(spark, tmp_path):
    """Five letters in, three buffers out, counted on both ends; then the table's buffers of fifty."""
    letters = [(x, x in "AEIOU", 10**9 + i, i) for i, x in enumerate("ABCDE")] + [("", None, END + i * HOUR, 10 + i) for i in range(4)]
    s = fed(spark, f"{tmp_path}/in", letters, "value string, vowel boolean, us long, event_id long", [2, 5, 6, 7, 8])
    join = lambda works: F.array_join(F.transform(works, lambda w: w["value"].cast("string")), ",")
    x = buffers.grouped_pipeline(s, "letters", "vowel", WindowConfig(timedelta(days=1), 2), join)
    q = x.writeStream.format("memory").queryName("letters").option("checkpointLocation", f"{tmp_path}/a").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.table("letters").where("vowel is not null").collect()
    assert sorted(r.result for r in got) == ["A,E", "B,C", "D"]
    count = lambda n: sum(p.observedMetrics[n]["items"] for p in q.recentProgress if n in p.observedMetrics)
    assert count("letters-inbound") - 4 == 5 and count("letters-outbound") - spark.table("letters").where("vowel is null").count() == 3
    r = V.records(spark, SF).select(F.col("value").alias("grp"), "event_id", "us")
    rows = [tuple(z) for z in r.orderBy("us", "event_id").collect()]
    far = [("", 10**9 + i, END + 800 * i * 24 * HOUR) for i in range(4)]
    s = fed(spark, f"{tmp_path}/in2", rows + far, r.schema, [300, 800, *(len(rows) + i for i in range(4))])
    join = lambda works: F.array_join(F.transform(works, lambda w: w["event_id"].cast("string")), ",")
    x = buffers.grouped_pipeline(s, "events", "grp", WindowConfig(timedelta(days=365), 50), join)
    got = {(z.grp, z.buffer, z.result) for z in ran(spark, x, f"{tmp_path}/b") if z.grp}
    assert got == {(z.grp, z.buffer, z.joined) for z in catalog.queries()["grouped_pipeline"](spark, SF).collect()}


@pytest.mark.parametrize("burst", [False, True])
def test_rate_limit(spark, tmp_path, burst):
    r = V.records(spark, SF).select("event_id", "part", "us")
    rows = [tuple(x) for x in r.orderBy("us", "event_id").collect()]
    far = [(10**9 + i, -1, END + i * HOUR) for i in range(3)]
    s = fed(spark, f"{tmp_path}/in", rows + far, r.schema, [50, 300, 301, 800, len(rows), len(rows) + 1, len(rows) + 2])
    got = [x for x in ran(spark, stream_qos.rate_limited(s, 1 / 3600, "part", burst=burst), f"{tmp_path}/ck") if x.part != -1]
    limit = qos.rate_limit_burst if burst else qos.rate_limit
    assert {x.event_id: x.out_us for x in got} == {x.event_id: x.out_us for x in limit(r, 1 / 3600, "part").collect()} and len(got) == len(rows)
    for part in range(10):
        out = [x.out_us for x in got if x.part == part]
        assert out == sorted(out)
    assert stream_qos.rate_limited(s, 0, "part") is s


def test_silence(spark, tmp_path):
    r = V.records(spark, SF).select("key", "us", "event_id")
    rows = [tuple(x) for x in r.orderBy("us", "event_id").collect()]
    far = [("", END + 100 * i * HOUR, i) for i in range(2)]
    s = fed(spark, f"{tmp_path}/in", rows + far, r.schema, [50, 51, 500, len(rows), len(rows) + 1])
    got = sorted(tuple(x) for x in ran(spark, stream_qos.silent(s, "key", 12 * HOUR, HOUR), f"{tmp_path}/ck") if x.key)
    want = qos.inactivity(r, "key", 12 * HOUR, HOUR, until_us=END).select("key", "last_us", "noticed_us").collect()
    assert got == sorted(tuple(x) for x in want) and len(got) > 100
    with pytest.raises(Exception, match="silent too long"):
        ran(spark, stream_qos.raised(stream_qos.silent(s, "key", 12 * HOUR, HOUR)), f"{tmp_path}/ck2")
    assert not ran(spark, stream_qos.silent(s, "key", 0, HOUR), f"{tmp_path}/ck3")


def test_auto_acknowledgement(spark, tmp_path):
    """A query that dies between two intervals: the log has the intervals that were due, and a new run is given the rest, though it
    was consumed; then one that is stopped has acknowledged all."""
    r = V.records(spark, SF).select("part", "off", "us", "event_id")
    rows = [tuple(x) for x in r.orderBy("us", "event_id").collect()]
    cuts = [200, 555]
    s = fed(spark, f"{tmp_path}/in", rows[:800], r.schema, cuts)
    interval, delay, seen = timedelta(hours=6), timedelta(seconds=5), []

    def consume(batch, n):
        seen.extend(x.event_id for x in batch.collect())
        if len(seen) > 555:
            raise RuntimeError("died")

    receiver = receive_auto(s, f"{tmp_path}/log", consume, f"{tmp_path}/ck", interval, delay, availableNow=True)
    with pytest.raises(Exception, match="died"):
        receiver.awaitTermination()
    now = rows[554][2]
    due = [x for x in catalog.queries()["auto_ack_commits"](spark, SF).collect() if x.ack_us <= now]
    assert sorted(receiver.acks.commits().select("part", "window_end", "commit_off", "n", "ack_us").collect()) == sorted((x.part, x.window_end, x.commit_off, x.n, x.ack_us) for x in due)
    assert len(seen) == 800 and len(due) > 20
    upto = {}
    for x in due:
        upto[x.part] = max(upto.get(x.part, 0), x.commit_off)
    fed(spark, f"{tmp_path}/in", rows[800:], r.schema, [])
    again = []
    receiver = receive_auto_grouped(s.withColumn("topic", F.lit("events")), f"{tmp_path}/log", lambda b, n: again.extend(x.event_id for x in b.collect()), f"{tmp_path}/ck", interval, delay, availableNow=True)
    receiver.awaitTermination()
    assert sorted(again) == sorted(e for part, off, _, e in rows if off >= upto.get(part, 0)) and len(again) < len(rows)
    assert '"0": ' in receiver.acks.starting_offsets("events") and receiver.acks.run == 2
    receiver.stop()
    rest = AckLog(spark, f"{tmp_path}/log", interval, delay)
    assert rest.run == 3 and rest.unacknowledged(r).count() == 0 and not rest.commits().count()
    whole = {part: max(o for p, o, *_ in rows if p == part) + 1 for part in {x[0] for x in rows}}
    assert dict(map(tuple, rest.committed().collect())) == whole


def test_timer_acknowledges(spark, tmp_path):
    """By a clock of its own, though no more records come."""
    import time

    rows = [(0, 0, 1_000, 1), (0, 1, 2_000_000, 2), (None, 0, 3_000, 3)]
    s = fed(spark, f"{tmp_path}/in", rows, "part long, off long, us long, event_id long", [])
    clock = [1_500_000]
    receiver = receive_auto(s, f"{tmp_path}/log", lambda b, n: b.count(), f"{tmp_path}/ck", timedelta(seconds=1), timedelta(0), clock=lambda: clock[0], processingTime="0 seconds")
    receiver.query.processAllAvailable()
    end = time.time() + 60
    while receiver.acks.commits().count() < 2 and time.time() < end:
        time.sleep(0.2)
    assert sorted(map(tuple, receiver.acks.committed().collect()), key=repr) == [(0, 1), (None, 1)]
    clock[0] = 4_000_000
    while receiver.acks.commits().count() < 3 and time.time() < end:
        time.sleep(0.2)
    assert sorted(map(tuple, receiver.acks.committed().collect()), key=repr) == [(0, 2), (None, 1)]
    receiver.stop()
