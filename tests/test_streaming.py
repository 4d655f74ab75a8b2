"""Streaming forms: windows equal the batch form; the queue delivers again what was not acknowledged."""

import json
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tidewater.functions.model import WindowConfig
from tidewater.operators import windows
from tidewater.sources.queue import QueueSource, split_outcomes
from tidewater.streaming.pipeline import STARTED, STOPPED, MetricRegistry, Pipeline
from tidewater.streaming.windows import first_occurrence


def test_windows_equal_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    x = e.select(F.col("user_id").alias("key"), F.date_trunc("second", "ts").alias("ts"), F.col("event_id").alias("id"), (F.col("event_type") == "purchase").alias("closes"))
    for i in range(3):
        x.where(f"id % 1000 between {i * 334} and {i * 334 + 333}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    cfg = WindowConfig(timedelta(hours=6), 4)
    s = spark.readStream.schema(x.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = first_occurrence(s, cfg, "40 days").writeStream.format("memory").queryName("first_windows").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.key, r.first_id, r.n) for r in spark.table("first_windows").collect()}
    b = windows.assign_windows(x.withColumn("us", F.unix_micros("ts")), "key", "us", "id", cfg, F.col("closes"))
    b = b.groupBy("key", "window").agg(F.min("id").alias("first_id"), F.count("*").alias("n"), F.max("window").alias("w"))
    last = {r["key"]: r["w"] for r in b.groupBy("key").agg(F.max("window").alias("w")).collect()}
    want = {(str(r["key"]), r.first_id, r.n): r["window"] == last[r["key"]] for r in b.collect()}
    assert got <= set(want) and {w for w, open_ in want.items() if not open_} <= got and len(got) > 50


def test_queue_contract(spark, tmp_path):
    spark.dataSource.register(QueueSource)
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "0.jsonl").write_text("".join(json.dumps({"topic": "t", "key": str(i), "value": "bad" if i == 6 else "ok"}) + "\n" for i in range(10)))
    seen, broken = [], [True]

    def start():
        def each(df, n):
            rows = [r.key for r in df.orderBy("seq").collect()]
            seen.append(rows)
            if broken[0] and "6" in rows:
                broken[0] = False
                raise RuntimeError("nack")

        s = spark.readStream.format("queue").option("path", str(tmp_path / "q")).option("maxPerBatch", "4").load()
        return s.writeStream.foreachBatch(each).option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="0 seconds").start()

    p = Pipeline(start)
    q = p.start()
    with pytest.raises(RuntimeError):
        p.start()
    with pytest.raises(Exception, match="nack"):
        q.processAllAvailable()
    p.stop()
    assert p.state == STOPPED
    q = p.start()
    assert p.state == STARTED
    q.processAllAvailable()
    p.stop()
    assert sum((x for x in seen), []).count("1") == 1 and sum((x for x in seen), []).count("6") == 2
    assert {k for x in seen for k in x} == {str(i) for i in range(10)}


def test_queue_reads_on_and_writes(spark, tmp_path):
    from tidewater.sources.queue import QueueReader, QueueWriter

    for name, n in (("a", 5), ("b", 3), ("c", 4)):
        (tmp_path / f"{name}.jsonl").write_text("".join(json.dumps({"key": f"{name}{i}"}) + "\n" for i in range(n)))
    r, at, batches = QueueReader(str(tmp_path), 4), {"file": "", "line": 0, "n": 0}, []
    while True:
        rows, end = r.read(at)
        rows = list(rows)
        if not rows:
            break
        assert [x[1] for x in r.readBetweenOffsets(at, end)] == [x[1] for x in rows]
        batches.append([x[1] for x in rows])
        (tmp_path / "a.jsonl").unlink(missing_ok=True) if end["file"] > "a.jsonl" else None  # what was read is not opened again
        at = end
    assert [len(x) for x in batches] == [4, 4, 4] and sum(batches, []) == [f"a{i}" for i in range(5)] + [f"b{i}" for i in range(3)] + [f"c{i}" for i in range(4)]
    w = QueueWriter(str(tmp_path / "out"))
    (tmp_path / "out").mkdir()
    done, lost = w.write(iter(spark.createDataFrame([("t", "k", "v", 1)], "topic string, key string, value string, seq long").collect())), w.write(iter([]))
    assert not list((tmp_path / "out").glob("*.jsonl"))
    w.abort([lost, None], 0)
    w.commit([done, None], 0)
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["000000000000-00000.jsonl"]
    assert json.loads((tmp_path / "out" / "000000000000-00000.jsonl").read_text()) == {"topic": "t", "key": "k", "value": "v"}


def test_queue_bodies(spark, tmp_path):
    from tidewater.sources import kafka, queue

    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "0.jsonl").write_text('{"value": "a"}\n{"key": "k"}\n{"value": "b"}\n')
    got = []
    q = queue.consume_body(spark, str(tmp_path / "q"), 2).writeStream.foreachBatch(lambda df, n: got.extend(r.value for r in df.collect())).option("checkpointLocation", f"{tmp_path}/ck")
    q = q.trigger(**kafka.auto_trigger(timedelta(0))).start()
    q.processAllAvailable()
    q.stop()
    assert got == ["a", "b"] and kafka.auto_trigger() == {"processingTime": "5 seconds"}


def test_listening_and_metrics(spark, tmp_path):
    import logging
    import time

    from tidewater.sources.kafka import await_assignment
    from tidewater.streaming import pipeline as p

    seen, registry = [], MetricRegistry()

    class Notes(p.Listener):
        def state_changed(self, state, about):
            seen.append(state)

        def next(self, progress):
            seen.append(progress.numInputRows)

    metrics = p.MetricsListener(registry, "work", flow="inbound")
    listening = p.Listening("listened", [Notes(), metrics, p.LoggingListener(logging.getLogger("x"))]).attach(spark)
    spark.createDataFrame([(1, None), (2, "bad")], "id long, error string").write.parquet(f"{tmp_path}/in")

    def start(fail=False, ck="a", **trigger):
        s = p.observed(spark.readStream.schema("id long, error string").parquet(f"{tmp_path}/in"), "work")

        def each(df, n):
            df.count()
            if fail:
                raise ValueError

        return s.writeStream.queryName("listened").foreachBatch(each).option("checkpointLocation", f"{tmp_path}/{ck}").trigger(**trigger).start()

    def wait(n):
        end = time.time() + 30
        while sum(isinstance(x, str) for x in seen) < n and time.time() < end:
            time.sleep(0.05)

    start(availableNow=True).awaitTermination()
    wait(2)
    assert seen[0] == "SUBSCRIBED" and seen[-1] == "COMPLETED" and 2 in seen
    q = start(ck="b", processingTime="0 seconds")
    assert await_assignment(q)
    listening.cancel(q)
    wait(4)
    assert seen[-1] == "CANCELED"
    with pytest.raises(Exception, match="ValueError"):
        start(True, "c", availableNow=True).awaitTermination()
    wait(6)
    spark.streams.removeListener(listening)
    value = lambda n: registry.value(registry.key(f"work.{n}", flow="inbound"))
    assert seen[-1] == "ERRORED" and value("subscribers") == 0 and value("items") >= 4 and value("errors") >= 3


def test_quality_of_service():
    from tidewater.operators import qos

    class Query:
        def __init__(self, progress):
            self.progress, self.stopped = iter(progress), False

        def awaitTermination(self, timeout=None):
            self.lastProgress = next(self.progress, "end")
            clock[0] += timeout or 0
            return self.lastProgress == "end"

        def stop(self):
            self.stopped = True

    clock = [0.0]
    batch = lambda i, n=1: {"batchId": i, "numInputRows": n}
    cfg = qos.QosConfig(timedelta(seconds=2), timedelta(seconds=1), timedelta(seconds=1))
    quiet = Query([batch(1), batch(2), batch(2), batch(2), batch(3, 0), batch(3, 0)])
    with pytest.raises(TimeoutError):
        qos.run(lambda: quiet, cfg, clock=lambda: clock[0])
    assert quiet.stopped and clock[0] == 5.0  # active at 2, silent for exactly 2 s at 4, longer at 5
    queries, slept = [Query([None] * 9), Query([batch(i) for i in range(9)])], []
    assert qos.run(lambda: queries.pop(0), qos.QosConfig(cfg.max_inactivity, cfg.check_delay, cfg.check_interval, timedelta(seconds=3)), sleep=slept.append, clock=lambda: clock[0]) == 1 and slept == [3.0]
    assert qos.run(lambda: Query([]), qos.QosConfig()) == 0  # all off


def test_outcomes_and_registry(spark):
    df = spark.createDataFrame([(1, "ACK"), (2, "NACK")], "id long, outcome string")
    good, bad = split_outcomes(df, "REQUEUE")
    assert [r.id for r in good.collect()] == [1] and [(r.id, r.target) for r in bad.collect()] == [(2, "source")]
    r, k = MetricRegistry(), MetricRegistry.key("lag", topic="t")
    r.register(k, "a", lambda: 1.0)
    r.register(k, "b", lambda: 2.0)
    assert not r.unregister(k, "a") and r.value(k) == 2.0 and r.unregister(k, "b") and r.value(k, 0.0) == 0.0
