"""Recycling into the source, sending with a result for each record, results in a stream."""

import os
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_streams import SF, fed, few_partitions, ran  # noqa: F401
from tidewater.operators import ack
from tidewater.plans import catalog
from tidewater.plans import views as V
from tidewater.sources import sender
from tidewater.streaming.recycling import RecycleConfig, RecyclingLoop

END = 1_893_456_000_000_000


def test_recycling_to_rest(spark, tmp_path):
    """Each try of each work, as the query over the table has them."""
    w = V.works(spark, SF).join(V.events(spark, SF).select("event_id", "k"), "event_id").select("event_id", "k", "subject", "type", "marker", "inception_ms", "recycle_count")
    now = max(r.inception_ms for r in w.collect())
    seen = []

    def process(batch):
        seen.append(batch.count())
        return batch.withColumn("error", catalog._try_error(F.col("recycle_count")))

    config = RecycleConfig(timedelta(days=20), 10, ("E1",))
    loop = RecyclingLoop(spark, f"{tmp_path}/topic", w.schema, process, config, f"{tmp_path}/out", lambda: now)
    loop.publish(w.where("event_id % 2 = 0").coalesce(1))
    loop.start()
    loop.publish(w.where("event_id % 2 = 1").coalesce(1))
    loop.rest()
    loop.stop()
    columns = ["event_id", "type", "recycle_count", "error", "outcome"]
    got = sorted((tuple(r) for r in loop.outcomes().select(*columns).collect()), key=repr)
    want = sorted((tuple(r) for r in catalog.queries()["recycle_attempts"](spark, SF).select(*columns).collect()), key=repr)
    assert got == want and {r[-1] for r in got} == {"DONE", "RECYCLED", "DROPPED"} and sum(seen) == len(got) > 1.5 * w.count()


def test_recycled_until_the_bound(spark, tmp_path):
    """Eleven times round where ten are allowed, then dropped; expired and ruled out ones not once; a batch that failed is done again."""
    rows = [(1, "INTENT", 5_000, 0, None), (2, "INTENT", 5_000, 0, "Other"), (3, "INTENT", -5_001, 0, None), (4, "COMMIT", -5_000, 10, None)]
    broken = [True]

    def process(batch):
        if broken[0] and batch.where("recycle_count = 3").count():
            broken[0] = False
            raise RuntimeError("lost")
        return batch.withColumn("error", F.coalesce("rule", F.lit("Base")))

    loop = RecyclingLoop(spark, f"{tmp_path}/topic", "id long, type string, inception_ms long, recycle_count long, rule string", process, RecycleConfig(timedelta(seconds=10), 10, ("Other",)), f"{tmp_path}/out", lambda: 5_000)
    loop.publish(spark.createDataFrame(rows, loop.schema).coalesce(1))
    loop.start()
    with pytest.raises(Exception, match="lost"):
        loop.rest()
    loop.start()
    loop.rest()
    loop.stop()
    by = {}
    for r in loop.outcomes().orderBy("recycle_count").collect():
        by.setdefault(r.id, []).append((r.recycle_count, r.type, r.outcome))
    assert by[1] == [(0, "INTENT", "RECYCLED"), *((i, "RETRY", "RECYCLED") for i in range(1, 11)), (11, "RETRY", "DROPPED")]
    assert by[2] == [(0, "INTENT", "DROPPED")] and by[3] == [(0, "INTENT", "DROPPED")] and by[4] == [(10, "COMMIT", "RECYCLED"), (11, "RETRY", "DROPPED")]


class Folder(sender.Target):
    """Knows an id by its file. Refuses every tenth record, for ever or the first time; the task that sends `kill` dies once."""

    def __init__(self, path, for_ever=True, kill=None):
        self.path, self.for_ever, self.kill, self.open_, self.most = path, for_ever, kill, 0, 0

    def open(self):
        os.makedirs(self.path, exist_ok=True)

    def submit(self, send_id, record):
        self.open_ += 1
        self.most = max(self.most, self.open_)

        def confirm():
            self.open_ -= 1
            if send_id == self.kill and not os.path.exists(f"{self.path}/killed"):
                open(f"{self.path}/killed", "x").close()
                os._exit(1)
            if record["k"] % 10 == 0 and (self.for_ever or not os.path.exists(f"{self.path}/_{send_id}")):
                open(f"{self.path}/_{send_id}", "w").close()
                raise ValueError("refused")
            with open(f"{self.path}/{send_id}", "a") as f:
                if not f.tell():
                    f.write(repr(sorted(record)) + "\n")

        return confirm

    def close(self):
        with open(f"{self.path}/most-{os.getpid()}-{id(self)}", "w") as f:
            f.write(str(self.most))


def written(path):
    return {n for n in os.listdir(path) if n[0] not in "_km"}


@pytest.mark.parametrize("stop", [False, True])
def test_results_of_records(spark, tmp_path, stop):
    r = V.records(spark, SF).withColumn("k", F.when(F.col("k") == 0, 10).otherwise(F.when(F.col("k") % 10 == 0, 1).otherwise(F.col("k"))))
    config = {"stop.on.error": stop, "resubscribe.on.error": False, "max.in.flight": 7}
    path = f"{tmp_path}/target"
    x = sender.send(r.select("part", "off", "k", "headers"), 3, lambda: Folder(path), config)
    got = {(x.part, x.off): x for x in x.collect()}
    part = {e.event_id: (e.part, e.off) for e in r.collect()}
    want = {part[x.event_id]: x.result for x in catalog.queries()["sender_stop_on_error" if stop else "sender_goes_on"](spark, SF).collect()}
    assert {k: x.result for k, x in got.items()} == want and set(want.values()) >= {"SENT", "FAILED"}
    assert written(path) == {x.send_id for x in got.values() if x.result == "SENT"} and got[(0, 0)].send_id == "3-0-0"
    assert all(x.error == "ValueError: refused" for x in got.values() if x.result == "FAILED") and "headers" not in open(f"{path}/{next(iter(written(path)))}").read()
    most = [int(open(f"{path}/{n}").read()) for n in os.listdir(path) if n.startswith("most-")]
    assert max(most) == (1 if stop else 7)


def test_sender_starts_again(spark, tmp_path):
    """Refusals that pass are sent again from their record; a task that dies is run again; each record is written once, and a batch that
    has its results is not sent again."""
    r = V.records(spark, SF).select("part", "off", "k")
    path, results = f"{tmp_path}/target", []
    kinds = {"stop.on.error": True, "resubscribe.on.error": True}
    sink = sender.RecordSink(f"{tmp_path}/results", lambda: Folder(path, False), kinds, lambda df, n: results.append(df.collect()), delay=timedelta(0))
    s = fed(spark, f"{tmp_path}/in", [tuple(x) for x in r.collect()], r.schema, [300])
    s.writeStream.foreachBatch(sink).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    got = [x for rows in results for x in rows]
    assert len(results) == 2 and len(got) == r.count() == len(written(path)) and {x.result for x in got} == {"SENT"}
    assert sum(x.attempts == 2 for x in got) == r.where("k % 10 = 0").count() > 5
    sink.make_target = None  # would fail if it were used
    sink(r.limit(0), 0)
    assert len(results) == 3 and len(results[2]) == len(results[0])
    bounded = sender.send(r.where("part = 0"), 9, lambda: Folder(f"{tmp_path}/never"), kinds, attempts=3, delay=timedelta(0)).collect()
    assert {x.attempts for x in bounded if x.result == "FAILED"} == {3} and {x.result for x in bounded} == {"SENT", "FAILED", "UNSENT"}
    sink = sender.RecordSink(f"{tmp_path}/results2", lambda: Folder(f"{tmp_path}/dies", False, "5-3-9"), kinds, delay=timedelta(0))
    with pytest.raises(Exception, match="(?i)worker|exit"):
        sink(r, 5)
    assert 0 < len(written(f"{tmp_path}/dies")) < r.count()
    sink(r, 5)
    once = [len(open(f"{tmp_path}/dies/{n}").readlines()) for n in written(f"{tmp_path}/dies")]
    assert once == [1] * r.count() and spark.read.parquet(f"{tmp_path}/results2/batch-5").where("result = 'SENT'").count() == r.count()
    assert sender.send(r.limit(0), 9, lambda: Folder(f"{tmp_path}/none"), {}).collect() == []


def test_results_in_a_stream(spark, tmp_path):
    """Results in time give the correlation of the tables; a send without one in time is nacked once."""
    c = V.completions(spark, SF)
    sends = c.select("event_id", "part", "off", "us")
    rows = [tuple(x) for x in sends.orderBy("us").collect()]
    done = c.where("done_us is not null").select("part", "off", F.when(F.col("outcome") == "NACK", "refused").alias("error"), "done_us")
    late = {x.event_id for x in sends.where("event_id % 50 = 7").collect()}
    lags = {(x.part, x.off): x.event_id for x in sends.collect()}
    results = sorted(((p, o, e, us + (3_600_000_000 if lags[p, o] in late else 0)) for p, o, e, us in map(tuple, done.collect())), key=lambda x: x[-1])
    a = fed(spark, f"{tmp_path}/a", [*rows, (-1, -1, 0, END), (-2, -1, 1, END + 10**10)], sends.schema, [200, 700, len(rows), len(rows) + 1])
    b = fed(spark, f"{tmp_path}/b", [*results, (-2, 0, None, END), (-2, 1, None, END + 10**10)], done.schema, [150, 650, len(results), len(results) + 1])
    x = sender.correlated(a.withColumn("at", F.timestamp_micros("us")), b.withColumn("back", F.timestamp_micros("done_us")), ["part", "off"], "at", "back", timedelta(seconds=97))
    got = [r for r in ran(spark, x, f"{tmp_path}/ck") if r.part >= 0]
    assert len(got) == len(rows) == len({r.event_id for r in got})
    for r, want in zip(sorted(got, key=lambda r: r.event_id), ack.correlate(sends, done.select("part", "off", "error"), ["part", "off"]).orderBy("event_id").collect(), strict=True):
        if r.event_id in late or want.status == "OPEN":
            assert (r.status, r.error) == ("NACKED", "no result in time")
        else:
            assert (r.status, r.error) == (want.status + "ED", want.error)
