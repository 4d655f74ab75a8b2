"""Registered queries against their SQL, and goldens of the sequential semantics."""

from datetime import timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewater.functions import columns as C
from tidewater.functions import config
from tidewater.functions.model import WindowConfig, duration
from tidewater.operators import ack, grouping, prefix, qos, windows
from tidewater.plans import catalog, streams  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(values):
    return sorted((tuple(r) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, db, name):
    got = catalog.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = db.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({catalog.oracle_sql()[name]})").fetchall()
    assert rows(got.select(*cols).collect()) == rows(want)
    assert want


def test_queries_have_sql():
    assert set(catalog.queries()) - set(catalog.oracle_sql()) == {"rate_limit_burst"}


def test_rate_limit_burst_against_a_loop(spark, db):
    """A limiter that stores up to a second's permits: an element pays for those it takes beyond the stored ones with the next's wait."""
    want, gap = {}, 3_600_000_000
    for part in range(10):
        free, stored = None, 0.0
        for event, us in db.execute(f"select event_id, epoch_us(ts) from events where user_id % 10 = {part} order by ts, event_id").fetchall():
            free = us if free is None else free
            if us > free:
                stored, free = min(1 / 3600, stored + (us - free) / gap), us
            want[event] = max(us, free)
            used = min(1.0, stored)
            stored, free = stored - used, free + round((1 - used) * gap)
    assert {r.event_id: r.out_us for r in catalog.queries()["rate_limit_burst"](spark, SF).collect()} == want
    x = spark.createDataFrame([(i, us, 0) for i, us in enumerate([0, 0, 5_000_000, 5_000_000, 5_000_000, 5_000_000])], "event_id long, us long, part long")
    got = [r.out_us for r in qos.rate_limit_burst(x, 2, "part").orderBy("event_id").collect()]
    assert got == [0, 500_000, 5_000_000, 5_000_000, 5_000_000, 5_500_000]


def frame(spark, items):
    return spark.createDataFrame([(k, int(t * 1_000_000), i, c) for i, (k, t, c) in enumerate(items)], "key string, us long, id long, c boolean")


def test_dedup_goldens(spark):
    cfg = WindowConfig(timedelta(milliseconds=800), 4)
    got = windows.deduplicate(frame(spark, [("ONE", 0, False)] * 5), "key", "us", "id", cfg).orderBy("window").collect()
    assert [(r.id, r.n, r.emit_us) for r in got] == [(0, 4, 0), (4, 1, 800_000)]
    words = "TWO TWO ONE TWO THREE TWO ONE TWO TWO".split()
    got = windows.deduplicate(frame(spark, [(w, 0, False) for w in words]), "key", "us", "id", WindowConfig(timedelta(seconds=2), 4)).collect()
    assert sorted((r.key, r.n) for r in got) == [("ONE", 2), ("THREE", 1), ("TWO", 2), ("TWO", 4)]
    half_open = windows.deduplicate(frame(spark, [("A", 0, False), ("A", 0.8, False)]), "key", "us", "id", cfg)
    assert half_open.count() == 2


def test_windows_by_walk_and_over_batches(spark):
    import random

    rng = random.Random(1)
    items = [(rng.choice(["a", "b", None]), rng.random() * 30, rng.random() < 0.1) for _ in range(2000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    got = {r.id: r.window for r in windows.assign_windows(frame(spark, items), "key", "us", "id", WindowConfig(timedelta(seconds=1), 8), F.col("c")).collect()}
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    state, want = {}, {}
    for i, (k, t, c) in sorted(enumerate(items), key=lambda x: (int(x[1][1] * 1_000_000), x[0])):
        us = int(t * 1_000_000)
        s = state.get(k)
        if s is None or s[2] or us >= s[0] + 1_000_000 or s[1] >= 8:
            s = [us, 0, False, s[3] + 1 if s else 0]
        s[1], s[2] = s[1] + 1, c
        state[k], want[i] = s, s[3]
    assert got == want


def test_shuffles(spark):
    """How often rows are shuffled: once to their key's walk, once more by buffer."""
    for name, most in (("dedup_first", 1), ("work_buffer", 1), ("work_buffer_reduce", 2), ("translate_ack_outcome", 2), ("cancel_filter", 2), ("buffer_fold", 2), ("recycle", 2), ("committable_offset", 4)):
        plan = catalog.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= most, (name, plan)


def test_dedup_over_batches(spark):
    import random

    rng = random.Random(2)
    items = [(rng.choice(["a", "b", None]), rng.randrange(30_000) / 1000, False) for _ in range(700)]
    cfg = WindowConfig(timedelta(seconds=1), 8)
    df = frame(spark, items)
    x = windows.assign_windows(df, "key", "us", "id", cfg)
    by = {}
    for r in sorted(x.collect(), key=lambda r: (r.us, r.id)):
        by.setdefault((r.key, r.window), []).append(r)
    for rows_a_batch in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows_a_batch)
        for keep, at in (("first", 0), ("last", -1)):
            got = {(r.key, r.window): (r.id, r.us, r.n, r.emit_us) for r in windows.deduplicate(df, "key", "us", "id", cfg, keep).collect()}
            assert got == {k: (v[at].id, v[at].us, len(v), v[-1].us if len(v) == 8 else v[0].us + 1_000_000) for k, v in by.items()}
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_queues():
    q = ack.AckQueue()
    [q.add(x) for x in "123"]
    assert (q.complete("2"), q.complete("1"), q.complete("1")) == (0, 2, 0) and q.executed == [("1", None), ("2", None)]
    q = ack.AckQueue(immediate_errors=True)
    [q.add(x) for x in "123"]
    assert q.complete("2", "e") == 0 and q.executed == [("2", "e")] and q.complete("1") == 2
    q = ack.AckQueue(cumulative=True)
    [q.add(x) for x in "12345"]
    assert (q.complete("1"), q.complete("3", "e"), q.complete("5")) == (1, 2, 2)
    assert [e for _, e in q.executed] == [None, "e", "e", None, None]
    a = ack.Admission(2)
    a.offer("MOM", "DAD", "DOG", "CAT", "BOY")
    sizes = [len(a.emitted)]
    for x in ("DAD", "MOM", "DOG"):
        a.complete(x)
        sizes.append(len(a.emitted))
    assert sizes == [2, 2, 4, 5]
    a = ack.Admission(3, len)
    a.offer("MOM", "GIRL", "DAD", "YEET")
    a.complete("DAD")
    assert len(a.emitted) == 3
    a.complete("MOM")
    assert len(a.emitted) == 4


def test_reconciliation_goldens(spark):
    def run(*works):
        df = spark.createDataFrame([("s", t, m, i, i, i, {"INTENT": 0, "RETRY": 1, "CANCEL": 2, "COMMIT": 3}[t], 0) for i, (t, m) in enumerate(works)], "subject string, type string, marker string, us long, event_id long, inception_ms long, rank int, window long")
        return windows.reduce_buffers(df).first().winner

    assert run(("CANCEL", "m"), ("INTENT", "m"), ("RETRY", "m")) is None
    assert run(("CANCEL", "m"), ("COMMIT", "m")) == 1
    assert run(("CANCEL", "m1"), ("INTENT", "m2")) == 1
    assert run(("COMMIT", "a"), ("INTENT", "b")) == 0


def test_flatten_goldens(spark):
    def run(*children):
        parents = spark.createDataFrame([(1, 0)], "event_id long, us long")
        df = spark.createDataFrame([(1, t, o) for t, o in children], "event_id long, done_us long, outcome string")
        r = ack.flatten(df, "event_id", parents).first()
        return r.n, r.status, r.status_us

    assert run((1, "ACK"), (2, "ACK"), (3, "ACK"), (None, "ACK")) == (4, "PENDING", None)
    assert run((1, "ACK"), (2, "ACK"), (3, "ACK"), (9, "ACK")) == (4, "ACK", 9)
    assert run((1, "ACK"), (5, "NACK"), (3, "NACK"), (None, "ACK")) == (4, "NACK", 3)
    assert run() == (0, "ACK", 0)


def test_grouped_pipeline_golden(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate("ABCDE")], "us long, v string").withColumn("vowel", F.col("v").isin("A", "E"))
    assert sorted(r.joined for r in grouping.buffered(df, "vowel", ["us"], 2, "v").collect()) == ["A,E", "B,C", "D"]


def test_buffer_goldens(spark):
    def run(*works, size=8):
        df = spark.createDataFrame([("s", {"INTENT": 0, "RETRY": 1, "CANCEL": 2, "COMMIT": 3}[t], int(at * 1e6), i) for i, (t, at) in enumerate(works)], "subject string, rank int, us long, event_id long")
        rows = windows.work_buffers(df, WindowConfig(timedelta(seconds=10), size)).orderBy("event_id").collect()
        return [r.window for r in rows]

    assert run(("INTENT", 0), ("RETRY", 1), ("CANCEL", 2)) == [0, 0, 0]
    assert run(("INTENT", 0), ("RETRY", 1), ("CANCEL", 2), ("COMMIT", 3), ("INTENT", 4)) == [0, 0, 0, 0, 1]
    assert run(("COMMIT", 0), ("COMMIT", 0)) == [0, 1]
    assert run(*[("INTENT", 0)] * 9) == [0] * 8 + [1]
    assert run(("INTENT", 0), ("INTENT", 10)) == [0, 1]


def test_recycling_goldens(spark):
    for count, ok in ((0, True), (10, True), (11, False)):
        df = spark.createDataFrame([(0, count, "E")], "inception_ms long, recycle_count long, error string")
        may = windows.recyclable(F.lit(5), 0, 10, ["Other"], F.col("error"))
        assert df.select(may.alias("ok")).first().ok is ok
    df = spark.createDataFrame([(0, 0, "Base"), (0, 0, "Sub")], "inception_ms long, recycle_count long, error string")
    assert [r.ok for r in df.select(windows.recyclable(F.lit(11), 11, None, ["Base"], F.col("error")).alias("ok")).collect()] == [False, True]
    assert not df.select(windows.recyclable(F.lit(12), 11, None, [], F.col("error")).alias("ok")).first().ok
    r = windows.recycle(spark.createDataFrame([("m", "INTENT", 4)], "marker string, type string, recycle_count long")).first()
    assert (r.marker, r.type, r.recycle_count) == ("m", "RETRY", 5)


def test_blocks_of_positions(spark, monkeypatch):
    """Acknowledgement over many blocks of a group equals that over one."""
    import random

    rng = random.Random(3)
    rows = [(p, i, 1000 * p + i, None if rng.random() < 0.02 and i > 90 else rng.randrange(500), rng.choice(["ACK", "NACK"]), rng.random() < 0.3) for p in range(3) for i in range(150)]
    df = spark.createDataFrame(rows, "part long, off long, event_id long, done_us long, outcome string, multiple boolean")
    forms = [lambda: ack.ordered(df), lambda: ack.ordered(df, immediate_errors=True), lambda: ack.cumulative(df), lambda: ack.settled(df)]
    whole = [{r.event_id: r for r in f().select(sorted(f().columns)).collect()} for f in forms]
    monkeypatch.setattr(prefix, "BLOCK", 7)
    assert [{r.event_id: r for r in f().select(sorted(f().columns)).collect()} for f in forms] == whole
    later = lambda r: [x for x in rows if x[0] == r[0] and x[1] >= r[1] and x[3] is not None]
    for r in rows:
        want = min(((x[3], x[2], x[4]) for x in later(r)), default=None)
        assert (whole[2][r[2]].executed_us, whole[2][r[2]].executed_as) == ((want[0], want[2]) if want else (None, None))
        want = min(((x[3], x[2], x[4]) for x in later(r) if x[5] or x[2] == r[2]), default=None)
        assert (whole[3][r[2]].settled_us, whole[3][r[2]].settled_as) == ((want[0], want[2]) if want else (None, None))


@pytest.mark.parametrize("whole", [0, 1 << 20])
def test_numbers_with_nulls(spark, monkeypatch, whole):
    monkeypatch.setattr(prefix, "WHOLE", whole)
    monkeypatch.setattr(prefix, "SPAN", 2)
    monkeypatch.setattr(prefix, "BOUND", 1)
    rows = [(g, us, i) for i, (g, us) in enumerate([("a", 5), ("a", None), ("a", 1), (None, 250), (None, 7), ("b", 99), (None, 7), ("a", -3), ("a", 205)])]
    df = spark.createDataFrame(rows, "g string, us long, id long")
    got = {r.id: r.n for r in prefix.numbered(df, "g", ["us", "id"], "n").collect()}
    want = {}
    for g in ("a", "b", None):
        for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))):
            want[r[2]] = n
    assert got == want
    assert {r.id: r.out_us for r in qos.rate_limit(df.where("us is not null"), 1, "g", tie="id").collect()}.keys() == {0, 2, 3, 4, 5, 6, 7, 8}


def test_inactivity_over_blocks(spark, monkeypatch):
    """One key's elements in many blocks; ties, and a null key."""
    import random

    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "b", None]), rng.randrange(3000)) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, key string, us long")
    whole = sorted(map(tuple, qos.inactivity(df, "key", 20, 5, until_us=10_000).collect()), key=repr)
    for name, value in (("WHOLE", 0), ("SPAN", 50), ("BLOCK", 7)):
        monkeypatch.setattr(prefix, name, value)
    assert sorted(map(tuple, qos.inactivity(df, "key", 20, 5, until_us=10_000).collect()), key=repr) == whole and len(whole) > 50


def test_numbers_of_one_instant(spark, monkeypatch):
    """All rows share a group and an instant: no task gets many more than a range's, and places are right."""
    monkeypatch.setattr(prefix, "WHOLE", 0)
    monkeypatch.setattr(prefix, "SPAN", 4000)
    df = spark.range(100_000).select(F.lit(1).alias("g"), F.lit(7).alias("us"), F.xxhash64("id").alias("id"))
    held = [r["count"] for r in prefix.spans(df, ["g", "us", "id"], 4000).groupBy("_span").count().collect()]
    assert len(held) > 20 and max(held) < 3 * 4000
    assert prefix.numbered(df, "g", ["us", "id"], "n").orderBy("id").agg(F.collect_list("n")).first()[0] == list(range(100_000))


def test_rate_limit_over_blocks(spark, monkeypatch):
    import random

    rng = random.Random(5)
    times = [sorted(rng.randrange(0, 400) * 3_600_000_000 for _ in range(60)) for _ in range(3)]
    df = spark.createDataFrame([(100 * p + i, us, p) for p in range(3) for i, us in enumerate(times[p])], "event_id long, us long, part long")
    monkeypatch.setattr(prefix, "BLOCK", 9)
    want, gap = {}, 7_200_000_000
    for p in range(3):
        free = 0
        for i, us in enumerate(times[p]):
            want[100 * p + i] = max(us, free)
            free = want[100 * p + i] + gap
    assert {r.event_id: r.out_us for r in qos.rate_limit(df, 1 / 7200, "part").collect()} == want


def test_assignment_and_rate(spark):
    m = spark.createDataFrame([("1", "t", 5), ("2", "t", 5), ("1", "u", None)], "member_id string, topic string, born_ms long")
    p = spark.createDataFrame([("t", 10)], "topic string, n_parts long")
    assert {tuple(r) for r in grouping.assign_all(m, p).collect()} == {("t", "1", 0), ("t", "2", 10), ("u", "1", 0)}
    x = spark.createDataFrame([(0, 0, 0), (1, 0, 0), (2, 0, 0)], "event_id long, us long, part long")
    assert [r.out_us for r in qos.rate_limit(x, 2, "part").orderBy("event_id").collect()] == [0, 500_000, 1_000_000]


def test_durations_and_config():
    assert duration("PT10S") == timedelta(seconds=10) and duration("P2D") == timedelta(days=2) and duration("PT-1S") == timedelta(seconds=-1) and duration("EMPTY") is None
    with pytest.raises(ValueError):
        duration("10 s")
    env = {"config.override.a": "1", "config.override.b": "2", "config.override.x.c": "3"}
    assert config.create({"specifier": "x", "a": "0"}, environment=env) == {"specifier": "x", "a": "1", "c": "3"}
    with pytest.raises(ValueError):
        config.create({}, required=("a",))
    assert config.create({"id": "q", "id.randomize": "true"})["id"].startswith("q-")
    assert config.to_collection("a, b") == ["a", "b"]


def test_resubscribing():
    tries, slept = [], []

    class Query:
        def awaitTermination(self):
            tries.append(1)
            if len(tries) < 3:
                raise RuntimeError

    assert qos.resubscribing(Query, sleep=slept.append) == 2 and slept == [20.0, 20.0]
    tries.clear()
    with pytest.raises(RuntimeError):
        qos.resubscribing(Query, timedelta(seconds=-1))


def test_xml_golden(spark):
    x = spark.range(1).select(C.to_xml(F.struct(F.lit("DATA").alias("data")), "concreteXmlData").alias("x")).first().x
    assert "".join(x.split()) == "<concreteXmlData><data>DATA</data></concreteXmlData>"
