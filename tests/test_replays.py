"""Replayed tables at other shapes than the given ones, against the queries' SQL."""

import duckdb
import pytest

from tidewater.plans import catalog, streams  # noqa: F401
from tidewater.streaming import replay

SF = "/root/testdata/sf0.001"


def differs(spark, name, folder):
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{folder}/events.parquet'")
    got = catalog.queries()[name](spark, str(folder))
    cols = sorted(got.columns)
    want = c.execute(f"select {', '.join(chr(34) + x + chr(34) for x in cols)} from ({catalog.oracle_sql()[name]})").fetchall()
    got = [tuple(r) for r in got.select(*cols).collect()]
    return sorted(got, key=repr) != sorted(want, key=repr)


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """Twelve copies with shifted keys: the last instants have many records, some without a result in time."""
    d = tmp_path_factory.mktemp("repeated")
    duckdb.sql(f"copy (select event_id + 1000 * i as event_id, ts, user_id + 2000 * i as user_id, event_type, value, props from '{SF}/events.parquet', range(12) r(i)) to '{d}/events.parquet'")
    return d


def test_sends_of_the_last_minute_come_out(spark, repeated):
    assert not differs(spark, "stream_send_results", repeated)


@pytest.mark.parametrize("files", [1, 3])
def test_a_replay_is_whole_and_in_order(spark, files, monkeypatch):
    """Batches of about `most` rows, of as many files each as hold them; none of an instant in two; `last` rows in batches of their own."""
    monkeypatch.setattr(replay, "FILE", 1000 // files)
    df = spark.range(5000).selectExpr("id div 7 as us", "id")
    seen = {}
    with replay.Replay(spark) as r:
        x = r.in_order(df, "us", 1, [(10**6 + i, -1) for i in range(2)], most=1000)
        q = x.writeStream.foreachBatch(lambda b, n: seen.update({n: [tuple(z) for z in b.collect()]})).option("checkpointLocation", r.scratch("c"))
        q.trigger(availableNow=True).start().awaitTermination()
    batches = [seen[n] for n in sorted(seen)]
    assert len(batches) == 7 and all(len(b) < 2000 for b in batches)
    assert sorted(i for b in batches for _, i in b if i >= 0) == list(range(5000))
    for a, b in zip(batches[:-1], batches[1:], strict=True):
        assert max(a)[0] < min(b)[0]


def test_a_table_is_staged_in_the_sessions_partitions(spark):
    """Not in the few that a stream's state has, in which a task's share would grow with the table."""
    was = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        with replay.Replay(spark) as r:
            few = int(spark.conf.get("spark.sql.shuffle.partitions"))
            x = r.once(spark.range(2000).repartition("id").selectExpr("id", "spark_partition_id() as p"), "x")
            assert few == spark.sparkContext.defaultParallelism < x.select("p").distinct().count() and int(spark.conf.get("spark.sql.shuffle.partitions")) == few
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
