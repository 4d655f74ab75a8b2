"""Rows that wait for a permit are kept in chunks."""

from tidewater.streaming import qos

from tests.test_streams import fed, few_partitions, ran  # noqa: F401


def test_waiting_rows_are_kept_in_chunks(spark, tmp_path):
    """A permit a second for 2,500 rows of one instant: event time lets 1,300 of them pass, the others wait."""
    rows = [("a", 10**9, i, [(i, "x")]) for i in range(2500)] + [("b", 10**9 + 1_299_500_000, -1, None)]
    s = fed(spark, f"{tmp_path}/in", rows, "key string, us long, event_id long, more array<struct<n: long, s: string>>", [2500])
    got = ran(spark, qos.rate_limited(s, 1, "key"), f"{tmp_path}/a")
    assert [(r.event_id, r.out_us, r.more[0].n) for r in got if r.key == "a"] == [(i, 10**9 + i * 10**6, i) for i in range(1300)]
    waits = spark.read.format("statestore").option("stateVarName", "waiting").load(f"{tmp_path}/a").where("key.key = 'a'")
    assert waits.count() == 2
