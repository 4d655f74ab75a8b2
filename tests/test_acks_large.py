"""Acknowledgement where more is in flight than is kept one by one."""

import random

from tidewater.streaming import acks

from tests.test_streams import fed, few_partitions, ran  # noqa: F401


def test_much_in_flight_is_kept_in_blocks(spark, tmp_path):
    """A random order with second completions; position 20,000 is open to the end, position 7 until the last batch."""
    rng, n, hole = random.Random(3), 30_000, 20_000
    rows = [("a", off, rng.randrange(10**6), rng.choice(["ACK", "NACK"]), off) for off in range(n) if off not in (7, hole)]
    rng.shuffle(rows)
    rows = [*rows, *(("a", off, 2 * 10**6, "NACK", n) for off in rng.sample(range(n), 500) if off != hole and off != 7), ("a", 7, 5, "NACK", n)]
    s = fed(spark, f"{tmp_path}/in", rows, "part string, off long, done_us long, outcome string, seq long", [8000, 16_000, len(rows) - 501])
    first = {}
    for _, off, done_us, outcome, _ in rows:
        first.setdefault(off, (done_us, outcome))
    want, last = {}, 0
    for off in range(hole):
        last = max(last, first[off][0])
        want[off] = (first[off][1], last)
    got = ran(spark, acks.acknowledged(s, immediate_errors=False), f"{tmp_path}/a")
    assert {r.off: (r.outcome, r.executed_us) for r in got} == want and len(got) == hole
    got = ran(spark, acks.acknowledged(s), f"{tmp_path}/b")
    said = {r.off: r.executed_us for r in got if r.outcome == "NACK" and r.executed_us is not None}
    assert said == {off: x[0] for off, x in first.items() if x[1] == "NACK"}
    assert {r.off: r.drained_us for r in got if r.drained_us is not None} == {off: x[1] for off, x in want.items()} and len(got) == hole + len(said)
    kept = lambda name: spark.read.format("statestore").option("stateVarName", name).load(f"{tmp_path}/a").count()
    assert kept("beyond") <= acks.KEPT and 0 < kept("blocks") <= n // acks.BLOCK + 1 - hole // acks.BLOCK
