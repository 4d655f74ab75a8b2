"""Silences by intervals of each key."""

import random

from tidewater.operators import qos
from tidewater.streaming import qos as stream_qos

from tests.test_streams import fed, few_partitions, ran  # noqa: F401


def test_silences_are_found_without_numbering(spark, monkeypatch):
    """Against a loop: times before the epoch too, equal times, null keys and times, gaps about the limit."""

    def numbered(*_):
        raise AssertionError("rows were numbered")

    monkeypatch.setattr(qos, "numbered", numbered)
    monkeypatch.setattr(qos, "few", lambda df: False)
    rng = random.Random(5)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(-1500, 1500), i) for i in range(150)] + [("c", t, t) for t in (-20, 4, 5, 30, 55, 55, 80, 106)] + [("d", None, 1)]
    df = spark.createDataFrame(rows, "key string, us long, event_id long")
    by, want = {}, []
    for k, t, _ in rows:
        if t is not None:
            by.setdefault(k, []).append(t)
    for k, ts in by.items():
        ts.sort()
        want += [(k, t, nxt, t + 25) for t, nxt in zip(ts, [*ts[1:], None], strict=True) if (2000 if nxt is None else nxt) > t + 25]
    got = sorted(map(tuple, qos.inactivity(df, "key", 20, 5, until_us=2000).collect()), key=repr)
    assert got == sorted(want, key=repr) and len(got) > 30
    assert sorted(map(tuple, qos.inactivity(df, "key", 20, 5).collect()), key=repr) == sorted((x for x in want if x[2] is not None), key=repr)


def test_silences_of_a_stream_need_no_call_for_each_key(spark, tmp_path):
    """Against a loop: gaps of exactly the limit and one more, within a batch and between two, null and many keys; state only of what is open."""
    after, rng = 25, random.Random(8)
    far = [("", 10**9 * i) for i in (1, 2)]
    rows = [("a", 0), ("a", after), ("a", 2 * after + 1), ("b", 7), (None, 3), ("a", 3 * after + 1), ("b", 8 + after), (None, 9)]
    rows = [*rows[:5], *((f"k{i}", rng.randrange(10)) for i in range(300)), *rows[5:], *((f"k{i}", rng.randrange(34, 60)) for i in range(300))]
    s = fed(spark, f"{tmp_path}/in", rows + far, "key string, us long", [305, len(rows), len(rows) + 1])
    x = stream_qos.silent(s, "key", 20, 5)
    got = sorted((tuple(r) for r in ran(spark, x, f"{tmp_path}/a") if r.key != ""), key=repr)
    by, want = {}, []
    for k, t in rows:
        by.setdefault(k, []).append(t)
    for k, ts in by.items():
        ts.sort()
        want += [(k, t, t + after) for t, nxt in zip(ts, [*ts[1:], 10**12], strict=True) if nxt > t + after]
    assert got == sorted(want, key=repr) and len(got) > 500
    assert "TransformWithState" not in x._jdf.queryExecution().analyzed().toString()
