"""Registered queries against counts over whole tables, made here without Spark."""

import duckdb
import pytest

from tidewater.operators import windows
from tidewater.plans import catalog

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def records():
    """(part, off, event_id, user_id, k, done, nack) of every event, in order of partition and offset."""
    rows = duckdb.sql(f"select user_id % 10, event_id, user_id, cast(json_extract_string(props, '$.k') as bigint), event_type = 'error' from '{SF}/events.parquet' order by ts, event_id").fetchall()
    at, out = {}, []
    for part, event, user, k, nack in rows:
        at[part] = at.get(part, -1) + 1
        out.append((part, at[part], event, user, k, event % 501 != 0, nack))
    return sorted(out)


def test_reduce_ack_folds_every_record(spark, records):
    want = {}
    for _, _, event, user, k, _, _ in records:
        total, order = want.setdefault(str(user), (0, []))
        want[str(user)] = (total + k, [*order, str(event)])
    got = {r.key: (r.total, r.ack_order.split(",")) for r in catalog.queries()["reduce_ack"](spark, SF).collect()}
    assert got == want and sum(len(x) for _, x in got.values()) == len(records) == 10_000


def test_commits_from_the_first_open_record(spark, records):
    first, last = {}, {}
    for part, off, _, _, _, done, nack in records:
        last[part] = off
        if nack or not done:
            first.setdefault(part, off)
    want = {p: (first.get(p, n + 1), n + 1) for p, n in last.items()}
    got = {r.part: (r.commit_off, r.n) for r in catalog.queries()["committable_offset"](spark, SF).collect()}
    assert got == want and min(first.values()) < 50
    again = {(event, part, off) for part, off, event, *_ in records if off >= want[part][0]}
    got = [(r.event_id, r.part, r.off) for r in catalog.queries()["replay_set"](spark, SF).collect()]
    assert len(got) == len(again) and set(got) == again


def test_fetch_looks_up_the_whole_table(spark):
    names = dict(duckdb.sql(f"select c_custkey, c_name from '{SF}/customer.parquet'").fetchall())
    orders = duckdb.sql(f"select o_orderkey, o_custkey from '{SF}/orders.parquet'").fetchall()
    want = sorted((o, c, names.get(c), c in names) for o, c in orders)
    assert sorted(tuple(r) for r in catalog.queries()["fetch_prepare"](spark, SF).collect()) == want


def test_fetch_of_missing_keys(spark):
    works = spark.createDataFrame([(1, 10), (2, 11), (3, None), (4, 10)], "id long, subject long")
    source = spark.createDataFrame([(10, "x"), (12, "y")], "key long, name string")
    got = windows.fetch_prepare(works, source, "subject", "key").select("id", "name", "fetched").collect()
    assert sorted(tuple(r) for r in got) == [(1, "x", True), (2, None, False), (3, None, False), (4, "x", True)]
