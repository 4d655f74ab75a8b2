"""Registered queries of the streaming forms: the table's rows replayed in batches through the operators with state, to the end, with the
SQL of what must come out. Importing this adds them to the catalog."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from tidewater.functions.model import WindowConfig
from tidewater.plans import catalog as K
from tidewater.plans import views as V
from tidewater.sources.auto import receive_auto
from tidewater.sources.sender import correlated
from tidewater.streaming import acks, buffers, qos
from tidewater.streaming.recycling import RecycleConfig, RecyclingLoop
from tidewater.streaming.replay import BATCH, MANY, Replay

#: When the clock stands after the table's end.
END_US = 1_893_456_000_000_000
HOUR = 3_600_000_000


def _completions(s, d):
    return V.completions(s, d).where("done_us is not null").select("part", "off", "done_us", "outcome", F.col("event_id").alias("seq"))


@K.query(K._ORDERED + " select part, off, drained_us as executed_us from o where drained_us is not null")
def stream_ack_ordered(s, d):
    """Completions come in any order; each takes effect when all before it have."""
    with Replay(s) as r:
        x = acks.acknowledged(r.scattered(_completions(s, d), "done_us", "seq"), immediate_errors=False)
        return r.to_end(x).select("part", "off", "executed_us")


@K.query(K._ORDERED + """ select part, off, case when outcome = 'NACK' then done_us else drained_us end as executed_us, drained_us from o where drained_us is not null or outcome = 'NACK' and done_us is not null""")
def stream_ack_immediate_error(s, d):
    """A refusal takes effect at once, its slot is freed in order: two rows, put together here."""
    with Replay(s) as r:
        x = r.to_end(acks.acknowledged(r.scattered(_completions(s, d), "done_us", "seq")))
        return x.groupBy("part", "off").agg(F.max("executed_us").alias("executed_us"), F.max("drained_us").alias("drained_us"))


@K.query("""select part, off, x[1] as executed_us, case when x[3] = 1 then 'NACK' else 'ACK' end as executed_as from (
 select part, off, min(case when done_us is not null then [done_us, event_id, (outcome = 'NACK')::bigint] end) over (partition by part order by off rows between current row and unbounded following) as x from completions) where x is not null""")
def stream_ack_cumulative(s, d):
    with Replay(s) as r:
        x = acks.acknowledged(r.in_order(_completions(s, d), "done_us", most=BATCH), "MULTIPLE")
        return r.to_end(x).select("part", "off", "executed_us", F.col("outcome").alias("executed_as"))


def _works(s, d, r, *columns):
    """The works' columns that a query is in need of: each costs a conversion a row, on the way to Python and back."""
    far = [{"event_id": -1 - i, "subject": -1, "type": "INTENT", "marker": "", "us": END_US + i * HOUR, "inception_ms": 0, "recycle_count": 0, "prepared": False, "fails": False, "rank": 0} for i in range(2)]
    return r.in_order(V.works(s, d).select(*columns), "us", last=[tuple(w[c] for c in columns) for w in far], most=MANY)


@K.query(K._TR + """ select subject, "window", state, fate, n, n_kept, case when state = 'TRANSLATED' then winner end as winner from o""", True)
def stream_translate(s, d):
    """Works buffered, reconciled and translated as they come."""
    with Replay(s) as r:
        x = buffers.translate(buffers.work_buffers(_works(s, d, r, "event_id", "subject", "marker", "us", "inception_ms", "fails", "rank"), K.BUFFER), F.col("work.fails"), F.col("work.rank") == 1)
        x = x.select("subject", "window", "state", "fate", "n", "n_kept", F.when(F.col("state") == "TRANSLATED", F.col("work.event_id")).alias("winner"))
        return r.to_end(x.where("subject <> -1"))


@K.query(K._BUFFER + " select event_id, subject, win as window, window_start from b", True)
def stream_work_buffer(s, d):
    with Replay(s) as r:
        x = buffers.work_buffers(_works(s, d, r, "event_id", "subject", "us", "rank"), K.BUFFER).where("subject <> -1")
        return r.to_end(x.select("subject", "window", "window_start", F.explode("works").alias("w"))).select("w.event_id", "subject", "window", "window_start")


_LIMIT = """with n as (select event_id, part, us, row_number() over (partition by part order by us, event_id) as rk from records)
select event_id, max(us - rk * 3600000000) over (partition by part order by us, event_id rows between unbounded preceding and current row) + rk * 3600000000 as out_us from n"""


@K.query(_LIMIT)
def stream_rate_limit(s, d):
    """Rows are held back until event time has reached their permit."""
    with Replay(s) as r:
        records = r.once(V.events(s, d).select("event_id", (F.col("user_id") % 10).cast("bigint").alias("part"), "us"), "records")
        n, latest = records.agg(F.count("*"), F.max("us")).first()
        end = (latest or 0) + (n + 1) * HOUR  # no permit is later
        x = r.in_order(records, "us", last=[(-1 - i, -1, end + i * HOUR) for i in range(3)], most=BATCH)
        return r.to_end(qos.rate_limited(x, 1 / 3600, "part").where("part <> -1").select("event_id", "out_us"))


@K.query("""with l as (select key, us as last_us, lead(us) over (partition by key order by us, event_id) as next_us from records)
select key, last_us, last_us + 46800000000 as noticed_us from l where coalesce(next_us, 1893456000000000) > last_us + 46800000000""")
def stream_silence(s, d):
    """Each silence of a key is told once, also one that lasts to the end."""
    with Replay(s) as r:
        x = r.in_order(V.events(s, d).select(F.col("user_id").cast("string").alias("key"), "us"), "us", last=[("", END_US + 100 * i * HOUR) for i in range(2)], most=MANY)
        # on the stream this condition would be pushed below the watermark, which the last rows then would not move
        return r.to_end(qos.silent(x, "key", 12 * HOUR, HOUR)).where("key <> ''")


@K.query("""with n as (select value as grp, event_id, row_number() over (partition by value order by us, event_id) - 1 as rn from records)
select grp, (rn // 50)::bigint as buffer, string_agg(event_id::varchar, ',' order by rn) as joined from n group by grp, rn // 50""")
def stream_grouped_pipeline(s, d):
    """Buffers of fifty by group, joined, let through at a rate: two operators with state, one after the other."""
    with Replay(s) as r:
        records = V.events(s, d).select(F.col("event_type").alias("grp"), "event_id", "us")
        x = r.in_order(records, "us", last=[("", -1 - i, END_US + 800 * i * 24 * HOUR) for i in range(4)], most=BATCH)
        join = lambda works: F.array_join(F.transform(works, lambda w: w["event_id"].cast("string")), ",")
        x = buffers.grouped_pipeline(x, "events", "grp", WindowConfig(timedelta(days=365), 50), join)
        return r.to_end(x.where("grp <> ''").select("grp", "buffer", F.col("result").alias("joined")))


@K.query("""select r.event_id, case when c.done_us is null or c.done_us > r.us + 60000000 then 'NACKED' when c.outcome = 'NACK' then 'NACKED' else 'ACKED' end as status,
 case when c.done_us is null or c.done_us > r.us + 60000000 then 'no result in time' when c.outcome = 'NACK' then 'refused' end as error from records r left join completions c using (part, off)""")
def stream_send_results(s, d):
    """Sends joined to results that come within a minute; the others are refused once, when their time is over."""
    with Replay(s) as r:
        c = r.once(V.completions(s, d), "completions")
        sends = r.in_order(c.select("event_id", "part", "off", "us"), "us", 2, [(-1, -1, i, END_US + i * HOUR) for i in range(2)], "sends")
        done = c.where("done_us is not null").select("part", "off", F.when(F.col("outcome") == "NACK", "refused").alias("error"), "done_us")
        results = r.in_order(done, "done_us", 2, [(-2, i, None, END_US + i * HOUR) for i in range(2)], "results")
        x = correlated(sends.withColumn("at", F.timestamp_micros("us")), results.withColumn("back", F.timestamp_micros("done_us")), ["part", "off"], "at", "back", timedelta(minutes=1))
        # on the stream this condition would be pushed below the watermark, which the last rows then would not move
        return r.to_end(x.select("part", "event_id", "status", "error")).where("part >= 0").drop("part")


@K.query(f"with c as (select part, (us // {K.HOURS6} + 1) * {K.HOURS6} as window_end, max(off) + 1 as commit_off, count(*) as n from records group by all) select *, window_end + 5000000 as ack_us from c where window_end + 5000000 <= (select max(us) from ev)")
def stream_auto_ack(s, d):
    """What a source that acknowledges itself has in its log when the last of the table has been read: the intervals that were due."""
    with Replay(s) as r:
        x = r.in_order(V.records(s, d).select("part", "off", "us", "event_id"), "us", most=MANY)
        receiver = receive_auto(x, r.scratch("log"), lambda batch, n: None, r.scratch("checkpoint"), timedelta(hours=6), timedelta(seconds=5), availableNow=True)
        receiver.awaitTermination()
        receiver.acks.commits().write.parquet(f"{r.folder}/commits")
        return s.read.parquet(f"{r.folder}/commits")


@K.query("with " + K.oracle_sql()["recycle_attempts"].split(V.SQL, 1)[1].lstrip(", "), True)
def stream_recycling(s, d):
    """The same works going round through their topic until none is on its way."""
    with Replay(s) as r:
        now_ms = V.events(s, d).agg(F.expr("max(us) div 1000")).first()[0]
        w = V.works(s, d).join(V.events(s, d).select("event_id", "k"), "event_id").select("event_id", "k", "type", "inception_ms", "recycle_count")
        config = RecycleConfig(timedelta(milliseconds=K._LATE_MS), K._MOST, ("E1",))
        loop = RecyclingLoop(s, r.scratch("topic"), w.schema, lambda b: b.withColumn("error", K._try_error(F.col("recycle_count"))), config, r.folder, lambda: now_ms)
        loop.publish(w)
        loop.start()
        loop.rest()
        loop.stop()
        return loop.outcomes().select("event_id", "type", "recycle_count", "error", "outcome")
