"""The registered queries: each operator over whole tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from tidewater.functions import avro
from tidewater.functions import columns as C
from tidewater.functions import translation as T
from tidewater.functions.model import WindowConfig
from tidewater.operators import ack, envelope, grouping, prefix, publishing, qos, tracing, windows
from tidewater.plans import views as V
from tidewater.sources import kafka, messages, queue, topics
from tidewater.streaming.pipeline import outcome_counts

_Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

HOURS6 = 6 * 3600 * 1_000_000
SIX = WindowConfig(timedelta(hours=6), 4)
SIX_ANY = WindowConfig(timedelta(hours=6))
BUFFER = WindowConfig(timedelta(hours=6), 8)
TOPICS = {"click": "clicks", "view": "views", "purchase": "orders"}
NOW_MS, DAYS = 1_800_000_000_000, 86_400_000


def query(sql: str | None = None, recursive: bool = False):
    def put(f):
        _Q[f.__name__] = f
        if sql is not None:
            body = sql.strip()
            _SQL[f.__name__] = f"with {'recursive ' if recursive else ''}{V.SQL}" + (f", {body[5:]}" if body.startswith("with ") else f" {body}")
        return f

    return put


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _walk_sql(max_size: int | None, commit: bool, source: str = "works") -> str:
    """Window numbers by a recursive walk over each subject's works."""
    full = f"or w.n >= {max_size}" if max_size else ""
    opens = f"(w.closed or e.us >= w.st + {HOURS6} {full})"
    return f"""with e as (select *, row_number() over (partition by subject order by us, event_id) as rn from {source}),
w(subject, rn, st, n, win, closed) as (
  select subject, rn, us, 1, 0, {"type = 'COMMIT'" if commit else "false"} from e where rn = 1
  union all
  select e.subject, e.rn, case when {opens} then e.us else w.st end, case when {opens} then 1 else w.n + 1 end, case when {opens} then w.win + 1 else w.win end, {"e.type = 'COMMIT'" if commit else "false"}
  from w join e on e.subject = w.subject and e.rn = w.rn + 1),
b as (select e.*, w.st as window_start, w.win::bigint as win from e join w using (subject, rn))"""


# sources and projections
@query("select topic, part, off, us, key, value from records")
def records_view(s, d):
    return V.records(s, d).select("topic", "part", "off", "us", "key", "value")


@query("select part, off, value from records where value <> 'error'")
def value_source_nonnull(s, d):
    r = V.records(s, d).withColumn("value", F.when(F.col("value") != "error", F.col("value")))
    return r.where("value is not null").select("part", "off", "value")


@query("select event_id, subject, type, marker, inception_ms, recycle_count, prepared from works")
def works_view(s, d):
    return V.works(s, d).select("event_id", "subject", "type", "marker", "inception_ms", "recycle_count", "prepared")


@query("select part, count(*) as n, min(off) as first_off, max(off) as last_off from records group by part")
def source_by_partition(s, d):
    return V.records(s, d).groupBy("part").agg(F.count("*").alias("n"), F.min("off").alias("first_off"), F.max("off").alias("last_off"))


@query("select 'out-' || value as topic, key, value, '' as headers, case when k % 10 = 0 then 'rejected' end as error, event_id from records")
def value_sink(s, d):
    """Outbound records: topic and key by extractors, headers stripped, the outcome of each."""
    r = V.records(s, d)
    out = kafka.outbound(r, F.concat(F.lit("out-"), "value"), F.col("key"), F.col("value"), F.col("headers"))
    return out.select("topic", "key", "value", C.render_map(F.col("headers")).alias("headers"), F.when(F.col("k") % 10 == 0, "rejected").alias("error"), "event_id")


# windows
def _dedup(s, d, config, keep):
    w = V.works(s, d).select("event_id", "subject", "us")
    return windows.deduplicate(w, "subject", "us", "event_id", config, keep).select("subject", "window", "event_id", "n", "emit_us")


_EMIT = f"case when count(*) >= 4 then max(us) else min(window_start) + {HOURS6} end"


@query(_walk_sql(None, False) + f" select subject, win as window, min_by(event_id, rn) as event_id, count(*) as n, min(window_start) + {HOURS6} as emit_us from b group by subject, win", True)
def dedup_first(s, d):
    return _dedup(s, d, SIX_ANY, "first")


@query(_walk_sql(None, False) + f" select subject, win as window, max_by(event_id, rn) as event_id, count(*) as n, min(window_start) + {HOURS6} as emit_us from b group by subject, win", True)
def dedup_last(s, d):
    return _dedup(s, d, SIX_ANY, "last")


@query(_walk_sql(4, False) + f" select subject, win as window, min_by(event_id, rn) as event_id, count(*) as n, {_EMIT} as emit_us from b group by subject, win", True)
def dedup_size_cap(s, d):
    return _dedup(s, d, SIX, "first")


@query("select event_id, subject, us from works")
def dedup_disabled(s, d):
    return windows.deduplicate(V.works(s, d).select("event_id", "subject", "us"), "subject", "us", "event_id", WindowConfig(timedelta(0)))


_BUFFER = _walk_sql(8, True)


def _buffers(s, d):
    return windows.work_buffers(V.works(s, d), BUFFER)


@query(_BUFFER + " select event_id, subject, win as window, window_start from b", True)
def work_buffer(s, d):
    return _buffers(s, d).select("event_id", "subject", "window", "window_start")


@query(_BUFFER + " select subject, win as window, count(*) as n, max_by(type, rn) as last_type from b group by subject, win having max_by(type, rn) = 'COMMIT'", True)
def work_buffer_commit_close(s, d):
    last = F.max_by("type", F.struct("us", "event_id"))
    return _buffers(s, d).groupBy("subject", "window").agg(F.count("*").alias("n"), last.alias("last_type")).where("last_type = 'COMMIT'")


@query(_BUFFER + ", o as (select subject, win, count(*) as n from b group by subject, win) select (select count(*) from works)::bigint as n_in, (select sum(n) from o)::bigint as n_out", True)
def work_buffer_conservation(s, d):
    """As many works leave the buffers as came in."""
    n = V.works(s, d).select(F.lit(1).alias("i"), F.lit(0).cast("bigint").alias("n"))
    out = _buffers(s, d).groupBy("subject", "window").agg(F.count("*").alias("n")).select(F.lit(0).alias("i"), "n")
    return n.unionByName(out).agg(F.sum("i").alias("n_in"), F.sum("n").alias("n_out"))


_REL = _BUFFER + ", r as (select *, max(rank) over (partition by subject, win, marker) as relevance from b), f as (select *, relevance <> 2 and rank <> 2 as kept from r)"


@query(_REL + " select subject, win as window, max_by(event_id, (rank, inception_ms, us, event_id)) filter (where kept) as winner, count(*) as n, count(*) filter (where kept) as n_kept from f group by subject, win", True)
def work_buffer_reduce(s, d):
    return windows.reduce_buffers(_buffers(s, d))


@query(_REL + " select event_id, kept from f", True)
def cancel_filter(s, d):
    return windows.with_relevance(_buffers(s, d)).select("event_id", "kept")


@query(_REL + " select subject, win as window, max_by(event_id, (inception_ms, us, event_id)) filter (where kept) as winner from f group by subject, win", True)
def reduce_latest(s, d):
    return windows.reduce_buffers(_buffers(s, d), prioritized=False).select("subject", "window", "winner")


@query(_REL + " select subject, win as window, max_by(event_id, (rank, inception_ms, us, event_id)) filter (where kept) as winner from f group by subject, win", True)
def reduce_prioritized(s, d):
    return windows.reduce_buffers(_buffers(s, d)).select("subject", "window", "winner")


@query(_BUFFER + " select subject, win as window, marker, max(rank)::integer as relevance from b group by all", True)
def marker_relevance(s, d):
    return _buffers(s, d).groupBy("subject", "window", "marker").agg(F.max("rank").alias("relevance"))


_TR = _REL + """, t as (select subject, win as window, max_by({'event_id': event_id, 'rank': rank, 'fails': fails}, (rank, inception_ms, us, event_id)) filter (where kept) as w, count(*) as n, count(*) filter (where kept) as n_kept from f group by subject, win),
o as (select subject, "window", w.event_id as winner, case when n_kept = 0 then 'EMPTY' when w.fails then 'FAILED' else 'TRANSLATED' end as state,
 case when n_kept = 0 then 'ACKED' when w.fails then case when w.rank = 1 then 'NACKED' else 'ACKED' end else 'CARRIED' end as fate, n, n_kept from t)"""


@query(_TR + """ select subject, "window", winner from o where state = 'TRANSLATED'""", True)
def translate_ok(s, d):
    return windows.translate_buffers(_buffers(s, d)).where("state = 'TRANSLATED'").select("subject", "window", "winner")


@query(_TR + """ select subject, "window", winner, n_kept from o where state = 'FAILED'""", True)
def translate_failed(s, d):
    return windows.translate_buffers(_buffers(s, d)).where("state = 'FAILED'").select("subject", "window", "winner", "n_kept")


@query(_TR + """ select subject, "window", state, fate, n, n_kept from o""", True)
def translate_ack_outcome(s, d):
    return windows.translate_buffers(_buffers(s, d)).select("subject", "window", "state", "fate", "n", "n_kept")


@query("select o_orderkey, o_custkey as subject, c_name, c_custkey is not null as fetched from orders left join customer on o_custkey = c_custkey")
def fetch_prepare(s, d):
    o = V.table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("subject"))
    c = V.table(s, d, "customer").select("c_custkey", "c_name")
    return windows.fetch_prepare(o, c, "subject", "c_custkey").select("o_orderkey", "subject", "c_name", "fetched")


_RECYCLE = f"""with f as (select *, 'E' || (k % 3)::varchar as error from works join (select event_id, k from ev) using (event_id) where fails),
g as (select *, not ({NOW_MS} - inception_ms > {40_000 * DAYS}) and not (recycle_count > 5) and error not in ('E1') as ok from f)"""


def _failed(s, d):
    k = V.events(s, d).select("event_id", "k")
    w = V.works(s, d).where("fails").join(k, "event_id").withColumn("error", F.concat(F.lit("E"), (F.col("k") % 3).cast("string")))
    return w.withColumn("ok", windows.recyclable(F.lit(NOW_MS), 40_000 * DAYS, 5, ["E1"], F.col("error")))


@query(_RECYCLE + " select event_id, subject, marker, inception_ms, 'RETRY' as type, recycle_count + 1 as recycle_count from g where ok")
def recycle(s, d):
    return windows.recycle(_failed(s, d).where("ok")).select("event_id", "subject", "marker", "inception_ms", "type", "recycle_count")


@query(_RECYCLE + " select event_id, error, recycle_count from g where not ok")
def recycle_drop(s, d):
    return _failed(s, d).where("not ok").select("event_id", "error", "recycle_count")


_LATE_MS, _MOST = 20 * DAYS, 10


def _try_error(count):
    """What a work's try ends with: most fail, an eleventh or so of them for good."""
    return F.when((F.col("k") * 7 + count * 5) % 11 < 9, F.concat(F.lit("E"), (F.col("k") % 7).cast("string")))


@query(f"""with w as (select works.*, k, (select max(us) // 1000 from ev) as now_ms from works join (select event_id, k from ev) using (event_id)),
a(event_id, k, inception_ms, now_ms, type, recycle_count) as (select event_id, k, inception_ms, now_ms, type, recycle_count from w
 union all select event_id, k, inception_ms, now_ms, 'RETRY', recycle_count + 1 from a
 where (k * 7 + recycle_count * 5) % 11 < 9 and k % 7 <> 1 and not (now_ms - inception_ms > {_LATE_MS}) and not (recycle_count > {_MOST}))
select event_id, type, recycle_count, case when fails then 'E' || (k % 7)::varchar end as error,
 case when not fails then 'DONE' when k % 7 = 1 or now_ms - inception_ms > {_LATE_MS} or recycle_count > {_MOST} then 'DROPPED' else 'RECYCLED' end as outcome
from (select *, (k * 7 + recycle_count * 5) % 11 < 9 as fails from a)""", True)
def recycle_attempts(s, d):
    """Failed works go round until they succeed, are too old, too often, or fail for a reason that rules it out."""
    now_ms = V.events(s, d).agg(F.expr("max(us) div 1000")).first()[0]
    w = V.works(s, d).join(V.events(s, d).select("event_id", "k"), "event_id")
    x = windows.attempts(w, _try_error, F.lit(now_ms).cast("bigint"), _LATE_MS, _MOST, ["E1"])
    return x.select("event_id", "type", "recycle_count", "error", "outcome")


# acknowledgement
_ORD = "rows between unbounded preceding and current row"
_ORDERED = f"with o as (select *, case when count(*) filter (where done_us is null) over w = 0 then max(done_us) over w end as drained_us from completions window w as (partition by part order by off {_ORD}))"


@query(_ORDERED + " select event_id, drained_us as executed_us from o")
def ack_ordered(s, d):
    return ack.ordered(V.completions(s, d)).select("event_id", "executed_us")


@query(_ORDERED + " select event_id, drained_us, case when outcome = 'NACK' then done_us else drained_us end as executed_us from o")
def ack_ordered_immediate_error(s, d):
    return ack.ordered(V.completions(s, d), immediate_errors=True).select("event_id", "drained_us", "executed_us")


@query("""select event_id, x[1] as executed_us, case when x[3] = 1 then 'NACK' when x[3] = 0 then 'ACK' end as executed_as from (
 select event_id, min(case when done_us is not null then [done_us, event_id, (outcome = 'NACK')::bigint] end) over (partition by part order by off rows between current row and unbounded following) as x from completions)""")
def ack_cumulative(s, d):
    return ack.cumulative(V.completions(s, d)).select("event_id", "executed_us", "executed_as")


_COMMIT = "with c as (select part, coalesce(min(off) filter (where done_us is null or outcome = 'NACK'), max(off) + 1) as commit_off, count(*) as n from completions group by part)"


@query(_COMMIT + " select part, commit_off, n from c")
def committable_offset(s, d):
    return ack.committable(V.completions(s, d))


@query(_COMMIT + " select event_id, part, off from completions join c using (part) where off >= commit_off")
def replay_set(s, d):
    return ack.replay(V.completions(s, d)).select("event_id", "part", "off")


_CHILD = """with ch as (select event_id, i, case when (event_id + i) % 29 <> 0 then us + (event_id * 31 + i * 17) % 53 * 1000000 end as done_us, case when (event_id + i) % 23 = 0 then 'NACK' else 'ACK' end as outcome
 from (select event_id, us, unnest(range(k % 4)) as i from ev)),
a as (select event_id, count(*) as n, count(done_us) as n_done, min(done_us) filter (where outcome = 'NACK') as nack_us, max(done_us) as last_us from ch group by event_id),
fl as (select event_id, k, us, coalesce(n, 0) as n, case when n is null then 'ACK' when nack_us is not null then 'NACK' when n = n_done then 'ACK' else 'PENDING' end as status,
 case when n is null then us when nack_us is not null then nack_us when n = n_done then last_us end as status_us from ev left join a using (event_id))"""


def _flat(s, d):
    e = V.events(s, d)
    ch = e.where("k % 4 > 0").select("event_id", "us", F.explode(F.expr("sequence(0, k % 4 - 1)")).alias("i"))
    done = F.when((F.col("event_id") + F.col("i")) % 29 != 0, F.col("us") + (F.col("event_id") * 31 + F.col("i") * 17) % 53 * 1_000_000)
    ch = ch.select("event_id", done.alias("done_us"), F.when((F.col("event_id") + F.col("i")) % 23 == 0, "NACK").otherwise("ACK").alias("outcome"))
    return ack.flatten(ch, "event_id", e.select("event_id", "us"))


@query(_CHILD + " select event_id, n, status, status_us from fl")
def ack_flatten(s, d):
    return _flat(s, d)


@query(_CHILD + " select event_id, n, status, case when status = 'ACK' then greatest(status_us, us + k * 1000000) else status_us end as status_us from fl")
def ack_publish(s, d):
    f = _flat(s, d).join(V.events(s, d).select("event_id", "us", "k"), "event_id")
    return ack.publish(f, F.col("us") + F.col("k") * 1_000_000).select("event_id", "n", "status", "status_us")


@query("select event_id, value = 'purchase' as passed, case when value = 'purchase' then 'PENDING' else 'ACKED' end as status from records")
def filter_ack(s, d):
    return envelope.filtered(envelope.acknowledgeable(V.records(s, d)), F.col("value") == "purchase").select("event_id", "passed", "status")


@query("select event_id, case when k <> 0 then 100 // k end as result, case when k = 0 then 'NACKED' else 'PENDING' end as status from ev")
def map_ack(s, d):
    """A mapping that fails nacks its record."""
    return envelope.mapped(envelope.acknowledgeable(V.events(s, d)), "result", F.expr("case when k <> 0 then 100 div k end"), F.col("k") == 0).select("event_id", "result", "status")


@query("select key, sum(k)::bigint as total, string_agg(event_id::varchar, ',' order by off) as ack_order from records group by key")
def reduce_ack(s, d):
    """Values folded, acknowledgements run in order."""
    r = envelope.reduced(V.records(s, d), "key", "off", {"total": F.sum("k")}, "event_id")
    return r.select("key", "total", F.array_join(F.col("ack_order").cast("array<string>"), ",").alias("ack_order"))


@query("select part, off // 8 as batch, count(*) as n, string_agg(off::varchar, ',' order by off) as members from records group by all")
def invert_list(s, d):
    r = envelope.inverted(V.records(s, d).withColumn("batch", F.expr("off div 8")), ["part", "batch"], "off", "off")
    return r.select("part", "batch", "n", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"))


@query(f"select part, (us // {HOURS6} + 1) * {HOURS6} as window_end, max(off) + 1 as commit_off, count(*) as n, (us // {HOURS6} + 1) * {HOURS6} + 5000000 as ack_us from records group by part, us // {HOURS6}")
def auto_ack_commits(s, d):
    return ack.auto_commits(V.records(s, d), HOURS6, 5_000_000)


@query(f"select (us // {HOURS6} + 1) * {HOURS6} as window_end, max_by(event_id, (us, event_id)) as event_id from records group by us // {HOURS6}")
def auto_ack_last(s, d):
    """The last message of each interval, which a multiple acknowledgement answers for all."""
    return ack.auto_last(V.records(s, d), HOURS6, ["us", "event_id"], "event_id")


@query("select event_id, case when outcome = 'NACK' then case when event_id % 2 = 0 then 'DISCARD' else 'REQUEUE' end else 'ACK' end as action from completions where done_us is not null")
def nack_policy(s, d):
    """Half of the messages come by a source that discards what is refused, half by one that puts it back."""
    c = V.completions(s, d).where("done_us is not null")
    out = []
    for policy, mine in (("DISCARD", F.col("event_id") % 2 == 0), ("REQUEUE", F.col("event_id") % 2 != 0)):
        good, bad = queue.split_outcomes(c.where(mine), policy)
        action = F.when(F.col("target") == "dead-letter", "DISCARD").otherwise("REQUEUE")
        out += [good.select("event_id", F.lit("ACK").alias("action")), bad.select("event_id", action.alias("action"))]
    return envelope.concat(*out).drop("stream")


@query("""select r.event_id, case when c.done_us is null then 'OPEN' when c.outcome = 'NACK' then 'NACK' else 'ACK' end as status,
 case when c.done_us is not null and c.outcome = 'NACK' then 'refused' end as error from records r left join completions c using (part, off)""")
def send_correlation(s, d):
    """Results of sends find the records they belong to by partition and offset."""
    done = V.completions(s, d).where("done_us is not null").select("part", "off", F.when(F.col("outcome") == "NACK", "refused").alias("error"))
    return ack.correlate(V.records(s, d).select("event_id", "part", "off"), done, ["part", "off"]).select("event_id", "status", "error")


@query("""select event_id, value as operand, case when k % 3 <> 0 and value <> 'view' and length(value) >= 6 then upper(value) || '!' end as result,
 case when k % 3 <> 0 then value || '?' end as composed from records""")
def translation_algebra(s, d):
    """A translator's result is mapped, filtered and translated again; the operand stays."""
    r = V.records(s, d)
    known = lambda c: F.when(F.col("k") % 3 != 0, c)
    t = T.translation(F.col("value"), known)
    t = T.filter_result(t, lambda c: c != "view")
    t = T.map_result(t, F.upper)
    t = T.flat_map_result(t, lambda c: T.translation(c, lambda x: F.when(F.length(x) >= 6, F.concat(x, F.lit("!")))))
    composed = T.compose(known, lambda c: F.concat(c, F.lit("?")))(F.col("value"))
    return r.select("event_id", t.alias("t"), composed.alias("composed")).select("event_id", "t.operand", "t.result", "composed")


@query("select batch, string_agg(off::varchar || '=' || event_id::varchar, ',' order by off::varchar) as entries from (select part::varchar || ':' || (off // 8)::varchar as batch, off, event_id from records) group by batch")
def list_to_map(s, d):
    r = V.records(s, d).select(F.concat(F.col("part").cast("string"), F.lit(":"), F.expr("off div 8").cast("string")).alias("batch"), F.col("off").cast("string").alias("off"), F.col("event_id").cast("string").alias("event_id"))
    return grouping.to_map(r, "batch", "off", "event_id").select("batch", C.render_map(F.col("entries")).alias("entries"))


# grouping and routing
@query("select ('0x' || substr(md5(key), 1, 8))::bigint % 16 as grp, count(*) as n from records group by 1")
def group_hash(s, d):
    return V.records(s, d).groupBy(grouping.hash_group(F.col("key"), 16).alias("grp")).agg(F.count("*").alias("n"))


@query("select ('0x' || substr(md5(replace(u, '-', '')), 1, 8))::bigint % 16 as grp, count(*) as n from (select '00000000-0000-0000-0000-' || lpad(event_id::varchar, 12, '0') as u from ev) group by 1")
def group_uuid(s, d):
    u = F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(F.col("event_id").cast("string"), 12, "0"))
    return V.events(s, d).groupBy(grouping.uuid_group(u, 16).alias("grp")).agg(F.count("*").alias("n"))


@query("select value as grp, count(*) as n from records group by value")
def group_field(s, d):
    return V.records(s, d).groupBy(F.col("value").alias("grp")).agg(F.count("*").alias("n"))


@query("select 'SINGLETON' as grp, count(*) as n from records")
def group_singleton(s, d):
    return V.records(s, d).agg(F.count("*").alias("n")).select(F.lit(grouping.SINGLETON).alias("grp"), "n")


@query("select event_id, case value when 'click' then 'clicks' when 'view' then 'views' when 'purchase' then 'orders' end as topic from records")
def route_topic(s, d):
    return V.records(s, d).select("event_id", grouping.route(F.col("value"), TOPICS).alias("topic"))


@query("select lang as grp, count(*) as n, 'docs-' || lang as topic from documents group by lang")
def route_documents(s, d):
    return V.table(s, d, "documents").groupBy(F.col("lang").alias("grp")).agg(F.count("*").alias("n")).withColumn("topic", F.concat(F.lit("docs-"), "grp"))


_ASSIGN = "with np as (select distinct topic, length(topic)::bigint as n_parts from members where topic <> 'error'), b as (select *, row_number() over (partition by topic order by born_ms {0}, member_id {0}) as rn from members) select topic, member_id, case when rn = 1 then coalesce(n_parts, 0) else 0 end as n_assigned from b left join np using (topic)"


def _assign(s, d, youngest):
    m = V.members(s, d)
    return grouping.assign_all(m, m.select("topic").distinct().where("topic <> 'error'").withColumn("n_parts", F.length("topic").cast("bigint")), youngest)


@query(_ASSIGN.format("desc"))
def assign_youngest(s, d):
    return _assign(s, d, True)


@query(_ASSIGN.format("asc"))
def assign_oldest(s, d):
    return _assign(s, d, False)


@query("""with n as (select value as grp, event_id, row_number() over (partition by value order by us, event_id) - 1 as rn from records)
select grp, (rn // 50)::bigint as buffer, string_agg(event_id::varchar, ',' order by rn) as joined from n group by grp, rn // 50""")
def grouped_pipeline(s, d):
    r = V.records(s, d).withColumn("grp", F.col("value"))
    return grouping.buffered(r, "grp", ["us", "event_id"], 50, "event_id").withColumn("buffer", F.col("buffer").cast("bigint"))


# quality of service
@query("""with n as (select event_id, part, us, row_number() over (partition by part order by us, event_id) as rk from records)
select event_id, max(us - rk * 3600000000) over (partition by part order by us, event_id rows between unbounded preceding and current row) + rk * 3600000000 as out_us from n""")
def rate_limit(s, d):
    return qos.rate_limit(V.records(s, d), 1 / 3600, "part").select("event_id", "out_us")


@query()
def rate_limit_burst(s, d):
    return qos.rate_limit_burst(V.records(s, d).select("event_id", "part", "us"), 1 / 3600, "part").select("event_id", "out_us")


@query("select event_id, us as out_us from records")
def rate_limit_disabled(s, d):
    return qos.rate_limit(V.records(s, d), 0, "part").select("event_id", F.col("us").alias("out_us"))


@query("""with l as (select key, us as last_us, lead(us) over (partition by key order by us, event_id) as next_us from records)
select key, last_us, next_us, last_us + (43200000000 // 3600000000 + 1) * 3600000000 as noticed_us from l where next_us > last_us + (43200000000 // 3600000000 + 1) * 3600000000""")
def activity_violations(s, d):
    e = V.events(s, d).select(F.col("user_id").cast("string").alias("key"), "us", "event_id")
    return qos.inactivity(e, "key", 12 * 3_600_000_000, 3_600_000_000)


@query("select event_id, us, 'data' as signal from records union all select -1 as event_id, min(us) as us, 'error' as signal from records")
def merge_signals(s, d):
    r = V.records(s, d).select("event_id", "us")
    return envelope.merged(data=r, error=r.agg(F.min("us").alias("us")).select(F.lit(-1).cast("bigint").alias("event_id"), "us"))


@query("select part, off, event_id from records where off < 3")
def take_first(s, d):
    return envelope.taken(V.records(s, d), "part", ["off"], 3).select("part", "off", "event_id")


# headers, names, codecs
@query("select event_id, 'a=' || (k + 1)::varchar || ',k=' || k::varchar as headers from ev")
def headers_last_wins(s, d):
    k = F.col("k").cast("string")
    entries = F.array(*(F.struct(F.lit(n).alias("key"), v.alias("value")) for n, v in (("a", k), ("k", k), ("a", (F.col("k") + 1).cast("string")))))
    return V.events(s, d).select("event_id", C.render_map(C.last_wins(entries)).alias("headers"))


@query("select event_id, 'k=' || value as headers from records")
def headers_put_unique(s, d):
    return V.records(s, d).select("event_id", C.render_map(C.put_unique(F.col("headers"), "k", F.col("value"))).alias("headers"))


def _headed(s, d):
    return V.events(s, d).select("event_id", F.create_map(F.lit("span"), F.lit("x"), F.lit("tag"), F.col("event_type"), F.lit("user"), F.col("user_id").cast("string")).alias("h"))


@query("select event_id, 'user=' || user_id::varchar as baggage from ev")
def baggage(s, d):
    return _headed(s, d).select("event_id", C.render_map(C.baggage(F.col("h"), ["span", "tag"])).alias("baggage"))


@query("select event_id, 'tag=' || event_type as tags from ev")
def header_tags(s, d):
    return _headed(s, d).select("event_id", C.render_map(C.header_tags(F.col("h"), ["tag", "absent"])).alias("tags"))


@query("select o_orderkey, cast(o_totalprice as decimal(18,2))::varchar as price, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '.000Z' as day, 'x' || o_orderkey::varchar as raw from orders")
def headers_stringify(s, d):
    o = V.table(s, d, "orders")
    return o.select(
        "o_orderkey", C.stringify_value(F.col("o_totalprice").cast("decimal(18,2)"), "decimal").alias("price"), C.stringify_value(F.col("o_orderdate").cast("timestamp"), "timestamp").alias("day"),
        C.stringify_value(F.concat(F.lit("x"), F.col("o_orderkey").cast("string")).cast("binary"), "binary").alias("raw"),
    )


@query(r"""select event_id, regexp_replace(case k % 3 when 0 then event_type || '-' || u when 1 then u || '-' || event_type || '-' || u else event_type || upper(u) || '-12345678-1234' end, '-?[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}', '', 'g') as name
 from (select event_id, k, event_type, 'abcdef01-0000-0000-0000-' || lpad(event_id::varchar, 12, '0') as u from ev)""")
def strip_uuid(s, d):
    """UUIDs anywhere in a name, any number of them; only lower-case ones count."""
    u, t = F.concat(F.lit("abcdef01-0000-0000-0000-"), F.lpad(F.col("event_id").cast("string"), 12, "0")), F.col("event_type")
    name = F.when(F.col("k") % 3 == 0, F.concat(t, F.lit("-"), u)).when(F.col("k") % 3 == 1, F.concat(u, F.lit("-"), t, F.lit("-"), u)).otherwise(F.concat(t, F.upper(u), F.lit("-12345678-1234")))
    return V.events(s, d).select("event_id", C.strip_uuid(name).alias("name"))


@query("select event_id, list_last(string_split(name, '.')) as suffix from (select event_id, case k % 3 when 0 then 'a.b.' || event_type when 1 then event_type else event_type || '.' end as name from ev)")
def suffix_after_dot(s, d):
    """A name without a dot is its own suffix, one that ends with it has an empty one."""
    name = F.when(F.col("k") % 3 == 0, F.concat(F.lit("a.b."), "event_type")).when(F.col("k") % 3 == 1, F.col("event_type")).otherwise(F.concat("event_type", F.lit(".")))
    return V.events(s, d).select("event_id", C.after_last(name, ".").alias("suffix"))


@query(r"select event_id, regexp_replace(case k % 3 when 0 then event_type || '-' || event_id::varchar when 1 then event_type || '-' || k::varchar || '-x' else event_type || '-1-' || k::varchar end, '-\d+$', '') as client from ev")
def sanitize_client_id(s, d):
    """Only the last number goes, and only from the end."""
    t, k = F.col("event_type"), F.col("k").cast("string")
    c = F.when(F.col("k") % 3 == 0, F.concat(t, F.lit("-"), F.col("event_id").cast("string"))).when(F.col("k") % 3 == 1, F.concat(t, F.lit("-"), k, F.lit("-x"))).otherwise(F.concat(t, F.lit("-1-"), k))
    return V.events(s, d).select("event_id", C.sanitize_client_id(c).alias("client"))


_CLIENTS = """c as (select event_id, case k % 7 when 0 then 'app-' || k::varchar || '-StreamThread-' || n || '-consumer' when 1 then 'StreamThread-' || n when 2 then 'StreamThread-' || n || '-restore-consumer'
 when 3 then 'app-StreamThread-' || n || 'abc' when 4 then 'a-StreamThread-1-StreamThread-' || n when 5 then 'a-12345678-1234-1234-1234-123456789012-StreamThread-' || n else event_type || '-' || n end as id
 from (select event_id, event_type, k, (event_id % 7)::varchar as n from ev)),
m as (select event_id, id, regexp_matches(id, '^((.+?)-)?StreamThread-[0-9]+(-.+)?$') as thread, case when contains(id, 'StreamThread-') then strpos(id, 'StreamThread-') end as i, substr(id, strpos(id, 'StreamThread-') + 13) as rest from c),
t as (select event_id, id, case when thread and i > 1 then substr(id, 1, i - 2) end as prefix, case when thread then regexp_extract(rest, '^[0-9]+') end as thread, case when thread and contains(rest, '-') then substr(rest, strpos(rest, '-') + 1) end as kind from m)"""


def _clients(s, d):
    n, k = (F.col("event_id") % 7).cast("string"), F.col("k").cast("string")
    join = lambda *x: F.concat(*(F.lit(y) if isinstance(y, str) else y for y in x))
    kinds = [
        join("app-", k, "-StreamThread-", n, "-consumer"), join("StreamThread-", n), join("StreamThread-", n, "-restore-consumer"), join("app-StreamThread-", n, "abc"),
        join("a-StreamThread-1-StreamThread-", n), join("a-12345678-1234-1234-1234-123456789012-StreamThread-", n), join(F.col("event_type"), "-", n),
    ]
    c = kinds[6]
    for i in range(6):
        c = F.when(F.col("k") % 7 == i, kinds[i]).otherwise(c)
    return V.events(s, d).select("event_id", c.alias("id"))


@query(f"with {_CLIENTS} select event_id, prefix, thread, kind from t")
def stream_thread_tags(s, d):
    """The first thread in an id counts; a prefix and a client type may be missing."""
    p, t, kind = C.stream_thread(F.col("id"))
    return _clients(s, d).select("event_id", p.alias("prefix"), t.alias("thread"), kind.alias("kind"))


@query(f"""with {_CLIENTS} select event_id, 'client-id=' || regexp_replace(case when thread is null then id else coalesce(prefix, id) end, '-?[0-9a-f]{{8}}(-[0-9a-f]{{4}}){{3}}-[0-9a-f]{{12}}', '', 'g')
 || case when kind is not null then ',client-type=' || kind else '' end || case when thread is not null then ',stream-thread=' || thread else '' end as tags from t""")
def client_id_tags(s, d):
    return _clients(s, d).select("event_id", C.render_map(C.client_tags(F.col("id"))).alias("tags"))


@query("select event_type as name, count(*) as n from ev where event_type not in ('view', 'click') group by 1")
def metric_filter(s, d):
    return V.events(s, d).where(C.metric_reported(F.col("event_type"), ["view", "click"], False)).groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"))


@query("select event_id, 'items.(tag=' || event_type || ',user=' || user_id::varchar || ')' as name from ev")
def tagged_name(s, d):
    return _headed(s, d).select("event_id", C.tagged_name(F.lit("items"), F.map_filter("h", lambda k, v: k != "span")).alias("name"))


@query("select event_id, case when k % 5 = 0 then 0 else k end::double as finite, coalesce(try_cast(case when k % 3 = 0 then event_type else k::varchar end as double), -1) as gauge from ev")
def gauge_values(s, d):
    bad = F.when(F.col("k") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("k").cast("double"))
    g = C.numeric_or_nan(F.when(F.col("k") % 3 == 0, F.col("event_type")).otherwise(F.col("k").cast("string")))
    return V.events(s, d).select("event_id", C.finite_or_zero(bad).alias("finite"), F.nanvl(g, F.lit(-1.0)).alias("gauge"))


@query("select event_id, k >= 2 and len(list_filter(range(2, floor(sqrt(k))::bigint + 1), lambda i: k % i = 0)) = 0 as prime, upper(event_type) as name from ev")
def prime_and_upper(s, d):
    return V.events(s, d).select("event_id", C.is_prime(F.col("k")).alias("prime"), F.upper("event_type").alias("name"))


@query("select event_id, event_type as data1, user_id::varchar as data2, '{\"data1\":\"' || event_type || '\",\"data2\":\"' || user_id::varchar || '\"}' as json from ev")
def json_roundtrip(s, d):
    x = V.events(s, d).select("event_id", C.to_json(F.struct(F.col("event_type").alias("data1"), F.col("user_id").cast("string").alias("data2"))).alias("json"))
    r = C.from_json(F.col("json"), "data1 string, data2 string")
    return x.select("event_id", r["data1"].alias("data1"), r["data2"].alias("data2"), "json")


@query("select event_id, event_type as data from ev")
def xml_roundtrip(s, d):
    x = V.events(s, d).select("event_id", C.to_xml(F.struct(F.col("event_type").alias("data")), "record").alias("xml"))
    return x.select("event_id", C.from_xml(F.col("xml"), "data string", "record")["data"].alias("data"))


@query("select event_id, case when k % 7 <> 0 then k end as schema_id, case when k % 7 <> 0 then event_type end as payload from ev")
def avro_frame(s, d):
    f = F.when(F.col("k") % 7 == 0, F.lit("junk").cast("binary")).otherwise(C.avro_frame(F.col("event_type").cast("binary"), F.col("k")))
    _, number, payload = C.avro_unframe(F.col("f"))
    return V.events(s, d).select("event_id", f.alias("f")).select("event_id", number.alias("schema_id"), F.decode(payload, "UTF-8").alias("payload"))


@query("select event_id, case when k % 9 <> 0 then us // 1000 end as born_ms from ev")
def born_roundtrip(s, d):
    b = F.when(F.col("k") % 9 == 0, F.lit("odd").cast("binary")).otherwise(C.born_encode(F.expr("us div 1000")))
    return V.events(s, d).select("event_id", C.born_decode(b).alias("born_ms"))


# metrics and tracing
@query("select value as name, count(*) filter (where outcome = 'ACK') as items, count(*) filter (where outcome = 'NACK') as errors from completions join records using (event_id) group by value")
def metrics_items_errors(s, d):
    return V.events(s, d).groupBy(F.col("event_type").alias("name")).agg(*outcome_counts(F.col("event_type") == "error"))


@query("select key, case when max_by(value, (us, event_id)) = 'error' then max(us) // 1000 end as error_ms from records group by key")
def latest_exception(s, d):
    """The last failure of each client, unless it has succeeded since."""
    return envelope.latest_exception(V.records(s, d), "key", ["us", "event_id"], F.col("value") == "error", F.expr("us div 1000"), F.lit(NOW_MS))


@query("""select event_id as trace_id, unnest(['start', 'map', case when outcome = 'NACK' then 'nack' when done_us is null then 'open' else 'ack' end]) as event, unnest([us, us, done_us]) as us from completions""")
def span_events(s, d):
    c = V.completions(s, d)
    end = F.when(F.col("outcome") == "NACK", "nack").when(F.col("done_us").isNull(), "open").otherwise("ack")
    return envelope.span_events(c, "event_id", [("start", F.col("us")), ("map", F.col("us")), (end, F.col("done_us"))])


@query("""with r as (select event_id, us, k, done_us, outcome from records join completions using (event_id, part, off, us)),
c as (select event_id, i, us + i as start_us, case when (event_id + i) % 29 <> 0 then us + (event_id * 31 + i * 17) % 53 * 1000000 end as done_us, case when (event_id + i) % 23 = 0 then 'NACK' else 'ACK' end as outcome
 from (select event_id, us, unnest(range(k % 4)) as i from r)),
f as (select event_id, count(*) as n, count(done_us) as n_done, min(done_us) filter (where outcome = 'NACK') as nack_us, max(done_us) as last_us from c group by event_id),
t(depth, event_id, trace_id, span_id, parent_id, name, start_us, end_us, error) as (
 select 0, event_id, md5('events/' || event_id::varchar), md5(md5('events/' || event_id::varchar) || '/produce/0'), null::varchar, 'produce', us, us, null::varchar from r
 union all
 select x.depth + 1, x.event_id, x.trace_id, md5(x.span_id || '/' || n.name || '/' || n.i::varchar), x.span_id, n.name, n.start_us, n.end_us, n.error from t x join (
  select 0 as depth, event_id, 'consume' as name, 0 as i, us as start_us, case when f.n is null then us when nack_us is not null then nack_us when n_done = f.n then last_us end as end_us, case when nack_us is not null then 'child failed' end as error from r left join f using (event_id)
  union all select 1, event_id, 'mapToMany', i, start_us, done_us, case when done_us is not null and outcome = 'NACK' then 'refused' end from c) n on n.depth = x.depth and n.event_id = x.event_id)
select trace_id, span_id, parent_id, name, start_us, end_us, error from t""", True)
def span_tree(s, d):
    """Records are produced and consumed under one trace, by their headers; what they are mapped to has child spans, and the
    consumer's span ends when all of those have, or with the first that fails."""
    r = V.records(s, d).select("event_id", "us", "k", "headers")
    made = tracing.begun(r, "produce", F.concat(F.lit("events/"), "event_id"), F.col("us"))
    sent = made.withColumn("headers", tracing.injected(F.col("headers"), F.col("span")))
    got = tracing.begun(sent, "consume", F.col("event_id"), F.col("us"))
    ch = got.where("k % 4 > 0").withColumn("i", F.explode(F.expr("sequence(0, k % 4 - 1)")))
    ch = tracing.child(ch, "mapToMany", F.col("i"), F.col("us") + F.col("i"))
    ch = ch.withColumn("done_us", F.when((F.col("event_id") + F.col("i")) % 29 != 0, F.col("us") + (F.col("event_id") * 31 + F.col("i") * 17) % 53 * 1_000_000))
    ch = ch.withColumn("outcome", F.when((F.col("event_id") + F.col("i")) % 23 == 0, "NACK").otherwise("ACK"))
    ends = ack.flatten(ch.select("event_id", "done_us", "outcome"), "event_id", r.select("event_id", "us")).select("event_id", "status", "status_us")
    refused = F.when(F.col("done_us").isNotNull() & (F.col("outcome") == "NACK"), "refused")
    spans = envelope.concat(
        tracing.finished(made, F.col("us"), F.lit(None).cast("string")), tracing.finished(got.join(ends, "event_id"), F.col("status_us"), F.when(F.col("status") == "NACK", "child failed")),
        tracing.finished(ch, F.col("done_us"), refused),
    )
    return spans.select("trace_id", "span_id", "parent_id", "name", "start_us", "end_us", "error")


def _lines(text):
    """A text's lines; one with a mark ends them with an error."""
    for line in (text or "").split("\n"):
        if "#" in line:
            raise ValueError("marked line")
        yield line


@query("""with l as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l from documents), p as (select doc_id, l, list_position(list_transform(l, lambda x: contains(x, '#')), true) as bad from l),
m as (select doc_id, bad, case when bad is null or bad = 0 then len(l) else bad - 1 end as n from p),
e as (select doc_id, n, bad > 0 as failed, case when doc_id % 13 <> 0 then n * 20000000 end as end_us from m),
c as (select doc_id, i, case when (doc_id + i) % 97 <> 0 then (doc_id * 31 + i * 17) % 53 * 1000000 end as done_us, (doc_id + i) % 41 = 0 as nack from (select doc_id, unnest(range(n)) as i from m)),
a as (select doc_id, count(done_us) as n_done, max(done_us) as last_us, min(done_us) filter (where nack) as nack_us from c group by doc_id),
x as (select doc_id, n, failed, end_us, coalesce(n_done, 0) as n_done, last_us, nack_us, case when failed then end_us end as error_us from e left join a using (doc_id))
select doc_id, n, case when nack_us is not null or error_us is not null then 'NACK' when not coalesce(failed, false) and end_us is not null and n_done = n then 'ACK' else 'PENDING' end as status,
 case when nack_us is not null or error_us is not null then least(nack_us, error_us) when not coalesce(failed, false) and end_us is not null and n_done = n then greatest(end_us, last_us) end as status_us,
 case when error_us is null and nack_us is not null or nack_us < error_us then 'refused' when error_us is null then null when nack_us = error_us then 'ValueError: marked line' else 'ValueError: marked line' end as error from x""")
def publish_lines(s, d):
    """Documents published as streams of their lines: elements are done, or refused, one by one, the stream ends late, with an error or
    not at all."""
    docs = V.table(s, d, "documents").select("doc_id", "text")
    out = publishing.published(docs, "doc_id", "text", _lines)
    i, doc = F.col("pos"), F.col("doc_id")
    done = F.when((doc + i) % 97 != 0, (doc * 31 + i * 17) % 53 * 1_000_000)
    ch = out.where("end is null").select("doc_id", done.alias("done_us"), F.when((doc + i) % 41 == 0, "NACK").otherwise("ACK").alias("outcome"), F.lit("refused").alias("error"))
    ends = out.where("end is not null").select("doc_id", "end", F.when(doc % 13 != 0, i.cast("bigint") * 20_000_000).alias("end_us"), "error")
    return publishing.acknowledged(ch, ends, docs, "doc_id")


@query("select key, max_by(case when value = 'signup' then null else event_id end, (us, event_id)) as registered from records group by key having max_by(value, (us, event_id)) <> 'signup'")
def metric_registry(s, d):
    """The last registration of each name counts, unless it was taken back."""
    return envelope.latest(V.records(s, d), "key", ["us", "event_id"], F.col("event_id"), F.col("value") == "signup").withColumnRenamed("value", "registered")


# messages
_MESSAGE = """select event_id, '' as exchange, 'queue-' || event_type as routing_key, 'application/octet-stream' as content_type, 2 as delivery_mode, 0 as priority, 'm' || event_id::varchar as message_id, value as body from (select event_id, event_type, event_type as value from ev)"""


def _message(s, d):
    return V.events(s, d).withColumn("message", messages.to_queue(F.col("event_type"), F.concat(F.lit("queue-"), "event_type"), message_id=F.concat(F.lit("m"), F.col("event_id").cast("string"))))


def _flat_message(df):
    m = F.col("message")
    return df.select("event_id", *(m[c].alias(c) for c in ("exchange", "routing_key")), *(m["properties"][c].alias(c) for c in ("content_type", "delivery_mode", "priority", "message_id")), m["body"].alias("body"))


@query(_MESSAGE)
def message_creation(s, d):
    return _flat_message(_message(s, d))


@query("select event_id, case when k % 5 = 0 then 'null' else 'key-' || k::varchar end as routing_key, 'events' as exchange, 36 as id_length from ev")
def message_to_exchange(s, d):
    """A routing key that is null is the text "null"; each message has an id of its own."""
    key = F.when(F.col("k") % 5 != 0, F.concat(F.lit("key-"), F.col("k").cast("string")))
    m = V.events(s, d).select("event_id", messages.to_exchange(F.col("event_type"), "events", key).alias("m"))
    return m.select("event_id", "m.routing_key", "m.exchange", F.length("m.properties.message_id").alias("id_length"))


@query("select event_id, 'queue-' || event_type || '.v2.audited' as routing_key, upper(event_type) as body from ev")
def send_interceptors(s, d):
    """Interceptors see a message in their order."""
    put = lambda name, f: lambda m: m.withField(name, f(m[name]))
    chain = [put("routing_key", lambda c: F.concat(c, F.lit(".v2"))), put("body", F.upper), put("routing_key", lambda c: F.concat(c, F.lit(".audited")))]
    m = _message(s, d).withColumn("message", messages.intercepted(F.col("message"), chain))
    return m.select("event_id", "message.routing_key", "message.body")


@query("select event_id, case when event_type <> 'error' then event_type end as body, case when event_type = 'error' then 'ACKED' end as status from ev")
def body_source(s, d):
    """Messages without a body are acknowledged and go no further."""
    m = _message(s, d).withColumn("message", F.col("message").withField("body", F.when(F.col("event_type") != "error", F.col("message.body"))))
    kept, dropped = messages.bodies(m)
    return kept.select("event_id", "body", F.lit(None).cast("string").alias("status")).unionByName(dropped.select("event_id", F.lit(None).cast("string").alias("body"), "status"))


_SIGNALS = "sig as (select *, event_id % 5 = 0 as multiple from completions)"


@query(f"""with {_SIGNALS}, w as (select event_id, done_us, outcome, min(case when multiple and done_us is not null then {{'done_us': done_us, 'event_id': event_id, 'outcome': outcome}} end)
 over (partition by part order by off rows between current row and unbounded following) as later, case when done_us is not null then {{'done_us': done_us, 'event_id': event_id, 'outcome': outcome}} end as own from sig),
x as (select event_id, case when later is null then own when own is null then later when own < later then own else later end as f from w) select event_id, f.done_us as settled_us, f.outcome as settled_as from x""")
def settle_multiple(s, d):
    """Single signals speak for one delivery, multiple ones for all before as well."""
    c = V.completions(s, d).withColumn("multiple", F.col("event_id") % 5 == 0)
    return ack.settled(c).select("event_id", "settled_us", "settled_as")


@query("select event_id, case when event_id % 5 = 4 then null else event_id % 5 >= 2 end as requeue, case when event_id % 5 = 4 then null else event_id % 5 in (1, 3) end as multiple from ev")
def nack_flags(s, d):
    names = F.array(*(F.lit(n) for n in [*messages.NACKS, "OTHER"]))
    f = messages.flags(F.get(names, (F.col("event_id") % 5).cast("int")))
    return V.events(s, d).select("event_id", f["requeue"].alias("requeue"), f["multiple"].alias("multiple"))


@query("select event_id, case when outcome = 'ACK' and done_us is not null then 'ACKED' else 'NACKED' end as status from completions")
def publish_confirms(s, d):
    c = V.completions(s, d)
    acked = F.when(F.col("done_us").isNotNull(), F.col("outcome") == "ACK")
    return messages.confirmed(c, acked).select("event_id", "status")


@query("""with f as (select part, min(off) as first_off from records where k = 0 group by part)
select event_id, case when off > first_off then 'UNSENT' when k = 0 then 'FAILED' else 'SENT' end as result from records left join f using (part)""")
def sender_stop_on_error(s, d):
    return kafka.sent(V.records(s, d), F.col("k") == 0, "part", "off", stop_on_error=True).select("event_id", "result")


@query("select event_id, case when k = 0 then 'FAILED' else 'SENT' end as result from records")
def sender_goes_on(s, d):
    return kafka.sent(V.records(s, d), F.col("k") == 0, "part", "off").select("event_id", "result")


@query("select part, count(*) as n, count(*) filter (where value <> 'view') as n_kept from records group by part")
def grouped_source(s, d):
    """The hook before grouping sees all records."""
    r = kafka.grouped(V.records(s, d), lambda df: df.withColumn("kept", F.col("value") != "view"))
    return r.groupBy("part").agg(F.count("*").alias("n"), F.count_if("kept").alias("n_kept"))


# streams as wholes
@query("select event_id, case when k % 10 = 0 then 'NACKED' else 'ACKED' end as status, case when k % 10 = 0 then 'consumer failed' end as error from records")
def consume_ack(s, d):
    return envelope.consumed(envelope.acknowledgeable(V.records(s, d)), F.col("k") % 10 == 0).select("event_id", "status", "error")


@query("select topic, part, off, k * 2 as doubled, 'k=' || k::varchar as headers, 'PENDING' as status from records")
def propagate_metadata(s, d):
    r = envelope.propagated(envelope.acknowledgeable(V.records(s, d)), {"doubled": F.col("k") * 2})
    return r.select("topic", "part", "off", "doubled", C.render_map(F.col("headers")).alias("headers"), "status")


@query("select event_id, us from records where value = 'error' order by us, event_id limit 1")
def first_match(s, d):
    return envelope.first_match(V.records(s, d), F.col("value") == "error", ["us", "event_id"]).select("event_id", "us")


@query("select 0 as stream, event_id from records where value = 'signup' union all select 1 as stream, event_id from records where value = 'error'")
def concat_streams(s, d):
    r = V.records(s, d)
    return envelope.concat(r.where("value = 'signup'"), r.where("value = 'error'")).select("stream", "event_id")


@query("select key, event_id, row_number() over (order by key, off, part) as pos from records where value = 'signup'")
def sorted_records(s, d):
    """Positions in the order of all rows, counted range by range of that order."""
    r = V.records(s, d).where("value = 'signup'").withColumn("all", F.lit(0))
    x = prefix.numbered(r, "all", ["key", "off", "part"], "pos")
    return x.select("key", "event_id", (F.col("pos") + 1).alias("pos"))


@query("""with u as (select event_id, md5(event_id::varchar) as h from ev), x as (select event_id, xor(xor(('0x' || substr(h, 1, 8))::bigint, ('0x' || substr(h, 9, 8))::bigint), xor(('0x' || substr(h, 17, 8))::bigint, ('0x' || substr(h, 25, 8))::bigint)) as x from u)
select event_id, abs((case when x >= 2147483648 then x - 4294967296 else x end) % 16) as grp from x""")
def arbitrary_group(s, d):
    h = F.md5(F.col("event_id").cast("string").cast("binary"))
    u = F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return V.events(s, d).select("event_id", grouping.arbitrary_group(u, 16).alias("grp"))


@query("select event_id, 'orders.created' as routing_key, true as always from ev")
def static_routing_key(s, d):
    return V.events(s, d).select("event_id", F.lit("orders.created").alias("routing_key"), C.always().alias("always"))


@query("select event_type as name, count(*) as n, sum(k)::bigint as total from ev group by event_type")
def scheduled_pipeline(s, d):
    """Where rows are worked on changes no result; only what is summed up goes to a single task."""
    e = envelope.scheduled(V.events(s, d), "BOUNDED_ELASTIC", 4)
    return envelope.scheduled(e.groupBy(F.col("event_type").alias("name")).agg(F.count("*").alias("n"), F.sum("k").alias("total")), "SINGLE")


@query(_ORDERED + """, m as (select event_id, x[1] as executed_us from (select event_id, min(case when done_us is not null then [done_us, event_id] end) over (partition by part order by off rows between current row and unbounded following) as x from completions))
select o.event_id, case when outcome = 'NACK' then done_us else drained_us end as ordered_us, m.executed_us as multiple_us, done_us as unbounded_us from o join m using (event_id)""")
def acknowledgement_strategies(s, d):
    """Ordered; cumulative with a bound; cumulative without one, which leaves completions as they are."""
    c = V.completions(s, d)
    pick = lambda df, col, name: df.select("event_id", F.col(col).alias(name))
    out = pick(ack.strategy("ORDERED")(c), "executed_us", "ordered_us").join(pick(ack.strategy("MULTIPLE", 256)(c), "executed_us", "multiple_us"), "event_id")
    return out.join(pick(ack.strategy("MULTIPLE")(c), "done_us", "unbounded_us"), "event_id")


@query(_walk_sql(4, False, "(select w.*, k from works w join (select event_id, k from ev) using (event_id))") + " select subject, win as window, sum(k)::bigint as total, max_by(event_id, rn) as last_id, count(*) as n from b group by subject, win", True)
def dedup_fold(s, d):
    """Duplicates folded by a function of the user's: the last with the sum of all."""
    w = V.works(s, d).join(V.events(s, d).select("event_id", "k"), "event_id").select("event_id", "subject", "us", "k")
    add = lambda a, b: F.struct(b["event_id"].alias("event_id"), b["subject"].alias("subject"), b["us"].alias("us"), (a["k"] + b["k"]).alias("k"))
    x = windows.deduplicate(w, "subject", "us", "event_id", SIX, reduce=add)
    return x.select("subject", "window", F.col("k").alias("total"), F.col("event_id").alias("last_id"), "n")


@query(_REL + " select subject, win as window, max_by(event_id, (inception_ms, us, event_id)) filter (where kept) as work from f group by subject, win", True)
def buffer_fold(s, d):
    """Works folded by a function of the user's, here the one incepted later."""
    return windows.fold_buffers(_buffers(s, d), windows.later_work).select("subject", "window", F.col("work.event_id").alias("work"))


@query("select event_id, 1800000000000 - us // 1000 as since_ms, us // 1000 > lag(us // 1000) over (order by us, event_id) as later from ev")
def inception(s, d):
    e = prefix.numbered(V.events(s, d).withColumn("all", F.lit(0)), "all", ["us", "event_id"], "off").select("event_id", "us", "off")
    was = e.select((F.col("off") + 1).alias("off"), F.expr("us div 1000").alias("was_ms"))
    ms = F.expr("us div 1000")
    return e.join(was, "off", "left").select("event_id", C.since_inception(F.lit(NOW_MS), ms).alias("since_ms"), C.incepted_after(ms, F.col("was_ms")).alias("later"))


@query("""with l as (select key, us as last_us, lead(us) over (partition by key order by us, event_id) as next_us from records), e as (select max(us) as until_us from records)
select key, last_us, next_us, last_us + 46800000000 as noticed_us from l, e where coalesce(next_us, 1893456000000000) > last_us + 46800000000""")
def activity_at_the_end(s, d):
    """A key that is silent to the end is noticed as well."""
    return qos.inactivity(V.records(s, d), "key", 12 * 3_600_000_000, 3_600_000_000, until_us=1_893_456_000_000_000)


@query("""with l as (select unnest(range(6)) as pos, unnest(['view', 'click', 'none', 'purchase', 'signup', 'error']) as word)
select pos + 1 as value, word, count(event_id) as n from l left join ev on event_type = word group by all""")
def literal_sources(s, d):
    """Literal words, numbered by a range, with how many events have each as their type."""
    words = topics.literals(s, ["view", "click", "none", "purchase", "signup", "error"])
    words = topics.ranged(s, 1, 6).join(words.select((F.col("pos") + 1).alias("value"), F.col("value").alias("word")), "value")
    n = V.events(s, d).groupBy(F.col("event_type").alias("word")).agg(F.count("*").alias("n"))
    return words.join(n, "word", "left").select("value", "word", F.coalesce("n", F.lit(0)).alias("n"))


# Avro
_PERSON = "data1 string, data2 string, n bigint, tags array<string>, inner struct<x: double, y: map<string,int>>"


def _person(s, d):
    k = F.col("k")
    return V.events(s, d).select("event_id", k, F.struct(
        F.col("event_type").alias("data1"), F.when(k % 3 != 0, F.col("user_id").cast("string")).alias("data2"), (k - 50).alias("n"), F.array(F.lit("b"), F.col("event_type"), F.lit("b"), F.lit("a")).alias("tags"),
        F.struct((k / 4).alias("x"), F.create_map(F.lit("k"), k.cast("int")).alias("y")).alias("inner"),
    ).alias("v"))


def _avro(s, d):
    registry = avro.Registry()
    schema = avro.schema_of(T_.StructType.fromDDL(_PERSON), "Person")
    number = registry.register(avro.topic_subject("people"), schema)
    rows = _person(s, d)
    return rows.select("event_id", "k", avro.serialize(F.when(F.col("k") % 11 != 0, F.col("v")), schema, number).alias("frame")), registry


@query("select event_id, event_type as data1, case when k % 3 <> 0 then user_id::varchar end as data2, k - 50 as n, 'b,' || event_type || ',b,a' as tags, k / 4 as x, k::integer as y from ev where k % 11 <> 0")
def avro_record(s, d):
    """Records with nullable and nested fields, lists and maps, through the wire frame and back; null stays null."""
    frames, registry = _avro(s, d)
    r = frames.select("event_id", avro.deserialize(F.col("frame"), T_.StructType.fromDDL(_PERSON), registry.by_id).alias("r")).where("r is not null")
    return r.select("event_id", "r.data1", "r.data2", "r.n", F.array_join("r.tags", ",").alias("tags"), "r.inner.x", F.col("r.inner.y")["k"].alias("y"))


@query("""select event_id, event_type as data1, (k - 50)::double as n, case event_type when 'click' then 'a,b,click' when 'error' then 'a,b,error' when 'purchase' then 'a,b,purchase' when 'signup' then 'a,b,signup' else 'a,b,view' end as tags, 7 as added from ev where k % 11 <> 0""")
def avro_evolution(s, d):
    """Under another schema: a field fewer, one wider, one new with a default, a list as a sorted set."""
    frames, registry = _avro(s, d)
    reader = {"type": "record", "name": "Person", "fields": [{"name": "data1", "type": "string"}, {"name": "n", "type": "double"}, {"name": "tags", "type": {"type": "array", "items": "string", avro.CLASS: avro.SORTED_SET}}, {"name": "added", "type": "int", "default": 7}]}
    nullable = {**reader, "fields": [{**f, "type": avro.make_nullable(f["type"])} if f["name"] != "added" else f for f in reader["fields"]]}
    out = T_.StructType.fromDDL("data1 string, n double, tags array<string>, added int")
    r = frames.select("event_id", avro.deserialize(F.col("frame"), out, registry.by_id, lambda writer: nullable).alias("r")).where("r is not null")
    return r.select("event_id", "r.data1", "r.n", F.array_join("r.tags", ",").alias("tags"), "r.added")


@query("select event_id, case when k % 11 = 0 or k % 2 = 0 then null else event_type end as data1 from ev")
def avro_null_on_failure(s, d):
    """Frames that cannot be read are null if so configured; a reader's schema that cannot be made gives way to the writer's."""
    frames, registry = _avro(s, d)

    def no_reader(writer):
        raise LookupError("no class")

    cut_off = F.when(F.col("k") % 2 == 0, F.substring("frame", 1, 8)).otherwise(F.col("frame"))
    out = T_.StructType.fromDDL(_PERSON)
    return frames.select("event_id", avro.deserialize(cut_off, out, registry.by_id, no_reader, read_null_on_failure=True).alias("r")).select("event_id", "r.data1")
