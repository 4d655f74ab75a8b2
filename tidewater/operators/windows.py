"""Windows that open at the first element of a key: deduplication and work buffers.

A window closes after a duration, or when it is full, or with an element that closes it, and the next element of the key opens
another. Where one opens depends on all before it, so a key's rows are walked in order, once, by one task; but they are streamed
from a sort that can spill, one jump per window, and never gathered.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions.model import CANCEL, COMMIT, DEDUPLICATION, WORK_BUFFER, WindowConfig, micros


def _runs(keys: pa.Array) -> list[int]:
    """Where runs of equal keys (null equals null) start, and the end."""
    a, b = keys[1:], keys[:-1]
    new = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    return [0, *(np.flatnonzero(new) + 1).tolist(), len(keys)] if len(keys) else [0]


def _walk(duration: int, max_size: int, hide: tuple[str, ...] = ("_us", "_key", "_close")):
    def go(batches):
        key, start, n, w, closed = None, 0, 0, -1, True  # of the window that is open where a batch ends
        for b in batches:
            us, close = b.column("_us").to_numpy(zero_copy_only=False), b.column("_close").to_numpy(zero_copy_only=False)
            keys = b.column("_key")
            starts, numbers = np.empty(len(us), np.int64), np.empty(len(us), np.int64)
            closers = np.flatnonzero(close)
            bounds = _runs(keys)
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                if (this := keys[lo].as_py()) != key or w < 0:
                    key, n, w, closed = this, 0, -1, True
                i = lo
                while i < hi:
                    if closed or us[i] >= start + duration or n >= max_size:
                        start, n, w, closed = int(us[i]), 0, w + 1, False
                    end = min(i + int(np.searchsorted(us[i:hi], start + duration, "left")), i + max_size - n, hi)
                    c = np.searchsorted(closers, i)
                    if c < len(closers) and closers[c] < end:
                        end, closed = int(closers[c]) + 1, True
                    starts[i:end], numbers[i:end] = start, w
                    n += end - i
                    i = end
            keep = [c for c in b.schema.names if c not in hide]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(numbers), pa.array(starts)], [*keep, "window", "window_start"])

    return go


def _one_each(duration: int, max_size: int, first: bool):
    """The first or last row of each window, its number, how many it holds and when it is emitted; of the window that is open where
    a batch ends one row is held."""

    def go(batches):
        held = None  # (rows with one row, n, key, window)

        def done(rows, n):
            start, last = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("window_start", "_last"))
            emit = np.where(n >= max_size, last, start + duration)
            names = [c for c in rows.schema.names if c not in ("_us", "_key", "_close", "_last", "window", "window_start")]
            return pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), rows.column("window"), pa.array(n), pa.array(emit)], [*names, "window", "n", "emit_us"])

        for b in _walk(duration, max_size, ())(batches):
            if not b.num_rows:
                continue
            window, us = b.column("window").to_numpy(), b.column("_us").to_numpy(zero_copy_only=False)
            lo = np.union1d(_runs(b.column("_key"))[:-1], np.flatnonzero(np.diff(window)) + 1).astype(np.int64)
            hi = np.append(lo[1:], b.num_rows)
            n, rows = hi - lo, b.take(pa.array(lo if first else hi - 1))
            if held is not None:
                if held[2] == b.column("_key")[0].as_py() and held[3] == window[0]:
                    n[0] += held[1]
                    if first:
                        rows = pa.Table.from_batches([held[0].drop_columns(["_last"]), rows.slice(1)]).combine_chunks().to_batches()[0]
                else:
                    yield done(held[0], np.array([held[1]]))
            rows = rows.append_column("_last", pa.array(us[hi - 1]))
            yield done(rows.slice(0, len(lo) - 1), n[:-1])
            held = rows.slice(len(lo) - 1), n[-1], b.column("_key")[b.num_rows - 1].as_py(), window[-1]
        if held is not None:
            yield done(held[0], np.array([held[1]]))

    return go


def _dealt(df: DataFrame, key: str, us: str, tie: str, close: Column | None = None) -> DataFrame:
    x = df.withColumns({"_us": F.col(us).cast("bigint"), "_key": F.col(key).cast("string"), "_close": F.lit(False) if close is None else F.coalesce(close, F.lit(False))})
    return x.repartition(F.col(key)).sortWithinPartitions("_key", "_us", tie)


def assign_windows(df: DataFrame, key: str, us: str, tie: str, config: WindowConfig, close: Column | None = None) -> DataFrame:
    """df with `window` (its number within the key, from 0) and `window_start`. Arrival is by (us, tie); ranges are half-open."""
    x = _dealt(df, key, us, tie, close)
    schema = df.withColumns({"window": F.lit(0).cast("bigint"), "window_start": F.lit(0).cast("bigint")}).schema
    return x.mapInArrow(_walk(micros(config.duration), config.max_size or 1 << 62), schema)


Fold = Callable[[Column, Column], Column]


def fold_window(reduce: Fold, columns: list[str], us: str, tie: str, where: Column | None = None) -> Column:
    """An aggregate: the elements, as structs of the columns, folded from the left in order of arrival; null where there are none.
    A window's elements are held in one row."""
    element = F.struct(us, tie, F.struct(*columns).alias("row"))
    rows = F.transform(F.array_sort(F.collect_list(element if where is None else F.when(where, element))), lambda x: x["row"])
    return F.when(F.size(rows) > 0, F.aggregate(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), F.get(rows, F.lit(0)), reduce))


def deduplicate(df: DataFrame, key: str, us: str, tie: str, config: WindowConfig = DEDUPLICATION, keep: str = "first", reduce: Fold | None = None) -> DataFrame:
    """One row per window: its first (or last) element's columns, or what `reduce` makes of all, `window`, `n` and `emit_us`; df
    itself when disabled.

    A full window is emitted with its last element, another when its time is up. `reduce` takes two structs of df's columns and
    gives one.
    """
    if not config.enabled:
        return df
    if reduce is None:  # the walk gives the window's row itself: nothing is shuffled again
        schema = df.withColumns({c: F.lit(0).cast("bigint") for c in ("window", "n", "emit_us")}).schema
        return _dealt(df, key, us, tie).mapInArrow(_one_each(micros(config.duration), config.max_size or 1 << 62, keep == "first"), schema)
    x = assign_windows(df, key, us, tie, config)
    full = F.lit(False) if config.max_size is None else F.count("*") >= config.max_size
    emit = F.when(full, F.max(us)).otherwise(F.min("window_start") + micros(config.duration))
    out = x.groupBy(key, "window").agg(fold_window(reduce, df.columns, us, tie).alias("row"), F.count("*").alias("n"), emit.alias("emit_us"))
    return out.select("row.*", "window", "n", "emit_us")


def work_buffers(works: DataFrame, config: WindowConfig = WORK_BUFFER) -> DataFrame:
    """Works with the buffer that each falls into; a COMMIT closes its buffer."""
    return assign_windows(works, "subject", "us", "event_id", config, F.col("rank") == COMMIT)


def with_relevance(buffers: DataFrame) -> DataFrame:
    """`relevance`: the highest rank that a work's marker has in its buffer; `kept`: whether the work survives cancelling."""
    rel = F.max("rank").over(Window.partitionBy("subject", "window", "marker"))
    buffers = buffers.repartition("subject", "window")  # serves what is done by buffer afterwards as well
    return buffers.withColumn("relevance", rel).withColumn("kept", (F.col("relevance") != CANCEL) & (F.col("rank") != CANCEL))


def reduce_buffers(buffers: DataFrame, prioritized: bool = True) -> DataFrame:
    """Each buffer's winner among its surviving works (null if none): by relevance, then inception, ties to the later; n works, n kept."""
    by = F.struct(*(["rank"] if prioritized else []), "inception_ms", "us", "event_id")
    x = with_relevance(buffers).groupBy("subject", "window")
    return x.agg(F.max_by(F.when(F.col("kept"), F.col("event_id")), F.when(F.col("kept"), by)).alias("winner"), F.count("*").alias("n"), F.count_if("kept").alias("n_kept"))


def fold_buffers(buffers: DataFrame, reduce: Fold) -> DataFrame:
    """Each buffer's surviving works folded into one: (subject, window, work), null where all were cancelled."""
    columns = [c for c in buffers.columns if c not in ("window", "window_start")]
    x = with_relevance(buffers).groupBy("subject", "window")
    return x.agg(fold_window(reduce, columns, "us", "event_id", F.col("kept")).alias("work"))


def later_work(a: Column, b: Column) -> Column:
    """The first if it was incepted after the second, else the second."""
    return F.when(a["inception_ms"] > b["inception_ms"], a).otherwise(b)


def translate_buffers(buffers: DataFrame) -> DataFrame:
    """Each buffer's outcome: TRANSLATED with its prepared winner, FAILED if preparing a work fails, or EMPTY; and what becomes of members.

    On success the survivors' acknowledgement passes to the result (CARRIED); a handled failure acknowledges all survivors (ACKED),
    a failure handler that fails as well (here, where the failed winner is of type RETRY) nacks them (NACKED). Cancelled works are
    acknowledged in any case.
    """
    kept = F.col("kept")
    by = F.when(kept, F.struct("rank", "inception_ms", "us", "event_id"))
    x = with_relevance(buffers).groupBy("subject", "window")
    x = x.agg(F.max_by(F.when(kept, F.struct("event_id", "rank", "prepared", "fails")), by).alias("w"), F.count("*").alias("n"), F.count_if(kept).alias("n_kept"))
    state = F.when(F.col("n_kept") == 0, "EMPTY").when(F.col("w.fails"), "FAILED").otherwise("TRANSLATED")
    fate = F.when(F.col("n_kept") == 0, "ACKED").when(F.col("w.fails"), F.when(F.col("w.rank") == 1, "NACKED").otherwise("ACKED")).otherwise("CARRIED")
    return x.select("subject", "window", F.col("w.event_id").alias("winner"), state.alias("state"), fate.alias("fate"), "n", "n_kept")


def recyclable(now_ms: Column, expiration_ms: int, max_count: int | None, unrecyclable: list[str], error: Column, count: Column | None = None) -> Column:
    """Whether a failed work may go round again: not too old (0: no limit), not too often, and its error's very class not ruled out; an
    error that is not known rules nothing out. count: how often it went round, by default its recycle_count."""
    count = F.col("recycle_count") if count is None else count
    old = F.lit(False) if expiration_ms == 0 else (now_ms - F.col("inception_ms") > expiration_ms)
    often = F.lit(False) if max_count is None else count > max_count
    return ~old & ~often & ~F.coalesce(error.isin(unrecyclable), F.lit(False))


def recycle(failed: DataFrame) -> DataFrame:
    """Failed works as they are published again: type RETRY, one count more, the rest unchanged."""
    return failed.withColumns({"type": F.lit("RETRY"), "recycle_count": F.col("recycle_count") + 1})


def attempts(works: DataFrame, error_at: Callable[[Column], Column], now_ms: Column, expiration_ms: int, max_count: int, unrecyclable: list[str]) -> DataFrame:
    """A row for each time that a work is tried until it is done or dropped: its columns with the type and recycle_count of that time,
    `error` and `outcome` (DONE, RECYCLED or DROPPED).

    error_at says of a count what the try ends with, null for success. A work that goes round is published again as a RETRY with one
    count more. At most max_count + 2 tries of a work lie in a row on the way; nothing is shuffled.
    """
    counts = F.sequence(F.col("recycle_count"), F.greatest("recycle_count", F.lit(max_count + 1)))

    def tried(count: Column) -> Column:
        error = error_at(count)
        may = recyclable(now_ms, expiration_ms, max_count, unrecyclable, error, count)
        outcome = F.when(error.isNull(), "DONE").when(may, "RECYCLED").otherwise("DROPPED")
        return F.struct(count.alias("recycle_count"), error.alias("error"), outcome.alias("outcome"))

    x = works.withColumn("_tries", F.transform(counts, tried)).withColumn("_first", F.col("recycle_count"))
    last = F.array_position(F.transform("_tries", lambda t: t["outcome"] == "RECYCLED"), F.lit(False))
    x = x.withColumn("_t", F.explode(F.slice("_tries", F.lit(1), last.cast("int"))))
    kind = F.when(F.col("_t.recycle_count") == F.col("_first"), F.col("type")).otherwise("RETRY")
    return x.withColumns({"type": kind, "recycle_count": F.col("_t.recycle_count"), "error": F.col("_t.error"), "outcome": F.col("_t.outcome")}).drop("_tries", "_first", "_t")


def fetch_prepare(works: DataFrame, source: DataFrame, subject: str, key: str) -> DataFrame:
    """Works with the fetched row's columns, and `fetched`; Spark broadcasts the source only if it is small enough."""
    s = source.withColumn("_hit", F.lit(True))
    return works.join(s, works[subject] == s[key], "left").withColumn("fetched", F.coalesce("_hit", F.lit(False))).drop("_hit")
