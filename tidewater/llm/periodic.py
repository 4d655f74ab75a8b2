"""Periodic runs of words, by the runs theorem.

Every maximal run of a string contains a Lyndon root that is the longest Lyndon word starting at its place, under the order of the
symbols or under the reversed one. The longest Lyndon word from a place ends where the next smaller value of the inverse suffix array
stands. So there are at most two roots a place; each is extended to both sides by the common prefix of the suffixes at its start and
its end, and by the common suffix of what comes before them: minima over ranges of the common prefixes of neighbours in the suffix
arrays of the string and of its reverse.

Only stretches that can hold a run are worked on. A run of 12 words or more that is at least two periods long is covered by sequences
of six words that come twice in the text, so the words that no such sequence covers end a stretch. Texts are worked on together, a
few megabytes of them at once, each stretch as a string of its own: their suffixes are sorted by stretch first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.store import table
from tidewater.llm.textkit import combine, hash_spans, ragged, slices, text_bytes, trimmed, words

LEAST = 12  # words in a run at least
SLICE = 2 << 20  # bytes of text at once
CHUNK = 1 << 17  # words joined to text at once
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def live(h: np.ndarray, bounds: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the stretches of words that are covered by sequences of `gram` words which come twice in their row."""
    n = len(h) - gram + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = np.flatnonzero(row[:n] == row[gram - 1 :])
    if not len(at):
        return at, at
    g = combine(*(h[k : k + n] for k in range(gram)), row[:n].astype(np.uint64))[at]
    by = np.argsort(g)
    same = g[by][1:] == g[by][:-1]
    twice = at[by[np.append(same, False) | np.append(False, same)]]
    step = np.zeros(len(h) + 1, np.int32)
    np.add.at(step, twice, 1)
    np.add.at(step, twice + gram, -1)
    on = np.append(np.cumsum(step[:-1]) > 0, False)
    first = on.copy()
    first[1:] &= ~on[:-1] | np.append(row[1:] != row[:-1], True)
    starts = np.flatnonzero(first)
    stop = np.flatnonzero(~on)
    ends = np.minimum(stop[np.searchsorted(stop, starts)], bounds[row[starts] + 1]) if len(starts) else starts
    return starts, ends


def suffix_ranks(text: np.ndarray, reverse: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank) of the suffixes of the strings in text, which are parted, begun and ended by -1, string by string. A suffix that
    another goes on from is the smaller. `reverse`: larger symbols come first. Groups of more than one are sorted again, each
    time to twice the depth."""
    gap = text < 0
    pos = np.flatnonzero(~gap)
    stop = np.flatnonzero(gap)
    left = np.zeros(len(text), np.int64)  # symbols up to the string's end
    nth = np.searchsorted(stop, pos)
    left[pos] = stop[nth] - pos
    key = nth << 32 | (text.max() - text[pos] if reverse else text[pos])
    rank = np.full(len(text), -1, np.int64)
    by = np.argsort(key, kind="stable")
    order, key = pos[by], key[by]
    rank[order] = np.maximum.accumulate(np.where(np.append(True, key[1:] != key[:-1]), np.arange(len(key)), 0))
    i, depth = np.arange(len(order)), 1
    while len(i):
        g = rank[order[i]]
        same = g[1:] == g[:-1]
        i = i[np.append(same, False) | np.append(False, same)]
        p = order[i]
        beyond = left[p] > depth
        key = rank[p] << 32
        key[beyond] |= rank[p[beyond] + depth] + 1
        by = np.argsort(key, kind="stable")
        p, key = p[by], key[by]
        order[i] = p
        at, was = np.arange(len(p)), key >> 32
        first = np.maximum.accumulate(np.where(np.append(True, was[1:] != was[:-1]), at, 0)) if len(p) else at
        now = np.maximum.accumulate(np.where(np.append(True, key[1:] != key[:-1]), at, 0)) if len(p) else at
        rank[p] = was + now - first
        depth *= 2
    return order, rank


def common_prefixes(text: np.ndarray, order: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Kasai: how many symbols each suffix in the order shares with the one before; none with another string's."""
    t, before, k = text.tolist(), np.append(-1, order[:-1])[rank].tolist(), 0
    out = np.zeros(len(t), np.int64)
    string = np.cumsum(text < 0)
    other = (np.append(-1, string[order[:-1]])[rank] != string).tolist()
    for i, x in enumerate(t):
        if x < 0 or other[i]:
            k = 0
            continue
        j = before[i]
        while t[i + k] == t[j + k]:
            k += 1
        out[i] = k
        if k:
            k -= 1
    return out[order]


def next_smaller(a: np.ndarray) -> np.ndarray:
    """For each place, the next one with a smaller value (the length where there is none)."""
    out, waiting = [len(a)] * len(a), []
    for i, x in enumerate(a.tolist()):
        while waiting and waiting[-1][0] > x:
            out[waiting.pop()[1]] = i
        waiting.append((x, i))
    return np.array(out, np.int64)


def range_minima(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The least of values[lo..hi] of each range. The sparse table's levels are made one from the other, and the ranges of a level's
    size are answered while it is there, so one level is held."""
    out = np.zeros(len(lo), np.int64)
    level = np.frexp((hi - lo + 1).astype(np.float64))[1] - 1
    size = 1
    for k in range(int(level.max()) + 1 if len(lo) else 0):
        if k:
            values, size = np.minimum(values[:-size], values[size:]), 2 * size
        q = np.flatnonzero(level == k)
        out[q] = np.minimum(values[lo[q]], values[hi[q] - size + 1])
    return out


class Extensions:
    """Lengths of common prefixes of a text's suffixes."""

    def __init__(self, text: np.ndarray):
        self.text, (order, self.rank) = text, suffix_ranks(text)
        self.shared = common_prefixes(text, order, self.rank)

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        q = np.flatnonzero((self.text[i] >= 0) & (self.text[j] >= 0))
        a, b = self.rank[i[q]], self.rank[j[q]]
        out[q] = range_minima(self.shared, np.minimum(a, b) + 1, np.maximum(a, b))
        return out


def maximal_runs(text: np.ndarray, least: int) -> np.ndarray:
    """Rows (start, length, period), sorted, of the runs of strings parted, begun and ended by -1: the smallest period q, `least` and
    2 * q symbols long or longer, and no longer with that period."""
    ahead, back = Extensions(text), Extensions(np.ascontiguousarray(text[::-1]))
    found, n = [], len(text)
    i = np.flatnonzero(text >= 0)
    for rank in (ahead.rank, suffix_ranks(text, reverse=True)[1]):
        j = next_smaller(rank)[i]
        p = j - i
        right, left = ahead(i, j), back(n - i, n - j)
        long = (left + right >= p) & (left + p + right >= least)
        found.append(np.column_stack([i - left, left + p + right, p])[long])
    return np.unique(np.concatenate(found), axis=0)


def runs_of_rows(h: np.ndarray, bounds: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (row, start, length, period), sorted, of the runs of each row's words, which are known by their hashes."""
    starts, ends = live(h, bounds, least // 2)
    if not len(starts):
        return np.zeros((0, 4), np.int64)
    size = ends - starts
    symbols = np.unique(h[ragged(starts, size)], return_inverse=True)[1]
    text = np.full(int(size.sum()) + len(size) + 1, -1, np.int64)
    lo = np.cumsum(size + 1) - size  # a string's start in text
    text[ragged(lo, size)] = symbols
    runs = maximal_runs(text, least)
    k = np.searchsorted(lo, runs[:, 0], "right") - 1
    word = starts[k] + runs[:, 0] - lo[k]
    row = np.searchsorted(bounds, word, "right") - 1
    return np.column_stack([row, word - bounds[row], runs[:, 1:]])


def joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The words of each row, joined by one space, as text."""
    size = np.append(0, np.cumsum(ends - starts + 1))
    out = np.full(int(size[-1]), 32, np.uint8)
    for lo in range(0, len(starts), CHUNK):
        n = (ends - starts)[lo : lo + CHUNK]
        out[ragged(size[lo : lo + CHUNK][: len(n)] + 1, n)] = buf[ragged(starts[lo : lo + CHUNK], n)]
    at = size[bounds]
    full = np.diff(at) > 0
    keep = np.ones(len(out), bool)
    keep[at[:-1][full]] = False  # the space before a row's first word
    offs = at - np.append(0, np.cumsum(full))
    return pa.LargeStringArray.from_buffers(len(full), pa.py_buffer(offs.astype(np.int64)), pa.py_buffer(out[keep])).cast(pa.string())


def _found(least: int):
    def go(batches):
        for b in slices(batches, size=SLICE):
            data, offs = text_bytes(b.column(1))
            buf, s, e, bounds = words(data, offs)
            runs = runs_of_rows(hash_spans(buf, s, e), bounds, least)
            row, start, length, period = runs.T
            step = np.zeros(len(s) + 1, np.int64)
            np.add.at(step, bounds[row] + start + period, 1)
            np.add.at(step, bounds[row] + start + length, -1)
            kept = np.flatnonzero(np.cumsum(step[:-1]) == 0)
            text = joined(buf, s[kept], e[kept], np.searchsorted(kept, bounds))
            at = pa.array(np.searchsorted(row, np.arange(len(offs))).astype(np.int32))
            each = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x)) for x in (start, length, period)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(bounds)), pa.ListArray.from_arrays(at, each), text], ["doc_id", "n_words", "runs", "collapsed"])

    return lambda batches: trimmed(go(batches))


def periodic_runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the runs of each text's words, by start, then period, and the text without repetitions.

    A run is a stretch (start, length, period) of words, numbered from 0, that repeats itself after `period` words and not after
    fewer, at least `least` (12 or more, even) and two periods long, which no neighbouring word carries on. collapsed is the words
    that no run holds after its first period, joined by one space. Words are runs of bytes other than ASCII white space and
    count as equal by 64 bits of their hash.

    A null or empty text, or one of white space, has no words, no runs and an empty collapsed text. Rows are worked on each,
    repeated ones alike; null ids are kept; other columns are ignored; an empty table gives no rows. Texts may be of any length.
    """
    if least < 12 or least % 2:
        raise ValueError("least must be even and 12 at least")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return docs.mapInArrow(_found(least), f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def rewritten(docs: DataFrame) -> DataFrame:
    """(doc_id, text): the texts, but of ids whose crc32 ends in 0 the words from one on repeated to the end: the query's own cases of
    periods. What a word's number is made of is computed once a text, in columns of its own."""
    docs = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    docs = docs.withColumn("words", F.when(F.col("h") % 10 == 0, F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")))
    docs = docs.withColumns({"n": F.size("words").cast("long"), "g": F.floor(F.col("h") / 10).cast("long")})
    docs = docs.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    docs = docs.withColumn("p", 1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)).cast("long"))
    tail = F.slice("words", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    again = F.slice(F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), F.flatten(F.array_repeat(tail, times))), F.lit(1), F.col("n").cast("int"))
    return docs.select("doc_id", F.when(F.col("n") > 0, F.array_join(again, " ")).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs(rewritten(docs))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    text = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), "best.length", (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"), F.sha2(text.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
