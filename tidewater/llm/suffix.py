"""Suffix-array deduplication of byte passages.

A window is `length` consecutive bytes of one text; windows with equal bytes lie in one shard, because a window's shard
comes from its smallest k-gram hash, which is a function of its bytes. Consecutive windows with the same smallest hash are
a run; a run and the bytes that its windows cover are a context. Runs whose hash occurs nowhere else cannot hold a repeated
window and stop here. Identical contexts, such as those of exact copies, are counted first and one goes on; if a hash has
one context only, its copies are each other's repeats and there is nothing else to compare with. The remaining contexts
go to their shards. There suffix arrays are built by Larsson-Sadakane refinement (only unresolved groups are sorted
again, each time by twice the depth), common prefixes of neighbours come from Kasai's pass, and a shard above a bounded
size is split in sub-shards that are merged by binary search of one's windows in another's suffix array.

One frequent passage amid different texts must not make one large shard. So a hash met by many contexts, or by long ones, is
dealt anew by two further hashes of the windows: the parts of contexts that this gives are treated as contexts are,
identical ones counted first, so that of a passage's inside, which is the same everywhere, one part goes to a shard. Where
still many different parts meet, at the passage's borders, each window of theirs is a part of its own, dealt by its 128-bit
digest; identical ones are counted, and no two others meet. Nothing is capped or sampled.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.store import cut, tidy
from tidewater.llm.textkit import U, loads, mix, slices, text_bytes, trimmed

GRAM, SHARD, PIECE = 32, 3 << 19, 1 << 21
HOT, HOT_BYTES = 2000, 4 << 20  # contexts, and their bytes, beyond which they are dealt anew
RUN = 1 << 16  # windows in a run at most; longer ones, as in periodic texts, are several
_A = [U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def gram_hashes(data: np.ndarray, seed: int) -> np.ndarray:
    """A hash of the GRAM bytes from each position that has as many."""
    buf = np.zeros(len(data) + 8, np.uint8)
    buf[: len(data)] = data
    v, n = loads(buf), len(data) - GRAM + 1
    h = v[:n] * _A[0]
    for k in range(1, GRAM // 8):
        h += v[8 * k : 8 * k + n] * _A[k]
    return mix(h + U(seed))


def window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w consecutive values."""
    m, size = h, 1
    while 2 * size <= w:
        m = np.minimum(m[: len(m) - size], m[size:])
        size *= 2
    n = len(h) - w + 1
    return np.minimum(m[:n], m[w - size : w - size + n])


def runs(data: np.ndarray, offs: np.ndarray, length: int, seed: int = 1) -> tuple[np.ndarray, ...]:
    """(row, hash, start in the flat bytes, windows, whether two of the windows may be equal) of each run of windows."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none.astype(np.uint64), none, none, none.astype(bool)
    h = gram_hashes(data, seed)
    m = window_minima(h, length - GRAM + 1)
    size = np.diff(offs)
    ok = np.zeros(len(m) + 1, np.int8)
    long = np.flatnonzero(size >= length)
    np.add.at(ok, offs[:-1][long], 1)
    np.add.at(ok, offs[1:][long] - length + 1, -1)
    valid = np.cumsum(ok[:-1]) > 0
    first = valid.copy()
    first[1:] &= (m[1:] != m[:-1]) | ~valid[:-1]
    first[offs[:-1][long]] = True
    lo = np.flatnonzero(first)
    row = np.searchsorted(offs, lo, "right") - 1
    hi = np.minimum(np.append(lo[1:], len(m)), offs[row + 1] - length + 1)
    parts = -(-(hi - lo) // RUN)
    if len(parts) and parts.max() > 1:
        turn = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        row, end = np.repeat(row, parts), np.repeat(hi, parts)
        lo = np.repeat(lo, parts) + RUN * turn
        hi = np.minimum(lo + RUN, end)
    s = np.cumsum(np.append(0, h[: len(m)] == m))
    return row, m[lo], lo, hi - lo, s[hi - 1] > s[lo]


def _runs(length: int):
    def go(batches):
        for b in slices(batches, size=4 << 20):
            data, offs = text_bytes(b.column(1))
            row, fp, lo, n, own = runs(data, offs, length)
            raw = memoryview(np.ascontiguousarray(data))
            dig = np.fromiter((xxhash.xxh3_64_intdigest(raw[i : i + k]) for i, k in zip(lo.tolist(), (n + length - 1).tolist(), strict=True)), np.uint64, len(lo))
            at = pa.array(np.searchsorted(row, np.arange(len(offs))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (fp.view(np.int64), dig.view(np.int64), lo - offs[row], np.where(own, -n, n))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *lists], ["doc_id", "row", "fp", "dig", "lo", "n"])

    return lambda batches: trimmed(go(batches))


CONTEXTS = "fp long, dig long, sub long, part long, shift long, n long, many boolean, own boolean, hot boolean, ctx binary"


def _contexts(length: int):
    """Cuts the wanted contexts out of their texts, those of hot hashes in parts by two more hashes of the windows (`sub`).

    dig and part are digests of the whole context's and of the part's bytes, shift the windows before the part.
    """
    names = [x.split()[0] for x in CONTEXTS.split(", ")]
    schema = pa.schema([(x, pa.binary() if x == "ctx" else pa.bool_() if x in ("many", "own", "hot") else pa.int64()) for x in names])

    def go(batches):
        out, size = {k: [] for k in names}, 0
        for b in batches:
            for text, wanted in zip(b.column(0), b.column(1), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                for x in wanted.as_py():
                    lo, n = x["lo"], abs(x["n"])
                    ctx = data[lo : lo + n + length - 1]
                    parts = [(0, n, x["fp"])]
                    if x["hot"]:
                        m = [window_minima(gram_hashes(ctx, seed), length - GRAM + 1) for seed in (2, 3)]
                        edge = np.flatnonzero(np.append(True, (m[0][1:] != m[0][:-1]) | (m[1][1:] != m[1][:-1])))
                        parts = [(int(i), int(j - i), int(mix(m[0][i : i + 1] * _A[1] + m[1][i : i + 1])[0].astype(np.int64)) ^ x["fp"]) for i, j in zip(edge, np.append(edge[1:], n), strict=True)]
                    for i, k, sub in parts:
                        raw = ctx[i : i + k + length - 1].tobytes()
                        part = int(np.uint64(xxhash.xxh3_64_intdigest(raw)).astype(np.int64)) if x["hot"] else x["dig"]
                        for name, y in zip(names, (x["fp"], x["dig"], sub, part, i, k, x["many"], x["n"] < 0, x["hot"], raw), strict=True):
                            out[name].append(y)
                        size += k + length
                    if size > 2 << 20:
                        yield pa.RecordBatch.from_pydict(out, schema=schema)
                        out, size = {k: [] for k in names}, 0
        yield pa.RecordBatch.from_pydict(out, schema=schema)

    return lambda batches: trimmed(go(batches))


def _windows(length: int):
    """Each window of the parts as a part of its own: its digest in two halves, and its place in the part."""

    def table(rows: list[tuple]) -> pa.RecordBatch:
        sub, part, lo, dig = zip(*rows, strict=True)
        n = [len(x) for x in dig]
        dig = np.concatenate(dig)
        cols = [np.repeat(np.array(sub, np.int64), n), np.repeat(np.array(part, np.int64), n), np.concatenate([np.arange(i, i + k) for i, k in zip(lo, n, strict=True)]), dig[:, 0], dig[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in cols], ["sub", "part", "i", "w1", "w2"])

    def go(batches):
        rows, held = [], 0
        for b in batches:
            for sub, part, ctx in zip(*(b.column(i) for i in range(3)), strict=True):
                raw = memoryview(ctx.as_buffer())
                n = len(raw) - length + 1
                for lo in range(0, n, 1 << 15):
                    dig = b"".join(xxhash.xxh3_128_digest(raw[i : i + length]) for i in range(lo, min(n, lo + (1 << 15))))
                    rows.append((sub.as_py(), part.as_py(), lo, np.frombuffer(dig, "<i8").reshape(-1, 2)))
                    held += len(rows[-1][3])
                    if held >= 1 << 15:
                        yield table(rows)
                        rows, held = [], 0
        if rows:
            yield table(rows)

    return lambda batches: trimmed(go(batches))


class SuffixArray:
    """The windows of some contexts, sorted: the suffixes that have `length` bytes, to that depth.

    order: their starts, sorted. group: a label of each, equal for equal windows and growing along the order. To refine the
    order from a depth to a greater one takes the order to the lesser depth of later suffixes, never of one that ends
    before that depth; so those drop out as the depth grows.
    """

    LANE = 256  # windows that one lane of Kasai's pass walks

    def __init__(self, contexts: list[bytes], length: int):
        self.length = length
        gap = b"\0" * 8
        self.text = np.frombuffer(gap.join(contexts) + gap * 2, np.uint8)
        self.size = np.array([len(x) for x in contexts])
        self.start = np.append(0, np.cumsum(self.size + 8)[:-1])
        pos = (np.arange(int(self.size.sum())) + np.repeat(self.start - (np.cumsum(self.size) - self.size), self.size)).astype(np.int32)
        self.left = np.zeros(len(self.text), np.int32)  # bytes up to the end of the context
        self.left[pos] = np.repeat(self.start + self.size, self.size) - pos
        pos = pos[self.left[pos] >= 8]
        key = loads(self.text)[pos].byteswap()  # as numbers, eight bytes then compare as bytes do
        by = np.argsort(key)
        self.order, key = pos[by], key[by]
        self.group = np.full(len(self.text), -1, np.int32)
        self.group[self.order] = np.maximum.accumulate(np.where(np.append(True, key[1:] != key[:-1]), np.arange(len(key), dtype=np.int32), 0)) if len(key) else 0
        depth = 8
        while depth < length:
            step = min(depth, length - depth)
            depth += step
            self.order = self.order[self.left[self.order] >= depth]
            self._refine(step)

    def _refine(self, step: int) -> None:
        """Sorts each group of more than one suffix by the group of the suffix `step` bytes on."""
        g = self.group[self.order]
        same = g[1:] == g[:-1]
        i = np.flatnonzero(np.append(same, False) | np.append(False, same))
        if not len(i):
            return
        p = self.order[i]
        key = g[i].astype(np.int64) << 32 | self.group[p + step]
        by = np.argsort(key)
        p, key = p[by], key[by]
        self.order[i] = p
        at, was = np.arange(len(p), dtype=np.int32), (key >> 32).astype(np.int32)
        first = np.maximum.accumulate(np.where(np.append(True, was[1:] != was[:-1]), at, 0))
        now = np.maximum.accumulate(np.where(np.append(True, key[1:] != key[:-1]), at, 0))
        self.group[p] = was + now - first

    def prefixes(self) -> np.ndarray:
        """Kasai: for each place of the order, the bytes, up to `length`, that its window shares with the one before.

        A window's next one shares one byte less with the window after its neighbour, if that is a window too and the two
        differ within `length` bytes; else its prefix is counted from nothing. Stretches of windows are walked side by side.
        """
        v, shared = loads(self.text), np.zeros(len(self.order), np.int32)
        place = np.full(len(self.text), -1, np.int32)
        place[self.order] = np.arange(len(self.order))
        n = np.maximum(self.size - self.length + 1, 0)
        lanes = -(-n // self.LANE)
        turn = np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        start, n = np.repeat(self.start, lanes) + self.LANE * turn, np.minimum(np.repeat(n, lanes) - self.LANE * turn, self.LANE)
        by = np.argsort(-n, kind="stable")
        start, n = start[by], n[by]
        k, q = np.zeros(len(start), np.int64), np.full(len(start), len(self.text) - 2)
        for t in range(int(n[0]) if len(n) else 0):
            live = int(np.searchsorted(-n, -t, "left"))
            k, q = k[:live], q[:live]
            k = np.where((k >= self.length) | (place[q + 1] < 0), 0, np.maximum(k - 1, 0))
            p = start[:live] + t
            at = place[p]
            q = self.order[np.maximum(at - 1, 0)]
            k[at == 0] = 0
            go = np.flatnonzero(at > 0)
            while len(go):
                x = v[p[go] + k[go]] ^ v[q[go] + k[go]]
                low = x & (~x + U(1))
                same = np.where(x == 0, 8, (np.log2(np.maximum(low, U(1)).astype(np.float64)) // 8).astype(np.int64))
                k[go] = np.minimum(k[go] + same, self.length)
                go = go[(same == 8) & (k[go] < self.length)]
            shared[at] = k
        return shared

    def repeated(self) -> np.ndarray:
        """Which positions start a window that starts at another position as well."""
        same = self.prefixes() >= self.length
        hit = np.zeros(len(self.text), bool)
        hit[self.order[same]] = True
        hit[self.order[np.flatnonzero(same) - 1]] = True
        return hit

    def windows(self) -> np.ndarray:
        """One position of each different window, sorted."""
        w = self.order
        return w[np.append(True, self.group[w[1:]] != self.group[w[:-1]])] if len(w) else w

    def find(self, other: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
        """By binary search of this array's windows among the other's: the groups, here and there, of equal windows."""
        mine, theirs = self.windows(), other.windows()
        lo, hi = np.zeros(len(mine), np.int64), np.full(len(mine), len(theirs))
        while len(theirs) and (lo < hi).any():
            mid = np.minimum((lo + hi) // 2, len(theirs) - 1)
            less = self._compare(mine, other, theirs[mid]) > 0
            lo, hi = np.where((lo < hi) & less, mid + 1, lo), np.where((lo < hi) & ~less, mid, hi)
        if not len(theirs) or not len(mine):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.minimum(lo, len(theirs) - 1)
        same = self._compare(mine, other, theirs[at]) == 0
        return self.group[mine[same]], other.group[theirs[at[same]]]

    def _compare(self, p: np.ndarray, other: SuffixArray, q: np.ndarray) -> np.ndarray:
        v, w = loads(self.text), loads(other.text)
        out, go, k = np.zeros(len(p), np.int8), np.arange(len(p)), 0
        while k < self.length and len(go):
            k = min(k, self.length - 8)
            x, y = v[p[go] + k].byteswap(), w[q[go] + k].byteswap()
            out[go] = np.where(x > y, 1, np.where(x < y, -1, 0))
            go, k = go[x == y], k + 8
        return out


def repeated_windows(contexts: list[bytes], length: int, piece: int = PIECE) -> list[np.ndarray]:
    """For each of different contexts, the places of its windows that occur more than once among all of them."""
    parts, now, size = [], [], 0
    for i, x in enumerate(contexts):
        if now and size + len(x) > piece:
            parts.append(now)
            now, size = [], 0
        now.append(i)
        size += len(x)
    parts += [now] if now else []
    arrays = [SuffixArray([contexts[i] for i in p], length) for p in parts]
    hits = [a.repeated() for a in arrays]
    for i, a in enumerate(arrays):
        for j in range(i):
            mine, theirs = a.find(arrays[j])
            for arr, hit, groups in ((a, hits[i], mine), (arrays[j], hits[j], theirs)):
                if len(groups):
                    full = np.flatnonzero(arr.left >= length)
                    hit[full[np.isin(arr.group[full], groups)]] = True
    out = [np.zeros(0, np.int64)] * len(contexts)
    for p, a, hit in zip(parts, arrays, hits, strict=True):
        for i, s in zip(p, a.start, strict=True):
            out[i] = np.flatnonzero(hit[s : s + max(0, len(contexts[i]) - length + 1)])
    return out


def _spans(at: np.ndarray) -> list[tuple[int, int]]:
    """Sorted places as ranges [i, j)."""
    if not len(at):
        return []
    cut_at = np.flatnonzero(np.diff(at) > 1)
    return list(zip(at[np.append(0, cut_at + 1)].tolist(), (at[np.append(cut_at, len(at) - 1)] + 1).tolist(), strict=True))


def _shard(length: int):
    def go(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["sub", "part"])  # repeated rows
        alone = (pdf.groupby("sub")["sub"].transform("size") == 1) & ~pdf["own"]
        take, rest = pdf[~alone], pdf[alone & pdf["many"]]
        out = list(zip(rest["sub"], rest["part"], [0] * len(rest), rest["n"], strict=True))
        found = repeated_windows(list(take["ctx"]), length)
        for sub, part, n, many, at in zip(take["sub"], take["part"], take["n"], take["many"], found, strict=True):
            out += [(sub, part, i, j) for i, j in ([(0, n)] if many else _spans(at))]
        return pd.DataFrame(out, columns=["sub", "part", "i", "j"]).astype("int64")

    return go


VERDICT = "sub long, part long, i long, j long"


def _verdicts(contexts: DataFrame, length: int) -> DataFrame:
    """(sub, part, i, j): the ranges of windows of each part that occur elsewhere as well."""
    cold = contexts.where("not hot").select("sub", "part", "n", "many", "own", "ctx")
    hot = contexts.where("hot")
    # identical parts are counted first; one of them goes on
    alike = hot.groupBy("sub", "part").agg(F.min(F.struct("fp", "dig", "shift")).alias("x"), F.max("n").alias("n"), (F.max("many") | (F.count("*") > 1)).alias("many"), F.max("own").alias("own"))
    rows = hot.count()
    alike = cut(alike.select("sub", "part", "n", "many", "own", "x.*"), "alike", rows)
    subs = alike.groupBy("sub").agg(F.count("*").alias("parts"), F.sum(F.col("n") + length).alias("size"))
    subs = cut(subs.select("sub", ((F.col("parts") > HOT) | (F.col("size") > HOT_BYTES)).alias("apart"), (F.col("parts") == 1).alias("lone")), "subs", rows)
    alike = alike.join(subs, "sub")
    plain = alike.where("not apart and lone and not own")
    out = plain.where("many").select("sub", "part", F.lit(0).cast("long").alias("i"), F.col("n").alias("j"))
    some = cut(alike.where("not (not apart and lone and not own)").join(hot.select("fp", "dig", "shift", "ctx"), ["fp", "dig", "shift"]).dropDuplicates(["sub", "part"]), "some", 2 * rows, 5_000)
    cold = cold.unionByName(some.where("not apart").select(cold.columns))
    shards = 1 + (cold.agg(F.sum(F.col("n") + length)).first()[0] or 0) // SHARD
    out = out.unionByName(cold.withColumn("shard", F.pmod(F.xxhash64("sub"), F.lit(shards))).groupBy("shard").applyInPandas(_shard(length), VERDICT))
    apart = some.where("apart")
    out = out.unionByName(apart.where("many").select("sub", "part", F.lit(0).cast("long").alias("i"), F.col("n").alias("j")))
    single = cut(apart.select("sub", "part", "ctx").mapInArrow(_windows(length), "sub long, part long, i long, w1 long, w2 long"), "single")
    again = cut(single.groupBy("w1", "w2").agg(F.count("*").alias("c")).where("c > 1").select("w1", "w2"), "again", single.count())
    out = out.unionByName(single.join(again, ["w1", "w2"]).select("sub", "part", "i", (F.col("i") + 1).alias("j")))
    return cut(out, "verdicts")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, row): rows of one id and text are one."""
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("row"))


@tidy
def repeated_spans(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row, spans): for each text with any, ranges of window starts whose `length` bytes also start elsewhere.

    Texts are UTF-8 bytes; null and empty ones, and those under `length` bytes, have no windows. Ids are integers; rows with a
    null id are compared with nothing, other columns are ignored, an empty table gives no rows. Texts may be of any length.
    Repeated rows are each other's repeats; `row`, a hash of the text, tells texts with one id apart.
    """
    docs = _keyed(docs, id_col, text_col).where("doc_id is not null")
    lists = "doc_id long, row long, fp array<long>, dig array<long>, lo array<long>, n array<long>"
    t = cut(docs.mapInArrow(_runs(length), lists), "runs")
    each = t.select("doc_id", "row", F.explode(F.arrays_zip("fp", "dig", "lo", "n")).alias("x")).select("doc_id", "row", "x.*")
    own = F.max(F.when(F.col("n") < 0, 1).otherwise(0))
    met = each.groupBy("fp").agg(F.count("*").alias("c"), F.sum(F.abs("n") + length).alias("size"), F.min("dig").alias("d1"), F.max("dig").alias("d2"), own.alias("own"))
    mixed, hot = (F.col("d1") != F.col("d2")) | (F.col("own") == 1), (F.col("c") > HOT) | (F.col("size") > HOT_BYTES)
    # written before it is joined: Spark can split the rows of a frequent hash only in a join of two plain shuffles
    met = cut(met.where("c > 1 or own = 1").select("fp", mixed.alias("mixed"), hot.alias("hot")), "met")
    found = cut(each.join(met, "fp"), "repeats")
    reps = found.where("mixed").groupBy("fp", "dig").agg(F.min(F.struct("doc_id", "row", "lo", "n", "hot")).alias("x"), (F.count("*") > 1).alias("many"))
    want = reps.groupBy("x.doc_id", "x.row").agg(F.collect_list(F.struct("fp", "dig", "x.lo", "x.n", "x.hot", "many")).alias("want"))
    ctx = want.join(docs, ["doc_id", "row"]).select(F.col("text").cast("binary").alias("text"), "want")
    contexts = cut(ctx.mapInArrow(_contexts(length), CONTEXTS), "contexts")
    verdict = _verdicts(contexts, length)
    parts = contexts.select("fp", "dig", "shift", "sub", "part").join(verdict, ["sub", "part"])
    parts = cut(parts.select("fp", "dig", (F.col("shift") + F.col("i")).alias("i"), (F.col("shift") + F.col("j")).alias("j")), "parts")
    plain = found.where("not mixed").select("doc_id", "row", "lo", (F.col("lo") + F.abs("n")).alias("hi"))
    mixed = found.where("mixed").join(parts, ["fp", "dig"]).select("doc_id", "row", (F.col("lo") + F.col("i")).alias("lo"), (F.col("lo") + F.col("j")).alias("hi"))
    return cut(plain.unionByName(mixed).groupBy("doc_id", "row").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "spans")


def removed(spans: list, length: int) -> list[list[int]]:
    """Ranges of window starts as sorted disjoint byte ranges, those that touch joined."""
    out: list[list[int]] = []
    for x in sorted((x["lo"], x["hi"] + length - 1) for x in spans or []):
        if out and x[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x[1])
        else:
            out.append(list(x))
    return out


def _digest(length: int):
    def go(batches):
        for b in slices(batches, size=4 << 20):
            rows = []
            for text, spans in zip(b.column(1), b.column(2), strict=True):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                gone, kept, at = removed(spans.as_py(), length), [], 0
                for i, j in gone:
                    kept.append(raw[at:i])
                    at = j
                kept.append(raw[at:])
                rows.append((len(raw), sum(j - i for i, j in gone), len(gone), hashlib.sha256(b"".join(kept)).hexdigest()))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return go


def _strip(length: int, at: int, names: list[str]):
    """The last column holds the spans of the text in column `at`."""

    def go(batches):
        for b in slices(batches, names[at], 4 << 20):
            texts = []
            for text, spans in zip(b.column(at), b.column(b.num_columns - 1), strict=True):
                gone = removed(spans.as_py(), length)
                if not gone or not text.is_valid:
                    texts.append(text.as_py())
                    continue
                raw, kept, done = text.as_buffer().to_pybytes(), [], 0
                for x, y in gone:  # a character goes only with all of its bytes
                    while x < y and raw[x] & 0xC0 == 0x80:
                        x += 1
                    while y < len(raw) and y > x and raw[y] & 0xC0 == 0x80:
                        y -= 1
                    kept.append(raw[done:x])
                    done = y
                texts.append(b"".join([*kept, raw[done:]]).decode())
            cols = [pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(cols, names)

    return lambda batches: trimmed(go(batches))


def without_repeats(docs: DataFrame, length: int = 200) -> DataFrame:
    """documents with each byte that lies in a repeated window taken out of its text and n_chars counted anew.

    Every row stays, a text that is all repeats as an empty one; a character stays unless all of its bytes go. Rows with a null
    id or text stay as they are. Other columns keep their values, whatever their names.
    """
    names = docs.columns
    spans = repeated_spans(docs, length).select(F.struct("doc_id", "row").alias("k"), F.struct("spans").alias("s"))
    text = F.col("text").cast("string")
    x = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("d"), F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row")).alias("k"))
    x = x.join(spans, "k", "left").select("d.*", F.col("s.spans").alias("spans of text"))
    out = x.mapInArrow(_strip(length, names.index("text"), names), docs.schema)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in names else out


def op3_suffix_array(spark, sf_dir):
    from tidewater.llm.store import table

    docs = table(spark, sf_dir, "documents")
    x = _keyed(docs, "doc_id", "text").join(repeated_spans(docs), ["doc_id", "row"], "left").select("doc_id", F.col("text").cast("binary").alias("text"), "spans")
    return x.mapInArrow(_digest(200), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
