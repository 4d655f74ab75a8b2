"""Quality by Bradley-Terry pairwise ranking.

A document's score is linear in features of its bytes and words. It is learned from preference pairs (a document marked good
over one marked bad) by logistic loss on the difference of their features; the threshold is the quantile of the training
scores that leaves as many above it as there are good ones.

It is learned from all labelled documents, each in a pair at least. Up to SAMPLE of them fit the driver. Of more the driver sees sums
only, an array from each task: of the features, of their squares, of the loss and its derivatives, of counts of scores.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.store import cut, drop, sieve, sifted, table
from tidewater.llm.textkit import hash_spans, slices, text_bytes, trimmed, words

SAMPLE = 20_000  # labelled rows that are learned from on the driver; more are learned from by sums over tasks
PAIRS = 60_000  # or as many as it takes for each row to be in one
DEAL, TURNS = 2048, 2  # of more rows: about those of a class that meet in a group, and the pairs of each of the commoner class
RIDGE = 1e-4
SLICE = 2 << 20  # bytes of text at once: what bounds a worker's memory
KINDS = [np.isin(np.arange(256), list(x)) for x in (b"!", b"?", b".", b",", b"|", b"#$%&*@~^_=+<>{}[]\\/", b"0123456789", bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(128, 256)), b"\n", b" \t\r", b"\"'()-:;")]


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """A row of features for each text, of its whole bytes."""
    n = len(offs) - 1
    size = np.diff(offs)
    buf, s, e, w = words(data, offs)
    count = np.diff(w)
    add = lambda x, at: np.diff(np.append(0, np.cumsum(x, dtype=np.float64))[at])
    per = lambda x, y: x / np.maximum(y, 1)
    cols = [np.log1p(size), np.log1p(count), size == 0]
    for kind in KINDS:
        c = add(kind[data], offs)
        cols += [per(c, size), np.log1p(c)]
    length = e - s
    cols += [per(add(length, w), count), per(add(length * length, w), count) ** 0.5, per(add(length == 1, w), count), per(add(length > 20, w), count)]
    h = hash_spans(buf, s, e)
    row = np.repeat(np.arange(n), count)
    again = np.append(False, (h[1:] == h[:-1]) & (row[1:] == row[:-1]))
    cols += [per(add(again, w), count), np.log1p(add(again, w))]
    by = np.lexsort((h, row))
    new = np.append(True, (h[by][1:] != h[by][:-1]) | (row[by][1:] != row[by][:-1])) if len(h) else np.zeros(0, bool)
    different = np.bincount(row[by][new], minlength=n)
    top = np.zeros(n)
    if len(h):
        at = np.flatnonzero(new)
        np.maximum.at(top, row[by][at], np.diff(np.append(at, len(h))))
    cols += [per(different, count), per(different, np.sqrt(count)), per(top, count)]
    bump = lambda ch: per(add(KINDS[ch][buf[np.maximum(e - 1, 0)]], w), count)  # noqa: E731  words that end in such a byte
    cols += [bump(0), bump(2), bump(3), bump(5), per(add(KINDS[7][buf[s]], w), count), per(add(KINDS[7][buf[np.maximum(e - 2, s)]], w), count)]
    return np.column_stack([np.asarray(c, np.float64) for c in cols])


@dataclass
class Ranker:
    """score = logistic((z - threshold) / scale), z = weights . (features - mean) / spread."""

    weights: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    threshold: float = 0.0
    scale: float = 1.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        return (np.clip((x - self.mean) / self.spread, -8, 8) * self.weights).sum(1)  # not @: the same for a row in any batch

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((self.margin(x) - self.threshold) / self.scale, -30, 30)))

    @classmethod
    def learn(cls, x: np.ndarray, y: np.ndarray, pairs: int | None = None, rounds: int = 400, ridge: float = RIDGE, seed: int = 11) -> Ranker:
        """pairs: so many drawn at random; None: each row in one at least."""
        if not len(x):
            return cls(np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.ones(x.shape[1]))
        spread = x.std(0)
        out = cls(np.zeros(x.shape[1]), x.mean(0), np.where(spread > 1e-12, spread, 1.0))
        good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
        if len(good) and len(bad):
            rng = np.random.default_rng(seed)
            z = np.clip((x - out.mean) / out.spread, -8, 8)
            if pairs is None:
                pairs = max(PAIRS, len(good), len(bad))
                d = z[np.resize(rng.permutation(good), pairs)] - z[rng.permutation(np.resize(bad, pairs))]
            else:
                d = z[rng.choice(good, pairs)] - z[rng.choice(bad, pairs)]
            m = v = np.zeros(x.shape[1])
            for t in range(1, rounds + 1):  # Adam on the logistic loss of the differences
                g = -(d.T @ (1 / (1 + np.exp(np.clip(d @ out.weights, -30, 30))))) / pairs + ridge * out.weights
                m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
                out.weights = out.weights - 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        s = out.margin(x)
        out.threshold = float(np.quantile(s, 1 - y.mean(), method="lower")) if 0 < y.mean() < 1 else float(s.min() if y.mean() == 1 else s.max() + 1)
        out.scale = float(max(s.std(), 1e-9))
        return out


def _features(wanted: np.ndarray | None = None):
    """(doc_id, x, row) of a table's (doc_id, text, row), with a sieve only of ids that may be in it."""

    def go(batches):
        for b in slices(batches, size=SLICE):
            if wanted is not None:
                b = b.filter(pa.array(sifted(wanted, b.column(0).to_numpy())))
            x = features(*text_bytes(b.column(1)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists, b.column(2)], ["doc_id", "x", "row"])

    return go


def _matrix(lists: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    return (lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists).flatten().to_numpy(zero_copy_only=False).reshape(-1, size) if len(lists) else np.zeros((0, size))


def _sum(rows: DataFrame, terms, size: int) -> np.ndarray:
    """The sum of terms(batch), arrays of `size` numbers, over the table: an array from each task, added up in order of size."""

    def go(batches):
        total = np.zeros(size)
        for b in batches:
            total += terms(b)
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], ["s"])

    return np.sort(_matrix(rows.mapInArrow(go, "s array<double>").toArrow().column("s"), size), axis=0).sum(0)


def _ordered(z: np.ndarray) -> np.ndarray:
    """Numbers in the order of z."""
    bits = (z + 0.0).view(np.int64)
    return (bits ^ ((bits >> 63) & np.int64(2**63 - 1))).view(np.uint64) ^ np.uint64(1 << 63)


def _smallest(rows: DataFrame, margins, k: int) -> float:
    """The k-th smallest margin, from 0: by counts of 16 of its bits after another."""
    prefix = 0
    for shift in (48, 32, 16, 0):

        def digits(batches, shift=shift, prefix=prefix):
            for b in batches:
                key = _ordered(margins(b))
                if shift < 48:
                    key = key[key >> np.uint64(shift + 16) == np.uint64(prefix)]
                digit, n = np.unique((key >> np.uint64(shift)) & np.uint64(0xFFFF), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(digit.astype(np.int64)), pa.array(n.astype(np.int64))], ["digit", "n"])

        got = rows.mapInArrow(digits, "digit long, n long").groupBy("digit").agg(F.sum("n").alias("n")).toArrow().sort_by("digit")
        upto = np.cumsum(got.column("n").to_numpy())
        at = int(np.searchsorted(upto, k, side="right"))
        k -= int(upto[at - 1]) if at else 0
        prefix = prefix << 16 | got.column("digit")[at].as_py()
    bits = prefix ^ (1 << 63) if prefix >> 63 else prefix ^ (2**64 - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _pairs(out: Ranker):
    """The differences of a group's pairs: each row of the commoner class meets TURNS of the other, and all of that have their turn."""

    def go(key, group):
        group = group.sort_by("doc_id")
        x, y = _matrix(group.column("x"), len(out.mean)), group.column("quality").to_numpy()
        z = np.clip((x - out.mean) / out.spread, -8, 8)
        rng = np.random.default_rng(key[0].as_py())
        good, bad = rng.permutation(np.flatnonzero(y == 1)), rng.permutation(np.flatnonzero(y == 0))
        n = max(len(good), len(bad)) if len(good) and len(bad) else 0
        d = [z[np.resize(good, n)] - z[np.resize(np.roll(bad, turn), n)] for turn in range(TURNS)] if n else [z[:0]]
        return pa.table({"d": pa.array([np.concatenate(d).astype(np.float32).tobytes()], pa.binary())})

    return go


def _newton(pairs: DataFrame, size: int, rounds: int = 40) -> np.ndarray:
    """The weights of least loss: Newton's steps, halved where one does not lower it."""

    def at(w):
        def terms(b):
            total = np.zeros(2 + size + size * size)
            for v in b.column(0):
                d = np.frombuffer(v.as_buffer(), np.float32).reshape(-1, size).astype(np.float64)
                m = d @ w
                p = 1 / (1 + np.exp(np.clip(m, -500, 500)))
                total += np.concatenate([[len(d), np.logaddexp(0, -m).sum()], -(d.T @ p), ((d * (p * (1 - p))[:, None]).T @ d).reshape(-1)])
            return total

        s = _sum(pairs, terms, 2 + size + size * size)
        n = max(s[0], 1)
        return s[1] / n + RIDGE / 2 * (w @ w), s[2 : 2 + size] / n + RIDGE * w, s[2 + size :].reshape(size, size) / n + RIDGE * np.eye(size)

    w = np.zeros(size)
    loss, g, h = at(w)
    step = -np.linalg.solve(h, g)
    for _ in range(rounds):
        if np.abs(step).max() < 1e-7:
            break
        new = at(w + step)
        if new[0] <= loss:
            w, (loss, g, h) = w + step, new
            step = -np.linalg.solve(h, g)
        else:
            step = step / 2
    return w


def learn(rows: DataFrame) -> Ranker:
    """The ranker of a table (doc_id, x, quality), a row a document, of any number of them: its rows are dealt into groups in which the
    classes meet, the rarer one's being in several if need be, and read a few times."""
    size = features(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]
    xy = lambda b: (_matrix(b.column("x"), size), b.column("quality").to_numpy())
    n, good, *total = _sum(rows, lambda b: np.concatenate([[b.num_rows, xy(b)[1].sum()], xy(b)[0].sum(0)]), 2 + size)
    n, good = int(n), int(good)
    if not n:
        return Ranker(np.zeros(size), np.zeros(size), np.ones(size))
    mean = np.array(total) / n
    spread = (_sum(rows, lambda b: ((xy(b)[0] - mean) ** 2).sum(0), size) / n) ** 0.5
    out = Ranker(np.zeros(size), mean, np.where(spread > 1e-12, spread, 1.0))
    if good in (0, n):
        out.threshold, out.scale = float(good == 0), 1e-9
        return out
    often = int(good * 2 >= n)
    groups, few = (-(-max(good, n - good) // DEAL), -(-min(good, n - good) // DEAL))
    h = F.xxhash64("doc_id")
    to = F.when(F.col("quality") == often, F.array(F.pmod(h, F.lit(groups)))).otherwise(F.sequence(F.pmod(h, F.lit(few)), F.lit(groups - 1).cast("long"), F.lit(few).cast("long")))
    pairs = cut(rows.select("doc_id", "x", "quality", F.explode(to).alias("to")).groupBy("to").applyInArrow(_pairs(out), "d binary"), "quality-pairs")
    out.weights = _newton(pairs, size)
    drop(pairs)
    margins = lambda b: out.margin(xy(b)[0])
    s, square = _sum(rows, lambda b: np.array([margins(b).sum(), (margins(b) ** 2).sum()]), 2)
    out.scale = float(max(max(square / n - (s / n) ** 2, 0) ** 0.5, 1e-9))
    out.threshold = _smallest(rows, margins, int((1 - good / n) * (n - 1)))
    return out


def train(docs: DataFrame, labels: DataFrame, sample: int | None = None, held_out: bool = True) -> Ranker:
    """Learns from all labelled documents; with held_out only from rows whose crc32(doc_id as text) mod 3 is not 1; with `sample` from so
    many at most, those with the smallest hash of their id. Labels other than 0 and 1 and null ids take no part; of several labels
    of a document the smaller counts, of several texts under one id that with the smallest hash, once. So the driver gets SAMPLE
    rows of features at most, however often documents are repeated."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)")
    if held_out:
        marked = marked.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    if sample is not None:  # four times as many as needed by their hash, before anything is shuffled: what one task sorts does not grow with the labels
        share = 4 * sample / max(marked.count(), 1)
        if share < 1:
            marked = marked.where(F.xxhash64("doc_id") <= int(share * 2**64) - 2**63)
    marked = marked.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    if sample is not None:
        marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("row")).where("doc_id is not null")
    schema = "doc_id long, x array<double>, row long"
    once = lambda x: x.groupBy("doc_id").agg(F.min_by("x", "row").alias("x"), F.min("quality").alias("quality"))
    if (marked.count() if sample is None else sample) > SAMPLE:
        rows = cut(once(docs.mapInArrow(_features(sieve(marked, "doc_id")), schema).join(marked, "doc_id")), "quality")
        out = learn(rows)
        drop(rows)
        return out
    x = docs.join(F.broadcast(marked.select("doc_id")), "doc_id", "left_semi").mapInArrow(_features(), schema)
    rows = once(x.join(F.broadcast(marked), "doc_id")).toArrow().sort_by("doc_id")
    return Ranker.learn(_matrix(rows.column("x"), features(np.zeros(0, np.uint8), np.zeros(2, np.int64)).shape[1]), rows.column("quality").to_numpy())


def _scored(ranker: Ranker):
    def go(batches):
        for b in slices(batches, size=SLICE):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ranker.score(features(*text_bytes(b.column(1)))), pa.float64())], ["doc_id", "score"])

    return lambda batches: trimmed(go(batches))


def score_quality(docs: DataFrame, ranker: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text; null counts as empty, and empty texts are scored by the same model.

    Repeated rows are scored each; other columns are ignored; an empty table gives no rows; a row with a null id has held_out null.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = docs.mapInArrow(_scored(ranker), "doc_id long, score double")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _keep(ranker: Ranker, at: int):
    def go(batches):
        for b in slices(batches, size=SLICE):
            yield b.filter(pa.array(ranker.score(features(*text_bytes(b.column(at)))) >= 0.5))

    return lambda batches: trimmed(go(batches))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier, learned as `train` says, does not reject (score 0.5 or more), with their columns.

    A null text counts as empty, and empty texts are judged by the same model; repeated rows are judged each, and alike; a null id
    is no hindrance. Without usable labels nothing is rejected. An empty table gives no rows.
    """
    return docs.mapInArrow(_keep(train(docs, labels), docs.columns.index("text")), docs.schema)


def op5_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, train(docs, table(spark, sf_dir, "labels")))
