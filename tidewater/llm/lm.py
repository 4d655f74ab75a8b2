"""Stupid-backoff scores of documents under n-gram counts of the whole corpus.

Documents are dealt into blocks. Each block's texts are exploded into n-grams, known by 64-bit hashes, and equal ones of a
block counted; a row (part, block, n) holds those of one range of hashes. The count tables are the sums over all blocks,
partitioned by the same ranges, of the n-grams seen more than once; the blocks' n-grams are joined to them partition by
partition, and a block sums the terms of each of its documents. An n-gram is thus shuffled once for each block that has it,
not once for each occurrence, and no partition depends on how frequent one n-gram is. Different n-grams whose hashes are
equal in the 48 low bits and the partition's bits count as one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F

from tidewater.llm.store import cut
from tidewater.llm.textkit import combine, distinct, hash_spans, text_bytes, words

BLOCK = 8 << 20
REQUEST = "part long, block long, n int, grams binary, counts binary"


def _pack(h: np.ndarray) -> bytes:
    """The low six bytes of each hash; the two high ones follow from the partition when it is a narrow range."""
    return h.view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _grams(table: pa.Table, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of the 1-, 2-, .. order-grams that end at each word (those that cross a text's start are not meant), and the rows' bounds among the words."""
    data, offs = text_bytes(table.column("text"))
    buf, s, e, w = words(data, offs, lower=True)
    h = hash_spans(buf, s, e)
    out = [h]
    for n in range(2, order + 1):
        g = np.zeros(len(h), np.uint64)
        if len(h) >= n:
            g[n - 1 :] = combine(*(h[i : len(h) - n + 1 + i] for i in range(n)))
        out.append(g)
    return out, w


def _whole(w: np.ndarray, n: int) -> np.ndarray:
    """Which words are the n-th or a later one of their text."""
    return np.arange(w[-1]) - np.repeat(w[:-1], np.diff(w)) >= n - 1


def _ask(order: int, bits: int):
    def go(key: tuple, table: pa.Table) -> pa.Table:
        grams, w = _grams(table, order)
        rows = []
        for n, g in enumerate(grams, 1):
            g = g[_whole(w, n)]
            first, place = distinct(g)
            u, c = g[first], np.bincount(place, minlength=len(first)).astype(np.uint32)
            part = u >> np.uint64(64 - bits) if bits else np.zeros(len(u), np.uint64)
            at = np.append(np.flatnonzero(np.append(len(u) > 0, part[1:] != part[:-1])), len(u))  # only partitions that are asked: a block's work does not grow with their number
            rows += [(p, key[0].as_py(), n, _pack(u[i:j]), c[i:j].tobytes()) for p, i, j in zip(part[at[:-1]].tolist(), at[:-1], at[1:], strict=True)]
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        return pa.table([pa.array(x, t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "block", "n", "grams", "counts"])

    return go


def _unpack(grams: pa.ChunkedArray) -> np.ndarray:
    h = np.frombuffer(b"".join(x.as_buffer() for x in grams), np.uint8).reshape(-1, 6)
    out = np.zeros((len(h), 8), np.uint8)
    out[:, :6] = h
    return out.view(np.uint64).reshape(-1)


def _count(key: tuple, asked: pa.Table) -> pa.Table:
    """A partition of a count table: the n-grams that the corpus has more than once."""
    counts = np.frombuffer(b"".join(x.as_buffer() for x in asked.column("counts")), np.uint32)
    h = _unpack(asked.column("grams"))
    first, place = distinct(h)
    total = np.bincount(place, weights=counts, minlength=len(first)).astype(np.int64)
    often = total > 1
    n = int(often.sum())
    return pa.table([pa.array(np.full(n, key[0].as_py())), pa.array(np.full(n, key[1].as_py()), pa.int32()), pa.array(h[first][often].astype(np.int64)), pa.array(total[often])], names=["part", "n", "gram", "count"])


def _answer(key: tuple, asked: pa.Table, counts: pa.Table) -> pa.Table:
    """The join of a block's n-grams with the count table; one that the table lacks has been seen once."""
    gram, count = counts.column("gram").to_numpy(), counts.column("count").to_numpy()
    by = np.argsort(gram)
    gram, count = np.append(gram[by], np.iinfo(np.int64).max), np.append(count[by], 1)
    wide = bool(count.max() >= 1 << 32)
    answers = []
    for x in asked.column("grams").chunks:
        for g in x:
            h = _unpack([g]).astype(np.int64)
            at = np.searchsorted(gram, h)
            answers.append(np.where(gram[at] == h, count[at], 1).astype(np.uint64 if wide else np.uint32).tobytes())
    return pa.table([asked.column("part"), asked.column("block"), asked.column("n"), pa.array(answers, pa.binary()), pa.array([wide] * len(answers), pa.bool_())], names=["part", "block", "n", "totals", "wide"])


def _score(order: int, backoff: float, least: int):
    def go(key: tuple, docs: pa.Table, told: pa.Table) -> pa.Table:
        grams, w = _grams(docs, order)
        told = told.sort_by([("n", "ascending"), ("part", "ascending")]).to_pydict()
        count = []
        for n, g in enumerate(grams, 1):
            whole = _whole(w, n)
            c = np.zeros(len(g), np.float64)
            parts = [np.frombuffer(x, np.uint64 if y else np.uint32) for x, y, k in zip(told["totals"], told["wide"], told["n"], strict=True) if k == n]
            if parts:
                c[whole] = np.concatenate(parts)[distinct(g[whole])[1]]
            count.append(c)
        # score of each word: the longest n-gram seen often enough over its history, times the backoff for each step down
        term, open_ = np.zeros(w[-1]), np.ones(w[-1], bool)
        for n in range(order, 1, -1):
            seen = open_ & (count[n - 1] >= least)
            i = np.flatnonzero(seen)
            down = np.minimum(order, np.arange(w[-1])[i] - np.repeat(w[:-1], np.diff(w))[i] + 1) - n
            term[i] = np.rint(1e6 * np.log(backoff**down * count[n - 1][i] / count[n - 2][i - 1]))
            open_ &= ~seen
        i = np.flatnonzero(open_)
        down = np.minimum(order, np.arange(w[-1])[i] - np.repeat(w[:-1], np.diff(w))[i] + 1) - 1
        term[i] = np.rint(1e6 * np.log(backoff**down * count[0][i]))
        sums = lambda x: np.diff(np.append(0, np.cumsum(x))[w])  # noqa: E731  whole numbers: exact in any order
        return pa.table([docs.column("doc_id"), pa.array(np.diff(w)), pa.array(sums(term.astype(np.int64))), pa.array(sums(open_.astype(np.int64)))], names=["doc_id", "n_words", "micro", "n_unigram"])

    return go


COUNTS = "part long, n int, gram long, count long"


def _asked(docs: DataFrame, order: int, id_col: str, text_col: str) -> tuple[GroupedData, GroupedData]:
    """The documents by block, and the blocks' n-grams by hash range and length."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    size = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    blocks = 1 + size // BLOCK
    dealt = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block"), "doc_id", "text").groupBy("block")
    return dealt, dealt.applyInArrow(_ask(order, 1 + (blocks - 1).bit_length()), REQUEST).groupBy("part", "n")


def count_tables(docs: DataFrame, order: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, n, gram, count) of the n-grams up to `order` that the corpus has more than once, partitioned by hash range; `gram` is
    the hash's low 48 bits. Texts, ids and empty tables as in stupid_backoff."""
    return _asked(docs, order, id_col, text_col)[1].applyInArrow(_count, COUNTS)


def stupid_backoff(docs: DataFrame, order: int = 2, backoff: float = 0.4, least: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_unigram, score): each text's summed log score and how many words fell back to their own frequency.

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased. A word's score is count(n-gram) / count(its
    history) for the longest n-gram that the corpus has at least `least` times, times `backoff` for each order given up; at
    the bottom count(word) / all words. Log terms are added in millionths. A text without words (null, empty, white space)
    scores 0 with n_words 0. Ids are integers; rows with a null id are left out, repeated rows count and are scored each,
    other columns are ignored, an empty table gives no rows.
    """
    dealt, asked = _asked(docs, order, id_col, text_col)
    counts = asked.applyInArrow(_count, COUNTS)  # hash-partitioned as the n-grams are: the join shuffles nothing more
    told = asked.cogroup(counts.groupBy("part", "n")).applyInArrow(_answer, "part long, block long, n int, totals binary, wide boolean")
    out = cut(dealt.cogroup(told.groupBy("block")).applyInArrow(_score(order, backoff, least), "doc_id long, n_words long, micro long, n_unigram long"), "scores")
    total = out.agg(F.sum("n_words")).first()[0] or 1
    return out.select("doc_id", "n_words", "n_unigram", F.round(F.col("micro") / F.lit(1e6) - F.col("n_unigram") * F.log(F.lit(float(total))), 4).alias("score"))


def op1_lm_scoring(spark, sf_dir):
    from tidewater.llm.store import table

    return stupid_backoff(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
t as (select doc_id, i, ws[i] as w, case when i > 1 then ws[i - 1] end as p from (select doc_id, ws, unnest(range(1, len(ws) + 1)) as i from d)),
c1 as (select w, count(*) as c from t group by w),
c2 as (select p, w, count(*) as c from t where p is not null group by p, w),
n as (select count(*)::double as n from t),
x as (select t.doc_id, case when c2.c >= 2 then round(1e6 * ln(c2.c::double / cp.c)) else round(1e6 * ln(case when t.p is null then 1.0::double else 0.4::double end * c1.c)) end as micro,
             case when c2.c >= 2 then 0 else 1 end as uni
      from t join c1 on t.w = c1.w left join c2 on t.p = c2.p and t.w = c2.w left join c1 cp on t.p = cp.w),
s as (select doc_id, count(*) as n_words, sum(micro)::bigint as micro, sum(uni)::bigint as uni from x group by doc_id)
select d.doc_id, coalesce(s.n_words, 0)::bigint as n_words, coalesce(s.uni, 0)::bigint as n_unigram,
       round(coalesce(s.micro, 0) / 1e6::double - coalesce(s.uni, 0) * (select ln(greatest(n, 1)) from n), 4) as score
from d left join s using (doc_id)
"""
