"""Searches in tables of vectors: the exact top k by branch and bound, and near neighbours by stable projections.

Both deal the candidates into blocks, once, and write them; a packet of the queries, of bounded size, is broadcast and passes by all
blocks where they lie; a block answers a query with its own best k, and the best of these are the result. So no task gathers more than
about one block and one packet, or k answers a block for a query. Each vector is shuffled once and read once a packet; what is
computed still grows with vectors times queries, as every query is asked of every block.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.llm.store import cut

#: Rows at most, on average, in a block of candidates and in a packet of queries; fewer where vectors are long.
BLOCK, PACKET, NEAR_BLOCK = 8192, 65536, 32768
BYTES = 32 << 20


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 1))


def _vectors(rows: DataFrame, id_col: str, vec_col: str, nonzero: bool) -> DataFrame:
    """(vec_id, dim, vec) of the vectors that take part."""
    v = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).where("vec_id is not null and size(vec) > 0")
    v = v.where(F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    if nonzero:
        v = v.where(F.exists("vec", lambda x: x != 0))
    return v.select("vec_id", F.size("vec").alias("dim"), "vec")


def _search(rows: DataFrame, every: int, k: int, work, kind: str, id_col: str, vec_col: str, nonzero: bool, block: int) -> DataFrame:
    """work(rows, queries) gives (query ids, vector ids, scores) of a block's best for a packet of queries, as arrays."""
    v = _vectors(rows, id_col, vec_col, nonzero)
    n, dim = v.agg(F.count("*"), F.max("dim")).first()
    most = max(1, BYTES // (8 * (dim or 1)))
    most = min(block, most)
    v = v.groupBy("vec_id", "dim").agg(F.min("vec").alias("vec"))  # one row of each id, the one with the least vector
    v = cut(v.repartition(1 + n // most), "vectors")
    asked = v.where(F.col("vec_id") % every == 0)
    packets = 1 + asked.count() // min(PACKET, max(1, BYTES // (8 * (dim or 1))))
    names = ["query_id", "vec_id", "score"]
    kinds = [pa.int64(), pa.int64(), pa.int64() if kind == "long" else pa.float64()]
    found = []
    for p in range(packets):
        packet = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(packets)) == p).toArrow()
        sent = rows.sparkSession.sparkContext.broadcast({d.as_py(): packet.filter(pc.equal(packet["dim"], d)) for d in pc.unique(packet["dim"])})

        def answers(held: list[pa.RecordBatch], sent=sent):
            block = pa.Table.from_batches(held)
            for d in pc.unique(block["dim"]).to_pylist():
                if d in sent.value:
                    got = work(block.filter(pc.equal(block["dim"], d)), sent.value[d])
                    yield pa.RecordBatch.from_arrays([pa.array(np.asarray(x), t) for x, t in zip(got, kinds, strict=True)], names)

        def go(batches, answers=answers):
            held, size = [], 0
            for b in batches:
                held, size = [*held, b], size + b.num_rows
                if size >= most:
                    yield from answers(held)
                    held, size = [], 0
            if size:
                yield from answers(held)

        best = v.mapInArrow(go, f"query_id long, vec_id long, score {kind}")
        found.append(cut(best, "found") if packets > 1 else best)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    all_ = functools.reduce(DataFrame.unionByName, found)
    return all_.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def branch_and_bound(columns: np.ndarray, rest: np.ndarray, query: np.ndarray, k: int, skip: int, step: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(places, inner products) of at least the k best columns, ties included.

    columns: dimensions by vectors. rest[i]: each vector's norm over the dimensions from step * i on. Products are added up a
    block of dimensions at a time; after each block only those vectors stay whose sum, plus the most that the rest can add
    (Cauchy-Schwarz), reaches the k-th largest of the sums less that most. `skip` is the query's own place, or -1.
    """
    d, n = columns.shape
    live = np.arange(n) if skip < 0 else np.delete(np.arange(n), skip)
    total = np.zeros(len(live))
    for i, lo in enumerate(range(0, d, step)):
        q = query[lo : lo + step]
        block = columns[lo : lo + step] if len(live) == n else columns[lo : lo + step][:, live]
        total += q @ block
        if lo + step >= d or len(live) <= k:
            continue
        slack = np.linalg.norm(query[lo + step :]) * rest[i + 1][live] * (1 + 1e-9) + 1e-6
        floor = np.partition(total - slack, len(live) - k)[len(live) - k]
        stay = total + slack >= floor
        live, total = live[stay], total[stay]
    return live, total


def _top(k: int, step: int = 8):
    def work(rows: pa.Table, queries: pa.Table) -> tuple:
        ids, asked = rows.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
        x, q = (np.floor(1024 * _matrix(t.column("vec"))) for t in (rows, queries))
        columns = np.ascontiguousarray(x.T)
        rest = [np.linalg.norm(columns[lo:], axis=0) for lo in range(0, x.shape[1], step)]
        place = {i: j for j, i in enumerate(ids.tolist())}
        got = [(np.zeros(0, np.int64),) * 3]
        for i, query in zip(asked.tolist(), q, strict=True):
            live, total = branch_and_bound(columns, rest, query, k, place.get(i, -1), step)
            best = np.lexsort((ids[live], -total))[:k]
            got.append((np.full(len(best), i), ids[live[best]], np.rint(total[best]).astype(np.int64)))
        return tuple(np.concatenate(z) for z in zip(*got, strict=True))

    return work


def exact_top_k(rows: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest integer inner products of floor(1024 * x) vectors, ties to the smaller vec_id.

    Queries are the rows whose id is divisible by `every`; a query meets the vectors of its own length but its own row. Null, empty
    and non-finite vectors, and rows with a null id, take no part. Of rows with one id and length, that with the least vector
    counts. Sums are exact up to 2**53. Other columns are ignored; an empty table gives no rows, a lone query none either.
    """
    return _search(rows, every, k, _top(k), "long", id_col, vec_col, False, BLOCK)


def chi_square(x: float, m: int) -> float:
    """The distribution function for an even number m of degrees of freedom."""
    if x == math.inf:
        return 1.0
    term = total = 1.0
    for i in range(1, m // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


class KdTree:
    """Points split at medians of their widest dimension into leaves with bounding boxes; neighbours come leaf by leaf."""

    def __init__(self, points: np.ndarray, leaf: int = 32):
        self.points, leaves, todo = points, [], [np.arange(len(points))]
        while todo:
            i = todo.pop()
            if len(i) <= leaf:
                leaves.append(i)
                continue
            d = int(np.argmax(np.ptp(points[i], axis=0)))
            i = i[np.argsort(points[i, d], kind="stable")]
            todo += [i[: len(i) // 2], i[len(i) // 2 :]]
        self.leaves = leaves
        self.low = np.array([points[i].min(0) for i in leaves])
        self.high = np.array([points[i].max(0) for i in leaves])

    def nearest(self, q: np.ndarray, leaves: int = 8, batch: int = 256):
        """Batches of (squared projected distance that all other points reach, points), each point once, the nearest first.

        Boxes are opened in order of their distance, ever more at a time; a point waits until all nearer boxes are open. Batches
        grow with what came before; points at the same distance come together.
        """
        gap = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        box = (gap * gap).sum(1)
        order, at, given = np.argsort(box, kind="stable"), 0, 0
        wait_i, wait_d = np.zeros(0, np.int64), np.zeros(0)
        while at < len(order):
            i = np.concatenate([self.leaves[k] for k in order[at : at + leaves]])
            d = self.points[i] - q
            wait_i, wait_d = np.append(wait_i, i), np.append(wait_d, (d * d).sum(1))
            at, leaves = at + leaves, 2 * leaves
            reach = box[order[at]] if at < len(order) else np.inf
            now = wait_d < reach
            i, d, wait_i, wait_d = wait_i[now], wait_d[now], wait_i[~now], wait_d[~now]
            by = np.argsort(d, kind="stable")
            i, d, lo = i[by], d[by], 0
            while lo < len(i):
                hi = int(np.searchsorted(d, d[min(lo + max(batch, given // 4), len(i)) - 1], "right"))
                given += hi - lo
                yield (d[hi] if hi < len(i) else reach), i[lo:hi]
                lo = hi


def nearest_by_cosine(tree: KdTree, raw: np.ndarray, norm: np.ndarray, ids: np.ndarray, own: int, full: np.ndarray, low: np.ndarray, k: int, m: int, sure: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, cosines) of the k best found for one query, and how many vectors were verified."""
    best_s, best_i, seen = np.zeros(0), np.zeros(0, np.int64), 0
    size = np.sqrt((full * full).sum())
    for reach, batch in tree.nearest(low):
        batch = batch[ids[batch] != own]
        seen += len(batch)
        if len(best_s) == k:  # by one product; what may be among the best is computed by rows
            batch = batch[(raw[batch] @ full) / (norm[batch] * size) >= best_s[-1] - 1e-9]
        s = (raw[batch] * full).sum(1) / (norm[batch] * size)  # not @: equal vectors get equal cosines wherever they lie
        if len(best_s) == k:
            batch, s = batch[s >= best_s[-1]], s[s >= best_s[-1]]
        best_s, best_i = np.append(best_s, s), np.append(best_i, ids[batch])
        top = np.lexsort((best_i, -best_s))[:k]
        best_s, best_i = best_s[top], best_i[top]
        if len(best_s) == k and chi_square(reach / max(2 - 2 * best_s[-1], 1e-12), m) >= sure:
            break
    return best_i, best_s, seen


def projected(x: np.ndarray, m: int, seed: int) -> np.ndarray:
    """x on m normal directions, by sums that are the same for a row wherever it lies."""
    away = np.random.default_rng(seed).standard_normal((m, x.shape[1]))
    return np.column_stack([(x * a).sum(1) for a in away])


def _near(k: int, m: int, sure: float, seed: int):
    def work(rows: pa.Table, queries: pa.Table) -> tuple:
        ids, asked = rows.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
        raw, raw_q = _matrix(rows.column("vec")), _matrix(queries.column("vec"))
        norm, norm_q = (np.sqrt((z * z).sum(1)) for z in (raw, raw_q))
        tree, got = KdTree(projected(raw / norm[:, None], m, seed)), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        for i, full, low in zip(asked.tolist(), raw_q, projected(raw_q / norm_q[:, None], m, seed), strict=True):
            best_i, best_s, _ = nearest_by_cosine(tree, raw, norm, ids, i, full, low, k, m, sure)
            got.append((np.full(len(best_i), i), best_i, best_s))
        return tuple(np.concatenate(z) for z in zip(*got, strict=True))

    return work


def near_neighbours(rows: DataFrame, k: int = 5, every: int = 50, m: int = 24, sure: float = 0.9, seed: int = 7, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): k near neighbours by cosine, with exact cosines of the original vectors.

    Unit vectors are projected on m normal directions, where squared distances are, but for the factor of the true one,
    chi-square with m degrees of freedom. Each block indexes its projected vectors by a kd-tree and verifies them by growing
    projected distance until a vector as near as the k-th found would, with probability `sure`, have come already. m is even.

    Queries, null handling and ids as in exact_top_k; zero vectors take no part either. Equal vectors have equal scores.
    """
    return _search(rows, every, k, _near(k, m, sure, seed), "double", id_col, vec_col, True, NEAR_BLOCK)


def op4_exact_top_k(spark, sf_dir):
    from tidewater.llm.store import table

    return exact_top_k(table(spark, sf_dir, "embeddings"))


def op8_near_neighbours(spark, sf_dir):
    from tidewater.llm.store import table

    return near_neighbours(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as x from embeddings
           where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.x, c.x)::bigint as score
      from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id and len(q.x) = len(c.x))
select query_id, rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from s) where rank <= 10
"""
