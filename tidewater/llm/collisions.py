"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Unit vectors are projected on normal directions. Two vectors of cosine s differ on each of them by a normal variable of variance
2 - 2 s, whatever the data. In a task the vectors are sorted along every projection; around each vector, as the query, lies a window
of `width` standard deviations of a pair at the threshold, and whoever lies in it collides with the query. A pair that collides on
fewer projections than a pair at the threshold does but with probability `miss` is out; the others are verified on the original vectors.

A window along one direction holds a tenth or more of all vectors of any table, so windows over the whole table would count the square
of its rows. Therefore vectors meet in cells: the signs of `bits` other projections, in as many tables of cells as it takes
until a pair at the threshold shares no cell only with probability `miss`. Bits grow with the logarithm of the rows, so that cells
of different vectors keep their size. A larger cell, one of many near copies, is cut into blocks, and every two blocks meet in a task:
none is dropped. A pair that shares several cells counts in the first. Pairs stay in their task; what leaves it is a row for each
vector that has links: how many, and the smallest id that it reaches there. Equal vectors are one from the start.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.components import components
from tidewater.llm.store import cut, table, tidy
from tidewater.llm.textkit import ragged

COSINE, PROJECTIONS, WIDTH, MISS = 0.95, 20, 2.0, 1e-4
#: Vectors in a block at most, on average, fewer where they are long; queries counted at once; pairs verified at once.
BLOCK, BYTES, QUERIES, PAIRS = 2048, 32 << 20, 128, 1 << 14


def least_collisions(m: int, width: float, miss: float) -> int:
    """The largest count that a pair at the threshold misses with probability `miss` at most."""
    p, below = math.erf(width / math.sqrt(2)), 0.0
    for k in range(m + 1):
        below += math.comb(m, k) * p**k * (1 - p) ** (m - k)
        if below > miss:
            return k
    return m


def tables_of_cells(n: int, block: int, cosine: float, miss: float) -> tuple[int, int]:
    """(bits, tables) for n vectors."""
    bits = max(0, math.ceil(math.log2(max(n, 1) * 2 / block)))
    same = (1 - math.acos(cosine) / math.pi) ** bits
    return bits, 1 if same == 1 else math.ceil(math.log(miss) / math.log(1 - same))


def _directions(seed: int, kind: int, n: int, dim: int) -> np.ndarray:
    return np.random.default_rng([seed, kind, dim]).standard_normal((n, dim))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1)[:, None]  # no overflow where components are huge
    return x / np.sqrt((x * x).sum(1))[:, None]


def _cells(bits: int, tables: int, seed: int):
    """The vectors' cells in each table."""

    def go(batches):
        for b in batches:
            dims = b.column("dim").to_numpy()
            codes = np.zeros((b.num_rows, tables), np.int64)
            for d in np.unique(dims).tolist():
                i = np.flatnonzero(dims == d)
                x = _unit(_matrix(b.column("vec").take(pa.array(i))))
                signs = (x @ _directions(seed, 0, bits * tables, d).T >= 0).reshape(len(i), tables, bits)
                codes[i] = signs @ (1 << np.arange(bits, dtype=np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, tables, dtype=np.int32)), pa.array(codes.reshape(-1)))
            yield b.append_column("codes", lists)

    return go


def colliding(a: np.ndarray, b: np.ndarray, width: float, least: int):
    """Batches of pairs (rows of a, rows of b) whose projections, a column each, collide at least so often; each pair once."""
    order = np.argsort(b, axis=0, kind="stable")
    along = np.take_along_axis(b, order, axis=0)
    for lo in range(0, len(a), QUERIES):
        q = a[lo : lo + QUERIES]
        count = np.zeros(len(q) * len(b), np.uint8)
        row = np.arange(len(q)) * len(b)
        for k in range(a.shape[1]):
            first, last = np.searchsorted(along[:, k], q[:, k] - width, "left"), np.searchsorted(along[:, k], q[:, k] + width, "right")
            count[order[ragged(first, last - first), k] + np.repeat(row, last - first)] += 1
        at = np.flatnonzero(count >= least)
        yield lo + at // len(b), at % len(b)


def _smallest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of n places that each reaches by the pairs."""
    low = np.arange(n)
    while True:
        m = np.minimum(low[a], low[b])
        was = low.copy()
        np.minimum.at(low, a, m)
        np.minimum.at(low, b, m)
        low = low[low]
        if (low == was).all():
            return low


def _linked(cosine: float, m: int, width: float, miss: float, seed: int):
    least, reach = least_collisions(m, width, miss), width * math.sqrt(2 - 2 * cosine)

    def go(key: tuple, rows: pa.Table) -> pa.Table:
        dim, t, i, j = key[0].as_py(), key[1].as_py(), key[3].as_py(), key[4].as_py()
        rows = rows.sort_by([("c", "ascending"), ("h", "ascending")])
        block, copies, c = (rows.column(x).to_numpy() for x in ("block", "n", "c"))
        x, codes = _unit(_matrix(rows.column("vec"))), rows.column("codes").combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)[:, :t]
        p = x @ _directions(seed, 1, m, dim).T
        mine, theirs = np.flatnonzero(block == i), np.flatnonzero(block == j)
        links, pairs = np.zeros(len(c), np.int64), []
        for a, b in colliding(p[mine], p[theirs], reach, least) if len(mine) and len(theirs) else ():
            a, b = mine[a], theirs[b]
            if i == j:
                a, b = a[a < b], b[a < b]
            for lo in range(0, len(a), PAIRS):
                u, v = a[lo : lo + PAIRS], b[lo : lo + PAIRS]
                near = (x[u] * x[v]).sum(1) >= cosine
                u, v = u[near], v[near]
                new = ~(codes[u] == codes[v]).any(1)  # else it counts in an earlier table
                pairs.append((u[new], v[new]))
        if pairs:
            u, v = (np.concatenate(z) for z in zip(*pairs, strict=True))
            np.add.at(links, u, copies[v])
            np.add.at(links, v, copies[u])
            root = c[_smallest(len(c), u, v)]
        some = np.flatnonzero(links)
        root = root[some] if len(some) else np.zeros(0, np.int64)
        return pa.table([pa.array(z.astype(np.int64)) for z in (c[some], rows.column("h").to_numpy()[some], root, links[some])], names=["c", "h", "root", "links"])

    return go


@tidy
def near_vectors(rows: DataFrame, cosine: float = COSINE, m: int = PROJECTIONS, width: float = WIDTH, miss: float = MISS, seed: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id): for each vector, with how many others it has a cosine of `cosine` or more, and the smallest id
    that it reaches by such links.

    A pair at the very threshold is missed with probability 2 * miss at most, nearer ones hardly ever; none below it is linked. A
    vector that is null or empty, zero, or holds null or non-finite components links with nothing, as do vectors of different lengths.
    Each row counts as a vector, repeated ones as copies of each other; rows that share an id share a component. Rows with
    a null id are left out; other columns are ignored; an empty table gives no rows.
    """
    kind = "float" if dict(rows.dtypes)[vec_col] == "array<float>" else "double"
    v = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast(f"array<{kind}>").alias("vec")).where("vec_id is not null")
    sound = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("vec", lambda x: x != 0)
    v = cut(v.withColumn("vec", F.when(sound, F.col("vec"))).withColumn("h", F.xxhash64("vec")), "vectors")
    classes = v.where("vec is not null").groupBy("h", "vec").agg(F.min("vec_id").alias("c"), F.count("*").alias("n"), F.size(F.first("vec")).alias("dim"))
    classes = cut(classes, "classes")
    n, dim = classes.agg(F.count("*"), F.max("dim")).first()
    block = min(BLOCK, max(2, BYTES // (8 * (dim or 1))))
    bits, tables = tables_of_cells(n, block, cosine, miss)
    coded = cut(classes.mapInArrow(_cells(bits, tables, seed), "h long, vec array<%s>, c long, n long, dim int, codes array<long>" % kind), "cells")
    cell = ["dim", "t", "code"]
    # how large a cell is is written before it is joined, so that a large one's rows can be split
    sizes = coded.select("dim", F.posexplode("codes").alias("t", "code")).groupBy(*cell).agg(F.count("*").alias("held")).where("held > 1")
    sizes = cut(sizes.select(*cell, (1 + F.expr(f"(held - 1) div {block}")).alias("blocks")), "sizes")
    dealt = coded.select("*", F.posexplode("codes").alias("t", "code")).join(sizes, cell)
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("c", "h"), "blocks")).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select(*cell, F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "c", "h", "n", "vec", "codes")
    found = cut(dealt.groupBy(*cell, "i", "j").applyInArrow(_linked(cosine, m, width, miss, seed), "c long, h long, root long, links long"), "found")
    links = cut(found.groupBy("c", "h").agg(F.sum("links").alias("links")), "links")
    comp = cut(components(found.where("c != root").select("c", "root").distinct(), "c", "root").select(F.col("node").alias("c"), "comp"), "components")
    many = cut(classes.where("n > 1").select("h", "vec", "c", "n"), "copies")
    # a row's class, then what is known of the class; a single vector is its own
    own = v.join(many, ["h", "vec"], "left").select("vec_id", F.when(F.col("vec").isNotNull(), F.col("h")).alias("h"), F.coalesce("c", "vec_id").alias("c"), F.coalesce("n", F.lit(1)).alias("n"))
    out = own.join(links, ["c", "h"], "left").join(comp, "c", "left")
    sound = F.col("h").isNotNull()
    return out.select("vec_id", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.when(sound, F.coalesce("comp", "c")).otherwise(F.col("vec_id")).alias("component_id"))


def op12_near_vectors(spark, sf_dir):
    out = near_vectors(table(spark, sf_dir, "embeddings"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))


#: Every pair by its cosine; reach grows link by link.
OP12_SQL = """
with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as x from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as materialized (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.x) = len(b.x) and list_cosine_similarity(a.x, b.x) >= 0.95),
r as (select vec_id as a, vec_id as b from v union select r.a, l.b from r join l on r.b = l.a),
n as (select a, count(*) as n from l group by a), c as (select a, min(b) as c from r group by a)
select vec_id, coalesce(n.n, 0)::bigint as n_links, coalesce(c.c, vec_id) as component_id, vec_id = coalesce(c.c, vec_id) as kept
from embeddings left join n on n.a = vec_id left join c on c.a = vec_id where vec_id is not null
"""
