"""MinHash near-duplicates with tensored banding.

Two small collections of `side` groups of `rows` minimum hashes are computed for each text; each pair of a group of the
first and a group of the second collection forms a key, so 2 * side * rows minima give side * side tables of 2 * rows rows
each, where plain banding would compute side * side * 2 * rows. A pair of Jaccard similarity s shares a key unless it
misses all groups of one side: (1 - s**rows)**side twice; at s = 0.8 with the defaults about 7e-5.

Texts with equal shingle sets are one class from the start (equal sets, equal keys); only one member goes on. First each
member of a bucket is compared with the bucket's pivot, the one that meets most others in all tables (the original of a
group of copies meets most). A bucket that this connects is done. The members of the others are compared in full, with no
cap, but only where a common shingle can decide: a set's shingles are put in order of rarity, and two sets alike enough
have one in common so early that the rest of both can still hold the overlap needed (prefix and position filter, exact).
Variants of one original that are too far from it differ by rare shingles, and so meet nobody by chance. Every comparison
is on the full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.components import components
from tidewater.llm.store import cut, drop, sieve, sifted, tidy
from tidewater.llm.textkit import U, combine, hash_spans, mix, slices, text_bytes, trimmed, words

SIDE, ROWS = 10, 2
SETS = 5_000  # rows with sets, or that meet many others, for a task to write where more are not needed
SLICE = 2 << 20  # bytes of text at once: what bounds a worker's memory


def shingle_sets(data: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct n-word shingles as sorted 64-bit hashes, flat, and each row's bounds. A-Z is lower-cased."""
    buf, starts, ends, w = words(data, offs, lower=True)
    h = hash_spans(buf, starts, ends)
    count = np.diff(w)
    rows, parts = [], []
    if len(h) >= n:
        g = combine(*(h[i : len(h) - n + 1 + i] for i in range(n)))
        row = np.repeat(np.arange(len(count)), count)[: len(g)]
        whole = np.arange(len(g)) + n <= w[row + 1]
        parts.append(g[whole])
        rows.append(row[whole])
    for size in range(1, n):
        short = np.flatnonzero(count == size)
        if len(short):
            parts.append(combine(*(h[w[short] + i] for i in range(size))))
            rows.append(short)
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(len(count) + 1, np.int64)
    g, row = np.concatenate(parts), np.concatenate(rows)
    order = np.lexsort((g, row))
    g, row = g[order], row[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (row[1:] != row[:-1])
    g, row = g[new], row[new]
    return g, np.searchsorted(row, np.arange(len(count) + 1))


def _set_hash(g: np.ndarray, at: np.ndarray) -> np.ndarray:
    """128 bits of each set, as two numbers."""
    raw = g.tobytes()
    dig = [xxhash.xxh3_128_digest(raw[8 * i : 8 * j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    return np.frombuffer(b"".join(dig), "<i8").reshape(-1, 2)


def _signatures(n: int, side: int, rows: int):
    def run(batches):
        rng = np.random.default_rng(20240613)
        salt = rng.integers(0, 1 << 63, size=(2, side, rows), dtype=np.uint64) | U(1)
        for b in slices(batches, size=SLICE):
            data, offs = text_bytes(b.column(1))
            g, at = shingle_sets(data, offs, n)
            full = np.flatnonzero(np.diff(at))
            sig = np.zeros((len(offs) - 1, 2 * side), np.uint64)
            if len(full):
                for s in range(2):
                    for k in range(side):
                        low = [np.minimum.reduceat(mix(g * salt[s, k, r]), at[:-1][full]) for r in range(rows)]
                        sig[full, s * side + k] = combine(*low)
            dig = _set_hash(g, at)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, side, dtype=np.int32)), pa.array(np.ascontiguousarray(x).reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.diff(at)), pa.array(dig[:, 0]), pa.array(dig[:, 1]), lists(sig[:, :side]), lists(sig[:, side:])], ["doc_id", "row", "n_shingles", "h1", "h2", "sa", "sb"])

    return lambda batches: trimmed(run(batches))


def _sets(n: int, wanted: np.ndarray):
    def run(batches):
        for b in slices((b.filter(pa.array(sifted(wanted, b.column(0).to_numpy()))) for b in batches), size=SLICE):
            g, at = shingle_sets(*text_bytes(b.column(1)), n)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(g.view(np.int64)))
            h1, h2 = _set_hash(g, at).T
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(h1)), pa.array(np.ascontiguousarray(h2)), lists], ["h1", "h2", "shingles"])

    return lambda batches: trimmed(run(batches))


def _class(salt: int):
    return F.col("h1") if salt == 0 else F.xxhash64("h1", "h2", F.lit(salt))


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike."""
    full = pairs.join(sets.select(F.col("c").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("c").alias("b"), F.col("shingles").alias("y")), "b")
    same = full.select("a", "b", F.size(F.array_intersect("x", "y")).alias("same"), (F.size("x") + F.size("y")).alias("both"))
    return cut(same.where(f"100 * same >= {percent} * (both - same)").select("a", "b"), "links", pairs.count() + sets.count(), SETS)


def _fits(percent: int) -> str:
    """Whether sets of sizes za, zb can be alike if the first shingle they have in common is the pa-th of one and the pb-th of the other."""
    return f"100 * least(za, zb) >= {percent} * greatest(za, zb) and {100 + percent} * (1 + least(za - pa, zb - pb)) >= {percent} * (za + zb)"


def _rest(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members (c, size, comp, sa, sb) of different comp that share a key and can be alike by their rarest shingles."""
    elements = cut(sets.join(members.select("c"), "c", "left_semi").select("c", F.explode("shingles").alias("e")), "elements")
    rows = elements.count()
    # counts are written before they are joined: Spark can split a frequent shingle's rows only in a join of two plain shuffles
    shared = cut(elements.groupBy("e").agg(F.count("*").alias("n")).where("n > 1"), "shared", rows)
    ranked = elements.join(shared, "e").groupBy("c").agg(F.sort_array(F.collect_set(F.struct("n", "e"))).alias("g"))
    ranked = ranked.join(members.select("c", "size", "comp"), "c").withColumn("alone", F.col("size") - F.size("g"))
    early = F.greatest(F.lit(0), F.expr(f"size - ceil({percent} * size / 100D) + 1 - alone")).cast("int")
    early = ranked.select("c", "size", "comp", "alone", F.posexplode(F.slice("g", 1, early)).alias("pos", "x"))
    early = cut(early.select("c", "size", "comp", (F.col("alone") + F.col("pos") + 1).alias("pos"), F.col("x.e").alias("e")), "early", rows)
    rows = early.count()
    main = early.groupBy("e", "comp").agg(F.count("*").alias("n")).groupBy("e").agg(F.max(F.struct("n", "comp"))["comp"].alias("main"), F.count("*").alias("comps"))
    main = cut(main.where("comps > 1").select("e", "main"), "main", rows)
    mixed = cut(early.join(main, "e"), "mixed", 2 * rows)
    mixed = mixed.join(members.select("c", "sa", "sb"), "c")
    lead = mixed.where("comp != main").select("e", F.col("c").alias("a"), F.col("size").alias("za"), F.col("comp").alias("ca"), F.col("pos").alias("pa"), F.col("sa").alias("a1"), F.col("sb").alias("a2"))
    other = mixed.select("e", "main", F.col("c").alias("b"), F.col("size").alias("zb"), F.col("comp").alias("cb"), F.col("pos").alias("pb"), F.col("sa").alias("b1"), F.col("sb").alias("b2"))
    may = f"ca != cb and (cb = main or a < b) and {_fits(percent)} and arrays_overlap(a1, b1) and arrays_overlap(a2, b2)"
    out = cut(lead.join(other, "e").where(may).select("a", "b").distinct(), "pairs", rows, SETS)
    drop(elements, shared, early, main)
    return out


def _labels(links: DataFrame) -> DataFrame:
    """(c, comp) of the classes that have links."""
    return cut(components(links, "a", "b").select(F.col("node").alias("c"), "comp"), "components", 2 * links.count())


@tidy
def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, side: int = SIDE, rows: int = ROWS) -> DataFrame:
    """(doc_id, row, n_shingles, component_id): the classes of texts linked by Jaccard similarity of word shingles.

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased. A text with fewer than `shingle` words has its
    whole word sequence as its one shingle; a null or empty text, or one of white space, has none and is a class of its own.
    Ids are integers; a row with a null id is left out. Each row is classed by its own text, repeated rows each alike, whether
    their ids are equal or not; `row`, Spark's xxhash64 of the text, tells texts with one id apart. component_id is the
    smallest id in the class. Other columns, whatever their names, are ignored. An empty table gives no rows; texts may be
    of any length.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    sig = cut(docs.withColumn("row", F.xxhash64("text")).mapInArrow(_signatures(shingle, side, rows), "doc_id long, row long, n_shingles long, h1 long, h2 long, sa array<long>, sb array<long>"), "signatures")
    # a class of equal sets is known by c, the first half of its hash, or if that is not one of its own, by another of both halves
    classes = sig.where("n_shingles > 0").groupBy("h1", "h2").agg(F.min("doc_id").alias("doc"), F.max("n_shingles").alias("size"), F.first("sa").alias("sa"), F.first("sb").alias("sb"))
    classes = cut(classes, "classes")
    n_classes, salt = classes.count(), 0
    while classes.select(_class(salt)).distinct().count() < n_classes:
        salt += 1
    classes = classes.withColumn("c", _class(salt))
    keys = classes.select("c", F.posexplode("sa").alias("i", "x"), "sb").select("c", "i", "x", F.posexplode("sb").alias("j", "y")).select("c", F.xxhash64("i", "j", "x", "y").alias("key"))
    # what is known of a key is written before it is joined, so that a frequent key's rows can be split
    shared = cut(keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    rows_met = shared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = cut(keys.join(shared, "key"), "met", side * side * n_classes)
    often = cut(found.groupBy("c").agg(F.sum("n").alias("often")).join(classes.select("c", "doc", "size"), "c"), "often", rows_met + n_classes)
    some = often.count()
    met = cut(found.join(often, "c").select("key", "c", "often", "doc", "size"), "buckets", rows_met)
    wanted = sieve(often, "doc")
    sets = docs.mapInArrow(_sets(shingle, wanted), "h1 long, h2 long, shingles array<long>").select(_class(salt).alias("c"), "shingles")
    sets = cut(sets.join(often.select("c"), "c", "left_semi"), "sets", some, SETS)
    first = met.groupBy("key").agg(F.min(F.struct((-F.col("often")).alias("o"), "doc", F.col("c").alias("a"), F.col("size").alias("za"))).alias("f")).select("key", "f.a", "f.za")
    first = cut(first, "first", rows_met)
    pairs = cut(met.join(first, "key").where(f"c != a and 100 * least(size, za) >= {percent} * greatest(size, za)").select("a", F.col("c").alias("b")).distinct(), "pairs", rows_met)
    drop(shared, found, first)
    links = _links(pairs, sets, percent)
    drop(pairs)
    comp = _labels(links)
    members = classes.select("c", "size", "sa", "sb").join(comp, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    now = met.select("key", "c").join(members.select("c", "comp"), "c")
    mixed = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    open_ = now.join(cut(mixed, "mixed", rows_met), "key", "left_semi").select("c").distinct()
    members = cut(members.join(open_, "c", "left_semi"), "members", n_classes)
    more = _links(_rest(members, sets, percent), sets, percent)
    if more.limit(1).count():
        comp = _labels(links.unionByName(more))
    ends = classes.select("h1", "h2", "doc", "c")
    least = classes.select("c", "doc").join(comp, "c").groupBy("comp").agg(F.min("doc").alias("least"))
    ends = ends.join(comp.join(least, "comp").select("c", "least"), "c", "left").withColumn("doc", F.coalesce("least", "doc"))
    ends = cut(ends.select("h1", "h2", "doc").distinct(), "ends", n_classes)
    out = sig.select("doc_id", "row", "n_shingles", "h1", "h2").join(ends, ["h1", "h2"], "left")
    return out.select("doc_id", "row", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("doc")).otherwise(F.col("doc_id")).alias("component_id"))


def op10_minhash(spark, sf_dir):
    from tidewater.llm.store import table

    out = near_duplicates(table(spark, sf_dir, "documents"), shingle=4).drop("row")
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))
