"""Connected components as DataFrame operations: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.store import cut, drop


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, comp) for each node of an edge, comp the smallest node that it reaches; u and v of one orderable type.

    Nulls and self-loops are left out; repeated and reversed edges count once. An empty edge table gives no rows.
    Each round points every node to the smallest of its neighbours, first for larger, then for smaller neighbours; the
    number of rounds grows with the logarithm of the longest path. Minima are aggregated before they are shuffled and written
    before they are joined back to the edges, a join of two plain shuffles, in which Spark can split a hub's edges.
    """
    a, b = F.col(u), F.col(v)
    now = cut(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")

    def state(df: DataFrame) -> tuple:
        r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        return r["n"], r["s"]

    was = state(now)
    while was[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low", 2 * was[0])
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = cut(large, "large", 2 * was[0])
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), "least", 2 * was[0])
        small = large.join(least, "u").select(F.col("v").alias("a"), "m").where("a != m").select(F.col("a").alias("u"), F.col("m").alias("v"))
        then = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small", 4 * was[0])
        drop(low, large, least, now)
        now, before, was = then, was, state(then)
        if was == before:
            break
    ends = now.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    return ends.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
