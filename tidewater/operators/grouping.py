"""Grouping, routing and partition assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.murmur import murmur3_text, murmur3_uuid
from tidewater.operators.prefix import numbered


def groups_or_default(n: int | None, spark: SparkSession) -> int:
    return n if n and n > 0 else spark.sparkContext.defaultParallelism


def hash_group(c: Column, n: int) -> Column:
    """A stable group in [0, n) of a text; null counts as the text "null"."""
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit("null")).cast("binary")), 1, 8), 16, 10).cast("bigint") % n


def murmur_group(c: Column, n: int) -> Column:
    """abs(hash % n) of a text's 32-bit murmur3; hashed in Python workers, where hash_group stays in the JVM."""
    return F.abs(murmur3_text(c) % n)


def murmur_uuid_group(c: Column, n: int) -> Column:
    return F.abs(murmur3_uuid(c) % n)


def uuid_group(c: Column, n: int) -> Column:
    """By the 16 bytes of a UUID; null as zero bytes."""
    return hash_group(F.coalesce(F.lower(F.regexp_replace(c, "-", "")), F.lit("0" * 32)), n)


SINGLETON = "SINGLETON"


def uuid_hash_code(c: Column) -> Column:
    """The 32 bits, signed, that its four words give by exclusive or."""
    h = F.regexp_replace(c, "-", "")
    words = [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("bigint") for i in range(4)]
    x = words[0].bitwiseXOR(words[1]).bitwiseXOR(words[2]).bitwiseXOR(words[3])
    return F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x)


def arbitrary_group(c: Column, n: int = 16) -> Column:
    """A UUID's group in [0, n): what is left of its hash code, without its sign."""
    return F.abs(uuid_hash_code(c) % n)


def route(group: Column, topics: dict[str, str]) -> Column:
    """The group's topic, null for a group without one."""
    return F.create_map(*[F.lit(x) for kv in topics.items() for x in kv])[group] if topics else F.lit(None).cast("string")


def assign_all(members: DataFrame, partitions: DataFrame, youngest: bool = True) -> DataFrame:
    """Each member's number of partitions of each of its topics: all for one of them, none for the others.

    The youngest wins (largest born, ties to the larger member id) or the oldest (smallest, ties to the smaller); no born counts
    as 0, and a topic without known partitions has none.
    """
    m = members.withColumn("born_ms", F.coalesce("born_ms", F.lit(0)))
    best = m.groupBy("topic").agg((F.max if youngest else F.min)(F.struct("born_ms", "member_id"))["member_id"].alias("winner"))
    x = m.join(best, "topic").join(partitions, "topic", "left")
    return x.select("topic", "member_id", F.when(F.col("member_id") == F.col("winner"), F.coalesce("n_parts", F.lit(0))).otherwise(0).cast("bigint").alias("n_assigned"))


def buffered(df: DataFrame, group: str, order: list[str], size: int, value: str) -> DataFrame:
    """Each group's values in order (by a whole number first), joined by commas in buffers of `size`."""
    x = numbered(df, group, order, "_n")
    x = x.groupBy(group, F.expr(f"_n div {size}").alias("buffer")).agg(F.array_sort(F.collect_list(F.struct("_n", F.col(value).alias("v")))).alias("all"))
    return x.select(group, "buffer", F.array_join(F.transform("all", lambda r: r["v"].cast("string")), ",").alias("joined"))


def to_map(df: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """Each group's values as a map by key; a key that comes twice within a group is an error, as a null key is."""
    return df.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(key).alias("key"), F.col(value).alias("value"))))).alias("entries"))
