"""Running values over ordered rows of a group without walking the group in one task.

Rows are cut into blocks, of places where they are known, else of sampled ranges; a block is summed up in one row, what all earlier
blocks come to is a window over those few rows, and a row's own value is that and a window within its block. So a task sorts a block,
however large the group is and however dense in time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions in a block.
BLOCK = 1 << 16
#: Rows that one window may number; rows in a range on average; ranges at most; sampled rows a range.
WHOLE, SPAN, SPANS, BOUND = 1 << 20, 1 << 20, 1 << 16, 32


def by_block(rows: DataFrame, group: str, pos: str, summary: dict[str, Column], merged: dict[str, Column], descending: bool = False) -> tuple[DataFrame, Window]:
    """rows with `_b`, their group and the block of their position, and what `merged` makes of the `summary` of all blocks before
    (after, if descending); and the window up to a row within its block. Null is a group like others."""
    x = rows.withColumn("_b", F.struct(F.col(group).alias("group"), F.expr(f"`{pos}` div {BLOCK}").alias("n")))
    blocks = x.groupBy("_b").agg(*(c.alias(n) for n, c in summary.items()))
    along = F.desc if descending else F.asc
    before = Window.partitionBy("_b.group").orderBy(along("_b.n")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_b", *(c.over(before).alias(n) for n, c in merged.items()))
    return x.join(blocks, "_b"), Window.partitionBy("_b").orderBy(along(pos)).rowsBetween(Window.unboundedPreceding, 0)


def spans(df: DataFrame, key: list[str], n: int, most: int = SPANS) -> DataFrame:
    """df with `_span`, the range of the ordered values of `key` that a row falls into: ranges that hold about n of its rows each, or
    1 / most of them if that is more, whatever their density.

    Their bounds are quantiles of a sample, BOUND rows of which make a range: at most BOUND * most rows, by key columns alone, come
    to the driver. A row's range is a function of the row and of the bounds, which are a constant of the plan; tasks that run
    again give the same.
    """
    rows = df.count()
    k = min(most, rows // n)
    keys = df.select(F.struct(*key).alias("k"))
    taken = keys.sample(min(1.0, BOUND * k / rows), seed=17).orderBy("k").select(F.to_json(F.struct("k")).alias("k")).toArrow().column("k").to_pylist() if k else []
    bounds = taken[BOUND::BOUND]
    kind = keys.schema["k"].dataType.simpleString()
    known = F.from_json(F.lit(f"[{','.join(bounds)}]"), f"array<struct<k:{kind}>>")
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))))
    at = lambda low, step: F.when(F.coalesce(F.get(known, low + step - 1)["k"] <= F.struct(*key), F.lit(False)), low + step).otherwise(low)
    return df.withColumn("_span", F.aggregate(steps, F.lit(0), at) if bounds else F.lit(0))


def few(df: DataFrame) -> bool:
    """Whether a window may hold all rows, should they share a group."""
    return df.count() <= WHOLE


def numbered(df: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    """df with `name`, each row's place within its group, from 0, by `order`. Null is a group like others, and comes first in order.

    Up to WHOLE rows are numbered by one window a group. More are cut into ranges of group and order, which hold about SPAN rows each
    even if all of them share a group and an instant: a row's place is what its group's earlier ranges hold, and its place in
    its own. Rows that are equal in group and order, all columns of it, share a range; they are told apart arbitrarily.
    """
    own = F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1
    if few(df):
        return df.withColumn(name, own.cast("bigint"))
    x = spans(df, [group, *order], SPAN).withColumn("_group", F.struct(group))
    before = Window.partitionBy("_group").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    held = x.groupBy("_group", "_span").agg(F.count("*").alias("_held")).select("_group", "_span", F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_held"))
    own = F.row_number().over(Window.partitionBy("_group", "_span").orderBy(*order)) - 1
    return x.join(held, ["_group", "_span"]).withColumn(name, (F.col("_held") + own).cast("bigint")).drop("_group", "_span", "_held")
