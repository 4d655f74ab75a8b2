"""Rows with the state of their acknowledgement: `status` is PENDING, ACKED or NACKED, `error` says why it is NACKED."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PENDING, ACKED, NACKED = "PENDING", "ACKED", "NACKED"
LINEAGE = ("topic", "part", "off")


def acknowledgeable(df: DataFrame) -> DataFrame:
    """df with nothing said of its rows yet."""
    return df.withColumns({"status": F.lit(PENDING), "error": F.lit(None).cast("string")})


def propagated(source: DataFrame, result: dict[str, Column], carried: tuple[str, ...] = (*LINEAGE, "headers", "status", "error")) -> DataFrame:
    """The result's columns, with those of the source that acknowledge it and describe it."""
    return source.select(*(c.alias(n) for n, c in result.items()), *(c for c in carried if c in source.columns and c not in result))


def filtered(df: DataFrame, keep: Column) -> DataFrame:
    """`passed`; what does not pass is acknowledged. Null is not true."""
    keep = F.coalesce(keep, F.lit(False))
    return df.withColumns({"passed": keep, "status": F.when(keep, F.col("status")).otherwise(ACKED)})


def mapped(df: DataFrame, name: str, value: Column, failed: Column, error: str = "mapping failed") -> DataFrame:
    """`name` as the value; a row whose mapping fails has none and is negatively acknowledged."""
    failed = F.coalesce(failed, F.lit(False))
    return df.withColumns({name: F.when(~failed, value), "status": F.when(failed, NACKED).otherwise(F.col("status")), "error": F.when(failed, F.lit(error)).otherwise(F.col("error"))})


def consumed(df: DataFrame, failed: Column, error: str = "consumer failed") -> DataFrame:
    """Rows that a consumer has seen: acknowledged, or negatively if it failed on them; the others are not held up."""
    failed = F.coalesce(failed, F.lit(False))
    return df.withColumns({"status": F.when(failed, NACKED).otherwise(ACKED), "error": F.when(failed, F.lit(error))})


def reduced(df: DataFrame, key: str, order: str, fold: dict[str, Column], ack: str) -> DataFrame:
    """A row of each key: the aggregates in `fold`, and `ack_order`, the rows' `ack` in the order their acknowledgements run."""
    run = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(ack).alias("a"))))
    return df.groupBy(key).agg(*(c.alias(n) for n, c in fold.items()), F.transform(run, lambda x: x["a"]).alias("ack_order"))


def span_events(df: DataFrame, trace: str, events: list[tuple[Column | str, Column]]) -> DataFrame:
    """(trace_id, event, us): a row for each named moment of a row."""
    rows = F.array(*(F.struct((F.lit(n) if isinstance(n, str) else n).alias("event"), us.alias("us")) for n, us in events))
    return df.select(F.col(trace).alias("trace_id"), F.explode(rows).alias("x")).select("trace_id", "x.event", "x.us")


def latest(df: DataFrame, key: str, order: list[str], value: Column, unless: Column | None = None) -> DataFrame:
    """(key, value) by each key's last row; `unless`: keys whose last row says so have no value and are left out."""
    last = F.max_by(F.struct(value.alias("v"), (F.lit(False) if unless is None else unless).alias("u")), F.struct(*order))
    return df.groupBy(key).agg(last.alias("x")).where("not x.u").select(key, F.col("x.v").alias("value"))


def latest_exception(df: DataFrame, client: str, order: list[str], failed: Column, at_ms: Column, now_ms: Column) -> DataFrame:
    """`error_ms` of each client's last outcome: when it failed (now, if that is not known: negative), null if it succeeded."""
    at = F.when(failed, F.when(at_ms < 0, now_ms).otherwise(at_ms))
    return latest(df, client, order, at).withColumnRenamed("value", "error_ms")


# streams as wholes
def first_match(df: DataFrame, match: Column, order: list[str]) -> DataFrame:
    """The first row that matches, if any."""
    return df.where(match).orderBy(*order).limit(1)


def merged(**streams: DataFrame) -> DataFrame:
    """The rows of all streams, in no order between them: `signal` names where a row is from."""
    out = [s.withColumn("signal", F.lit(n)) for n, s in streams.items()]
    return reduce(DataFrame.unionByName, out)


def taken(df: DataFrame, group: str, order: list[str], n: int) -> DataFrame:
    """The first n rows of each group. Tasks drop what cannot be among them before rows are shuffled."""
    x = df.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return x.where(F.col("_n") <= n).drop("_n")


def inverted(df: DataFrame, batch: list[str], order: str, value: str) -> DataFrame:
    """A row of each batch of rows: `n` and `members`, its values in order, whose acknowledgements then run in that order. A batch
    is what one buffer held."""
    each = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    return df.groupBy(*batch).agg(F.count("*").alias("n"), F.transform(each, lambda x: x["v"]).alias("members"))


def concat(*streams: DataFrame) -> DataFrame:
    """All rows of the first, then of the second, and so on: `stream` numbers where a row is from."""
    parts = [s.withColumn("stream", F.lit(i)) for i, s in enumerate(streams)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scheduled(df: DataFrame, kind: str, parallelism: int | None = None) -> DataFrame:
    """df dealt anew to so many tasks: IMMEDIATE leaves it where it is, SINGLE takes one; the rest `parallelism`, by default as many
    as the cluster runs at once, of which BOUNDED_ELASTIC allows ten times as many at most."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    match kind:
        case "IMMEDIATE":
            return df
        case "SINGLE":
            return df.coalesce(1)
        case "PARALLEL" | "ELASTIC":
            return df.repartition(parallelism or cores)
        case "BOUNDED_ELASTIC":
            return df.repartition(min(parallelism or 10 * cores, 10 * cores))
    raise ValueError(kind)


def transformed(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    for step in steps:
        df = step(df)
    return df
