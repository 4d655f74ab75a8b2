"""Publishing: a row is mapped to an inner stream with an end of its own, which may fail or come late."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPLETE = "COMPLETE"


def published(df: DataFrame, parent: str, source: str, mapper: Callable[[Any], Iterable[Any]], kind: str = "string") -> DataFrame:
    """(parent, pos, value, end, error): the elements that the mapper gives of each row's `source`, then a row with `end`, COMPLETE or
    ERROR, whose pos is how many there were.

    The mapper is a table function beside the row, by lateral join: elements leave as they are made, those before an error as well, and
    no row's elements are gathered. A mapper that gives nothing has an end only.
    """

    class Publish:
        def eval(self, x: Any):
            n = 0
            try:
                for v in mapper(x):
                    yield n, v, None, None
                    n += 1
            except Exception as e:  # noqa: BLE001
                yield n, None, "ERROR", f"{type(e).__name__}: {e}"
            else:
                yield n, None, COMPLETE, None

    table = F.udtf(Publish, returnType=f"pos int, value {kind}, end string, error string")
    return df.lateralJoin(table(F.col(source).outer())).select(parent, "pos", "value", "end", "error")


def acknowledged(children: DataFrame, ends: DataFrame, parents: DataFrame, parent: str) -> DataFrame:
    """Parents' n, `status`, `status_us` and `error`: NACK at the first of a child's NACK and the inner stream's error, else ACK when the
    inner stream has ended and all its elements are done, whichever is later, else PENDING.

    children: (parent, done_us, outcome, error), a row an element; ends: (parent, end, end_us, error), end_us null while it is to come.
    An inner error that comes first leaves what elements say later without effect. Counts and minima only: combined before they
    are shuffled, whatever a parent's elements.
    """
    nack = F.when((F.col("outcome") == "NACK") & F.col("done_us").isNotNull(), F.struct(F.col("done_us").alias("us"), F.col("error")))
    c = children.groupBy(parent).agg(F.count("*").alias("n"), F.count("done_us").alias("_done"), F.max("done_us").alias("_last"), F.min(nack).alias("_nack"))
    e = ends.select(parent, F.col("end").alias("_end"), F.col("end_us").alias("_end_us"), F.when((F.col("end") != COMPLETE) & F.col("end_us").isNotNull(), F.struct(F.col("end_us").alias("us"), F.col("error"))).alias("_failed"))
    x = parents.select(parent).join(c, parent, "left").join(e, parent, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    bad = F.least("_nack", "_failed")
    whole = (F.col("_end") == COMPLETE) & F.col("_end_us").isNotNull() & (F.coalesce("_done", F.lit(0)) == F.col("n"))
    status = F.when(bad.isNotNull(), "NACK").when(whole, "ACK").otherwise("PENDING")
    at = F.when(bad.isNotNull(), bad["us"]).when(whole, F.greatest("_end_us", "_last"))
    return x.select(parent, "n", status.alias("status"), at.alias("status_us"), bad["error"].alias("error"))
