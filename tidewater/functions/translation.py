"""Translations as struct columns (operand, result): a null result means that there is none; the operand is kept through every step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Step = Callable[[Column], Column]


def _pair(operand: Column, result: Column) -> Column:
    return F.struct(operand.alias("operand"), result.alias("result"))


def translation(operand: Column, translator: Step) -> Column:
    """The translator's result beside its operand; a null operand has no result."""
    return _pair(operand, F.when(operand.isNotNull(), translator(operand)))


def map_result(t: Column, f: Step) -> Column:
    """f of a result that is there; f may give null, which is no result."""
    return _pair(t["operand"], F.when(t["result"].isNotNull(), f(t["result"])))


def filter_result(t: Column, keep: Step) -> Column:
    """The result only where keep is true of it; false and null take it away."""
    return _pair(t["operand"], F.when(F.coalesce(keep(t["result"]), F.lit(False)), t["result"]))


def flat_map_result(t: Column, f: Step) -> Column:
    """The result of the translation that f makes of the result, under the first operand."""
    return _pair(t["operand"], F.when(t["result"].isNotNull(), f(t["result"])["result"]))


def compose(*translators: Step) -> Step:
    """One translator of several, each over the result of the one before; the first without a result ends it."""

    def run(c: Column) -> Column:
        for f in translators:
            c = F.when(c.isNotNull(), f(c))
        return c

    return run
