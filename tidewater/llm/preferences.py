"""Preference formatting, in DataFrame functions only.

The turns that a chosen and a rejected conversation share from their start are the prompt, rendered once; what follows in either
is its completion, with a mask that marks what a loss should see: the text of assistant turns, not headers or other roles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.store import table

HEAD, TAIL = "<|{}|>\n", "<|end|>\n"


def _head(role: Column) -> Column:
    before, after = HEAD.split("{}")
    return F.concat(F.lit(before), role, F.lit(after))


def _render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t["role"]), t["text"], F.lit(TAIL))), "")


def _mask(turns: Column) -> Column:
    """Alternating lengths in characters, masked and seen, from the start of the rendered turns."""
    return F.flatten(
        F.transform(
            turns,
            lambda t: F.when(t["role"] == "assistant", F.array(F.length(_head(t["role"])), F.length(t["text"]) + F.lit(len(TAIL)))).otherwise(F.array(F.length(_head(t["role"])) + F.length(t["text"]) + F.lit(len(TAIL)), F.lit(0))),
        )
    )


def format_preferences(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, chosen_id, rejected_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask), one row per pair.

    turns: (conv_id, turn, role, text); pairs: (pair_id, chosen_id, rejected_id). Turns go by number, then role and text; rows of the
    same turn that repeat count once. Null roles and texts are empty; rows with null conv_id or turn are left out. A side without any turns
    is an empty conversation; a pair without both is left out. Equal conversations give two empty completions. Masks
    are alternating lengths in characters, masked then seen. Other columns are ignored; empty tables give no rows.
    """
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = t.where("conv_id is not null and turn is not null")
    side = pairs.select("pair_id", "chosen_id", "rejected_id", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("chosen_id").alias("conv_id")), F.struct(F.lit(1).alias("side"), F.col("rejected_id").alias("conv_id")))).alias("s"))
    side = side.select("pair_id", "chosen_id", "rejected_id", "s.side", "s.conv_id")
    x = side.join(t, "conv_id").groupBy("pair_id", "chosen_id", "rejected_id").agg(F.sort_array(F.collect_set(F.struct("side", "turn", "role", "text"))).alias("all"))
    pick = lambda k: F.filter("all", lambda r: r["side"] == k)
    x = x.select("pair_id", "chosen_id", "rejected_id", pick(0).alias("a"), pick(1).alias("b"))
    differ = F.array_position(F.zip_with("a", "b", lambda p, q: F.coalesce((p["role"] == q["role"]) & (p["text"] == q["text"]), F.lit(False))), F.lit(False))
    x = x.withColumn("n_common", F.when(differ > 0, differ - 1).otherwise(F.size("a")).cast("long"))
    rest = lambda c: F.slice(c, F.col("n_common").cast("int") + 1, F.greatest(F.size(c), F.lit(1)))
    x = x.withColumn("prompt", _render(F.slice("a", F.lit(1), F.col("n_common").cast("int")))).withColumn("a", rest("a")).withColumn("b", rest("b"))
    return x.select("pair_id", "chosen_id", "rejected_id", "n_common", "prompt", _render(F.col("a")).alias("chosen"), _render(F.col("b")).alias("rejected"), _mask(F.col("a")).alias("chosen_mask"), _mask(F.col("b")).alias("rejected_mask"))


def neighbours(turns: DataFrame) -> DataFrame:
    """Pairs for a table that has none: conversation 2i is chosen over 2i + 1."""
    ids = turns.select((F.col("conv_id").cast("long") - F.pmod(F.col("conv_id").cast("long"), F.lit(2))).alias("chosen_id")).where("chosen_id is not null").distinct()
    return ids.select(F.expr("chosen_id div 2").alias("pair_id"), "chosen_id", (F.col("chosen_id") + 1).alias("rejected_id"))


def op7_preferences(spark, sf_dir):
    """Masks as comma-separated text."""
    turns = table(spark, sf_dir, "conversations")
    out = format_preferences(turns, neighbours(turns))
    return out.withColumns({c: F.array_join(c, ",") for c in ("chosen_mask", "rejected_mask")})


_R = "list_transform({0}, lambda t: '<|' || t.role || '|>' || chr(10) || t.text || '<|end|>' || chr(10))"
_M = """list_transform({0}, lambda t: case when t.role = 'assistant' then (length(t.role) + 5)::varchar || ',' || (length(t.text) + 8)::varchar
        else (length(t.role) + 5 + length(t.text) + 8)::varchar || ',0' end)"""
OP7_SQL = f"""
with t as (select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null and turn is not null),
c as (select conv_id, list({{'role': role, 'text': text}} order by turn, role, text) as turns from t group by conv_id),
ids as (select distinct conv_id - conv_id % 2 as chosen_id from t),
p as (select chosen_id // 2 as pair_id, chosen_id, chosen_id + 1 as rejected_id, coalesce(a.turns, []) as a, coalesce(b.turns, []) as b
      from ids left join c a on a.conv_id = chosen_id left join c b on b.conv_id = chosen_id + 1),
n as (select *, coalesce(list_min(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: not coalesce(a[i] = b[i], false))) - 1, len(a)) as n from p)
select pair_id, chosen_id, rejected_id, n::bigint as n_common, array_to_string({_R.format('a[1:n]')}, '') as prompt,
       array_to_string({_R.format('a[n + 1:]')}, '') as chosen, array_to_string({_R.format('b[n + 1:]')}, '') as rejected,
       array_to_string({_M.format('a[n + 1:]')}, ',') as chosen_mask, array_to_string({_M.format('b[n + 1:]')}, ',') as rejected_mask
from n
"""
