"""How filters interact: what each removes in every order in which they can be applied.

A document's failures are a flag for each filter. Documents are counted by their flags once; a CUBE over the flags and the part then
gives, for every subset of filters, the rows in which all selected flags are false: what survives that subset. A step of an order
is a pair of subsets, without and with the step's filter, so its numbers are differences of two such rows. What is counted by flags
is at most 2**filters rows a part, whatever the table's size.
"""

from __future__ import annotations

import itertools
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.llm.store import cut, table, tidy

WORD_GAPS = r"[\x20\x09-\x0D]+"
LEAST_WORDS, DISTINCT_PERCENT, CAPITALS_PERCENT, MARKS = 200, 50, 3, r"[#$%&*|]"
#: The filter that compares texts; the others judge a text alone.
DUPLICATE = "E"


def judged(text: Column, words: Column) -> dict[str, Column]:
    """Which filters a text fails: too few words, too few different ones, too many capitals, marks."""
    n = F.size(words)
    return {
        "A": n < LEAST_WORDS,
        "B": 100 * F.size(F.array_distinct(words)) < DISTINCT_PERCENT * n,
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > CAPITALS_PERCENT * F.length(text),
        "D": text.rlike(MARKS),
    }


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(doc_id, part, A, B, C, D, E) of each document: the filters that it fails.

    A null text counts as empty, a null part as the empty string. E: a document with a smaller id has the same text, by its 256-bit
    digest; repeated rows of the smallest id all pass, a null id neither fails nor makes others fail. Texts are read
    once; they are compared by digest, and what is known of a digest is written before it is joined, so that a frequent
    text's rows can be split. Other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    docs = docs.withColumn("words", F.array_remove(F.split("text", WORD_GAPS), ""))
    alone = judged(F.col("text"), F.col("words"))
    flags = cut(docs.select("doc_id", "part", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), *(c.alias(n) for n, c in alone.items())), "flags")
    first = cut(flags.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "first")
    return flags.join(first, "digest", "left").select("doc_id", "part", *alone, F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).alias(DUPLICATE))


def survivors(rows: DataFrame, flags: list[str], sums: list[str]) -> DataFrame:
    """(part, subset, ...sums): what of each part survives each subset of the flags' filters, as the sums of the rows (part, flags, sums)
    that fail none of them. A subset is a number with a bit for each flag. Where nothing survives there is no row."""
    cube = rows.cube("part", *flags).agg(*(F.sum(s).alias(s) for s in sums), F.grouping("part").alias("_all"), *(F.grouping(f).alias(f"_{f}") for f in flags))
    none = F.lit(True)
    for f in flags:
        none &= ~F.coalesce(F.col(f), F.lit(False))
    subset = sum((F.when(F.col(f"_{f}") == 0, 1 << i).otherwise(0) for i, f in enumerate(flags)), F.lit(0))
    return cube.where((F.col("_all") == 0) & none).select("part", subset.alias("subset"), *sums)


def steps(rows: DataFrame, flags: list[str], sums: list[str]) -> DataFrame:
    """(part, filter, subset, before, after, failing, alone): for each part, filter and subset of the other filters, the sums before and
    after the filter; those of what fails it at all, and of what fails it only, are of `n`, the first of the sums. Zeros
    included."""
    n, every = len(flags), (1 << len(flags)) - 1
    got = cut(survivors(rows, flags, sums).select("part", "subset", F.struct(*sums).alias("s")), "survivors", 1)
    pairs = [(f, m) for i, f in enumerate(flags) for m in range(1 << n) if not m >> i & 1]
    bit = {f: 1 << i for i, f in enumerate(flags)}
    pair = F.explode(F.array(*(F.struct(F.lit(f).alias("filter"), F.lit(m).alias("subset"), F.lit(m | bit[f]).alias("next"), F.lit(bit[f]).alias("own"), F.lit(every ^ bit[f]).alias("others")) for f, m in pairs)))
    out = rows.select("part").distinct().select("part", pair.alias("p")).select("part", "p.*")
    for name, at in (("before", F.col("subset")), ("after", F.col("next")), ("whole", F.lit(0)), ("single", F.col("own")), ("rest", F.col("others")), ("end", F.lit(every))):
        here = got.select(F.col("part").alias("_part"), F.col("subset").alias("_subset"), F.struct(*(F.coalesce(f"s.{s}", F.lit(0)).alias(s) for s in sums)).alias(name))
        out = out.join(here, (out["part"] == F.col("_part")) & (at == F.col("_subset")), "left").drop("_part", "_subset")
    less = lambda a, b, s: F.coalesce(F.col(f"{a}.{s}"), F.lit(0)) - F.coalesce(F.col(f"{b}.{s}"), F.lit(0))
    first = sums[0]
    kept, gone = F.coalesce(F.col(f"after.{first}"), F.lit(0)), (less("before", "after", s) for s in sums)
    return out.select("part", "filter", "subset", kept.alias("kept"), *(g.alias(f"gone_{s}") for g, s in zip(gone, sums, strict=True)), less("whole", "single", first).alias("failing"), less("rest", "end", first).alias("alone"))


@tidy
def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the five filters and step: what the step keeps and removes, and how its filter counts.

    (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley). A document is good
    (toxic) if any of its labels says so; labels that are null, or of no document, say nothing. Repeated rows count each. What
    failures() says of nulls holds; an empty table gives no rows.
    """
    rows = failures(docs)
    flags = sorted(c for c in rows.columns if c not in ("doc_id", "part"))
    yes = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marks = cut(labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(yes("quality").alias("good"), yes("toxic").alias("toxic")), "marks")
    some = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(False)))
    by = rows.join(marks, "doc_id", "left").groupBy("part", *flags).agg(F.count("*").alias("n"), some("good").alias("good"), some("toxic").alias("toxic"))
    by = cut(by, "counts", 1)
    step = steps(by, flags, ["n", "good", "toxic"])
    k = F.bit_count("subset")
    times = F.element_at(F.array(*(F.lit(factorial(i) * factorial(len(flags) - 1 - i)).cast("long") for i in range(len(flags)))), (k + 1).cast("int"))
    step = cut(step.withColumn("shapley", times * F.col("gone_n")), "steps", 1)
    total = step.groupBy("part", "filter").agg(F.sum("shapley").alias("shapley"))
    orders = [("".join(o), i + 1, f, sum(1 << flags.index(x) for x in o[:i])) for o in itertools.permutations(flags) for i, f in enumerate(o)]
    orders = docs.sparkSession.createDataFrame(orders, "filter_order string, step int, filter string, subset int")
    out = step.drop("shapley").join(F.broadcast(orders), ["filter", "subset"]).join(total, ["part", "filter"])
    return out.select("part", "filter_order", "step", "kept", F.col("gone_n").alias("removed"), (F.col("failing") - F.col("gone_n")).alias("redundant"), F.col("alone").alias("unique_fails"), F.col("gone_good").alias("good_lost"), F.col("gone_toxic").alias("toxic_lost"), "shapley")


def op13_filter_audit(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Document by document and step by step: a step removes what fails its filter and none of the earlier ones.
OP13_SQL = r"""
with t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents),
w as (select *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words, min(doc_id) over (partition by text) as first from t),
f as (select doc_id, part, case when len(words) < 200 then 'A' else '' end || case when 100 * len(list_distinct(words)) < 50 * len(words) then 'B' else '' end
  || case when 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text) then 'C' else '' end || case when regexp_matches(text, '[#$%&*|]') then 'D' else '' end
  || case when doc_id > first then 'E' else '' end as fails from w),
m as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
g as (select part, fails, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic from f left join m using (doc_id) group by all),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (select a.x || b.x || c.x || d.x || e.x as filter_order from l a, l b, l c, l d, l e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s as (select filter_order, step::integer as step, substr(filter_order, step, 1) as letter, left(filter_order, step - 1) as earlier from o, range(1, 6) as r(step)),
p as (select part, filter_order, step, letter, n, good, toxic, contains(fails, letter) as failing, fails = letter as sole, translate(fails, earlier, '') = fails as here from g, s),
q as (select part, filter_order, step, letter, coalesce(sum(n) filter (where here and not failing), 0)::bigint as kept, coalesce(sum(n) filter (where here and failing), 0)::bigint as removed,
  coalesce(sum(n) filter (where failing and not here), 0)::bigint as redundant, coalesce(sum(n) filter (where sole), 0)::bigint as unique_fails,
  coalesce(sum(good) filter (where here and failing), 0)::bigint as good_lost, coalesce(sum(toxic) filter (where here and failing), 0)::bigint as toxic_lost from p group by all)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, letter))::bigint as shapley from q
"""
