"""A corpus pipeline: quality, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.minhash import near_duplicates
from tidewater.llm.packing import pack
from tidewater.llm.quality import keep_good
from tidewater.llm.store import cut, drop, table, tidy
from tidewater.llm.suffix import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier, learned from the table of labels, does not reject.

    A null text counts as empty; repeated rows are judged each, and alike; an empty table gives no rows.
    """
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest id: five-word shingles, similarity 0.8.

    Of repeated rows, and of alike texts that share an id, one stays; a text without words is a group of its own with its id. Rows
    with a null id stay as they are. An empty table gives no rows.
    """
    found = near_duplicates(docs)
    n = F.row_number().over(Window.partitionBy("doc_id", "component_id").orderBy("row"))
    stays = (F.col("doc_id") == F.col("component_id")) & (F.col("n") == 1)
    marks = found.withColumn("n", n).groupBy("doc_id", "row").agg(F.max(stays).alias("stays"), F.count("*").alias("rows"))
    marks = cut(marks.where("not stays or rows > 1"), "marks")
    here = [docs[f"`{c}`"] for c in docs.columns]
    both = docs.join(marks, (docs["doc_id"] == marks["doc_id"]) & (F.xxhash64(docs["text"]) == marks["row"]), "left")
    out = both.where(marks["stays"].isNull()).select(*here)
    if marks.where("stays").limit(1).count():
        out = out.unionByName(both.where(marks["stays"]).select(*here).dropDuplicates(["doc_id", "text"]))
    return out


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the passages of 200 bytes or more that occur elsewhere as well.

    Every row stays, with a shorter, maybe empty text; nulls stay null, rows with a null id as they are. An empty table gives
    no rows.
    """
    return without_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences of at most 1024: one row per piece, with its ids.

    A null text counts as empty, rows with a null id keep it, repeated rows are packed each; an empty table gives no rows.
    """
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("passages", passages), ("packing", packing)]
#: A learned classifier and repeated-substring removal have no SQL; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        was = docs
        docs = tidy(lambda: cut(stage(spark, was, sf_dir), name))()  # noqa: B023
        drop(was)
    return STAGES[-1][1](spark, docs, sf_dir)
