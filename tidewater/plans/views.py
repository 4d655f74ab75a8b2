"""Canonical views over the driver's tables: records, works, completions, group members."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.model import work_type_rank
from tidewater.operators.prefix import numbered


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", "value", "props", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log records: an offset numbers the records of a partition in order of arrival."""
    e = numbered(events(spark, sf_dir).withColumn("part", (F.col("user_id") % 10).cast("bigint")), "part", ["us", "event_id"], "off")
    return e.select(
        F.lit("events").alias("topic"), "part", "off", "us", F.col("user_id").cast("string").alias("key"),
        F.col("event_type").alias("value"), F.create_map(F.lit("k"), F.col("k").cast("string")).alias("headers"), "event_id", "user_id", "k",
    )


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    kind = F.when(F.col("event_type").isin("signup", "view"), "INTENT").when(F.col("event_type") == "error", "RETRY").when(F.col("event_type") == "click", "CANCEL").otherwise("COMMIT")
    w = e.select(
        "event_id", F.col("user_id").alias("subject"), kind.alias("type"), F.concat(F.col("user_id").cast("string"), F.lit(":"), (F.col("k") % 8).cast("string")).alias("marker"), "us",
        F.expr("us div 1000").alias("inception_ms"), (F.col("k") % 12).alias("recycle_count"), (F.col("k") % 2 == 0).alias("prepared"), (F.col("k") % 10 == 0).alias("fails"),
    )
    return w.withColumn("rank", work_type_rank("type"))


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    done = F.when(F.col("event_id") % 501 != 0, F.col("us") + (F.col("event_id") * 7919 % 97) * 1_000_000)
    return r.select("part", "off", "us", "event_id", done.alias("done_us"), F.when(F.col("value") == "error", "NACK").otherwise("ACK").alias("outcome"))


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(F.concat(F.lit("m"), (F.col("user_id") % 4).cast("string")).alias("member_id"), F.col("event_type").alias("topic"), "event_id").groupBy("member_id", "topic").agg(F.min("event_id").alias("born_ms"))


SQL = """ev as (select event_id, user_id, event_type, value, props, epoch_us(ts) as us, cast(json_extract_string(props, '$.k') as bigint) as k from events),
records as (select 'events' as topic, (user_id % 10)::bigint as part, (row_number() over (partition by user_id % 10 order by us, event_id) - 1)::bigint as off, us,
  user_id::varchar as key, event_type as value, event_id, user_id, k from ev),
works as (select *, case type when 'COMMIT' then 3 when 'CANCEL' then 2 when 'RETRY' then 1 else 0 end as rank from (
  select event_id, user_id as subject, case when event_type in ('signup', 'view') then 'INTENT' when event_type = 'error' then 'RETRY' when event_type = 'click' then 'CANCEL' else 'COMMIT' end as type,
  user_id::varchar || ':' || (k % 8)::varchar as marker, us, us // 1000 as inception_ms, k % 12 as recycle_count, k % 2 = 0 as prepared, k % 10 = 0 as fails from ev)),
completions as (select part, off, us, event_id, case when event_id % 501 <> 0 then us + (event_id * 7919 % 97) * 1000000 end as done_us, case when value = 'error' then 'NACK' else 'ACK' end as outcome from records),
members as (select 'm' || (user_id % 4)::varchar as member_id, event_type as topic, min(event_id) as born_ms from ev group by all)"""
