"""Reading the input tables and presenting them as the engine's observations, facts and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import local_date, source_class
from ..params import GENERATED_PREFIX


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def point_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as point facts: fact_id, user_id, metric, ts, local_date, value, k, source_sid, source_class, offset_seconds."""
    sid = F.concat(F.when(F.col("user_id") % 2 == 1, GENERATED_PREFIX).otherwise(""), (F.col("user_id") % 8).cast("string"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("fact_id"), "user_id", F.col("event_type").alias("metric"), "ts",
        local_date(F.col("ts"), F.lit(28800)).alias("local_date"), "value",
        F.get_json_object("props", "$.k").try_cast("bigint").alias("k"),
        sid.alias("source_sid"), source_class(sid).alias("source_class"), F.lit(28800).alias("offset_seconds"),
    )


def observation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as an append-only log: seq, logical (what is observed) and payload (what is said of it)."""
    facts = point_facts(spark, sf_dir)
    day = F.to_date("ts")
    return facts.select(
        F.col("fact_id").alias("seq"), F.concat_ws("|", F.col("user_id").cast("string"), "metric", day.cast("string")).alias("logical"),
        (F.col("k") % 3).alias("payload"), "ts", "metric", "user_id", day.alias("day"),
    )


def episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as interval episodes."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("episode_id"), F.col("o_orderstatus").alias("source_sid"), F.to_date("o_orderdate").alias("local_date"),
        F.col("o_custkey").alias("user_id"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the segments of those episodes, durations in seconds."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("episode_id"), F.col("l_linenumber").alias("segment"), F.col("l_returnflag").alias("stage"),
        F.col("l_quantity").cast("bigint").alias("seconds"),
    )


def long_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as daily features over years: a series for each priority."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("local_date")).agg(
        F.round(F.avg("o_totalprice"), 6).alias("value")
    )
