"""Daily and episode features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SERIES = ["metric", "source_class", "source_sid", "offset_seconds"]


def point_daily(facts: DataFrame) -> DataFrame:
    """Count, mean, median, min and max of a series and local day; values that are null do not count,
    a day without values gives no row. Sources are never merged."""
    return (
        facts.where("value is not null").groupBy(*SERIES, "local_date")
        .agg(
            F.count("value").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.percentile("value", 0.5), 6).alias("median"),
            F.min("value").alias("low"), F.max("value").alias("high"),
        )
    )


def long_features(daily: DataFrame) -> DataFrame:
    """The daily statistics as one row for each feature."""
    stats = ["n", "mean", "median", "low", "high"]
    doubles = daily.withColumn("n", F.col("n").cast("double"))
    return doubles.unpivot([*SERIES, "local_date"], stats, "statistic", "value_num").withColumn(
        "feature", F.concat_ws(".", "metric", F.lit("daily"), "statistic")
    )


def bucket_daily(facts: DataFrame, metrics: list[str]) -> DataFrame:
    """Sum and number of the buckets of a day; the width of a bucket is not known and not used."""
    return (
        facts.where(F.col("metric").isin(metrics)).groupBy(*SERIES, "local_date")
        .agg(F.round(F.sum("value"), 6).alias("total"), F.count("*").alias("buckets"))
    )


def episode_features(episodes: DataFrame, segments: DataFrame, awake: str) -> DataFrame:
    """Segments and seconds of each episode, awake and asleep; an episode without segments counts 0."""
    seconds = F.coalesce(F.col("seconds"), F.lit(0))
    return (
        episodes.join(segments, "episode_id", "left").groupBy("episode_id", "source_sid", "local_date")
        .agg(
            F.count("segment").alias("segments"), F.sum(seconds).alias("seconds"),
            F.sum(F.when(F.col("stage") == awake, seconds).otherwise(0)).alias("awake_seconds"),
            F.sum(F.when(F.col("stage") != awake, seconds).otherwise(0)).alias("asleep_seconds"),
        )
    )


def stage_shares(segments: DataFrame) -> DataFrame:
    """Seconds of each stage of an episode and its share of all; none where all is zero."""
    per = segments.groupBy("episode_id", "stage").agg(F.sum("seconds").alias("seconds"))
    total = F.sum("seconds").over(Window.partitionBy("episode_id"))
    return per.withColumn("total", total).where("total > 0").select("episode_id", "stage", "seconds", F.round(F.col("seconds") / F.col("total"), 6).alias("share"))


def series_catalog(features: DataFrame) -> DataFrame:
    """The series that features with a value make, with their days and a folded coverage status."""
    seen = F.collect_set("coverage_status")
    return (
        features.where("mean is not null").groupBy(*SERIES)
        .agg(
            F.count("*").alias("observations"), F.min("local_date").alias("first_date"), F.max("local_date").alias("last_date"),
            F.when(F.size(seen) == 1, F.get(seen, F.lit(0))).otherwise("MIXED").alias("coverage_status"),
        )
    )
