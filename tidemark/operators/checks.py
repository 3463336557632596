"""Assertions in place of constraints: each returns the rows that break a rule, or counts them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..params import FORBIDDEN_WORDS


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(key), key, "left_anti")


def baseline_checks(baselines: DataFrame) -> DataFrame:
    """One row: how many baselines break the order of quantiles, median = q50, bounds of counts, and
    publishing only with enough history."""
    q = ["q10", "q25", "q50", "q75", "q90"]
    ordered = F.lit(True)
    for a, b in zip(q, q[1:], strict=False):
        ordered = ordered & (F.col(a) <= F.col(b) + 1e-6)
    none = F.col("maturity") == "INSUFFICIENT_HISTORY"
    return baselines.agg(
        F.count("*").alias("rows"),
        F.count_if(~none & ~ordered).alias("unordered"),
        F.count_if(~none & (F.abs(F.col("median") - F.col("q50")) > 1e-6)).alias("median_off"),
        F.count_if(F.col("distinct_dates") > F.col("window_days")).alias("out_of_window"),
        F.count_if(none & F.col("median").isNotNull()).alias("published_early"),
    )


def input_audit(baselines: DataFrame, links: DataFrame, keys: list[str]) -> DataFrame:
    """By window: baselines, links to their inputs, links to the baseline's own day or a later one (leaks),
    links to days before the window (early), and baselines whose number of links is not what they state."""
    on = [*keys, "window_days", "as_of"]
    late, early = F.col("local_date") >= F.col("as_of"), F.datediff("as_of", "local_date") > F.col("window_days")
    per = links.groupBy(*on).agg(F.count("*").alias("links"), F.count_if(late).alias("leaks"), F.count_if(early).alias("early"))
    some = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return baselines.join(per, on, "left").groupBy("window_days").agg(
        F.count("*").alias("baselines"), some("links"), some("leaks"), some("early"), F.count_if(F.col("n") != F.coalesce("links", F.lit(0))).alias("miscounted")
    )


def forbidden(df: DataFrame, column: str) -> DataFrame:
    """Rows whose text has one of the words that results must not use."""
    return df.where(F.lower(column).rlike(r"\b(" + "|".join(FORBIDDEN_WORDS) + r")\b"))
