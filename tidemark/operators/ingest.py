"""From captures to classified, versioned observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def classify(log: DataFrame) -> DataFrame:
    """NEW for the first observation of a record, REVISION for the first of another payload,
    REOBSERVATION for all others (a payload that comes back is one)."""
    first = F.row_number().over(Window.partitionBy("logical").orderBy("seq"))
    version = F.row_number().over(Window.partitionBy("logical", "payload").orderBy("seq"))
    return log.withColumn(
        "classification", F.when(first == 1, "NEW").when(version == 1, "REVISION").otherwise("REOBSERVATION")
    )


def versions(classified: DataFrame) -> DataFrame:
    """One row for each different payload of a record, with where it was first and last seen."""
    return classified.groupBy("logical", "payload").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("observations"))


def latest_versions(versions_: DataFrame) -> DataFrame:
    """The version of each record that appeared last (a reverted payload does not become latest)."""
    return versions_.groupBy("logical").agg(
        F.max_by("payload", "first_seq").alias("payload"), F.max("first_seq").alias("first_seq"), F.count("*").alias("versions")
    )


def late_arrivals(captures: DataFrame, log: DataFrame) -> DataFrame:
    """Flags new records whose time lies in the scope of an earlier capture. captures(capture, metric,
    starts, ends); log(capture, metric, ts, classification, ...).

    For each capture the scopes of those before it are merged into disjoint intervals, which are few;
    an observation is joined on its own capture only and no observation is copied.
    """
    w = Window.partitionBy("metric").orderBy("capture").rowsBetween(Window.unboundedPreceding, -1)
    scope = F.struct("starts", "ends")
    # Intervals in order; one that begins within the last is merged with it.
    merge = lambda done, x: F.when(
        (F.size(done) > 0) & (x["starts"] <= F.element_at(done, -1)["ends"]),
        F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["starts"].alias("starts"), F.greatest(F.element_at(done, -1)["ends"], x["ends"]).alias("ends")))),
    ).otherwise(F.concat(done, F.array(x)))
    before = captures.withColumn("_all", F.array_sort(F.collect_list(scope).over(w))).select(
        "metric", "capture", F.aggregate("_all", F.slice("_all", 1, 0), merge).alias("scopes")
    )
    inside = F.exists("scopes", lambda s: (F.col("ts") >= s["starts"]) & (F.col("ts") <= s["ends"]))
    return log.join(before, ["metric", "capture"], "left").withColumn(
        "late", (F.col("classification") == "NEW") & F.coalesce(inside, F.lit(False))
    ).drop("scopes")


def compare_captures(before: DataFrame, now: DataFrame) -> DataFrame:
    """Counts of shared, unchanged, revised, new and missing records of two captures(metric, logical, payload)."""
    both = before.select("metric", "logical", F.col("payload").alias("old"), F.lit(True).alias("was")).join(
        now.select("metric", "logical", F.col("payload").alias("new"), F.lit(True).alias("is")), ["metric", "logical"], "full_outer"
    )
    shared = F.col("was").isNotNull() & F.col("is").isNotNull()
    same = F.col("old").eqNullSafe(F.col("new"))
    return both.groupBy("metric").agg(
        F.count_if(shared).alias("shared"), F.count_if(shared & same).alias("unchanged"), F.count_if(shared & ~same).alias("revised"),
        F.count_if(F.col("was").isNull()).alias("new"), F.count_if(F.col("is").isNull()).alias("missing"),
    )


def version_audit(classified: DataFrame) -> DataFrame:
    """The counts that the classification must satisfy, and whether it does."""
    per = classified.groupBy("logical").agg(F.count("*").alias("obs"), F.count_distinct("payload").alias("versions"), F.count_if(F.col("classification") == "NEW").alias("new"))
    totals = per.agg(F.count("*").alias("logical_records"), F.sum("versions").alias("versions"), F.sum("obs").alias("observations"), F.sum(F.col("versions") - 1).alias("revisions"), F.max("new").alias("most_new"))
    kinds = classified.agg(*(F.count_if(F.col("classification") == k).alias(k.lower()) for k in ("NEW", "REVISION", "REOBSERVATION")))
    return totals.join(F.broadcast(kinds)).withColumn(
        "ok",
        (F.col("new") == F.col("logical_records")) & (F.col("revision") == F.col("revisions"))
        & (F.col("reobservation") == F.col("observations") - F.col("versions")) & (F.col("most_new") == 1),
    )


def exact_duplicates(log: DataFrame, keys: list[str]) -> DataFrame:
    """Rows beyond the first of each group of equal records, by metric."""
    return log.groupBy("metric", *keys).agg(F.count("*").alias("n")).groupBy("metric").agg(F.sum(F.col("n") - 1).alias("duplicates"))


def sampling_gaps(facts: DataFrame) -> DataFrame:
    """Median and longest gap, in minutes, between different instants of a metric and day. Gaps are
    found hour by hour, the last instant before an hour carried on to it, so that no task sorts a day."""
    hour = ["metric", "local_date", "_hour"]
    instants = facts.select("metric", "local_date", "ts", F.date_trunc("hour", "ts").alias("_hour")).distinct()
    last = instants.groupBy(*hour).agg(F.max("ts").alias("_last"))
    carried = last.withColumn("_carried", F.lag("_last").over(Window.partitionBy("metric", "local_date").orderBy("_hour"))).drop("_last")
    before = F.coalesce(F.lag("ts").over(Window.partitionBy(*hour).orderBy("ts")), "_carried")
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(before.cast("timestamp"))) / F.lit(60e6)
    return (
        instants.join(carried, hour).withColumn("gap", gap).groupBy("metric", "local_date")
        .agg(F.count("*").alias("instants"), F.round(F.percentile("gap", 0.5), 4).alias("median_gap"), F.round(F.max("gap"), 4).alias("longest_gap"))
    )


def incremental_range(previous_end: str | None, today: str, overlap_days: int = 2, lookback_days: int = 3) -> tuple[str, str]:
    """First and last day to fetch: with an earlier capture some of its days again, else a lookback."""
    from datetime import date, timedelta

    end = date.fromisoformat(today)
    start = date.fromisoformat(previous_end) - timedelta(days=overlap_days - 1) if previous_end else end - timedelta(days=lookback_days - 1)
    return start.isoformat(), end.isoformat()
