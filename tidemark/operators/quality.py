"""Normalisation, structural quality checks and agreement among sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def normalise_points(raw: DataFrame) -> DataFrame:
    """raw(id, ts, raw_time, body) -> facts with `issue` null, and rejected rows with one. body is JSON
    with a number at $.k; raw_time must be the instant's epoch second."""
    value = F.get_json_object("body", "$.k").try_cast("double")
    issue = (
        F.when(F.col("body").isNull(), "MISSING_BODY").when(F.get_json_object("body", "$.k").isNull(), "MISSING_FIELD")
        .when(value.isNull(), "NOT_A_NUMBER").when(F.col("raw_time").isNull(), "MISSING_TIME")
        .when(F.col("raw_time") != F.unix_seconds(F.col("ts").cast("timestamp")), "TIME_MISMATCH")
    )
    return raw.select("id", "ts", value.alias("value"), issue.alias("issue"))


def invariant_violations(buckets: DataFrame, factor: float, tolerance: float = 1e-5) -> DataFrame:
    """Generated buckets whose second value is not the first one times a factor."""
    return buckets.where(F.abs(F.col("b") - F.col("a") * factor) > tolerance)


def interval_facts(episodes: DataFrame, stages: dict[str, str]) -> DataFrame:
    """episodes(id, items: array<struct<start, end, state>>) -> a row for each item with its stage;
    an empty interval is legal, a negative one is an issue, as is an unknown state."""
    item = episodes.select("id", F.posexplode("items").alias("segment", "x"))
    names = F.create_map(*(F.lit(v) for kv in stages.items() for v in kv))
    return item.select(
        "id", "segment", (F.col("x.end") - F.col("x.start")).alias("seconds"), F.try_element_at(names, F.col("x.state")).alias("stage"),
    ).withColumn("issue", F.when(F.col("seconds") < 0, "NEGATIVE_INTERVAL").when(F.col("stage").isNull(), "UNKNOWN_STATE"))


def assess(facts: DataFrame, provenance: DataFrame) -> DataFrame:
    """Three checks of each fact: times, provenance, and how certain its meaning is. facts(fact_id,
    kind, starts, ends, evidence); provenance(fact_id)."""
    links = provenance.groupBy("fact_id").agg(F.count("*").alias("links"))
    timed = F.col("starts").isNotNull() & ((F.col("kind") != "INTERVAL") | (F.col("ends").isNotNull() & (F.col("ends") >= F.col("starts"))))
    joined = facts.join(links, "fact_id", "left")
    checks = F.array(
        F.struct(F.lit("STRUCTURE").alias("check"), F.when(F.coalesce(timed, F.lit(False)), "PASS").otherwise("FLAGGED").alias("result")),
        F.struct(F.lit("PROVENANCE").alias("check"), F.when(F.col("links") > 0, "PASS").otherwise("FLAGGED").alias("result")),
        F.struct(F.lit("SEMANTICS").alias("check"), F.when(F.col("evidence").startswith("VENDOR_"), "UNKNOWN").otherwise("PASS").alias("result")),
    )
    return joined.select("fact_id", F.explode(checks).alias("c")).select("fact_id", "c.check", "c.result")


def resolve_sources(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Agreement of the sources of one thing at one time. facts(keys, source_class, value, code, unit).
    Sources are compared, never merged; two ids of one class are one source."""
    said = F.count_distinct(F.struct("value", "code", "unit"))
    folded = facts.groupBy(*keys).agg(F.count("*").alias("members"), F.count_distinct("source_class").alias("classes"), said.alias("said"))
    one = F.col("classes") == 1
    return folded.select(
        *keys, "members", "classes",
        F.when(one, "SINGLE_SOURCE").when(F.col("said") == 1, "AGREE").otherwise("CONFLICT").alias("agreement"),
        F.when(one & (F.col("members") == 1), "SELECTED").when(one | (F.col("said") == 1), "COEXIST").otherwise("UNRESOLVED").alias("decision"),
    )


def eligible(facts: DataFrame, assessments: DataFrame) -> DataFrame:
    """Facts that no check has flagged."""
    return facts.join(assessments.where("result = 'FLAGGED'"), "fact_id", "left_anti")
