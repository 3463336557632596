"""Acceptance checks of each layer as assertion frames: check, violations. A check that holds has none.

Every frame is one pass of aggregates over its table, besides the joins that a check is about.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import CONFIDENCE, DEFAULT, FORBIDDEN_WORDS, GENERATED, GENERATED_PREFIX, NUMERIC, Params
from ..functions.scalar import local_date
from .analytics import INSUFFICIENT

# The vocabularies that results may use.
EVIDENCE = ["SENSOR_DERIVED", "VENDOR_DERIVED", "USER_REPORTED"]
RESULTS = {"STRUCTURE": ["PASS", "FLAGGED"], "PROVENANCE": ["PASS", "FLAGGED"], "SEMANTICS": ["PASS", "UNKNOWN"]}
STATES = ["INSUFFICIENT_EVIDENCE", "NOTABLE_CHANGE", "MILD_CHANGE", "STABLE"]


def tally(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """How many rows break each rule (a rule says when a row is wrong)."""
    return df.agg(*(F.count_if(wrong).alias(name) for name, wrong in rules.items())).unpivot([], list(rules), "check", "violations")


def counted(rows: DataFrame, check: str) -> DataFrame:
    return rows.agg(F.count("*").alias("violations")).select(F.lit(check).alias("check"), "violations")


def together(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def repeated(df: DataFrame, keys: list[str], check: str) -> DataFrame:
    return counted(df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1"), check)


def facts_audit(facts: DataFrame, log: DataFrame) -> DataFrame:
    """Normalised facts against the observations they come from (log: fact_id)."""
    generated = F.col("source_sid").startswith(GENERATED_PREFIX)
    return together(
        tally(facts, {
            "no_time": F.col("ts").isNull(), "wrong_source_class": F.col("source_class") != F.when(generated, GENERATED).otherwise(NUMERIC),
            "unknown_evidence": ~F.col("evidence").isin(EVIDENCE), "wrong_local_date": F.col("local_date") != local_date(F.col("ts"), F.col("offset_seconds")),
        }),
        repeated(facts, ["fact_id"], "duplicate_fact"),
        counted(facts.join(log, "fact_id", "left_anti"), "fact_without_observation"),
        counted(log.join(facts, "fact_id", "left_anti"), "observation_without_fact"),
    )


def provenance_audit(facts: DataFrame, raw: DataFrame) -> DataFrame:
    """Facts (fact_id, raw_sha256) derived again from raw lines (fact_id, text): text that is gone, text
    that no longer has the hash, and lines that no fact uses."""
    joined = facts.join(raw.select("fact_id", F.sha2("text", 256).alias("_found")), "fact_id", "full_outer")
    return tally(joined, {
        "raw_missing": F.col("_found").isNull(), "hash_differs": F.col("_found") != F.col("raw_sha256"), "raw_unused": F.col("raw_sha256").isNull(),
    })


def quality_audit(facts: DataFrame, assessed: DataFrame, linked: DataFrame, decisions: DataFrame) -> DataFrame:
    """Three checks a fact, in their words; provenance as linked; vendors' meanings never certain;
    conflicts kept open. facts(fact_id, evidence), assessed(fact_id, check, result), linked(fact_id)."""
    known = reduce(lambda a, b: a | b, ((F.col("check") == k) & F.col("result").isin(v) for k, v in RESULTS.items()))
    told = assessed.join(linked.distinct().withColumn("_linked", F.lit(True)), "fact_id", "left").join(facts, "fact_id", "left")
    has = F.coalesce("_linked", F.lit(False))
    three = facts.select("fact_id").join(assessed.groupBy("fact_id").agg(F.count_distinct("check").alias("_n")), "fact_id", "left")
    return together(
        tally(told, {
            "unknown_result": ~known, "orphan_assessment": F.col("evidence").isNull(),
            "provenance_wrong": (F.col("check") == "PROVENANCE") & F.col("evidence").isNotNull() & (has != (F.col("result") == "PASS")),
            "vendor_certain": (F.col("check") == "SEMANTICS") & F.col("evidence").startswith("VENDOR_") & (F.col("result") == "PASS"),
        }),
        tally(three, {"not_three_checks": F.coalesce("_n", F.lit(0)) != 3}),
        repeated(assessed, ["fact_id", "check"], "duplicate_assessment"),
        tally(decisions, {
            "conflict_decided": (F.col("agreement") == "CONFLICT") & (F.col("decision") != "UNRESOLVED"),
            "single_source_open": (F.col("agreement") == "SINGLE_SOURCE") & (F.col("decision") == "UNRESOLVED"),
        }),
    )


def features_audit(daily: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Daily features against the facts of their day: count, mean, order of statistics, nothing made of
    nothing, no day left out."""
    again = facts.where("value is not null").groupBy(*keys, "local_date").agg(F.count("*").alias("_n"), F.avg("value").alias("_mean"))
    both = daily.withColumn("_is", F.lit(True)).join(again, [*keys, "local_date"], "full_outer")
    has = F.col("_is").isNotNull()
    return together(
        tally(both, {
            "without_facts": F.col("_n").isNull(), "missing_day": ~has, "wrong_count": has & (F.col("n") != F.col("_n")), "wrong_mean": has & (F.abs(F.col("mean") - F.col("_mean")) > 1e-5),
            "zero_samples": F.col("n") == 0, "unordered": (F.col("low") > F.col("median")) | (F.col("median") > F.col("high")),
        }),
        repeated(daily, [*keys, "local_date"], "duplicate_feature"),
    )


def baselines_audit(baselines: DataFrame, keys: list[str], params: Params = DEFAULT) -> DataFrame:
    """Order of quantiles, bounds of counts and coverage, maturity from its thresholds, nothing published
    without enough history."""
    q = ["q10", "q25", "q50", "q75", "q90"]
    unordered = reduce(lambda a, b: a | b, (F.col(a) > F.col(b) + 1e-6 for a, b in zip(q, q[1:], strict=False)))
    level = F.lit(None).cast("string")
    for w, m in params.windows.items():
        enough = (F.col("n") >= m.observations) & (F.col("span_days") >= m.span_days) & (F.col("distinct_dates") / w >= m.coverage)
        level = F.when(F.col("window_days") == w, F.when(F.col("n") < m.least, "INSUFFICIENT_HISTORY").when(enough, "ESTABLISHED").otherwise("PROVISIONAL")).otherwise(level)
    none = F.col("maturity") == "INSUFFICIENT_HISTORY"
    return together(
        tally(baselines, {
            "unknown_window": ~F.col("window_days").isin(list(params.windows)), "unordered": unordered, "median_off": F.abs(F.col("median") - F.col("q50")) > 1e-6,
            "negative_mad": F.col("mad") < 0, "too_many_dates": F.col("distinct_dates") > F.col("window_days"), "span_over_window": F.col("span_days") > F.col("window_days"),
            "coverage_off": F.abs(F.col("coverage") - F.col("distinct_dates") / F.col("window_days")) > 1e-5, "maturity_off": F.col("maturity") != level,
            "published_early": none & F.col("median").isNotNull(), "not_published": ~none & F.col("median").isNull(),
        }),
        repeated(baselines, [*keys, "window_days", "as_of"], "duplicate_baseline"),
    )


def analytics_audit(devs: DataFrame, runs: DataFrame, changes: DataFrame, pairs: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Deviations, persistence, change points and relationships against the rules they follow."""
    none = F.col("deviation_class") == INSUFFICIENT
    band = F.col("quantile_band")
    kind = F.when(band == "ABOVE_Q90", F.col("deviation_class") != "BELOW_TYPICAL_RANGE").when(band == "BELOW_Q10", F.col("deviation_class") == "BELOW_TYPICAL_RANGE").otherwise(
        F.col("deviation_class") == "WITHIN_TYPICAL_RANGE"
    )
    run, least = F.col("persistence_class"), params.min_consecutive
    return together(
        tally(devs, {
            "class_off_band": ~none & ~kind, "insufficient_with_numbers": none & F.coalesce("absolute", "relative", "robust_z").isNotNull(),
            "z_without_spread": F.col("z_reason").isNotNull() & F.col("robust_z").isNotNull(), "maturity_ignored": none != (F.col("maturity") == "INSUFFICIENT_HISTORY"),
            "evidence_off": (F.col("evidence") == "SUFFICIENT") != (F.col("maturity") == "ESTABLISHED"),
        }),
        tally(runs, {
            "run_without_days": (run == "PERSISTENT_ABOVE_TYPICAL") & (F.col("above") < least) | (run == "PERSISTENT_BELOW_TYPICAL") & (F.col("below") < least),
            "run_not_named": (run == "NO_PERSISTENT_DEVIATION") & (F.greatest("above", "below") >= least), "both_runs": (F.col("above") > 0) & (F.col("below") > 0),
        }),
        tally(changes, {
            "change_without_date": (F.col("change_class") == "CHANGE_DETECTED") & F.col("split_date").isNull(), "change_too_small": (F.col("change_class") == "CHANGE_DETECTED") & (F.col("magnitude") < params.change_shift),
            "change_on_few": (F.col("n") < params.change_points) & (F.col("change_class") != "INSUFFICIENT_EVIDENCE"),
        }),
        tally(pairs, {
            "rho_out_of_bounds": F.abs("rho") > 1 + 1e-9, "rho_on_few": (F.col("n") < params.pair_points) & F.col("rho").isNotNull(),
            "cause_named": ~F.col("relationship_class").isin("POSITIVE_ASSOCIATION", "NEGATIVE_ASSOCIATION", "NO_ASSOCIATION", "INSUFFICIENT_PAIRED_DATA"),
        }),
    )


def reasoning_audit(days: DataFrame) -> DataFrame:
    """days(overall_state, known, above, below, persistent, changed, candidates, confidence): vocabularies, states that follow
    from their evidence, evidence for every hypothesis, no forbidden word, one row a subject and day."""
    first = F.get("candidates", F.lit(0))
    state = F.col("overall_state")
    return together(
        tally(days, {
            "unknown_state": ~state.isin(STATES), "unknown_confidence": ~F.col("confidence").isin(CONFIDENCE), "no_hypothesis": F.size("candidates") == 0,
            "without_support": F.exists("candidates", lambda c: F.size(c["supporting"]) == 0), "blind_state": (F.col("known") == 0) != (state == "INSUFFICIENT_EVIDENCE"),
            "quiet_but_stable": (state == "STABLE") & ((F.col("above") + F.col("below") > 0) | F.col("persistent") | F.col("changed")),
            "finding_on_stable": (first["type"] == "NO_SIGNIFICANT_FINDING") & (state != "STABLE"),
            "forbidden_word": F.exists("candidates", lambda c: F.lower(F.regexp_replace(c["type"], "_", " ")).rlike(r"\b(" + "|".join(FORBIDDEN_WORDS) + r")\b")),
        }),
        repeated(days, ["subject", "day"], "duplicate_day"),
    )


def stage_audit(runs: DataFrame, frontiers: DataFrame, tables: DataFrame) -> DataFrame:
    """For each pipeline of runs(run, pipeline, status, frontier): whether its last run passed, whether its
    checkpoint is the log's frontier(pipeline, frontier), and whether its table(pipeline, rows) has rows."""
    last = runs.groupBy("pipeline").agg(F.max_by(F.struct("status", "frontier"), "run").alias("last"), F.max(F.when(F.col("status") == "PASS", F.col("frontier"))).alias("checkpoint"))
    joined = last.join(frontiers.withColumnRenamed("frontier", "_frontier"), "pipeline", "left").join(tables, "pipeline", "left")
    return joined.select(
        "pipeline", (F.col("last.status") == "PASS").alias("last_passed"), F.coalesce(F.col("checkpoint") == F.col("_frontier"), F.lit(False)).alias("at_frontier"),
        (F.coalesce("rows", F.lit(0)) > 0).alias("has_rows"),
    )


def issue_log(**stages: DataFrame) -> DataFrame:
    """stage, code, severity, n of the issues (issue) that stages have found; rows without one are fine."""
    severe = F.col("issue").isin("HASH_MISMATCH", "NEGATIVE_INTERVAL", "NOT_JSON", "TIME_MISMATCH")
    told = [df.where("issue is not null").select(F.lit(stage).alias("stage"), F.col("issue"), F.when(severe, "ERROR").otherwise("WARNING").alias("severity")) for stage, df in stages.items()]
    return together(*told).groupBy("stage", F.col("issue").alias("code"), "severity").agg(F.count("*").alias("n"))
