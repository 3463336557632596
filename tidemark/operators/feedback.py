"""Feedback on judgments: what it is about, what it says of the patterns it confirms, what it adds to the contexts.

What feedback counts is a state that merges: sums, and the first and last by id. So it can be folded in any
batches, once for each feedback.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import contains_any
from ..params import CONTEXT_KEYWORDS, DEFAULT, Params
from .evidence import feedback_status
from .product import pattern_status
from .reasoning import extract_contexts

COUNTERS = "subject string, trigger string, signal string, support bigint, total bigint, first struct<id: bigint, day: date>, last struct<id: bigint, day: date>"
RECORDED = "id bigint, subject string, subject_type string, subject_id bigint, feedback_status string, category string, problem string, text string"
CONTEXTS = "id bigint, subject string, context_type string, context_date date, body_part string, raw_text string, source string, status string"

#: The type of feedback that is about a judgment, whose evidence it then counts for.
JUDGMENT = "DAILY_REASONING"


def outcome_signals(deviations: Column) -> Column:
    """The sorted names of what is above or below its range in array<struct<metric, deviation_class>>."""
    up, down = (lambda x: x["deviation_class"] == "ABOVE_TYPICAL_RANGE"), (lambda x: x["deviation_class"] == "BELOW_TYPICAL_RANGE")
    name = lambda x: F.when(up(x), F.concat(x["metric"], F.lit("_UP"))).when(down(x), F.concat(x["metric"], F.lit("_DOWN")))
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(deviations, name))))


def settle(feedback: DataFrame, judgments: DataFrame, keywords: dict[str, list[str]] | None = None) -> DataFrame:
    """feedback(id, subject, subject_type, subject_id, day, verdict, text) with what it is about and says.

    judgments(id, subject, day, status, contexts, deviations) hold their evidence. Feedback without a
    subject_id is about the last current judgment of its subject, of its day if it names one. Adds
    feedback_status, category, problem (UNKNOWN_VERDICT, NO_JUDGMENT; such rows count nothing and add
    nothing), bundle_day, contexts and signals: null where it is about no known judgment. A verdict that
    adds to the facts and has a text in which nothing is found is a reason_corrected.
    """
    words = [w for group in (keywords or CONTEXT_KEYWORDS).values() for w in group]
    current = judgments.where("status = 'CURRENT'")
    of_day = current.groupBy("subject", "day").agg(F.max("id").alias("_of_day"))
    last = current.groupBy("subject").agg(F.max("id").alias("_last"))
    named = feedback.join(of_day, ["subject", "day"], "left").join(last, "subject", "left").withColumn(
        "subject_id", F.coalesce("subject_id", F.when(F.col("day").isNull(), F.col("_last")).otherwise(F.col("_of_day")))
    )
    status = feedback_status(F.col("verdict"))
    silent = F.coalesce(F.length("text"), F.lit(0)) == 0
    category = F.when(status == "CONFIRMED", "judgment_confirmed").when(status == "REJECTED", "judgment_rejected").when(
        (status == "CORRECTED") & (silent | contains_any(F.col("text"), words)), "context_added").when(status == "CORRECTED", "reason_corrected")
    problem = F.when(status.isNull(), "UNKNOWN_VERDICT").when(F.col("subject_id").isNull(), "NO_JUDGMENT")
    told = judgments.select(F.col("id").alias("subject_id"), F.lit(JUDGMENT).alias("subject_type"), F.col("day").alias("bundle_day"), "contexts", outcome_signals(F.col("deviations")).alias("signals"))
    return named.join(told, ["subject_id", "subject_type"], "left").select(
        "id", "subject", "subject_type", "subject_id", status.alias("feedback_status"), category.alias("category"), problem.alias("problem"), "text", "bundle_day", "contexts", "signals"
    )


def recorded(settled: DataFrame) -> DataFrame:
    """Every feedback once, those that were refused with their problem."""
    return settled.select("id", "subject", "subject_type", "subject_id", "feedback_status", "category", "problem", "text")


def counters(settled: DataFrame) -> DataFrame:
    """What settled feedback adds to the counters of each pattern of a subject; see merge_counters. A
    context that the evidence names twice counts twice, a signal once."""
    counts = settled.where("problem is null and signals is not null").withColumn("trigger", F.explode("contexts"))
    row = counts.select("subject", "trigger", F.explode("signals").alias("signal"), (F.col("feedback_status") == "CONFIRMED").cast("bigint").alias("support"),
                        F.lit(1).cast("bigint").alias("total"), F.struct("id", F.col("bundle_day").alias("day")).alias("first"))
    return merge_counters(row.withColumn("last", F.col("first")))


def merge_counters(rows: DataFrame) -> DataFrame:
    """Counters of one pattern merge by sums, and by their first and last feedback id."""
    return rows.groupBy("subject", "trigger", "signal").agg(F.sum("support").alias("support"), F.sum("total").alias("total"), F.min("first").alias("first"), F.max("last").alias("last"))


def patterns_of(state: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """The patterns of a state of counters, with what to show of them."""
    return pattern_status(state.select("subject", "trigger", "signal", "support", "total", F.col("first.day").alias("first_seen"), F.col("last.day").alias("last_seen")), params)


def corrected_contexts(settled: DataFrame, keywords: dict[str, list[str]] | None = None) -> DataFrame:
    """The contexts that the texts of corrections name, on the day of the judgment that they are about (no
    day where that is not known)."""
    said = settled.where("problem is null and feedback_status = 'CORRECTED' and length(text) > 0").select("id", "subject", "text", "bundle_day")
    return extract_contexts(said, F.col("bundle_day"), keywords).select(
        "id", "subject", "context_type", "context_date", "body_part", F.col("text").alias("raw_text"), F.lit("USER_REPORTED").alias("source"), F.lit("CURRENT").alias("status")
    )
