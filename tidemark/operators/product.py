"""What a user sees: states, episodes, patterns, notifications, sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import in_quiet_hours
from ..params import DEFAULT, ONGOING, Params

NOTABLE = ["MILD_CHANGE", "NOTABLE_CHANGE"]


def product_state(overall: Column, primary: Column, confidence: Column, review: Column, symptom: Column) -> Column:
    """E (attention), D (too little evidence), else A to C by the overall state."""
    attention = (primary == "ACUTE_ILLNESS_SUSPECTED") | review.isin("REQUIRED", "PERFORMED", "UNAVAILABLE") | symptom
    return (
        F.when(F.coalesce(attention, F.lit(False)), "E").when(overall == "INSUFFICIENT_EVIDENCE", "D")
        .when((primary == "UNKNOWN") & (confidence == "VERY_LOW"), "D")
        .when(overall == "STABLE", "A").when(overall == "MILD_CHANGE", "B").when(overall == "NOTABLE_CHANGE", "C")
    )


def canonical_days(reasoning: DataFrame) -> DataFrame:
    """One judgment a subject and day: the last current one, else the first."""
    current = F.col("status") == "CURRENT"
    order = [F.desc(current), F.when(current, -F.col("id")).otherwise(F.col("id"))]
    return reasoning.withColumn("_n", F.row_number().over(Window.partitionBy("subject", "day").orderBy(*order))).where("_n = 1").drop("_n")


def episodes(days: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Runs of notable days of one theme, with gaps of up to one quiet day; a run that reaches the
    subject's last day is still developing."""
    w = Window.partitionBy("subject").orderBy("day")
    last = F.max("day").over(Window.partitionBy("subject"))
    notable = days.withColumn("_last", last).where(F.col("overall_state").isin(*NOTABLE)).withColumn("primary", F.coalesce("primary", F.lit("UNKNOWN")))
    near = (F.lag("primary").over(w) == F.col("primary")) & (F.datediff("day", F.lag("day").over(w)) <= params.episode_gap_days + 1)
    marked = notable.withColumn("_new", F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    return marked.groupBy("subject", "_run", "primary").agg(
        F.min("day").alias("start_day"), F.max("day").alias("end_day"), F.count("*").alias("days"), F.max("_last").alias("_last"),
    ).select(
        "subject", "primary", "start_day", "end_day", "days", F.when(F.col("end_day") == F.col("_last"), "DEVELOPING").otherwise("CLOSED").alias("phase"),
        F.concat_ws(":", "primary", F.col("start_day").cast("string")).alias("episode_key"),
    )


def timeline(episodes_: DataFrame, events: DataFrame) -> DataFrame:
    """Events (subject, day, ...) of the days of each episode: its days are listed and joined on
    equality, so no range join is needed."""
    listed = episodes_.select("subject", "episode_key", F.explode(F.sequence("start_day", "end_day", F.expr("interval 1 day"))).alias("day"))
    return listed.join(events, ["subject", "day"])


def patterns(outcomes: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Counters of trigger and signal over outcomes(id, trigger, signal, confirmed, day), with what to
    show; first and last are the days of the first and last outcome processed."""
    return pattern_status(outcomes.groupBy("trigger", "signal").agg(
        F.sum(F.col("confirmed").cast("bigint")).alias("support"), F.count("*").alias("total"), F.min_by("day", "id").alias("first_seen"), F.max_by("day", "id").alias("last_seen"),
    ), params)


def pattern_status(folded: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Counters (support, total) with their maturity and what to show; null: nothing."""
    # The row that starts a pattern never establishes it.
    established = (F.col("support") >= params.pattern_support) & (F.col("total") > 1)
    weak = (F.col("total") >= 4) & (F.col("support") * 2 < F.col("total"))
    return folded.withColumn("maturity", F.when(established, "ESTABLISHED").otherwise("OBSERVING")).withColumn(
        "display",
        F.when(~(established | (F.col("support") >= 2) | weak), None).when(established, "ESTABLISHED")
        .when((F.col("total") >= 4) & (F.col("support") == 0), "INVALIDATED").when(weak, "WEAKENED").otherwise("OBSERVING"),
    )


def notification(mode: Column, state: Column, updated: Column, minute: Column, quiet: tuple[int, int] | None) -> Column:
    """struct<decision, reason>; safety goes before everything, quiet hours stop the rest."""
    known = F.when(mode.isin("QUIET", "SMART", "DAILY"), mode).otherwise("SMART")
    reason = (
        F.when(state == "E", "safety_attention").when(~updated, "no_new_judgment").when(known == "QUIET", "quiet_mode")
        .when((known == "SMART") & (state == "C"), "actionable_change").when(known == "SMART", "smart_mode_no_action_needed").otherwise("daily_update")
    )
    sends = reason.isin("safety_attention", "actionable_change", "daily_update")
    hushed = sends & (state != "E") & (in_quiet_hours(minute, *quiet) if quiet else F.lit(False))
    return F.struct(
        F.when(sends & ~hushed, "SEND").otherwise("SUPPRESS").alias("decision"), F.when(hushed, "quiet_hours").otherwise(reason).alias("reason")
    )


def valid_until(context_type: Column, day: Column, params: Params = DEFAULT) -> Column:
    return F.date_add(day, F.when(context_type.isin(*ONGOING), params.ongoing_days).otherwise(params.oneshot_days))


def sessions(turns: DataFrame, slept: DataFrame) -> DataFrame:
    """turns(user_id, ts, day, id) with their session. A session ends when the day has advanced since
    the last turn and the long sleep is over: there is a sleep row for the day, or it is noon."""
    w = Window.partitionBy("user_id").orderBy("ts", "id")
    joined = turns.join(slept.select("user_id", "day").distinct().withColumn("_slept", F.lit(True)), ["user_id", "day"], "left")
    ended = (F.col("day") > F.lag("day").over(w)) & (F.coalesce("_slept", F.lit(False)) | (F.hour("ts") >= 12))
    opens = F.when(F.lag("day").over(w).isNull() | ended, 1).otherwise(0)
    return joined.withColumn("_opens", opens).withColumn("session", F.sum("_opens").over(w)).drop("_opens", "_slept")


def project_episodes(stored: DataFrame, projected: DataFrame) -> DataFrame:
    """stored(id, subject, episode_key, start_day, end_day, phase, status) after a new projection of the
    same columns without id and status: known episodes are renewed under their id, those that are gone
    are SUPERSEDED, others come without an id."""
    fields = ["start_day", "end_day", "phase"]
    both = stored.join(projected.select("subject", "episode_key", *(F.col(c).alias(f"_{c}") for c in fields), F.lit(True).alias("_now")), ["subject", "episode_key"], "full_outer")
    now = F.col("_now").isNotNull()
    status = F.when(now, "CURRENT").when(F.col("status") == "CURRENT", "SUPERSEDED").otherwise(F.col("status"))
    return both.select("id", "subject", "episode_key", *(F.when(now, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in fields), status.alias("status"))


def sent_with_versions(notifications: DataFrame, versions: DataFrame, most: int = 20) -> DataFrame:
    """The last notifications sent to each user with what the version that they are about shows."""
    sent = notifications.where("decision = 'SEND'").join(versions.select(F.col("id").alias("version_id"), "state"), "version_id", "left")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("id")))
    return sent.withColumn("_n", place).where(F.col("_n") <= most).drop("_n")


def contexts_with_times(contexts: DataFrame, meta: DataFrame) -> DataFrame:
    """Current contexts with whether they go on and until when, where that is known."""
    return contexts.where("status = 'CURRENT'").join(meta.select(F.col("context_id").alias("id"), "ongoing", "valid_until", "ended_on"), "id", "left")
