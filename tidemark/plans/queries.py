"""The registered queries: each operator on the whole of its input tables.

Where an operator compares two states (before and after, with gaps, with errors), a rule on the keys
makes them out of one table: it says what changed or is missing, and all rows take part.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import contains_any, local_date, metric_of
from ..functions.stats import last_n
from ..operators import analytics, baseline, checks, evidence, features, ingest, product, quality, reasoning, reconcile
from ..params import CONTEXT_KEYWORDS, DEFAULT, PAIRS, SCOPE_WORDS
from ..sources.scratch import stash
from ..sources.tables import episodes, long_series, observation_log, point_facts, segments, table

Query = Callable[[SparkSession, str], DataFrame]

#: How the event types stand for metrics where rules name metrics.
METRICS = {"click": "heart_rate", "view": "sleep", "error": "stress_score", "purchase": "steps", "signup": "resting_heart_rate"}
#: Context types that the sign-ups of a subject stand for, by k % 5.
CONTEXTS = ["HIGH_INTENSITY_TRAINING", "LATE_SLEEP", "STRESS", "FEVER", "FATIGUE"]
#: Keywords that occur in the invented prose of the text tables.
KEYWORDS = {"HIGH_INTENSITY_TRAINING": ["thering"], "LATE_SLEEP": ["nder"], "FEVER": ["tionth"], "ILLNESS": ["thly"], "STRESS": ["ouin"], "TRAVEL": ["ethat"]}

#: All phrases of the rules, and those of the invented prose.
WORDS = {kind: [*words, *KEYWORDS.get(kind, [])] for kind, words in CONTEXT_KEYWORDS.items()}


def _values(spark: SparkSession, d: str) -> DataFrame:
    return features.point_daily(point_facts(spark, d)).withColumn("value", F.col("mean"))


def _baselines(spark: SparkSession, d: str) -> DataFrame:
    return baseline.rolling_baselines(_values(spark, d))


def _deviations(spark: SparkSession, d: str) -> DataFrame:
    daily = _values(spark, d)
    return analytics.deviations(daily, baseline.rolling_baselines(daily))


def _metric_name() -> F.Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in METRICS.items() for x in kv)), F.col("metric"))


def _contexts(spark: SparkSession, d: str) -> DataFrame:
    """subject, day, contexts: what the sign-ups of a subject's day stand for."""
    kinds = F.get(F.array(*map(F.lit, CONTEXTS)), (F.col("k") % 5).cast("int"))
    return (
        point_facts(spark, d).where("metric = 'signup'").groupBy(F.col("source_sid").alias("subject"), F.col("local_date").alias("day"))
        .agg(F.sort_array(F.collect_set(kinds)).alias("contexts"))
    )


def _days(spark: SparkSession, d: str) -> DataFrame:
    """subject, day with signals, contexts, overall state, candidates, confidence: the reasoning of each
    day on the 28-day window, and on persistence (all windows), change points and trends as of the day.

    Daily values and deviations are used several times and are small beside the events: each is worked
    out once and written."""
    daily = stash(_values(spark, d).select(*features.SERIES, "local_date", "value"), "daily")
    devs = stash(analytics.deviations(daily, baseline.rolling_baselines(daily)), "deviations")
    recent = devs.where("window_days = 28").select(
        F.col("source_sid").alias("subject"), F.col("local_date").alias("day"), _metric_name().alias("metric"), "deviation_class"
    )
    of_day = lambda df, kind: df.select(F.col("source_sid").alias("subject"), F.col("as_of").alias("day"), kind)
    told = reasoning.signals(recent, ["subject", "day"]).join(_contexts(spark, d), ["subject", "day"], "left").withColumn(
        "contexts", F.coalesce("contexts", F.array().cast("array<string>"))
    )
    folded = reasoning.with_analytics(
        told, of_day(analytics.persistence(devs, rolling=True), "persistence_class"), of_day(analytics.change_points(daily, features.SERIES, rolling=True), "change_class"),
        of_day(analytics.trends(daily, features.SERIES, rolling=True), "trend_class"), ["subject", "day"],
    )
    state = reasoning.overall_state(F.col("known"), F.col("above"), F.col("below"), F.col("persistent"), F.col("changed"), F.col("trending"))
    named = folded.withColumn("overall_state", state)
    named = named.withColumn("candidates", reasoning.candidates(F.col("overall_state"), F.col("signals"), F.col("contexts")))
    # The rules know no counter-evidence: it comes from callers that have some.
    confidence = reasoning.base_confidence(
        F.size(F.get("candidates", F.lit(0))["supporting"]), F.lit(0), F.col("overall_state") == "INSUFFICIENT_EVIDENCE", F.size("contexts") > 0
    )
    return named.withColumns({
        "hypotheses": F.col("candidates.type"), "primary": F.get("candidates", F.lit(0))["type"], "confidence": confidence,
        "symptom": F.array_contains("contexts", "FEVER"),
    })


# --- sources, scalars, features


def point_daily_stats(spark, d):
    return features.point_daily(point_facts(spark, d))


def feature_rows(spark, d):
    long = features.long_features(features.point_daily(point_facts(spark, d)))
    return long.withColumn("base_metric", metric_of(F.col("feature"))).groupBy("feature", "base_metric").agg(
        F.count("*").alias("n"), F.round(F.sum("value_num"), 4).alias("total")
    )


def bucket_daily_sum(spark, d):
    return features.bucket_daily(point_facts(spark, d), ["purchase", "click"])


def daily_passthrough(spark, d):
    return long_series(spark, d)


def local_date_rules(spark, d):
    ts = F.col("ts").cast("timestamp")
    k = F.col("event_id") % 4
    offset = F.when(k == 0, 28800).when(k == 1, -18000)
    zone = F.when(k == 2, "Asia/Tokyo").when(k == 3, "Not/AZone")
    return table(spark, d, "events").select("event_id", local_date(ts, offset, zone, ["Asia/Tokyo", "UTC"]).alias("local_date"))


def source_classes(spark, d):
    return point_facts(spark, d).groupBy("source_sid", "source_class").agg(F.count("*").alias("n"))


def json_normalise(spark, d):
    raw = table(spark, d, "events").select(
        F.col("event_id").alias("id"), "ts",
        F.when(F.col("event_id") % 50 == 0, F.lit('{"k": "x"}')).when(F.col("event_id") % 51 == 0, F.lit("{}")).otherwise(F.col("props")).alias("body"),
        (F.unix_seconds(F.col("ts").cast("timestamp")) + F.when(F.col("event_id") % 53 == 0, 1).otherwise(0)).alias("raw_time"),
    )
    return quality.normalise_points(raw).groupBy("issue").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


def bucket_invariant(spark, d):
    buckets = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("a"),
        (F.col("l_quantity") * 0.04 + F.when(F.col("l_orderkey") % 97 == 0, 0.001).otherwise(0.0)).alias("b"),
    )
    return quality.invariant_violations(buckets, 0.04).select("l_orderkey", "l_linenumber")


def interval_segments(spark, d):
    item = F.struct(
        F.lit(0).cast("bigint").alias("start"), (F.col("l_quantity").cast("bigint") - F.when(F.col("l_orderkey") % 40 == 0, 60).otherwise(1)).alias("end"),
        F.col("l_returnflag").alias("state"), F.col("l_linenumber").alias("n"),
    )
    eps = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(F.struct(item["n"].alias("n"), item["start"].alias("start"), item["end"].alias("end"), item["state"].alias("state")))).alias("items"))
    facts = quality.interval_facts(eps, {"A": "AWAKE", "N": "SLEEP"})
    return facts.groupBy("stage", "issue").agg(F.count("*").alias("n"), F.sum("seconds").alias("seconds"))


def episode_segments(spark, d):
    return features.episode_features(episodes(spark, d), segments(spark, d), "A")


def stage_share(spark, d):
    return features.stage_shares(segments(spark, d))


def series_catalog(spark, d):
    daily = features.point_daily(point_facts(spark, d)).withColumn("coverage_status", F.when(F.col("n") > 1, "COMPLETE").otherwise("OBSERVED_ONLY"))
    return features.series_catalog(daily)


def fact_union(spark, d):
    points = point_facts(spark, d).select("fact_id", F.lit("POINT").alias("kind"), "local_date", "value")
    intervals = episodes(spark, d).select(F.col("episode_id").alias("fact_id"), F.lit("INTERVAL").alias("kind"), "local_date")
    return points.unionByName(intervals, allowMissingColumns=True).groupBy("kind", "local_date").agg(
        F.count("*").alias("n"), F.count("value").alias("valued")
    )


# --- baselines and analytics


def baseline_rolling(spark, d):
    return _baselines(spark, d)


def maturity_summary(spark, d):
    return _baselines(spark, d).groupBy("window_days", "maturity").agg(F.count("*").alias("n"))


def deviation(spark, d):
    return _deviations(spark, d)


def persistence(spark, d):
    return analytics.persistence(_deviations(spark, d))


def trend_theil_sen(spark, d):
    return analytics.trends(long_series(spark, d), ["series"])


def change_point(spark, d):
    return analytics.change_points(_values(spark, d), features.SERIES)


def relationship(spark, d):
    return analytics.relationships(_values(spark, d), PAIRS, ["source_class", "source_sid", "offset_seconds"])


# --- ingestion


def observation_classify(spark, d):
    return ingest.classify(observation_log(spark, d)).select("seq", "classification")


def record_versions(spark, d):
    return ingest.versions(ingest.classify(observation_log(spark, d)))


def latest_version(spark, d):
    return ingest.latest_versions(ingest.versions(ingest.classify(observation_log(spark, d))))


def _captured(spark, d):
    """The log in captures of a week."""
    log = ingest.classify(observation_log(spark, d))
    return log.withColumn("capture", F.expr("cast(seq % 4 as int)"))


def late_arrival(spark, d):
    log = _captured(spark, d)
    scopes = log.groupBy("metric", "capture").agg(F.min("ts").alias("starts"), F.max("ts").alias("ends"))
    return ingest.late_arrivals(scopes, log).groupBy("metric", "capture").agg(F.count("*").alias("n"), F.count_if("late").alias("late"))


def capture_compare(spark, d):
    """Two captures that overlap in the middle third of the days: the first ends with it, the second
    begins with it."""
    log = observation_log(spark, d)
    days = log.agg(F.min("day").alias("_from"), F.datediff(F.max("day"), F.min("day")).alias("_span"))
    placed = log.crossJoin(F.broadcast(days))  # one row
    last = lambda df: df.groupBy("metric", "logical").agg(F.max_by("payload", "seq").alias("payload"))
    first = placed.where(F.datediff("day", "_from") <= F.expr("_span * 2 div 3"))
    second = placed.where(F.datediff("day", "_from") >= F.expr("_span div 3"))
    return ingest.compare_captures(last(first), last(second))


def overlap_audit(spark, d):
    """Each capture against the one before, over the days that both have."""
    log = observation_log(spark, d).withColumn("capture", F.datediff("day", F.lit("2024-01-01").cast("date")).cast("int"))
    said = log.select("metric", F.concat_ws("|", "user_id", "metric").alias("who"), "payload", "capture", "seq").groupBy("metric", "who", "capture").agg(F.max_by("payload", "seq").alias("payload"))
    w = Window.partitionBy("who").orderBy("capture")
    before = said.withColumn("was", F.when(F.lag("capture").over(w) == F.col("capture") - 1, F.lag("payload").over(w)))
    return before.groupBy("capture").agg(
        F.count("*").alias("records"), F.count("was").alias("shared"), F.count_if(F.col("was") != F.col("payload")).alias("revised")
    )


def version_audit(spark, d):
    return ingest.version_audit(ingest.classify(observation_log(spark, d)))


def exact_duplicates(spark, d):
    return ingest.exact_duplicates(observation_log(spark, d), ["logical", "payload"])


def sampling_gap(spark, d):
    return ingest.sampling_gaps(point_facts(spark, d))


# --- quality


def _assessed(spark, d):
    facts = point_facts(spark, d).select(
        "fact_id", "metric", F.when(F.col("fact_id") % 3 == 0, "INTERVAL").otherwise("POINT").alias("kind"), F.col("ts").alias("starts"),
        F.when(F.col("fact_id") % 6 == 0, F.timestamp_add("MINUTE", F.lit(5), "ts")).alias("ends"),
        F.when(F.col("fact_id") % 2 == 0, "VENDOR_DERIVED").otherwise("SENSOR_DERIVED").alias("evidence"),
    )
    # Sign-ups come without a source record.
    return facts, quality.assess(facts, facts.where("metric <> 'signup'").select("fact_id"))


def quality_assess(spark, d):
    return _assessed(spark, d)[1]


def quality_anti_join(spark, d):
    facts, found = _assessed(spark, d)
    return quality.eligible(facts, found).select("fact_id", "kind")


def provenance_counts(spark, d):
    people, orders = table(spark, d, "customer"), table(spark, d, "orders")
    return people.join(orders, people.c_custkey == orders.o_custkey, "left").groupBy("c_custkey").agg(F.count("o_custkey").alias("links"))


def source_resolution(spark, d):
    facts = point_facts(spark, d).select(
        "metric", F.date_trunc("hour", "ts").alias("hour"), "source_class", F.floor(F.col("value") / 40).alias("value"),
        F.lit(None).cast("string").alias("code"), F.lit("count").alias("unit"),
    )
    return quality.resolve_sources(facts, ["metric", "hour"])


# --- reconciliation


def _states(spark, d):
    """Two states of daily inputs: before, and after some were added, removed and changed."""
    daily = features.point_daily(point_facts(spark, d)).select(
        F.concat_ws("|", "metric", "source_sid", F.col("local_date").cast("string")).alias("id"), "metric", "source_sid", "local_date", "n", "mean"
    )
    sig = reconcile.signature("n", "mean")
    day = F.dayofmonth("local_date")
    return (
        daily.where(day != 20).withColumn("sig", sig).select("id", "local_date", "sig"),
        daily.where((day != 12) | (F.col("metric") != "click")).withColumn("n", F.col("n") + F.when((day == 15) & (F.col("source_sid") == "4"), 1).otherwise(0)).withColumn("sig", sig).select("id", "local_date", "sig"),
    )


def reconcile_delta(spark, d):
    return reconcile.delta(*_states(spark, d), ["id"])


def reconcile_apply(spark, d):
    before, now = _states(spark, d)
    history = before.select("id", "sig").withColumn("status", F.lit("CURRENT"))
    return reconcile.apply_delta(history, now.select("id", "sig"), ["id"]).groupBy("status").agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"))


def set_difference(spark, d):
    """What clicks say of a user more often than views do: the operator compares two of the tables that
    the kinds of events stand for."""
    log = observation_log(spark, d)
    a, b = (log.where(F.col("metric") == m).select("user_id", "payload") for m in ("click", "view"))
    return a.exceptAll(b).groupBy("user_id", "payload").agg(F.count("*").alias("n"))


def dirty_dates(spark, d):
    return reconcile.dirty_dates(*_states(spark, d))


def affected_region(spark, d):
    before, now = _states(spark, d)
    return reconcile.affected_region(reconcile.dirty_dates(before, now), before, now)


def _keyed(spark, d):
    """Values by key, and newer ones of which some keys are known and some are new."""
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))
    return known, table(spark, d, "part").select((F.col("p_partkey") * 2).alias("key"), F.col("p_brand").alias("value"))


def latest_upsert(spark, d):
    return reconcile.upsert(*_keyed(spark, d), ["key"])


def insert_ignore(spark, d):
    return reconcile.insert_or_ignore(*_keyed(spark, d), ["key"])


def semantic_digest(spark, d):
    return reconcile.digest(observation_log(spark, d), ["seq", "logical", "payload"])


# --- reasoning


def context_extract(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text")
    return reasoning.extract_contexts(turns, F.lit("2024-01-15").cast("date"), WORDS).select("conv_id", "turn", "context_type", "context_date", "body_part")


def signal_set(spark, d):
    return _days(spark, d).select("subject", "day", F.array_join("signals", ",").alias("signals"), "above", "below")


def overall_state(spark, d):
    return _days(spark, d).select("subject", "day", "overall_state")


def hypothesis_candidates(spark, d):
    return _days(spark, d).select("subject", "day", F.array_join("hypotheses", ",").alias("hypotheses"))


def base_confidence(spark, d):
    capped = reasoning.cap_confidence(F.col("confidence"), F.when(F.dayofmonth("day") % 2 == 0, "LOW").otherwise("HIGH"))
    return _days(spark, d).select("subject", "day", "confidence", capped.alias("capped"))


def medical_trigger(spark, d):
    question = F.when(F.dayofmonth("day") % 5 == 0, "should I see a Doctor")
    reasons = reasoning.review_reasons(F.col("contexts"), F.col("hypotheses"), F.col("persistent"), question)
    return _days(spark, d).select("subject", "day", F.array_join(reasons, ",").alias("reasons"), F.when(F.size(reasons) > 0, "REQUIRED").otherwise("BYPASSED").alias("review"))


def evidence_latest(spark, d):
    last = reasoning.latest_evidence(_deviations(spark, d), ["metric", "source_sid"])
    return last.select("metric", "source_sid", "local_date", "window_days", "deviation_class")


def similar_cases(spark, d):
    """For each day the earlier days of the subject with the same hypothesis, at most the last ten."""
    days = _days(spark, d).select("subject", "day", "primary")
    w = Window.partitionBy("subject", "primary").orderBy("day").rowsBetween(-DEFAULT.similar_cases, -1)
    found = F.collect_list("day").over(w)
    return days.select("subject", "day", "primary", F.size(found).cast("bigint").alias("cases"), F.array_max(found).alias("last_case"))


def _evidence_days(spark, d):
    return _deviations(spark, d).where("window_days = 28").select(
        F.col("source_sid").alias("subject"), F.col("local_date").alias("day"), _metric_name().alias("metric"), "deviation_class", "maturity", F.abs("robust_z").alias("distance")
    )


def evidence_bundle(spark, d):
    made = evidence.bundles(_evidence_days(spark, d), _contexts(spark, d), ["subject"])
    return made.select(
        "subject", "day", F.size("deviations").cast("bigint").alias("deviations"), "established", "provisional", "insufficient_history",
        F.array_join("recent_context", ",").alias("recent_context"), F.array_join("missing", ",").alias("missing"),
    )


def bundle_changes(spark, d):
    """Days of a subject whose bundle differs from that of its day before."""
    made = evidence.bundles(_evidence_days(spark, d), _contexts(spark, d), ["subject"])
    before = F.lag("bundle_hash").over(Window.partitionBy("subject").orderBy("day"))
    return made.withColumn("same", F.col("bundle_hash") == before).groupBy("subject").agg(F.count("*").alias("days"), F.count_if("same").alias("unchanged"))


def evidence_sentences(spark, d):
    return evidence.sentences(_evidence_days(spark, d), ["subject", "day"]).select("subject", "day", F.array_join("sentences", "; ").alias("sentences"))


def retired_baselines(spark, d):
    daily = _values(spark, d)
    return evidence.retire(_baselines(spark, d), daily.where("metric <> 'error'"), ["metric", "source_sid"]).groupBy("metric", "window_days").agg(F.count("*").alias("n"))


def context_corrections(spark, d):
    """Sign-ups as contexts: those of small values are corrected, those of large ones deleted."""
    signups = table(spark, d, "events").where("event_type = 'signup'")
    history = signups.select(F.col("event_id").alias("id"), F.lit("STRESS").alias("context_type"), F.when(F.col("event_id") % 3 == 0, "SUPERSEDED").otherwise("CURRENT").alias("status"))
    changes = signups.where("value < 20 or value > 60").select(F.col("event_id").alias("id"), F.when(F.col("value") < 20, "FATIGUE").alias("context_type"))
    return evidence.correct_context(history, changes).groupBy("context_type", "status").agg(F.count("*").alias("n"), F.count("revises").alias("revisions"))


def change_gates(spark, d):
    e = table(spark, d, "events").where("event_type <> 'signup'")  # sign-ups are new
    text = lambda n: F.md5((F.floor(F.col("event_id") / n)).cast("string"))
    last = e.select(F.col("event_id").alias("key"), text(2).alias("upstream"), text(3).alias("bundle"), text(5).alias("judgment"))
    now = table(spark, d, "events").select((F.col("event_id") + 0).alias("key"), F.md5(F.floor((F.col("event_id") + 1) / 2).cast("string")).alias("upstream"), F.md5(F.floor((F.col("event_id") + 1) / 3).cast("string")).alias("bundle"), F.md5(F.floor((F.col("event_id") + 1) / 5).cast("string")).alias("judgment"))
    return evidence.gates(last, now, "key").groupBy("gate").agg(F.count("*").alias("n"))


# --- product


def product_state(spark, d):
    review = F.when(F.col("symptom"), "REQUIRED").otherwise("BYPASSED")
    state = product.product_state(F.col("overall_state"), F.col("primary"), F.col("confidence"), review, F.lit(False))
    return _days(spark, d).select("subject", "day", state.alias("state"))


def _judgments(spark, d):
    """Daily judgments with some days judged twice."""
    n = F.dayofmonth("day")
    judged = lambda id_, state, status: F.struct(F.lit(id_).alias("id"), state.alias("overall_state"), status.alias("status"))
    first = judged(1, F.col("overall_state"), F.when(n % 3 == 0, "STALE").otherwise("CURRENT"))
    second = F.when(n % 3 == 0, judged(2, F.lit("STABLE"), F.when(n % 2 == 0, "CURRENT").otherwise("STALE")))
    days = _days(spark, d).select("subject", "day", "primary", F.explode(F.array_compact(F.array(first, second))).alias("x"))
    return days.select("x.id", "subject", "day", "x.overall_state", "primary", "x.status")


def _episodes(spark, d):
    return product.episodes(product.canonical_days(_judgments(spark, d)))


def canonical_days(spark, d):
    return product.canonical_days(_judgments(spark, d)).select("subject", "day", "id", "overall_state", "status")


def episode_islands(spark, d):
    return _episodes(spark, d)


def episode_timeline(spark, d):
    events = point_facts(spark, d).where("metric = 'signup'").select(F.col("source_sid").alias("subject"), F.col("local_date").alias("day"), "fact_id")
    return product.timeline(_episodes(spark, d), events).groupBy("subject", "episode_key").agg(F.count("*").alias("events"))


def episode_search(spark, d):
    return _episodes(spark, d).where(F.lower("episode_key").contains("sleep")).select("subject", "episode_key").distinct()


def patterns(spark, d):
    days = _days(spark, d).where((F.size("contexts") > 0) & (F.size("signals") > 0))
    outcomes = days.select(
        F.concat_ws("|", F.col("day").cast("string"), "subject").alias("id"), "day", (F.length("subject") % 2 == 1).alias("confirmed"), F.explode("contexts").alias("trigger"), "signals",
    ).select("id", "day", "confirmed", "trigger", F.explode("signals").alias("signal"))
    return product.patterns(outcomes)


def notification_gate(spark, d):
    e = table(spark, d, "events")
    k = F.col("event_id")
    mode = F.get(F.array(*map(F.lit, ("QUIET", "SMART", "DAILY", "OTHER"))), (k % 4).cast("int"))
    state = F.get(F.array(*map(F.lit, "ABCDE")), (k % 5).cast("int"))
    minute = F.hour("ts") * 60 + F.minute("ts")
    gate = product.notification(mode, state, k % 3 != 0, minute, (22 * 60, 7 * 60))
    return e.select("event_id", gate["decision"].alias("decision"), gate["reason"].alias("reason"))


def context_expiry(spark, d):
    c = _contexts(spark, d).select("subject", "day", F.explode("contexts").alias("context_type"))
    until = product.valid_until(F.col("context_type"), F.col("day"))
    return c.select("subject", "day", "context_type", until.alias("valid_until"), (until < F.lit("2024-01-20").cast("date")).alias("expired"))


def sessions(spark, d):
    turns = table(spark, d, "events").select("user_id", "ts", F.to_date("ts").alias("day"), F.col("event_id").alias("id"))
    slept = table(spark, d, "events").where("event_type = 'view'").select("user_id", F.to_date("ts").alias("day"))
    return product.sessions(turns, slept).groupBy("user_id", "session").agg(F.count("*").alias("turns"), F.min("id").alias("first_id"))


def top_series(spark, d):
    last = last_n(_values(spark, d), DEFAULT.last_series, [F.desc("local_date")], "metric", "source_sid")
    return last.select("metric", "source_sid", "local_date", "mean")


def usage_rollup(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("cost"), F.count_distinct("event_type").alias("kinds"))


def upstream_signature(spark, d):
    e = table(spark, d, "events")
    return e.agg(*(F.max(F.when(F.col("event_type") == k, F.col("event_id"))).alias(f"max_{k}") for k in METRICS), F.coalesce(F.count("*"), F.lit(0)).alias("n"))


def export_user(spark, d):
    return table(spark, d, "orders").where("o_custkey = 7").select("o_orderkey", "o_orderstatus", "o_totalprice")


def scope_guard(spark, d):
    text = F.col("text")
    return table(spark, d, "conversations").select("conv_id", "turn", contains_any(text, [*SCOPE_WORDS, "thering", "nder"]).alias("in_scope"))


# --- checks


def quantile_checks(spark, d):
    return checks.baseline_checks(_baselines(spark, d))


def leak_check(spark, d):
    """The days that each baseline was made from, held against its window, for all windows: none may lie
    on its day or later, none before its window, and their number is the one it states."""
    daily = _values(spark, d)
    return checks.input_audit(baseline.rolling_baselines(daily), baseline.baseline_inputs(daily), features.SERIES)


def duplicate_keys(spark, d):
    return checks.duplicates(observation_log(spark, d), ["logical"])


def orphan_check(spark, d):
    events = table(spark, d, "events").select(F.col("user_id").alias("s_suppkey"), "event_id")
    return checks.orphans(events, table(spark, d, "supplier"), "s_suppkey")


def forbidden_words(spark, d):
    named = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.when(F.col("p_partkey") % 4 == 0, "Score")).alias("label"))
    return checks.forbidden(named, "label").select("p_partkey")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        point_daily_stats, feature_rows, bucket_daily_sum, daily_passthrough, local_date_rules, source_classes, json_normalise, bucket_invariant,
        interval_segments, episode_segments, stage_share, series_catalog, fact_union, baseline_rolling, maturity_summary, deviation, persistence,
        trend_theil_sen, change_point, relationship, observation_classify, record_versions, latest_version, late_arrival, capture_compare, overlap_audit,
        version_audit, exact_duplicates, sampling_gap, quality_assess, quality_anti_join, provenance_counts, source_resolution, reconcile_delta,
        reconcile_apply, set_difference, dirty_dates, affected_region, latest_upsert, insert_ignore, semantic_digest, context_extract, signal_set,
        overall_state, hypothesis_candidates, base_confidence, medical_trigger, evidence_latest, similar_cases, evidence_bundle, bundle_changes, evidence_sentences, retired_baselines,
        context_corrections, change_gates, product_state, canonical_days,
        episode_islands, episode_timeline, episode_search, patterns, notification_gate, context_expiry, sessions, top_series, usage_rollup,
        upstream_signature, export_user, scope_guard, quantile_checks, leak_check, duplicate_keys, orphan_check, forbidden_words,
    )
}
