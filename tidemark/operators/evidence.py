"""Evidence bundles, what is rendered from them, and when anything is rendered anew."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULT, SYMPTOMS, Params
from ..sources.scratch import stash
from .reconcile import signature

# What a deviation is called in a sentence.
PHRASES = {"ABOVE_TYPICAL_RANGE": "above the usual range", "BELOW_TYPICAL_RANGE": "below the usual range", "WITHIN_TYPICAL_RANGE": "within the usual range"}
# Feedback verdicts and the status each sets.
VERDICTS = {"accurate": "CONFIRMED", "inaccurate": "REJECTED", "partly": "CORRECTED", "准确": "CONFIRMED", "不太准确": "REJECTED", "补充情况": "CORRECTED"}


def bundles(devs: DataFrame, contexts: DataFrame, keys: list[str], params: Params = DEFAULT) -> DataFrame:
    """One evidence bundle a subject and day: deviations in order, the maturity histogram, recent
    contexts (the last ones up to that day, whatever their age), what is missing, and a content hash.
    devs(keys, day, metric, deviation_class, maturity); contexts(keys, day, contexts)."""
    folded = devs.groupBy(*keys, "day").agg(
        F.array_sort(F.collect_list(F.struct("metric", "deviation_class"))).alias("deviations"),
        *(F.count_if(F.col("maturity") == m).alias(m.lower()) for m in ("ESTABLISHED", "PROVISIONAL", "INSUFFICIENT_HISTORY")),
    )
    # The last contexts as of each day with contexts come from a frame of fixed length; bundle days on
    # the same line then take the last such list, without a range join.
    lately = Window.partitionBy(*keys).orderBy("day").rowsBetween(1 - params.recent_context, 0)
    told = contexts.where(F.size("contexts") > 0).select(
        *keys, "day", F.lit(0).alias("_bundle"), F.slice(F.reverse(F.flatten(F.collect_list("contexts").over(lately))), 1, params.recent_context).alias("recent")
    )
    line = told.unionByName(folded.select(*keys, "day", F.lit(1).alias("_bundle"), F.lit(None).cast("array<string>").alias("recent")))
    last = F.last("recent", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("day", "_bundle").rowsBetween(Window.unboundedPreceding, 0))
    recent = F.coalesce(last, F.array().cast("array<string>"))
    seen = line.withColumn("_last", recent).where("_bundle = 1").select(*keys, "day", F.array_sort(F.array_distinct("_last")).alias("recent_context"))
    joined = folded.join(seen, [*keys, "day"])
    missing = F.array_compact(F.array(
        F.when(F.col("insufficient_history") > 0, "baseline_history"), F.when(F.size("recent_context") == 0, "recent_context"),
    ))
    return joined.withColumn("missing", missing).withColumn("bundle_hash", signature("deviations", "recent_context", "missing"))


def judgment_signature(*visible: str) -> Column:
    """The hash of what a user can see of a judgment."""
    return signature(*visible)


def sentences(devs: DataFrame, keys: list[str], most: int = 6) -> DataFrame:
    """Up to `most` evidence sentences a key: one for each label and class, the farthest first."""
    place = F.row_number().over(Window.partitionBy(*keys, "metric", "deviation_class").orderBy(F.desc_nulls_last("distance")))
    words = F.create_map(*(F.lit(x) for kv in PHRASES.items() for x in kv))
    once = devs.withColumn("_n", place).where("_n = 1").where(F.col("deviation_class").isin(*PHRASES))
    said = F.struct((-F.coalesce("distance", F.lit(0.0))).alias("d"), F.col("metric").alias("m"), F.concat_ws(" ", "metric", F.lit("is"), F.element_at(words, F.col("deviation_class"))).alias("s"))
    return once.groupBy(*keys).agg(F.slice(F.array_sort(F.collect_list(said)), 1, most).alias("x")).select(*keys, F.col("x.s").alias("sentences"))


def today(judgments: DataFrame, sentences_: DataFrame, keys: list[str]) -> DataFrame:
    """What is shown for a key: state, at most three actions (none on a stable day), sentences."""
    actions = F.when(F.col("state") == "A", F.array().cast("array<string>")).otherwise(F.slice("actions", 1, 3))
    return judgments.join(sentences_, keys, "left").select(
        *keys, F.struct("state", "confidence", actions.alias("actions"), F.coalesce("sentences", F.array().cast("array<string>")).alias("sentences")).alias("payload")
    )


def gates(last: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """What to do for each key, last and now holding (key, upstream, bundle, judgment) hashes: UNCHANGED
    (inputs), SAME_EVIDENCE (no model is asked), SAME_JUDGMENT (no new version), NEW_VERSION."""
    joined = now.join(last.select(key, *(F.col(c).alias(f"_{c}") for c in ("upstream", "bundle", "judgment"))), key, "left")
    same = lambda c: F.col(c) == F.col(f"_{c}")
    return joined.select(
        key, F.when(same("upstream"), "UNCHANGED").when(same("bundle"), "SAME_EVIDENCE").when(same("judgment"), "SAME_JUDGMENT").otherwise("NEW_VERSION").alias("gate")
    )


def cached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """requests(request) with a hash and the cached answer for it, if there is one."""
    return requests.withColumn("request_hash", F.sha2("request", 256)).join(cache, "request_hash", "left")


def correct_context(history: DataFrame, changes: DataFrame) -> DataFrame:
    """history(id, context_type, status) after changes(id, context_type), null to delete: the old row
    is SUPERSEDED or DELETED and a correction is a new CURRENT row that names what it revises."""
    joined = history.join(changes.select("id", F.col("context_type").alias("_to"), F.lit(True).alias("_hit")), "id", "left")
    hit = F.coalesce("_hit", F.lit(False)) & (F.col("status") == "CURRENT")
    old = joined.select("id", "context_type", F.when(hit, F.when(F.col("_to").isNull(), "DELETED").otherwise("SUPERSEDED")).otherwise(F.col("status")).alias("status"), F.lit(None).cast("bigint").alias("revises"))
    new = joined.where(hit & F.col("_to").isNotNull()).select(F.lit(None).cast("bigint").alias("id"), F.col("_to").alias("context_type"), F.lit("CURRENT").alias("status"), F.col("id").alias("revises"))
    return old.unionByName(new)


def feedback_status(verdict: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in VERDICTS.items() for x in kv)), F.lower(verdict))


def retire(baselines: DataFrame, series: DataFrame, keys: list[str]) -> DataFrame:
    """Baselines whose series is gone; their rows turn stale with it."""
    return baselines.join(series.select(*keys).distinct(), keys, "left_anti")


def absent_facts(outputs: DataFrame, bundles_: DataFrame, categories: dict[str, list[str]]) -> DataFrame:
    """Categories that an output names and its bundle does not. outputs(id, text), bundles_(id, text)."""
    def named(text: Column) -> Column:
        low = F.lower(text)
        return F.array_compact(F.array(*(F.when(low.rlike(r"\b(" + "|".join(words) + r")\b"), F.lit(k)) for k, words in categories.items())))

    joined = outputs.select("id", named(F.col("text")).alias("said")).join(bundles_.select("id", named(F.col("text")).alias("known")), "id", "left")
    return joined.select("id", F.explode(F.array_except("said", F.coalesce("known", F.array().cast("array<string>")))).alias("category"))


def has_symptom(contexts: Column) -> Column:
    return F.arrays_overlap(contexts, F.array(*map(F.lit, SYMPTOMS)))


def drill_down(shown: DataFrame, values: DataFrame, devs: DataFrame, baselines: DataFrame, keys: list[str], most: int = 28, latest: int = 3) -> DataFrame:
    """For shown(keys, analysis_date, today): how many of the last values and deviations there are, their
    total, and the latest baselines up to the day (as_of/window, latest first)."""
    def last(df: DataFrame, n: int, *order: Column) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return df.withColumn("_n", place).where(F.col("_n") <= n)

    listed = last(shown.join(values.select(*keys, "local_date", "value"), keys), most, F.desc("local_date"))
    total = listed.groupBy(*keys, "analysis_date", "today").agg(F.count("*").alias("shown_values"), F.round(F.sum("value"), 4).alias("total"))
    told = last(shown.select(*keys).join(devs, keys), most, F.desc("local_date"), F.col("window_days"))
    seen = told.groupBy(*keys).agg(F.count("*").alias("shown_deviations"), F.count_if(F.col("deviation_class") == "INSUFFICIENT_BASELINE").alias("without_baseline"))
    known = last(shown.select(*keys, "analysis_date").join(baselines, keys).where("as_of <= analysis_date"), latest, F.desc("as_of"), F.col("window_days"))
    name = F.struct("_n", F.concat_ws("/", F.col("as_of").cast("string"), F.col("window_days").cast("string")).alias("name"))
    base = known.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(name)), lambda x: x["name"]), ",").alias("latest_baselines"))
    return total.join(seen, keys, "left").join(base, keys, "left")


#: What a full bundle says of each series or pair, and the parts in which it says it.
PARTS = {"DEVIATION": "deviations", "PERSISTENCE": "persistence", "TREND": "trends", "CHANGE_POINT": "changes", "RELATIONSHIP": "relationships"}


def full_bundles(said: DataFrame, asks: DataFrame, base: DataFrame, keys: list[str], lookback: int = 7) -> DataFrame:
    """One bundle a row of asks(keys, day): the parts of PARTS, recent deviations, provenance, and what
    base(keys, day, ...) says of it (see bundles), with a hash over all of it but base's own hash.

    said(keys, kind, item, day, finding): what the analytics say of an item (a series or pair) as of a day.
    Each part holds what was last said of every item up to the bundle's day, in the order of items:
    array<struct<item, day, finding>>; a deviation only if it is of the last `lookback` days.
    recent_deviations are all of those days. provenance names every row that went in, with the feature and
    the baseline of each deviation. Of two findings of one item and day the greater one counts.

    What is said is written once. Items of a key are few; the last finding is carried on by one sort by key, kind and item, in which a
    bundle has as many rows as parts to fill.
    """
    once = stash(said.groupBy(*keys, "kind", "item", "day").agg(F.max("finding").alias("finding")), "findings")
    days = asks.select(*keys, "day").distinct()
    filled = once.select(*keys, "kind", "item").distinct().join(days, keys).withColumn("_ask", F.lit(1))
    line = once.withColumn("_ask", F.lit(0)).unionByName(filled, allowMissingColumns=True)
    order = Window.partitionBy(*keys, "kind", "item").orderBy("day", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_ask") == 0, F.struct("day", "finding")), ignorenulls=True).over(order)
    carried = line.withColumn("_last", last).where("_ask = 1 and _last is not null")
    carried = carried.where((F.col("kind") != "DEVIATION") | (F.datediff("day", F.col("_last.day")) <= lookback))
    told = F.struct("item", F.col("_last.day").alias("day"), F.col("_last.finding").alias("finding"))
    parts = carried.groupBy(*keys, "day").agg(*(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, told))).alias(part) for kind, part in PARTS.items()))
    # Lately: the frame holds some days of a few items.
    number = F.datediff("day", F.lit("1970-01-01").cast("date"))
    lately = Window.partitionBy(*keys).orderBy("_day").rangeBetween(-lookback, 0)
    devs = once.where("kind = 'DEVIATION'").withColumn("_day", number)
    seen = devs.unionByName(days.withColumn("_day", number).withColumn("kind", F.lit("ASK")), allowMissingColumns=True)
    recent = seen.withColumn("_seen", F.collect_list(F.when(F.col("kind") == "DEVIATION", F.struct("day", "item", "finding"))).over(lately)).where("kind = 'ASK'")
    recent = recent.select(*keys, "day", F.array_sort("_seen").alias("recent_deviations"))
    joined = days.join(parts, [*keys, "day"], "left").join(recent, [*keys, "day"], "left").join(base, [*keys, "day"], "left")
    none = F.array().cast("array<struct<item: string, day: date, finding: string>>")
    joined = joined.withColumns({part: F.coalesce(part, none) for part in PARTS.values()})
    name = lambda kind: lambda x: F.concat_ws("|", F.lit(kind), x["item"], x["day"].cast("string"))
    rows = [F.transform(part, name(kind)) for kind, part in [*PARTS.items(), ("FEATURE", "deviations"), ("BASELINE", "deviations")]]
    whole = joined.withColumn("provenance", F.array_sort(F.concat(*rows)))
    content = [c for c in whole.columns if c not in (*keys, "bundle_hash")]
    return whole.withColumn("bundle_hash", signature(*content))
