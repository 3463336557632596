"""Rule-based reasoning over the analytics of a subject's day: contexts, signals, states, hypotheses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import contains_any
from ..params import BODY_PARTS, CONFIDENCE, CONTEXT_KEYWORDS, OUTPUT_KEYS, PAST_KEYWORDS, REVIEW_WORDS, SYMPTOMS


def extract_contexts(texts: DataFrame, today: Column, keywords: dict[str, list[str]] | None = None) -> DataFrame:
    """All columns of texts, and context_type, context_date, body_part for each context that its
    `text` names. Phrases are looked for anywhere in the lower-cased text. A general illness gives
    way to a particular symptom; a phrase for the day before moves all contexts of the text."""
    keywords = keywords or CONTEXT_KEYWORDS
    text = F.col("text")
    found = F.array_compact(F.array(*(F.when(contains_any(text, words), F.lit(kind)) for kind, words in keywords.items())))
    part = F.coalesce(*(F.when(F.lower(text).contains(k), F.lit(v)) for k, v in BODY_PARTS.items()))
    day = F.when(contains_any(text, PAST_KEYWORDS), F.date_sub(today, 1)).otherwise(today)
    general = F.arrays_overlap("_found", F.array(*map(F.lit, ("FEVER", "SORE_THROAT", "NASAL_CONGESTION"))))
    kept = F.when(general, F.array_remove("_found", "ILLNESS")).otherwise(F.col("_found"))
    return (
        texts.where(text.isNotNull()).withColumn("_found", found).withColumns({"context_date": day, "_part": part})
        .select(*texts.columns, "context_date", "_part", F.explode(kept).alias("context_type"))
        .withColumn("body_part", F.when(F.col("context_type") == "HIGH_INTENSITY_TRAINING", F.col("_part"))).drop("_part")
    )


def signals(devs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, signals (sorted), above, below, known for devs(keys, metric, deviation_class)."""
    up, down = F.col("deviation_class") == "ABOVE_TYPICAL_RANGE", F.col("deviation_class") == "BELOW_TYPICAL_RANGE"
    name = F.when(up, F.concat("metric", F.lit("_UP"))).when(down, F.concat("metric", F.lit("_DOWN")))
    return devs.groupBy(*keys).agg(
        F.sort_array(F.collect_set(name)).alias("signals"), F.count_if(up).alias("above"), F.count_if(down).alias("below"),
        F.count_if(F.col("deviation_class") != "INSUFFICIENT_BASELINE").alias("known"), F.count("*").alias("deviations"),
    )


def with_analytics(days: DataFrame, persistent: DataFrame, changed: DataFrame, trending: DataFrame, keys: list[str]) -> DataFrame:
    """days(keys, signals) with the flags persistent, changed, trending of the analytics as of the same
    day (keys, and their class), and the signals PERSISTENT_HIGH and PERSISTENT_LOW."""
    kind = F.col("persistence_class")
    # All three are flags of a key: told as one table, they are dealt and joined once.
    runs = persistent.select(*keys, (kind == "PERSISTENT_ABOVE_TYPICAL").alias("_high"), (kind == "PERSISTENT_BELOW_TYPICAL").alias("_low"))
    steps = changed.select(*keys, (F.col("change_class") == "CHANGE_DETECTED").alias("changed"))
    slopes = trending.select(*keys, F.col("trend_class").isin("RISING", "FALLING").alias("trending"))
    flags = runs.unionByName(steps, allowMissingColumns=True).unionByName(slopes, allowMissingColumns=True)
    folded = flags.groupBy(*keys).agg(*(F.bool_or(c).alias(c) for c in ("_high", "_low", "changed", "trending")))
    joined = days.join(folded, keys, "left")
    more = F.array_compact(F.array(F.when(F.col("_high"), "PERSISTENT_HIGH"), F.when(F.col("_low"), "PERSISTENT_LOW")))
    return joined.withColumns({
        "signals": F.array_sort(F.concat("signals", more)), "persistent": F.coalesce(F.col("_high") | F.col("_low"), F.lit(False)),
        "changed": F.coalesce("changed", F.lit(False)), "trending": F.coalesce("trending", F.lit(False)),
    }).drop("_high", "_low")


def overall_state(known: Column, above: Column, below: Column, persistent: Column, changed: Column, trending: Column) -> Column:
    return (
        F.when(known == 0, "INSUFFICIENT_EVIDENCE").when(persistent | changed | (above >= 2) | (below >= 2), "NOTABLE_CHANGE")
        .when((above > 0) | (below > 0) | trending, "MILD_CHANGE").otherwise("STABLE")
    )


def candidates(state: Column, signal: Column, contexts: Column) -> Column:
    """array<struct<type, supporting>> of the hypotheses whose rules hold, in the order of the rules,
    with the evidence for each; with none, what the state says."""
    has = lambda s: F.array_contains(signal, s)
    told = lambda c: F.array_contains(contexts, c)
    heart = has("resting_heart_rate_UP") | has("heart_rate_UP")
    stress = has("stress_score_UP")
    up = F.filter(signal, lambda s: s.contains("UP"))
    some = lambda *parts: F.array_sort(F.array_distinct(F.array_compact(F.array(*parts))))
    late = F.when(F.size(up) > 0, up).when(told("FATIGUE"), F.array(F.lit("FATIGUE"))).otherwise(F.array(F.lit("stress_score_UP")))
    symptoms = F.array_sort(F.array_intersect(contexts, F.array(*map(F.lit, SYMPTOMS))))
    case = lambda when, kind, why: F.when(when, F.struct(F.lit(kind).alias("type"), why.alias("supporting")))
    found = F.array_compact(F.array(
        case(heart & told("HIGH_INTENSITY_TRAINING"), "RECOVERY_STRAIN", F.array_sort(F.array_distinct(F.concat(up, F.array(F.lit("HIGH_INTENSITY_TRAINING")))))),
        F.coalesce(
            case(has("sleep_DOWN"), "SLEEP_DEFICIT", some(F.lit("sleep_like_duration_below_typical"), F.when(told("LATE_SLEEP"), "LATE_SLEEP"))),
            case(told("LATE_SLEEP") & (stress | heart | told("FATIGUE")), "SLEEP_DEFICIT", F.array_sort(F.array_distinct(F.concat(F.array(F.lit("LATE_SLEEP")), late)))),
        ),
        case(stress & (told("STRESS") | heart), "STRESS_RESPONSE", some(F.lit("stress_score_UP"), F.when(told("STRESS"), "STRESS"), F.when(heart, "heart_rate_UP"))),
        case(F.size(symptoms) > 0, "ACUTE_ILLNESS_SUSPECTED", F.concat(symptoms, F.when(heart, F.array(F.lit("heart_rate_UP"))).otherwise(F.array().cast("array<string>")))),
    ))
    none = F.array(
        F.when(state == "STABLE", F.struct(F.lit("NO_SIGNIFICANT_FINDING").alias("type"), F.array(F.lit("overall_state_STABLE")).alias("supporting")))
        .otherwise(F.struct(F.lit("UNKNOWN").alias("type"), F.array(F.lit("insufficient_distinguishing_evidence")).alias("supporting")))
    )
    return F.when(F.size(found) > 0, found).otherwise(none)


def base_confidence(support: Column, counter: Column, insufficient: Column, context: Column) -> Column:
    return (
        F.when(counter > support, "VERY_LOW").when(counter > 0, "LOW").when(insufficient & ~context & (support < 2), "VERY_LOW")
        .when(support >= 3, "HIGH").when(support >= 2, "MODERATE").when((support >= 1) | context, "LOW").otherwise("VERY_LOW")
    )


def cap_confidence(base: Column, proposed: Column) -> Column:
    """A proposal may lower the confidence, never raise it."""
    ladder = F.array(*map(F.lit, CONFIDENCE))
    level = lambda c: F.array_position(ladder, c)
    return F.when((level(proposed) > 0) & (level(proposed) < level(base)), proposed).otherwise(base)


def review_reasons(contexts: Column, hypothesis: Column, persistent: Column, question: Column) -> Column:
    """Why a review is needed, sorted; empty: it is not."""
    return F.array_sort(F.array_compact(F.array(
        F.when(F.arrays_overlap(contexts, F.array(*map(F.lit, SYMPTOMS))), "user_reported_symptom"),
        F.when(F.array_contains(hypothesis, "ACUTE_ILLNESS_SUSPECTED"), "high_risk_hypothesis"),
        F.when(persistent, "persistent_notable_anomaly"),
        F.when(question.isNotNull() & contains_any(question, REVIEW_WORDS), "disease_or_doctor_question"),
    )))


def latest_evidence(devs: DataFrame, keys: list[str]) -> DataFrame:
    """The last deviation of each feature and source."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("local_date"), "window_days"))
    return devs.withColumn("_n", last).where("_n = 1").drop("_n")


def asserted(text: Column, marker: str, hedges: list[str], reach: int = 50) -> Column:
    """Whether a text asserts a marker (an ASCII word): one stands without a hedging phrase within
    `reach` characters on either side."""
    pieces = F.split(F.lower(text), rf"\b{marker}\b", -1)

    def free(i: Column) -> Column:
        """Whether the marker after piece i stands without a hedge."""
        before = F.right(F.array_join(F.slice(pieces, F.lit(1), i), marker), F.lit(reach))
        after = F.left(F.array_join(F.slice(pieces, i + 1, F.size(pieces)), marker), F.lit(reach))
        return ~F.exists(F.array(*map(F.lit, hedges)), lambda h: F.contains(before, h) | F.contains(after, h))

    return (F.size(pieces) > 1) & F.exists(F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1))), free)


def output_problems(output: Column, allowed: Column | None = None) -> Column:
    """What is wrong with a model's answer (JSON text), as an array; empty: nothing. allowed: the
    hypothesis types that the rules have found."""
    whole = F.try_parse_json(output)
    kind = F.schema_of_variant(whole)
    field = lambda name: F.get_json_object(output, f"$.{name}")
    actions = F.coalesce(F.schema_of_variant(F.try_variant_get(whole, "$.recommended_actions", "variant")), F.lit("VOID"))
    said = F.coalesce(field("primary_hypothesis_type"), F.lit(""))
    return F.when(whole.isNull() | ~kind.startswith("OBJECT"), F.array(F.lit("not_an_object"))).otherwise(F.array_compact(F.array(
        *(F.when(field(k).isNull(), F.lit(f"missing_{k}")) for k in OUTPUT_KEYS),
        *([F.when(~F.array_contains(allowed, said), F.lit("invalid_primary"))] if allowed is not None else []),
        F.when(~actions.startswith("ARRAY"), "actions_not_a_list"),
        F.when(~F.coalesce(field("confidence"), F.lit("")).isin(*CONFIDENCE), "invalid_confidence"),
    )))


def normalised_output(output: Column) -> Column:
    """The object in a model's answer: from its first brace to its last one, without the text around."""
    return F.nullif(F.regexp_extract(output, r"(?s)\{.*\}", 0), F.lit(""))
