"""Guards on a model's texts: facts and diagnoses that its evidence does not name, and the form of a review.

A text is searched once for any marker; only what is found is looked at more closely: each marker that
occurs becomes a row with the places where it stands, and a place counts unless a hedging phrase is near.
Markers of a group are one fact: a group that the evidence names in any way is not held against a text.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import DIAGNOSIS_MARKERS, FACT_MARKERS, HEDGES, REVIEW_KEYS, REVIEW_LISTS, REVIEW_STATES

#: (kind, group, markers in order) of all guards.
GROUPS = [*(("FACT", name, words) for name, words in FACT_MARKERS.items()), *(("DIAGNOSIS", words[0], words) for words in DIAGNOSIS_MARKERS)]
#: Characters on either side of a marker in which a hedge takes it back.
REACH = 50


def is_word(marker: str) -> bool:
    """Whether a marker counts as a whole word only; others (of other scripts, or with signs) anywhere."""
    return marker.isascii() and marker.replace(" ", "").isalpha()


def _pattern(marker: str) -> str:
    quoted = re.escape(marker)
    return rf"(?<![\p{{L}}\p{{N}}_]){quoted}(?![\p{{L}}\p{{N}}_])" if is_word(marker) else quoted


def _places(text: Column, pattern: Column, size: Column) -> Column:
    """Where (from 0) the matches of a pattern of fixed length begin: the lengths of the pieces between them."""
    pieces = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found"))

    def step(acc: Column, piece: Column) -> Column:
        at = acc["at"] + F.length(piece)
        return F.struct((at + size).alias("at"), F.concat(acc["found"], F.array(at)).alias("found"))

    return F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), start, step)["found"]


def assertions(texts: DataFrame, keys: list[str], groups: list[tuple[str, str, list[str]]] | None = None, hedges: list[str] | None = None, reach: int = REACH) -> DataFrame:
    """keys, kind, group, marker for each marker that texts(keys, text) assert: of which one place at least
    has no hedge within `reach` characters on either side (or in it). A null text asserts nothing."""
    listed = [(kind, group, i, m) for kind, group, words in groups or GROUPS for i, m in enumerate(words)]
    hedges = HEDGES if hedges is None else hedges
    marker = lambda kind, group, i, m: F.struct(F.lit(kind).alias("kind"), F.lit(group).alias("group"), F.lit(i).alias("nth"), F.lit(m).alias("marker"), F.lit(_pattern(m)).alias("pattern"))
    every = F.array(*(marker(*x) for x in listed))
    any_of = "|".join(sorted({re.escape(m) for *_, m in listed}))
    low = texts.select(*keys, F.lower("text").alias("text")).where(F.col("text").rlike(any_of))
    found = low.select(*keys, "text", F.explode(F.filter(every, lambda m: F.contains(F.col("text"), m["marker"]))).alias("m")).select(*keys, "text", "m.*")
    size = F.length("marker")

    def free(at: Column) -> Column:
        low_ = F.greatest(at - reach, F.lit(0))
        near = F.col("text").substr(low_ + 1, at + size + reach - low_)
        return ~reduce(lambda a, b: a | b, (F.contains(near, F.lit(h)) for h in hedges))

    placed = found.withColumn("places", _places(F.col("text"), F.col("pattern"), size))
    return placed.where(F.exists("places", free)).select(*keys, "kind", "group", "nth", "marker")


def unsupported(outputs: DataFrame, evidence: DataFrame, keys: list[str], groups: list[tuple[str, str, list[str]]] | None = None, hedges: list[str] | None = None) -> DataFrame:
    """keys, kind, group, marker for each group that an output of outputs(keys, text) asserts and its
    evidence(keys, text) does not name: the first of the group's markers that it asserts. Evidence names a
    group where any of its markers occurs in it; an output without evidence has none."""
    groups = groups or GROUPS
    known = F.array_compact(F.array(*(F.when(F.col("_low").rlike("|".join(map(re.escape, words))), F.lit(f"{kind}|{group}")) for kind, group, words in groups)))
    named = evidence.select(*keys, F.lower("text").alias("_low")).select(*keys, F.explode(known).alias("_group")).distinct()
    said = assertions(outputs, keys, groups, hedges).groupBy(*keys, "kind", "group").agg(F.min_by("marker", "nth").alias("marker"))
    return said.withColumn("_group", F.concat_ws("|", "kind", "group")).join(named, [*keys, "_group"], "left_anti").drop("_group")


def review_problems(output: Column) -> Column:
    """What is wrong with a review (JSON text), as an array; empty: nothing."""
    whole = F.try_parse_json(output)
    keys = F.coalesce(F.json_object_keys(output), F.array().cast("array<string>"))
    kind = lambda k: F.coalesce(F.schema_of_variant(F.try_variant_get(whole, f"$.{k}", "variant")), F.lit("VOID"))
    texts = lambda k: F.try_variant_get(whole, f"$.{k}", "array<string>")
    listed = lambda k: kind(k).isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.coalesce(F.exists(texts(k), lambda x: x.isNull()), F.lit(False))
    reason, state = F.get_json_object(output, "$.escalation_reason"), F.coalesce(F.get_json_object(output, "$.review_status"), F.lit(""))
    found = F.array_compact(F.array(
        *(F.when(~F.array_contains(keys, k), F.lit(f"missing_{k}")) for k in REVIEW_KEYS),
        F.when(~state.isin(REVIEW_STATES), "invalid_review_status"),
        *(F.when(~listed(k), F.lit(f"not_texts_{k}")) for k in REVIEW_LISTS),
        F.when(~kind("escalation_reason").isin("STRING", "VOID"), "escalation_reason_not_text"),
        F.when(kind("review_summary") != "STRING", "review_summary_not_text"),
        F.when((state == "ESCALATE") & (F.coalesce(reason, F.lit("")) == ""), "escalation_without_reason"),
    ))
    return F.when(whole.isNull() | ~F.coalesce(F.schema_of_variant(whole), F.lit("")).startswith("OBJECT"), F.array(F.lit("not_an_object"))).otherwise(found)
