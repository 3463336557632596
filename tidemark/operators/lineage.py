"""What follows from what: provenance links over all layers, and the cascade of a retirement.

A link says that a row of one layer was made from a row of another. A retirement goes over the links
frontier by frontier: what is reached in a round is the frontier of the next, until nothing new is. A
round reads only the links that begin in the layers of its frontier.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stash
from .baseline import baseline_inputs
from .features import SERIES

LINKS = "parent_layer string, parent_id string, layer string, id string"


def row_id(*parts: str | Column) -> Column:
    """The id of a row in its layer: its keys as text."""
    return F.concat_ws("|", *(F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("-")) for p in parts))


def link(df: DataFrame, parent_layer: str, parent: Column, layer: str, child: Column) -> DataFrame:
    return df.select(F.lit(parent_layer).alias("parent_layer"), parent.alias("parent_id"), F.lit(layer).alias("layer"), child.alias("id"))


def analytics_links(facts: DataFrame, features: DataFrame, devs: DataFrame, keys: list[str] | None = None, source: str = "source_sid", window: int = 28) -> DataFrame:
    """The links of sources, facts(fact_id, keys, local_date), features(keys, local_date, value), their
    baselines, devs(keys, local_date, window_days) and the bundles (source and day) that hold those of
    one window."""
    keys = keys or SERIES
    fact, feature = F.col("fact_id").cast("string"), row_id(*keys, "local_date")
    baseline, deviation = row_id(*keys, "window_days", "as_of"), row_id(*keys, "window_days", "local_date")
    parts = [
        link(facts, "SOURCE", F.col(source).cast("string"), "FACT", fact),
        link(facts.join(features.select(*keys, "local_date"), [*keys, "local_date"], "left_semi"), "FACT", fact, "FEATURE", feature),
        link(baseline_inputs(features, keys), "FEATURE", feature, "BASELINE", baseline),
        link(devs, "FEATURE", feature, "DEVIATION", deviation),
        link(devs, "BASELINE", row_id(*keys, "window_days", "local_date"), "DEVIATION", deviation),
        link(devs.where(F.col("window_days") == window), "DEVIATION", deviation, "BUNDLE", row_id(source, "local_date")),
    ]
    return reduce(DataFrame.unionByName, parts)


def cascade(links: DataFrame, retired: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """layer, id, step of every row that is made, through any number of links, from one of
    retired(layer, id), these with step 0; step: the least number of links. Cycles end, as a row is
    reached once. links(parent_layer, parent_id, layer, id) and what is reached are written to the
    shared folder once; ids that are null are in no link.
    """
    links = stash(links.where("parent_id is not null and id is not null").distinct(), "links")
    frontier = stash(retired.select("layer", "id").distinct().withColumn("step", F.lit(0)), "stale-0")
    reached = frontier
    for step in range(1, most_rounds + 1):
        layers = [r.layer for r in frontier.select("layer").distinct().collect()]  # a handful
        if not layers:
            return reached
        parents = frontier.select(F.col("layer").alias("parent_layer"), F.col("id").alias("parent_id"))
        next_ = links.where(F.col("parent_layer").isin(layers)).join(parents, ["parent_layer", "parent_id"], "left_semi").select("layer", "id").distinct()
        frontier = stash(next_.join(reached, ["layer", "id"], "left_anti").withColumn("step", F.lit(step)), f"stale-{step}")
        reached = reached.unionByName(frontier)
    raise ValueError(f"more than {most_rounds} rounds")


def retire_rows(rows: DataFrame, stale: DataFrame, layer: str, row: Column) -> DataFrame:
    """rows(..., status) of a layer after a cascade: those that it has reached and that are CURRENT are
    STALE. row: the id of a row, as in the links."""
    hit = stale.where(F.col("layer") == layer).select(F.col("id").alias("_id"), F.lit(True).alias("_hit"))
    marked = rows.withColumn("_id", row).join(hit, "_id", "left")
    status = F.when(F.coalesce("_hit", F.lit(False)) & (F.col("status") == "CURRENT"), "STALE").otherwise(F.col("status"))
    return marked.withColumn("status", status).select(*rows.columns)
