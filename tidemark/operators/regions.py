"""Affected regions, a series at a time: which (series, window, day) cells a change of inputs touches, and
baselines that are renewed in those cells only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..params import DEFAULT, Params
from ..sources.scratch import stash
from .baseline import rolling_baselines
from .features import SERIES


def _same(a: str, b: str, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys))


def merged(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """keys, from_date, to_date: the union of the intervals of each key as disjoint ones, adjacent ones as
    one. One sort of the intervals by key."""
    order = Window.partitionBy(*keys).orderBy("from_date", "to_date")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    opens = F.coalesce(F.col("from_date") > F.date_add(F.max("to_date").over(before), 1), F.lit(True))
    marked = intervals.withColumn("_opens", opens.cast("int")).withColumn("_island", F.sum("_opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_island").agg(F.min("from_date").alias("from_date"), F.max("to_date").alias("to_date")).drop("_island")


def _span(features: DataFrame, a: str, b: str) -> DataFrame:
    """The days that have baselines: one row, nulls without features."""
    return features.agg(F.date_add(F.min("local_date"), 1).alias(a), F.date_add(F.max("local_date"), 1).alias(b))


def dirty_cells(before: DataFrame, now: DataFrame, keys: list[str] | None = None, params: Params = DEFAULT) -> DataFrame:
    """keys, window_days, from_date, to_date: disjoint intervals of the days whose baseline may differ
    between two states of features(keys, local_date, value), within the days of the new state.

    A day whose value came, went or changed touches the baselines of the next W days of its series in the
    window of W days. A new series is touched on all days, and every series on days that the whole table
    did not span before. Series that are gone have no cells. Keys may be null.
    """
    keys = keys or SERIES
    was, has = (df.where("value is not null").select(*keys, "local_date", "value") for df in (before, now))
    both = was.alias("a").join(has.alias("b"), _same("a", "b", keys) & (F.col("a.local_date") == F.col("b.local_date")), "full_outer")
    changed = both.where(~F.col("a.value").eqNullSafe(F.col("b.value"))).select(
        *(F.when(F.col("b.local_date").isNotNull(), F.col(f"b.{k}")).otherwise(F.col(f"a.{k}")).alias(k) for k in keys), F.coalesce("a.local_date", "b.local_date").alias("day")
    )
    windows = F.explode(F.array(*map(F.lit, params.windows))).alias("window_days")
    touched = changed.select("*", windows).select(*keys, "window_days", F.date_add("day", 1).alias("from_date"), F.date_add("day", F.col("window_days")).alias("to_date"))
    ends = _span(was, "_old_from", "_old_to").join(F.broadcast(_span(has, "_from", "_to")))  # one row each
    series = has.select(*keys).distinct().alias("b").join(was.select(*keys).distinct().withColumn("_known", F.lit(True)).alias("a"), _same("a", "b", keys), "left")
    series = series.select(*(F.col(f"b.{k}").alias(k) for k in keys), F.coalesce("a._known", F.lit(False)).alias("_known")).join(F.broadcast(ends))
    part = lambda a, b: F.struct(a.alias("from_date"), b.alias("to_date"))
    whole = F.array(part(F.col("_from"), F.col("_to")))
    rims = F.array(
        part(F.col("_from"), F.least(F.col("_to"), F.date_sub("_old_from", 1))), part(F.greatest(F.col("_from"), F.date_add("_old_to", 1)), F.col("_to"))
    )
    fresh = series.select(*keys, F.explode(F.when(F.col("_known"), rims).otherwise(whole)).alias("x"), windows).select(*keys, "window_days", "x.from_date", "x.to_date")
    within = touched.join(F.broadcast(ends)).select(
        *keys, "window_days", F.greatest("from_date", "_from").alias("from_date"), F.least("to_date", "_to").alias("to_date")
    )
    present = within.alias("a").join(has.select(*keys).distinct().alias("b"), _same("a", "b", keys), "left_semi")
    return merged(present.unionByName(fresh).where("from_date <= to_date"), [*keys, "window_days"])


def cell_days(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, window_days, as_of: the cells one by one. Their number is that of the rows to renew."""
    return cells.select(*keys, "window_days", F.explode(F.sequence("from_date", "to_date", F.expr("interval 1 day"))).alias("as_of"))


def renew_baselines(old: DataFrame, before: DataFrame, now: DataFrame, keys: list[str] | None = None, params: Params = DEFAULT) -> tuple[DataFrame, DataFrame]:
    """The baselines of `now` from those of `before` (old), and the rows among them that were worked out
    anew; both the cells and those rows are written once. Equal to rolling_baselines(now): rows outside of the dirty cells are taken over, those of series
    and days that are gone are left out."""
    keys = keys or SERIES
    cells = stash(dirty_cells(before, now, keys, params), "dirty-cells")
    fresh = stash(rolling_baselines(now, keys, params, cells=cells), "renewed")
    has = now.where("value is not null")
    on = _same("a", "b", keys)
    days = cell_days(cells, keys)
    kept = (
        old.join(F.broadcast(_span(has, "_from", "_to"))).where("as_of between _from and _to").drop("_from", "_to")
        .alias("a").join(has.select(*keys).distinct().alias("b"), on, "left_semi")
        .alias("a").join(days.alias("b"), on & (F.col("a.window_days") == F.col("b.window_days")) & (F.col("a.as_of") == F.col("b.as_of")), "left_anti")
    )
    return kept.unionByName(fresh), fresh
