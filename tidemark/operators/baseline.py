"""Rolling personal baselines without look-ahead.

The baseline of a series as of day D sees the days D-W to D-1. All windows are range frames over one
shuffle and sort by series: nothing is joined on a range and no observation is copied for the days
it serves. Quantiles are exact (type 7) on the sorted values of a frame.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..params import DEFAULT, Params
from .features import SERIES


def spine(features: DataFrame, keys: list[str]) -> DataFrame:
    """Every series with every day from the day after the first of all to the day after the last."""
    days = features.agg(F.min("local_date").alias("_from"), F.max("local_date").alias("_to"))
    series = features.select(*keys).distinct()
    return series.join(F.broadcast(days)).select(
        *keys, F.explode(F.sequence(F.date_add("_from", 1), F.date_add("_to", 1), F.expr("interval 1 day"))).alias("as_of")
    )


def _cells(known: DataFrame, cells: DataFrame, keys: list[str], params: Params) -> tuple[DataFrame, DataFrame]:
    """The features that the cells look at, and the days of the cells with their windows."""
    days = cells.select(*keys, "window_days", F.explode(F.sequence("from_date", "to_date", F.expr("interval 1 day"))).alias("as_of"))
    days = days.groupBy(*keys, "as_of").agg(F.collect_set("window_days").alias("_asked"))
    # A series looks back from its first dirty day by the longest window.
    reach = cells.groupBy(*keys).agg(F.date_sub(F.min("from_date"), max(params.windows)).alias("_low"), F.max("to_date").alias("_high"))
    on = reduce(lambda a, b: a & b, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys))
    seen = known.alias("a").join(reach.alias("b"), on & F.col("a.local_date").between(F.col("b._low"), F.col("b._high")), "left_semi")
    return seen, days


def _frames(features: DataFrame, keys: list[str], params: Params, since: str | None, cells: DataFrame | None = None) -> DataFrame:
    """keys, as_of, x: struct<window_days, seen: the days and values of the window>."""
    known = features.where("value is not null").select(*keys, "local_date", "value")
    asked = [] if cells is None else ["_asked"]
    if cells is None:
        days = spine(known, keys)
    else:
        known, days = _cells(known, cells, keys, params)
    if since:
        days = days.where(F.col("as_of") > F.lit(since).cast("date"))
    number = F.datediff("day", F.lit("1970-01-01").cast("date"))
    rows = known.select(*keys, F.col("local_date").alias("day"), F.struct(F.col("local_date").alias("d"), F.col("value").alias("v")).alias("seen")).unionByName(
        days.select(*keys, F.col("as_of").alias("day"), F.lit(None).cast("struct<d: date, v: double>").alias("seen"), *asked), allowMissingColumns=True
    ).withColumn("_day", number)
    order = Window.partitionBy(*keys).orderBy("_day")
    framed = rows.withColumns({f"_w{w}": F.collect_list("seen").over(order.rangeBetween(-w, -1)) for w in params.windows}).where("seen is null")
    each = F.array(*(F.struct(F.lit(w).alias("window_days"), F.col(f"_w{w}").alias("seen")) for w in params.windows))
    if asked:
        each = F.filter(each, lambda x: F.array_contains("_asked", x["window_days"]))
    return framed.select(*keys, F.col("day").alias("as_of"), F.explode(each).alias("x"))


def baseline_inputs(features: DataFrame, keys: list[str] | None = None, params: Params = DEFAULT, since: str | None = None) -> DataFrame:
    """keys, window_days, as_of, local_date: which days each baseline was made from (its provenance)."""
    keys = keys or SERIES
    each = _frames(features, keys, params, since)
    return each.select(*keys, F.col("x.window_days").alias("window_days"), "as_of", F.explode(F.col("x.seen.d")).alias("local_date"))


def rolling_baselines(
    features: DataFrame, keys: list[str] | None = None, params: Params = DEFAULT, since: str | None = None, cells: DataFrame | None = None
) -> DataFrame:
    """keys, window_days, as_of, n, distinct_dates, span_days, coverage, mean, median, mad, q10..q90,
    maturity for features(keys, local_date, value). Statistics are null without enough history.

    since: leave out days up to this one (the affected region of an incremental run).
    cells: only these intervals of series and windows (keys, window_days, from_date, to_date).
    """
    keys = keys or SERIES
    each = _frames(features, keys, params, since, cells)
    seen = each.select(*keys, "as_of", "x.window_days", F.col("x.seen").alias("seen")).withColumns({
        "dates": F.array_distinct(F.col("seen.d")),
        "values": F.sort_array(F.col("seen.v")),
    })
    counted = seen.withColumns({
        "n": F.size("values").cast("bigint"),
        "distinct_dates": F.size("dates").cast("bigint"),
        "span_days": F.when(F.size("dates") > 0, F.datediff(F.array_max("dates"), F.array_min("dates")) + 1).cast("bigint"),
    }).withColumn("coverage", F.col("distinct_dates") / F.col("window_days"))
    level = F.lit(None).cast("string")
    for w, m in params.windows.items():
        established = (F.col("n") >= m.observations) & (F.col("span_days") >= m.span_days) & (F.col("coverage") >= m.coverage)
        level = F.when(
            F.col("window_days") == w,
            F.when(F.col("n") < m.least, "INSUFFICIENT_HISTORY").when(established, "ESTABLISHED").otherwise("PROVISIONAL"),
        ).otherwise(level)
    graded = counted.withColumn("maturity", level)
    enough = F.col("maturity") != "INSUFFICIENT_HISTORY"
    center = F.round(stats.quantile(F.col("values"), 0.5), 12)
    published = {"mean": stats.mean(F.col("values")), "median": center, "mad": stats.mad(F.col("values"), center)}
    published |= {f"q{round(q * 100)}": stats.quantile(F.col("values"), q) for q in params.quantiles}
    return graded.select(
        *keys, "window_days", "as_of", "n", "distinct_dates", "span_days", F.round("coverage", 6).alias("coverage"),
        *(F.when(enough, F.round(c, 9)).alias(k) for k, c in published.items()), "maturity",
    )
