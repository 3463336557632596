"""Deviation, persistence, trend, change point and relationship of series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..params import DEFAULT, Params
from .features import SERIES

INSUFFICIENT = "INSUFFICIENT_BASELINE"


def deviations(features: DataFrame, baselines: DataFrame, keys: list[str] | None = None, unit: Column | None = None, params: Params = DEFAULT) -> DataFrame:
    """Each feature against each window's baseline as of its own day. features(keys, local_date,
    value); keys are compared null-safely."""
    keys = keys or SERIES
    base = baselines.select(*(F.col(k).alias(f"_{k}") for k in keys), "window_days", "as_of", "median", "mad", "q10", "q25", "q50", "q75", "q90", "maturity")
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)) & (F.col("local_date") == F.col("as_of"))
    unit = F.lit("count") if unit is None else unit
    v, mid = F.col("value"), F.col("median")
    known = (F.col("maturity") != "INSUFFICIENT_HISTORY") & mid.isNotNull()
    distance = F.round(v - mid, 9)
    relative = known & unit.isin(*params.relative_units) & (mid != 0)
    band = (
        F.when(v < F.col("q10"), "BELOW_Q10").when(v < F.col("q25"), "Q10_Q25").when(v < F.col("q50"), "Q25_Q50")
        .when(v < F.col("q75"), "Q50_Q75").when(v < F.col("q90"), "Q75_Q90").otherwise("ABOVE_Q90")
    )
    side = F.when(F.abs(v - mid) <= 1e-9, "WITHIN").when(v > mid, "ABOVE").otherwise("BELOW")
    kind = F.when(v > F.col("q90"), "ABOVE_TYPICAL_RANGE").when(v < F.col("q10"), "BELOW_TYPICAL_RANGE").otherwise("WITHIN_TYPICAL_RANGE")
    return features.select(*keys, "local_date", "value").join(base, on).select(
        *keys, "local_date", "window_days", "value", "maturity",
        F.when(known, distance).alias("absolute"),
        F.when(relative, F.round(F.try_divide(distance, mid), 9)).alias("relative"),
        F.when(known & (F.col("mad") != 0), F.round(F.try_divide(distance, F.col("mad")), 9)).alias("robust_z"),
        F.when(known & F.col("mad").isNull(), "MAD_MISSING").when(known & (F.col("mad") == 0), "MAD_ZERO").alias("z_reason"),
        F.when(known, band).alias("quantile_band"),
        F.when(known, side).alias("side"),
        F.when(known, kind).otherwise(INSUFFICIENT).alias("deviation_class"),
        F.when(~known, INSUFFICIENT).when(F.col("maturity") == "ESTABLISHED", "SUFFICIENT").otherwise("PROVISIONAL").alias("evidence"),
    )


def persistence(devs: DataFrame, keys: list[str] | None = None, params: Params = DEFAULT, rolling: bool = False) -> DataFrame:
    """The run of like deviations at the end of each series and window. Evidence folds the maturity
    of the whole series. rolling: a row for each day, as of that day, instead of the last one."""
    keys = [*(keys or SERIES), "window_days"]
    few, least = F.col("n") < params.min_consecutive, params.min_consecutive
    if rolling:
        order = Window.partitionBy(*keys).orderBy("local_date")
        seen = order.rowsBetween(Window.unboundedPreceding, 0)
        folded = devs.withColumn("n", F.row_number().over(order).cast("bigint")).withColumns({
            "as_of": F.col("local_date"),
            **{name: F.col("n") - F.coalesce(F.max(F.when(F.col("deviation_class") != kind, F.col("n"))).over(seen), F.lit(0))
               for name, kind in (("above", "ABOVE_TYPICAL_RANGE"), ("below", "BELOW_TYPICAL_RANGE"))},
            "_none": F.bool_or(F.col("maturity") == "INSUFFICIENT_HISTORY").over(seen), "_some": F.bool_or(F.col("maturity") == "PROVISIONAL").over(seen),
        })
    else:
        ordered = devs.withColumn("_back", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("local_date"))))

        def run(kind: str) -> Column:
            return F.coalesce(F.min(F.when(F.col("deviation_class") != kind, F.col("_back"))) - 1, F.count("*")).cast("bigint")

        folded = ordered.groupBy(*keys).agg(
            F.count("*").alias("n"), F.max("local_date").alias("as_of"), run("ABOVE_TYPICAL_RANGE").alias("above"), run("BELOW_TYPICAL_RANGE").alias("below"),
            F.bool_or(F.col("maturity") == "INSUFFICIENT_HISTORY").alias("_none"), F.bool_or(F.col("maturity") == "PROVISIONAL").alias("_some"),
        )
    return folded.select(
        *keys, "as_of", "n", "above", "below",
        F.when(few, "INSUFFICIENT_OBSERVATIONS").when(F.col("above") >= least, "PERSISTENT_ABOVE_TYPICAL")
        .when(F.col("below") >= least, "PERSISTENT_BELOW_TYPICAL").otherwise("NO_PERSISTENT_DEVIATION").alias("persistence_class"),
        F.when(few, "INSUFFICIENT_OBSERVATIONS").when(F.col("_none"), INSUFFICIENT).when(F.col("_some"), "PROVISIONAL").otherwise("SUFFICIENT").alias("evidence"),
    )


def _last_points(features: DataFrame, keys: list[str], n: int, rolling: bool) -> DataFrame:
    """days, values of the last n observations of each series, in order; rolling: as of each day."""
    if rolling:
        lately = Window.partitionBy(*keys).orderBy("local_date").rowsBetween(1 - n, 0)
        point = F.struct(F.datediff("local_date", F.lit("1970-01-01").cast("date")).alias("d"), F.col("value").alias("v"))
        framed = features.where("value is not null").withColumn("p", F.sort_array(F.collect_list(point).over(lately)))
        return framed.select(*keys, F.col("local_date").alias("as_of"), F.col("p.d").alias("days"), F.col("p.v").alias("values"))
    last = features.where("value is not null").withColumn("_back", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("local_date"))))
    points = F.sort_array(F.collect_list(F.struct(F.datediff("local_date", F.lit("1970-01-01").cast("date")).alias("d"), F.col("value").alias("v"))))
    return last.where(F.col("_back") <= n).groupBy(*keys).agg(points.alias("p")).select(*keys, F.col("p.d").alias("days"), F.col("p.v").alias("values"))


def trends(features: DataFrame, keys: list[str], params: Params = DEFAULT, rolling: bool = False) -> DataFrame:
    """Theil-Sen slope and Spearman correlation of the last points of each series; rolling: a row for
    each day (as_of), of the points up to it."""
    least, most = params.trend_points
    points = _last_points(features, keys, most, rolling).withColumn("n", F.size("values").cast("bigint"))
    enough = F.col("n") >= least
    measured = points.withColumns({
        "slope": F.when(enough, F.round(stats.theil_sen(F.col("days"), F.col("values")), 6)),
        "rho": F.when(enough, F.round(stats.spearman(F.col("days").cast("array<double>"), F.col("values")), 6)),
    })
    return measured.select(
        *keys, *(["as_of"] if rolling else []), "n", "slope", "rho",
        F.when(~enough, "INSUFFICIENT_OBSERVATIONS").when((F.col("slope") > 0) & (F.col("rho") >= params.trend_rho), "RISING")
        .when((F.col("slope") < 0) & (F.col("rho") <= -params.trend_rho), "FALLING").otherwise("STABLE").alias("trend_class"),
        F.when(enough, "SUFFICIENT").otherwise("INSUFFICIENT_OBSERVATIONS").alias("evidence"),
    )


def change_points(features: DataFrame, keys: list[str], params: Params = DEFAULT, rolling: bool = False) -> DataFrame:
    """The split of the last points with the largest shift of medians over the spread within the
    parts; the first of equal ones. A clean step has an infinite shift and no magnitude. rolling: a
    row for each day (as_of), of the points up to it."""
    n, least = params.change_points, params.change_segment
    points = _last_points(features, keys, n, rolling).withColumn("n", F.size("values").cast("bigint"))
    v = F.col("values")

    def spread(p: Column) -> Column:
        """The median distance of the points of a split from the median of their part."""
        return stats.median(F.concat(F.transform(p["before"], lambda x: F.abs(x - p["a"])), F.transform(p["after"], lambda x: F.abs(x - p["b"]))))

    def shift(p: Column, width: Column) -> Column:
        return F.when(width == 0, F.when(p["a"] == p["b"], F.lit(0.0)).otherwise(F.lit(float("inf")))).otherwise(F.try_divide(F.abs(p["b"] - p["a"]), width))

    def split(k: Column) -> Column:
        before, after = F.slice(v, F.lit(1), k), F.slice(v, k + 1, F.size(v))
        parts = F.struct(before.alias("before"), after.alias("after"), stats.median(before).alias("a"), stats.median(after).alias("b"))
        moved = stats.let(parts, lambda p: stats.let(spread(p), lambda width: shift(p, width)))
        return F.struct(moved.alias("shift"), (-k).alias("first"), F.get(F.col("days"), k).alias("day"))

    best = F.array_max(F.transform(F.sequence(F.lit(least), F.lit(n - least)), split))
    enough = F.col("n") >= n
    found = points.withColumn("best", F.when(enough, best)).withColumn("shift", F.col("best.shift"))
    changed = enough & (F.col("shift") >= params.change_shift)
    finite = ~F.col("shift").isin(0.0, float("inf"))
    return found.select(
        *keys, *(["as_of"] if rolling else []), "n",
        F.when(changed, F.date_add(F.lit("1970-01-01").cast("date"), F.col("best.day"))).alias("split_date"),
        F.when(finite, F.round("shift", 6)).alias("magnitude"),
        F.when(~enough, "INSUFFICIENT_EVIDENCE").when(changed, "CHANGE_DETECTED").otherwise("NO_CHANGE").alias("change_class"),
        F.when(enough, "SUFFICIENT").otherwise("INSUFFICIENT_EVIDENCE").alias("evidence"),
    )


def relationships(features: DataFrame, pairs: list[tuple[str, str]], context: list[str], params: Params = DEFAULT) -> DataFrame:
    """Rank correlation of pairs of metrics over their common days in one source context; a pair of
    present metrics without a common day has no points and no date."""
    names = features.sparkSession.createDataFrame(sorted({tuple(sorted(p)) for p in pairs}), "left_metric string, right_metric string")
    daily = features.where("value is not null")
    left = daily.select(F.col("metric").alias("left_metric"), *context, "local_date", F.col("value").alias("x"))
    right = daily.select(F.col("metric").alias("right_metric"), *context, "local_date", F.col("value").alias("y"))
    has = daily.select("metric", *context).distinct()
    both = (
        has.withColumnRenamed("metric", "left_metric").join(F.broadcast(names), "left_metric")
        .join(has.withColumnRenamed("metric", "right_metric"), ["right_metric", *context])
    )
    points = left.join(F.broadcast(names), "left_metric").join(right, ["right_metric", *context, "local_date"])
    keys = ["left_metric", "right_metric", *context]
    # Ranks and sums by window and group: days of a pair may be many.
    ranked = points.select(*keys, "local_date", "x", "y").withColumns({"rx": stats.window_rank("x", *keys), "ry": stats.window_rank("y", *keys)})
    folded = ranked.groupBy(*keys).agg(
        F.count("*").alias("n"), F.max("local_date").alias("as_of"),
        stats.correlation(F.count("*").cast("double"), F.sum("rx"), F.sum("ry"), F.sum(F.col("rx") * F.col("rx")), F.sum(F.col("ry") * F.col("ry")), F.sum(F.col("rx") * F.col("ry"))).alias("r"),
    )
    joined = both.join(folded, keys, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))
    enough = F.col("n") >= params.pair_points
    rho = joined.withColumn("rho", F.when(enough, F.round("r", 6)))
    return rho.select(
        "left_metric", "right_metric", *context, "as_of", "n", "rho",
        F.when(~enough, "INSUFFICIENT_PAIRED_DATA").when(F.col("rho") >= params.pair_rho, "POSITIVE_ASSOCIATION")
        .when(F.col("rho") <= -params.pair_rho, "NEGATIVE_ASSOCIATION").otherwise("NO_ASSOCIATION").alias("relationship_class"),
    )
