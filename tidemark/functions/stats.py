"""Statistics as column expressions: exact quantiles of arrays, ranks, correlation, slopes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def quantile(ordered: Column, q: float) -> Column:
    """The type-7 quantile of an ascending array; null for an empty one."""
    at = F.lit(q) * (F.size(ordered) - 1)
    low, part = F.floor(at).cast("int"), at - F.floor(at)
    high = F.ceil(at).cast("int")
    return F.when(F.size(ordered) > 0, F.get(ordered, low) * (1 - part) + F.get(ordered, high) * part)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), the value computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def median(values: Column) -> Column:
    """The median of an array without nulls."""
    return let(F.sort_array(values), lambda ordered: quantile(ordered, 0.5))


def mad(values: Column, center: Column) -> Column:
    """The median distance from a center."""
    return median(F.transform(values, lambda x: F.abs(x - center)))


def mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(values) > 0, total / F.size(values))


def average_ranks(values: Column) -> Column:
    """Ranks from 1, ties sharing their mean rank, in the order of the array."""
    below = lambda x: F.size(F.filter(values, lambda y: y < x))
    equal = lambda x: F.size(F.filter(values, lambda y: y == x))
    return F.transform(values, lambda x: below(x) + (equal(x) + 1) / F.lit(2.0))


def correlation(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    """Pearson's r from sums; 0 where either side is constant. ANSI mode makes the built-in corr()
    fail on constants."""
    vx, vy = sxx - sx * sx / n, syy - sy * sy / n
    return F.when((vx > 1e-9) & (vy > 1e-9), F.try_divide(sxy - sx * sy / n, F.sqrt(vx * vy))).otherwise(F.lit(0.0))


def pearson(x: Column, y: Column) -> Column:
    """Correlation of two short arrays of one length."""
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    dot = lambda a, b: total(F.zip_with(a, b, lambda p, q: p * q))
    # Deviations from the means: sums of squares of large values would cancel.
    centred = lambda a: let(total(a) / F.size(a), lambda m: F.transform(a, lambda v: v - m))
    return let(
        F.struct(centred(x).alias("x"), centred(y).alias("y")),
        lambda c: let(
            F.struct(dot(c["x"], c["x"]).alias("xx"), dot(c["y"], c["y"]).alias("yy"), dot(c["x"], c["y"]).alias("xy")),
            lambda d: F.when((d["xx"] > 0) & (d["yy"] > 0), F.try_divide(d["xy"], F.sqrt(d["xx"]) * F.sqrt(d["yy"]))).otherwise(F.lit(0.0)),
        ),
    )


def spearman(x: Column, y: Column) -> Column:
    return let(F.struct(average_ranks(x).alias("x"), average_ranks(y).alias("y")), lambda r: pearson(r["x"], r["y"]))


def theil_sen(days: Column, values: Column) -> Column:
    """The median of the slopes of all pairs of points at different days; 0 without such a pair.
    days ascend; arrays are short (the last points of a series)."""
    points = F.arrays_zip(days.alias("d"), values.alias("v"))
    slopes = F.flatten(
        F.transform(
            points,
            lambda p, i: F.transform(
                F.filter(F.slice(points, i + 2, F.size(points)), lambda q: q["d"] != p["d"]), lambda q: (q["v"] - p["v"]) / (q["d"] - p["d"])
            ),
        )
    )
    return F.coalesce(median(slopes), F.lit(0.0))


def window_rank(value: str, *keys: str) -> Column:
    """Average ranks over the rows of a key, for groups of any size."""
    ordered = F.rank().over(Window.partitionBy(*keys).orderBy(value))
    return ordered + (F.count("*").over(Window.partitionBy(*keys, value)) - 1) / F.lit(2.0)


def last_n(df: DataFrame, n: int, order: list[Column], *keys: str) -> DataFrame:
    """The first n rows of each key in the given (descending) order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")
