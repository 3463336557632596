"""Exact running totals over a key's rows without gathering the key in one task.

Rows are dealt to buckets by their sort value; only the bucket totals (a few thousand rows) are
summed in order, and each bucket sorts its own rows. A key that holds a third of all rows is
spread over as many buckets as any other rows of that number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one bucket should hold on average; small inputs still get some hundred buckets.
ROWS_PER_BUCKET = 20_000
LEAST_BUCKETS = 256


def bucket_count(rows: int, per_bucket: int = ROWS_PER_BUCKET) -> int:
    return max(1, min(rows // 100, LEAST_BUCKETS), -(-rows // per_bucket))


def running_total(df: DataFrame, keys: list[str], bucket: Column, order: list[str], weight: Column, out: str) -> DataFrame:
    """Adds `out`: the sum of weight over the rows of the same keys that come before this one.

    bucket must not decrease along `order` within the keys. keys may be empty; none may be null.
    """
    dealt = df.withColumns({"_bucket": bucket, "_weight": weight})
    place = [*keys, "_bucket"]
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy(*place)
        .agg(F.sum("_weight").alias("_total"))
        .select(*place, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy(*place).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.withColumn("_inside", F.coalesce(F.sum("_weight").over(inside), F.lit(0)))
        .join(offsets, place)
        .withColumn(out, F.col("_offset") + F.col("_inside"))
        .drop("_bucket", "_weight", "_inside", "_offset")
    )
