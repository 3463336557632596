"""What is held of users over all tables that have their rows: given out, or erased."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import store


@dataclass(frozen=True)
class Held:
    """A table with rows of users: the column that names the user, and what is given out (None: all)."""

    key: str
    columns: tuple[str, ...] | None = None


def export(tables: Mapping[str, DataFrame], held: Mapping[str, Held], users: DataFrame) -> DataFrame:
    """user_id, table, row: every row of the users(user_id) in each table, as JSON with nulls. A user that is
    asked for twice is given once; rows without a user are nobody's."""
    asked = users.select("user_id").distinct()
    out = []
    for name, h in held.items():
        df = tables[name]
        row = F.to_json(F.struct(*(h.columns or df.columns)), {"ignoreNullFields": "false"})
        out.append(df.select(F.col(h.key).alias("user_id"), F.lit(name).alias("table"), row.alias("row")).join(asked, "user_id", "left_semi"))
    return reduce(DataFrame.unionByName, out)


def erase(spark: SparkSession, root: str, held: Mapping[str, Held], users: DataFrame) -> DataFrame:
    """Takes users(user_id) out of the versioned tables root/name: table, deleted, left. Rows without a user stay.

    All tables are written before the first is named, so a run that fails while it writes has erased nothing; one
    that fails later is run again and finds the rest. A table with no row of theirs gets no new version. What
    is erased is gone from earlier versions too: they are dropped.
    """
    asked = users.select("user_id").distinct()
    written, out = [], []
    for name, h in held.items():
        path = f"{root}/{name}"
        number = store.current_version(spark, path)
        now = store.read_version(spark, path, number)
        kept = now.join(asked.withColumnRenamed("user_id", h.key), h.key, "left_anti").select(*now.columns)
        before = now.count()
        data = store.write(kept, path)
        left = spark.read.schema(now.schema).parquet(f"{path}/{data}").count()
        out.append((name, before - left, left))
        written.append((path, number, data, before != left))
    for path, number, data, changed in written:
        if changed:
            store.name(spark, path, number + 1, "users erased", data)
        else:
            store.drop_data(spark, path, data)
        store.forget(spark, path)
    return spark.createDataFrame(out, "table string, deleted long, left long")
