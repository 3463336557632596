"""Desired-state reconciliation: what to keep, retire and insert, without ever overwriting a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def signature(*columns: str) -> Column:
    """A content hash in which null differs from every text."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def delta(current: DataFrame, desired: DataFrame, keys: list[str]) -> DataFrame:
    """keys, action for current(keys, sig) and desired(keys, sig): KEEP, INSERT, STALE (gone), or
    REPLACE (stale and insert)."""
    both = current.select(*keys, F.col("sig").alias("_old")).join(desired.select(*keys, F.col("sig").alias("_new")), keys, "full_outer")
    action = (
        F.when(F.col("_old").isNull(), "INSERT").when(F.col("_new").isNull(), "STALE")
        .when(F.col("_old") == F.col("_new"), "KEEP").otherwise("REPLACE")
    )
    return both.select(*keys, action.alias("action"))


def apply_delta(history: DataFrame, desired: DataFrame, keys: list[str]) -> DataFrame:
    """The next version of an append-only table history(keys, sig, status): old rows change status
    only, new ones are CURRENT. Doing it twice changes nothing."""
    current = history.where("status = 'CURRENT'")
    plan = delta(current, desired, keys)
    gone = plan.where(F.col("action").isin("STALE", "REPLACE")).select(*keys, F.lit("CURRENT").alias("status"), F.lit(True).alias("_gone"))
    kept = history.join(gone, [*keys, "status"], "left").withColumn("status", F.when(F.col("_gone"), "STALE").otherwise(F.col("status"))).drop("_gone")
    fresh = desired.join(plan.where(F.col("action").isin("INSERT", "REPLACE")).select(*keys), keys, "left_semi").withColumn("status", F.lit("CURRENT"))
    return kept.unionByName(fresh.select(*kept.columns))


def same_content(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, repeats counted."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def dirty_dates(before: DataFrame, now: DataFrame) -> DataFrame:
    """Days whose inputs (id, local_date, sig) were added, removed or changed."""
    both = before.select("id", F.col("local_date").alias("_was"), F.col("sig").alias("_old")).join(
        now.select("id", F.col("local_date").alias("_is"), F.col("sig").alias("_new")), "id", "full_outer"
    ).where(~F.col("_old").eqNullSafe(F.col("_new")))
    return both.select(F.explode(F.array_distinct(F.array_compact(F.array("_was", "_is")))).alias("local_date")).distinct()


def affected_region(dirty: DataFrame, before: DataFrame, now: DataFrame) -> DataFrame:
    """From the day after the first dirty day to the day after the last day of either state. One row;
    new series need the whole range (see README)."""
    last = before.select("local_date").union(now.select("local_date")).agg(F.date_add(F.max("local_date"), 1).alias("to_date"))
    return dirty.agg(F.date_add(F.min("local_date"), 1).alias("from_date")).join(F.broadcast(last))


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace those of old with the same keys."""
    both = old.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)))
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_turn")))
    return both.withColumn("_n", last).where("_n = 1").drop("_n", "_turn")


def insert_or_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti").select(*old.columns))


def digest(df: DataFrame, columns: list[str]) -> DataFrame:
    """An order-independent digest: the count, and the sums of two 24-bit parts of the row hashes (so
    that no sum overflows below 2**39 rows)."""
    h = F.md5(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns)))
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring(h, at, 6), 16, 10).cast("bigint")), F.lit(0))
    return df.agg(F.count("*").alias("n"), part(1).alias("high"), part(7).alias("low"))


def replace_all(history: DataFrame, desired: DataFrame, keys: list[str]) -> DataFrame:
    """The next version of history(keys, sig, status), all or nothing: if the current rows are not the
    desired ones, all of them turn stale and the whole desired set is added; else nothing changes."""
    plan = delta(history.where("status = 'CURRENT'"), desired, keys)
    differs = plan.agg(F.coalesce(F.bool_or(F.col("action") != "KEEP"), F.lit(False)).alias("_differs"))
    old = history.crossJoin(F.broadcast(differs)).withColumn("status", F.when(F.col("_differs") & (F.col("status") == "CURRENT"), "STALE").otherwise(F.col("status")))
    new = desired.crossJoin(F.broadcast(differs)).where("_differs").withColumn("status", F.lit("CURRENT"))
    return old.drop("_differs").unionByName(new.select(*history.columns))


def apply_revisions(history: DataFrame, batch: DataFrame, full: bool = False) -> tuple[DataFrame, DataFrame]:
    """history(logical, version, status) after a batch(logical, version, classification): the next
    history, and what breaks the rules (logical, problem).

    A NEW record must have no current row and a REVISION must have one; a version that is current
    already is skipped. full: the batch is the latest version of every record and has no such rules.
    In both, a record that the batch has in several versions breaks the rules, as only one can be current;
    the same version twice is one. A record that breaks a rule is left as it is.
    """
    current = history.where("status = 'CURRENT'").select("logical", F.col("version").alias("_is"))
    once = batch.groupBy("logical").agg(F.min_by("classification", "version").alias("classification"), F.min("version").alias("version"), F.max("version").alias("_last"))
    joined = once.join(current, "logical", "left")
    same = F.coalesce(F.col("_is") == F.col("version"), F.lit(False))
    several = F.when(F.col("version") < F.col("_last"), "SEVERAL_IN_BATCH")
    problem = several.when(~same & (F.col("classification") == "NEW") & F.col("_is").isNotNull(), "NEW_HAS_CURRENT").when(
        ~same & (F.col("classification") == "REVISION") & F.col("_is").isNull(), "REVISION_WITHOUT_CURRENT"
    )
    judged = joined.withColumn("problem", several if full else problem)
    taken = judged.where(~same & F.col("problem").isNull()).select("logical", "version")
    gone = taken.select("logical", F.lit("CURRENT").alias("status"), F.lit(True).alias("_gone"))
    kept = history.join(gone, ["logical", "status"], "left").withColumn("status", F.when(F.col("_gone"), "STALE").otherwise(F.col("status")))
    after = kept.select("logical", "version", "status").unionByName(taken.withColumn("status", F.lit("CURRENT")))
    return after, judged.where("problem is not null").select("logical", "problem")


def replace_sets(history: DataFrame, batch: DataFrame, key: str, stated: DataFrame | None = None) -> DataFrame:
    """Facts of history(key, ..., status) after a batch of whole fact sets: the current facts of every
    key in the batch turn stale unless its set is the same, then the set of the batch is added.

    stated: the keys that the batch speaks of, with those whose set is now empty; without it, the keys of
    its facts."""
    content = [c for c in batch.columns if c != key]
    sets = lambda df: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*content))).alias("_set"))
    now, was = sets(batch), sets(history.where("status = 'CURRENT'")).withColumnRenamed("_set", "_was")
    keys = (now if stated is None else stated).select(key).distinct()
    changed = keys.join(now, key, "left").join(was, key, "left").where(~F.col("_set").eqNullSafe(F.col("_was"))).select(key)
    marked = history.join(changed.withColumn("_hit", F.lit(True)), key, "left")
    old = marked.withColumn("status", F.when(F.col("_hit") & (F.col("status") == "CURRENT"), "STALE").otherwise(F.col("status"))).select(*history.columns)
    return old.unionByName(batch.join(changed, key, "left_semi").withColumn("status", F.lit("CURRENT")).select(*history.columns))


def semantic_compare(a: DataFrame, b: DataFrame, content: list[str], refers: dict[str, tuple[DataFrame, DataFrame, str, list[str]]] | None = None) -> DataFrame:
    """Rows of one table and not of the other, by content and repeats counted: content, side.

    refers: column -> (parent of a, parent of b, its id, its content): a column that holds surrogate
    ids is compared by what the rows it refers to say.
    """
    for column, (of_a, of_b, key, said) in (refers or {}).items():
        named = lambda df, parent: df.join(parent.select(F.col(key).alias(column), signature(*said).alias("_said")), column, "left").drop(column).withColumnRenamed("_said", column)  # noqa: B023, E731
        a, b = named(a, of_a), named(b, of_b)
    a, b = a.select(*content), b.select(*content)
    return a.exceptAll(b).withColumn("side", F.lit("only_first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("only_second")))


def definitions_changed(registry: DataFrame, definitions: DataFrame) -> DataFrame:
    """Definitions (name, version, checksum) whose checksum differs from the registered one of the same
    version: a definition may only change with its version."""
    was = registry.select("name", "version", F.col("checksum").alias("_was"))
    return definitions.join(was, ["name", "version"]).where("checksum <> _was").select("name", "version")
