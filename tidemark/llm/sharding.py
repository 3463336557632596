"""Sharding by proportional stratified interleaving.

Rows of each source are put in a seeded random order and numbered; a row's fractional rank is its
number, plus a random start of its source, over the size of the source. In the order of fractional
ranks every stretch holds the sources in proportion, so cutting that order into equal counts gives
shards that all match the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._columns import row_key, source_key, uniform
from ._store import stash
from .ranks import bucket_count, running_total

_SPAN = 1 << 60


def interleave_shards(docs: DataFrame, shards: int = 40, seed: int = 11) -> DataFrame:
    """One row per row of docs: doc_id, source, size, text_crc32, law, shard, slot, grown_shard,
    row (row_key of id, text and source).

    docs needs doc_id, text and source; other columns are left out, whatever their names. Law
    `rows`: the counts of any two shards differ by one at most. A null source is a source of its
    own; a null text has size 16 and the CRC of the empty text; null ids are ordinary values.
    Repeated rows are separate rows. An empty table gives an empty table.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id",
        "source",
        source_key(F.col("source")).alias("skey"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.md5(text).alias("_digest"),
        row_key(F.col("doc_id"), F.col("text"), F.col("source")).alias("row"),
    )
    rows = stash(narrow.withColumn("_u", uniform(seed, F.col("doc_id"), F.col("_digest"))), "shard-rows")
    total = rows.count()
    buckets = bucket_count(total)
    ranked = running_total(
        rows, ["skey"], F.expr(f"_u div {_SPAN // buckets + 1}"), ["_u", "doc_id", "_digest"], F.lit(1), "rank"
    )
    counts = rows.groupBy("skey").agg(F.count("*").alias("in_source"))
    start = uniform(seed + 1, F.col("skey")) / F.lit(float(_SPAN))
    fraction = ranked.join(counts, "skey").withColumn("_f", (F.col("rank") + start) / F.col("in_source"))
    placed = running_total(
        fraction,
        [],
        F.least(F.floor(F.col("_f") * buckets), F.lit(buckets - 1)),
        ["_f", "skey", "_u", "doc_id", "_digest"],
        F.lit(1),
        "position",
    )
    n = max(total, 1)
    return placed.withColumn("shard", F.expr(f"cast(position * {shards} div {n} as int)")).select(
        "doc_id",
        "source",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        F.expr(f"position - (shard * cast({n} as bigint) + {shards - 1}) div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "row",
    )
