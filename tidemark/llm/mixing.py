"""Mixing sources to target weights, in DataFrame operations only.

Targets: every source has a share of all words by its weight; a target stops at `cap` times the
words of its source, and what is over is shared again by weight until no target is above its cap.
That fixed point is a water level: sources sorted by cap / weight fill up one after another.

Drawing: the documents of a source stand in a seeded random order on a line of words; the mix takes
the line from its start, again and again, up to the target. The line is cut into blocks. All blocks
of all sources are dealt to output shards by a splitting tree: a node holds the blocks of a range of
shards and draws, without replacement, as many as its left half of the range needs, so the counts
that the sources have in either half are multivariate hypergeometric. Blocks are disjoint stretches
of randomly permuted lines. Each shard is shuffled by itself: a copy has a random key, and shards are
written in the order of these keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._columns import row_key, source_key, uniform, word_count
from ._store import stash
from .ranks import bucket_count, running_total

_SPAN = 1 << 60


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: float = 3.0) -> DataFrame:
    """skey, source_size, target for each source of sizes(skey, source, size); one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    sources = sizes.groupBy("skey", "source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*(F.lit(w) for w in weights))
    everything = Window.partitionBy()
    filled = Window.orderBy("_full_at", "skey").rowsBetween(Window.unboundedPreceding, -1)
    level = (
        sources.withColumn("_weight", F.get(cycle, (F.row_number().over(by_name) - 1) % len(weights)))
        .withColumn("_cap", F.col("source_size") * cap)
        .withColumn("_full_at", F.col("_cap") / F.col("_weight"))
        .withColumns({"_all": F.sum("source_size").over(everything), "_weights": F.sum("_weight").over(everything)})
        .withColumn("_left", F.col("_all") - F.coalesce(F.sum("_cap").over(filled), F.lit(0.0)))
        .withColumn("_open", F.col("_weights") - F.coalesce(F.sum("_weight").over(filled), F.lit(0)))
        .withColumn("_level", F.col("_left") / F.col("_open"))
    )
    # The level stands where the first source, in the order of filling up, is not full.
    water = F.min_by(F.when(F.col("_full_at") > F.col("_level"), F.col("_level")),
                     F.when(F.col("_full_at") > F.col("_level"), F.col("_full_at"))).over(everything)
    return level.withColumn("_water", F.coalesce(water, F.lit(0.0))).select(
        "skey", "source_size", F.least(F.col("_cap"), F.col("_weight") * F.col("_water")).alias("target")
    )


def split_blocks(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """skey, block, shard for quotas(skey, blocks): the splitting tree, a level at a time."""
    nodes = quotas.where("blocks > 0").select("skey", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)).alias("block"))
    nodes = nodes.withColumns({"_lo": F.lit(0), "_hi": F.lit(shards)})
    for level in range((shards - 1).bit_length()):
        node = Window.partitionBy("_lo", "_hi")
        drawn = F.row_number().over(node.orderBy(uniform(seed + level, F.col("skey"), F.col("block")), "skey", "block"))
        nodes = (
            nodes.withColumns({"_drawn": drawn, "_n": F.count("*").over(node)})
            .withColumn("_mid", F.expr("_lo + (_hi - _lo) div 2"))
            .withColumn("_left", F.expr("_drawn <= (_n * (_mid - _lo)) div (_hi - _lo)"))
            .withColumns({
                "_lo": F.when(F.col("_hi") - F.col("_lo") == 1, F.col("_lo")).when(F.col("_left"), F.col("_lo")).otherwise(F.col("_mid")),
                "_hi": F.when(F.col("_hi") - F.col("_lo") == 1, F.col("_hi")).when(F.col("_left"), F.col("_mid")).otherwise(F.col("_hi")),
            })
            .select("skey", "block", "_lo", "_hi")
        )
    return nodes.select("skey", "block", F.col("_lo").alias("shard"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    cap: float = 3.0,
    shards: int = 16,
    blocks_per_shard: int = 64,
    whole_documents: bool = False,
    seed: int = 5,
) -> DataFrame:
    """One row per row of docs: doc_id, source, row (row_key of id, text and
    source), size, source_size, target, taken, copies, shards, orders.

    docs needs doc_id, text and source; other columns are left out, whatever their names. taken: words that the mix
    takes of the document, repeats counted. With whole_documents a document is taken whole or not
    (the one at the end of a target whole if over half of it is due), else the last one is cut so
    that each source meets its rounded target. copies: texts to write, the cut one included.
    shards: the output shard of each copy; orders: its key in the shuffle of the shard. A null text has size 0 and is never taken, nor is any
    other text without words; a null source is a source of its own, last in order. Repeated rows
    count as separate documents. An empty table, or one without words, takes nothing.
    """
    sized = docs.select(
        "doc_id", "source", source_key(F.col("source")).alias("skey"), word_count(F.col("text")).alias("size"),
        F.md5(F.coalesce(F.col("text"), F.lit(""))).alias("_digest"),
        row_key(F.col("doc_id"), F.col("text"), F.col("source")).alias("row"),
    )
    rows = stash(sized.withColumn("_u", uniform(seed, F.col("doc_id"), F.col("_digest"))), "mix-rows")
    whole = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    width = max(1, -(-whole[1] // (shards * blocks_per_shard)))
    targets = source_targets(rows, weights, cap).withColumn("_due", F.round("target").cast("long"))
    quotas = targets.withColumn("blocks", F.ceil(F.col("_due") / width))
    dealt = split_blocks(quotas, shards, seed + 100).groupBy("skey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("block", "shard"))), lambda x: x["shard"]).alias("_dealt")
    )
    plan = quotas.join(dealt, "skey", "left")
    lined = running_total(
        rows, ["skey"], F.expr(f"_u div {_SPAN // bucket_count(whole[0]) + 1}"), ["_u", "doc_id", "size"], F.col("size"), "_at"
    ).join(plan, "skey")
    full = F.when(F.col("source_size") > 0, F.expr("_due div source_size")).otherwise(F.lit(0))
    due = F.col("_due") - F.col("_full") * F.col("source_size") - F.col("_at")
    cut = F.greatest(F.lit(0), F.least(F.col("size"), due))
    if whole_documents:
        cut = F.when(F.col("_cut") * 2 > F.col("size"), F.col("size")).otherwise(F.lit(0))
        lined = lined.withColumn("_full", full).withColumn("_cut", F.greatest(F.lit(0), F.least(F.col("size"), due)))
    else:
        lined = lined.withColumn("_full", full)
    taken = lined.withColumn("_cut", cut).withColumn("taken", (F.col("_full") * F.col("size") + F.col("_cut")).cast("long"))
    copies = F.when(F.col("size") > 0, F.col("_full") + F.when(F.col("_cut") > 0, 1).otherwise(0)).otherwise(F.lit(0)).cast("int")

    def shard_of(copy: Column) -> Column:
        at = copy.cast("long") * F.col("source_size") + F.col("_at")
        block = F.least(F.floor(at * F.col("blocks") / F.col("_due")).cast("int"), F.col("blocks").cast("int") - 1)
        return F.get(F.col("_dealt"), block)

    return taken.withColumn("copies", copies).select(
        "doc_id", "source", "row", "size", "source_size", "target", "taken", "copies",
        F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), shard_of))
        .otherwise(F.array().cast("array<int>")).alias("shards"),
        F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda copy: uniform(seed + 50, F.col("doc_id"), F.col("_digest"), copy)))
        .otherwise(F.array().cast("array<bigint>")).alias("orders"),
    )


def write_shards(docs: DataFrame, mixed: DataFrame, path: str) -> None:
    """Writes the copies of docs that mixed = mix_sources(docs) takes, as Parquet in a folder for each
    shard (`out_shard`), every shard in the order of its shuffle. A cut document is written whole."""
    copies = mixed.where("copies > 0").dropDuplicates(["row"]).select(F.col("row").alias("_key"), F.explode(F.arrays_zip("shards", "orders")).alias("_x"))
    keyed = docs.withColumn("_key", row_key(F.col("doc_id"), F.col("text"), F.col("source")))
    dealt = keyed.join(copies, "_key").select(*docs.columns, F.col("_x.shards").alias("out_shard"), F.col("_x.orders").alias("_order"))
    dealt.repartition("out_shard").sortWithinPartitions("out_shard", "_order").drop("_order").write.partitionBy("out_shard").parquet(path)
