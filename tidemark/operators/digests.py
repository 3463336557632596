"""A hash tree over a table, so that two builds are compared by looking only where they differ.

Rows are hashed with their key. A leaf is the SHA-256 of the sorted row hashes of one range of keys, a
node that of its children in order, up to one root. Ranges are fixed by the key alone, so a row that
comes, goes or changes moves the digests of its own range and of the nodes above it, and no others.
The tree is a table (level, node, digest, rows); it has about rows / width leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stash
from .reconcile import signature

#: Hex digits of a row hash by which a range is dealt to tasks before it is hashed: a range with many
#: rows (or one key that most rows have) is gathered in so many parts.
_PART = 2


def _range(key: str, width: int) -> Column:
    """The range of an integer key; rows without a key are in range -1 with the keys below 0."""
    return F.coalesce(F.floor(F.col(key) / F.lit(width)), F.lit(-1)).cast("bigint")


def _parent(fanout: int) -> Column:
    """The node above; rounded towards 0, so that all nodes meet there."""
    return F.expr(f"node div {fanout}")


def row_hashes(df: DataFrame, key: str, columns: list[str], width: int) -> DataFrame:
    """node, row, n: the hash of each distinct row (key and columns), the range that it is in, and how
    often it is there."""
    return df.select(_range(key, width).alias("node"), signature(key, *columns).alias("row")).groupBy("node", "row").agg(F.count("*").alias("n"))


def _leaves(df: DataFrame, key: str, columns: list[str], width: int) -> DataFrame:
    said = F.concat_ws(":", "row", F.col("n").cast("string"))
    parts = row_hashes(df, key, columns, width).groupBy("node", F.substring("row", 1, _PART).alias("part")).agg(
        F.sha2(F.array_join(F.sort_array(F.collect_list(said)), ","), 256).alias("digest"), F.sum("n").alias("rows")
    )
    whole = F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "part", "digest"))), ",")
    return parts.groupBy("node").agg(F.sha2(whole, 256).alias("digest"), F.sum("rows").alias("rows"))


def hash_tree(df: DataFrame, key: str, columns: list[str], width: int = 256, fanout: int = 16) -> DataFrame:
    """level, node, digest, rows: level 0 has a leaf for each range of `width` keys that has rows, the
    last level the root. key: an integer column; rows need not be unique. An empty table has no nodes.

    Two rows that swap their columns change two row hashes, as a row is hashed with its key.
    """
    leaves = stash(_leaves(df, key, columns, width), "hash-leaves")
    low, high = leaves.agg(F.min("node"), F.max("node")).first()
    levels, level, found = [leaves.select(F.lit(0).alias("level"), "node", "digest", "rows")], leaves, 0
    while low != high:
        found += 1
        low, high = (abs(x) // fanout * (1 if x > 0 else -1) for x in (low, high))
        # At most `fanout` children a node; node 0 has those on both sides of it.
        children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "digest"))), lambda c: F.concat_ws(":", c["node"].cast("string"), c["digest"])), ",")
        level = level.groupBy(_parent(fanout).alias("_up")).agg(F.sha2(children, 256).alias("digest"), F.sum("rows").alias("rows"))
        level = stash(level.withColumnRenamed("_up", "node"), f"hash-level-{found}")
        levels.append(level.select(F.lit(found).alias("level"), "node", "digest", "rows"))
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out


def root(tree: DataFrame) -> str | None:
    """The digest of the whole table; None for an empty one."""
    top = tree.orderBy(F.desc("level")).first()
    return top.digest if top else None


def differing_ranges(a: DataFrame, b: DataFrame, fanout: int = 16) -> DataFrame:
    """node of the leaves that differ or that only one of the trees has. From the level of the lower root
    down, only the children of nodes that differ are looked at."""
    tops = [t.agg(F.max("level")).first()[0] for t in (a, b)]
    if None in tops:
        return (b if tops[0] is None else a).where("level = 0").select("node")
    frontier = None
    for level in range(min(tops), -1, -1):
        left, right = (t.where(F.col("level") == level).select("node", F.col("digest").alias(name)) for t, name in ((a, "_a"), (b, "_b")))
        if frontier is not None:
            left, right = (side.withColumn("_up", _parent(fanout)).join(frontier, "_up", "left_semi").drop("_up") for side in (left, right))
        both = left.join(right, "node", "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("node")
        frontier = stash(both.withColumnRenamed("node", "_up"), f"hash-differs-{level}")
    return frontier.withColumnRenamed("_up", "node")


def differing_rows(a: DataFrame, b: DataFrame, ranges: DataFrame, key: str, columns: list[str], width: int = 256) -> DataFrame:
    """The rows of the ranges that differ, with side (only_first, only_second) and n, by how many more of
    them that side has. Other ranges are filtered out before anything is hashed or shuffled."""

    def part(df: DataFrame) -> DataFrame:
        near = df.select(key, *columns).withColumn("_node", _range(key, width)).join(ranges.select(F.col("node").alias("_node")), "_node", "left_semi")
        return near.groupBy(key, *columns).agg(F.count("*").alias("n"))

    first, second = part(a).withColumn("_turn", F.lit(1)), part(b).withColumn("_turn", F.lit(-1))
    summed = first.unionByName(second).groupBy(key, *columns).agg(F.sum(F.col("n") * F.col("_turn")).alias("_more")).where("_more <> 0")
    return summed.select(key, *columns, F.when(F.col("_more") > 0, "only_first").otherwise("only_second").alias("side"), F.abs("_more").alias("n"))
