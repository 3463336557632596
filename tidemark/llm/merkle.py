"""Merkle manifest of a table: a hash tree over its rows, a root, and for every row the digests that
prove that it belongs to that root.

Rows are numbered in order within their group and dealt to aligned blocks of fanout**height. A task
walks the subtree of a block in postorder: a node returns its digest and, while the recursion unwinds,
appends the siblings of each child to the proofs of the leaves below. The roots of the blocks are the
nodes of the next, equally distributed traversal, until one node is left of each group; the groups'
roots are nodes of one more tree. Proofs are completed from the top down: what is above a block is
worked out once and joined to the block's rows, so that proofs are never shuffled with the leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._columns import source_key
from ._store import partitions, stash
from .ranks import running_total

#: Children of a node, and levels of the tree that one task walks through.
FANOUT, HEIGHT = 8, 3
_PROOF = "at array<int>, near array<binary>"


def leaf_text(columns: Iterable[Column]) -> Column:
    """What a leaf is the hash of: each value as its byte count in UTF-8, a colon and the value, null as `-`."""
    texts = [c.cast("string") for c in columns]
    return F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts))


def leaf_digest(columns: Iterable[Column]) -> Column:
    """The SHA-256 of leaf_text, as 32 bytes."""
    return F.unhex(F.sha2(leaf_text(columns), 256))


def fold(leaf: Column, at: Column, near: Column) -> Column:
    """The root (hex text) that a leaf and its proof lead to."""
    level = lambda acc, x: F.sha2(F.concat(*_around(x, acc)), 256)
    return F.aggregate(F.arrays_zip(at.alias("at"), near.alias("near")), F.lower(F.hex(leaf)), level)


def _around(level: Column, own: Column) -> tuple[Column, Column, Column]:
    near = F.lower(F.hex(level["near"]))
    cut = level["at"] * 64
    return near.substr(F.lit(1), cut), own, near.substr(cut + 1, F.length(near) - cut)


def proof_text(near: Column) -> Column:
    """All siblings of a proof as hex text, from the leaf up, left to right."""
    return F.lower(F.hex(F.aggregate(near, F.lit(b""), lambda a, x: F.concat(a, x))))


def _hash(children: list[bytes]) -> bytes:
    return hashlib.sha256("".join(c.hex() for c in children).encode()).digest()


def walk(digests: list[bytes], low: int, high: int, height: int, proofs: list[list[tuple[int, bytes]]] | None, fanout: int) -> bytes:
    """The digest of the subtree of `height` levels over digests[low:high]. Proofs of the leaves get
    (place among the siblings, their digests) of each level while the recursion unwinds."""
    if not height:
        return digests[low]
    span = fanout ** (height - 1)
    cuts = range(low, high, span)
    children = [walk(digests, at, min(at + span, high), height - 1, proofs, fanout) for at in cuts]
    if proofs is not None:
        for place, at in enumerate(cuts):
            siblings = b"".join(children[:place] + children[place + 1 :])
            for leaf in range(at, min(at + span, high)):
                proofs[leaf].append((place, siblings))
    return _hash(children)


def _levels(block: int, rows: int, height: int, fanout: int) -> int:
    """How many levels a block's subtree has. The first block is the whole group if it is not full, and
    then ends with its one node; any other belongs to a larger tree."""
    return height if block else next(h for h in range(height + 1) if fanout**h >= rows)


def _in_order(table: pa.Table) -> pa.Table:
    return table.sort_by("r")


def _up(nodes: DataFrame, fanout: int, height: int) -> DataFrame:
    """g, r, digest of the roots of the blocks of nodes(g, r, digest)."""

    def root(table: pa.Table) -> pa.Table:
        table = _in_order(table)
        g, block, digests = table["g"][0], table["block"][0].as_py(), table["digest"].to_pylist()
        top = walk(digests, 0, len(digests), _levels(block, len(digests), height, fanout), None, fanout)
        return pa.table({"g": pa.array([g.as_py()], pa.string()), "r": pa.array([block], pa.int64()), "digest": pa.array([top], pa.binary())})

    blocks = nodes.select("g", "r", "digest", F.expr(f"r div {fanout**height}").alias("block"))
    return blocks.groupBy("g", "block").applyInArrow(root, "g string, r long, digest binary")


def _down(nodes: DataFrame, above: DataFrame, fanout: int, height: int) -> DataFrame:
    """All columns of nodes(g, r, digest, ...) and their proofs. above(g, r, at, near, ...): the proofs of
    the roots of their blocks; its other columns, binary ones, are handed down."""
    told = [c for c in above.columns if c not in ("g", "r", "at", "near")]

    def proved(table: pa.Table, upper: pa.Table) -> pa.Table:
        table = _in_order(table)
        block, digests = table["block"][0].as_py(), table["digest"].to_pylist()
        proofs: list[list[tuple[int, bytes]]] = [[] for _ in digests]
        walk(digests, 0, len(digests), _levels(block, len(digests), height, fanout), proofs, fanout)
        rest = list(zip(upper["at"][0].as_py(), upper["near"][0].as_py(), strict=True))
        own = [p + rest for p in proofs]
        out = table.drop_columns(["block"])
        for name in told:
            out = out.append_column(name, pa.array([upper[name][0].as_py()] * len(own), pa.binary()))
        out = out.append_column("at", pa.array([[x for x, _ in p] for p in own], pa.list_(pa.int32())))
        return out.append_column("near", pa.array([[x for _, x in p] for p in own], pa.list_(pa.binary())))

    blocks = nodes.withColumn("block", F.expr(f"r div {fanout**height}"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in nodes.schema.fields] + [f"`{c}` binary" for c in told]
    over = above.withColumnRenamed("r", "block")
    return blocks.groupBy("g", "block").cogroup(over.groupBy("g", "block")).applyInArrow(proved, ", ".join([*fields, _PROOF]))


def _ranked(nodes: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """r: the place of a row in the order, from 0, within its keys; dealt by ranges of keys and order."""
    dealt = nodes.repartitionByRange(partitions(nodes.sparkSession), *keys, *order).withColumn("_dealt", F.spark_partition_id())
    return running_total(stash(dealt, label), keys, F.col("_dealt"), order, F.lit(1), "r").drop("_dealt")


def _tree(nodes: DataFrame, fanout: int, height: int, label: str) -> list[DataFrame]:
    """The nodes of every traversal, from the given ones to the last, of which each g has one."""
    levels = [nodes]
    while True:
        levels.append(stash(_up(levels[-1], fanout, height), label))
        if not levels[-1].where("r > 0").limit(1).count():
            return levels


def merkle_proofs(leaves: DataFrame, group: str, order: list[str], digest: str = "leaf", fanout: int = FANOUT, height: int = HEIGHT) -> DataFrame:
    """All columns of leaves and `subroot`, `root` (32 bytes each) and the proof of each row: `at`, its
    node's place among the siblings of each level, and `near`, the digests of those siblings.

    leaves(group, order, digest (32 bytes), ...) must not have columns named `subroot`, `root`, `at`,
    `near`, `g`, `r`, `block`. Leaves of a group ascend by `order`, nulls first; leaves that are equal
    there by digest; what is still equal has equal digests, and each takes one of the places. Groups
    ascend by their text, null first. A tree of one leaf is that leaf. A table without rows gives none.
    """
    spark = leaves.sparkSession
    held = stash(leaves.select("*", source_key(F.col(group).cast("string")).alias("g"), F.monotonically_increasing_id().alias("_tie")), "merkle-leaves")
    placed = stash(_ranked(held, ["g"], [*order, digest, "_tie"], "merkle-dealt").drop("_tie"), "merkle-placed")
    named = placed if digest == "digest" else placed.withColumn("digest", F.col(digest))
    groups = _tree(named, fanout, height, "merkle-blocks")
    heads = groups[-1].select(F.col("g").alias("_of"), "digest", F.lit("").alias("g"))
    heads = stash(_ranked(heads, ["g"], ["_of"], "merkle-groups"), "merkle-heads")
    top = _tree(heads, fanout, height, "merkle-top")
    found = top[-1].head()
    root = F.lit(bytes(found["digest"]) if found else None).cast("binary")
    empty = [F.array().cast("array<int>").alias("at"), F.array().cast("array<binary>").alias("near")]
    proofs = top[-1].select("g", "r", *empty)
    for nodes in reversed(top[:-1]):
        proofs = stash(_down(nodes, proofs.select("g", "r", "at", "near"), fanout, height), "merkle-proofs")
    heads_of = proofs.select(F.col("_of").alias("g"), F.lit(0).cast("long").alias("r"), "at", "near", F.col("digest").alias("subroot"))
    for nodes in reversed(groups[1:-1]):
        heads_of = stash(_down(nodes, heads_of, fanout, height), "merkle-proofs").drop("digest")
    return _down(named, heads_of, fanout, height).select(*leaves.columns, "subroot", root.alias("root"), "at", "near")


def tampered(doc_id: Column) -> Column:
    """Whether the manifest of the contract checks a changed copy of a document: a third of the ids."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 0, F.lit(False))


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for every row of docs(doc_id,
    source, lang, n_chars, text); other columns are left out, whatever their names.

    One tree a language over the documents by id (nulls first), one over the languages. Null and empty
    values are different values. Documents with equal ids are ordered by their hash; equal rows take
    places of their own and so have proofs of their own. verified: whether the row, tampered with where
    `tampered` says so, leads to the root; tampering that changes nothing is not noticed.
    """
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    changed = [F.translate("text", upper, upper.lower()) if c == "text" else F.col(c) for c in columns]
    leaves = docs.select("doc_id", "lang", leaf_digest(map(F.col, columns)).alias("leaf"), F.when(tampered(F.col("doc_id")), leaf_digest(changed)).alias("seen"))
    proved = merkle_proofs(leaves, "lang", ["doc_id"])
    text = lambda c: F.lower(F.hex(c))
    folded = fold(F.coalesce("seen", "leaf"), F.col("at"), F.col("near"))
    told = proved.select(
        "doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"),
        F.sha2(proof_text(F.col("near")), 256).alias("proof_sha256"), folded.alias("folded_root"),
    )
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))
