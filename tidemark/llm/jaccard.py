"""The byte-position index of near-duplicates for texts whose word shingles are similar.

SimHash bytes of all shingles suit copies that are nearly equal: at a similarity of 0.8 majority bits
differ in 15 % of the places, so no number of shared bytes is certain. Here a positional byte is the
hash byte of the shingle that comes first in the position's own order of all shingles; two texts share
it as often as their shingle sets are similar. The index is that of simhash.py otherwise: a posting
holds the texts that agree in one set of positions, the shared positional bytes of a pair are tallied,
pairs below the least number are dropped, and the others are verified, on their whole shingle sets.

Texts with equal words (ASCII letters in lower case) are one class. Classes of a posting are compared
with its least one. What that leaves in different components is compared in cells of bounded size,
each with an inverted index of its shingles, and gives the edges of a forest: no pairs are listed,
and a posting of any size is dealt to many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import buffer_of, hash_ranges, hash_runs, mix, slices, tokens, whole_windows, windows
from ._columns import row_key
from ._store import stash
from .components import connected

#: Position sets and the positions of each. A pair of similarity s has equal bytes in one set unless
#: all differ: 1 - (1 - s**5)**24, 0.99993 at 0.8.
SETS, WIDTH = 24, 5
POSITIONS = SETS * WIDTH
#: Shared bytes of a pair of similarity 0.8: 96 of 120 on average, fewer than 74 once in 500,000.
LEAST_SHARED = 74
#: Shingles of the texts of one side of a cell.
CELL = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FACTORS = mix(np.arange(1, POSITIONS + 1, dtype=np.uint64)) | np.uint64(1)


def _shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts: a hash of all words; the hashes of the shingles, and where those of each text begin
    (one more entry than texts). A text of fewer words is one shingle, one without words has none."""
    buf, offsets = buffer_of(column)
    start, end, first = tokens(buf, offsets)
    words = hash_ranges(_LOWER[buf], start, end)
    content = hash_runs(words, first[:-1], first[1:])
    counts = np.diff(first)
    n = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    begin = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=begin[1:])
    out = np.empty(int(begin[-1]), np.uint64)
    short = (counts > 0) & (counts < size)
    inside = ~np.repeat(short, n)
    out[inside] = windows(words, size)[whole_windows(first, size)]
    out[begin[:-1][short]] = content[short]
    return content, out, begin


def _prints(shingle: int):
    """Of rows (doc_id, text, row): doc_id, row, content, fp (the positional bytes; null without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            content, hashes, begin = _shingles(batch.column(1), shingle)
            full = np.flatnonzero(np.diff(begin))
            places = np.zeros((batch.num_rows, POSITIONS), np.uint8)
            if len(full):
                for i, factor in enumerate(_FACTORS):
                    least = np.minimum.reduceat((hashes ^ (factor >> np.uint64(7))) * factor, begin[:-1][full])
                    places[full, i] = mix(least) >> np.uint64(56)
            ends = np.arange(batch.num_rows + 1, dtype=np.int32) * POSITIONS
            some = np.packbits(np.diff(begin) > 0, bitorder="little").tobytes()
            fp = pa.Array.from_buffers(pa.binary(), batch.num_rows, [pa.py_buffer(some), pa.py_buffer(ends.tobytes()), pa.py_buffer(places.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(content.view(np.int64)), fp], ["doc_id", "row", "content", "fp"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            _, hashes, begin = _shingles(batch.column(1), shingle)
            sets = [np.unique(hashes[a:b]).view(np.int64) for a, b in zip(begin[:-1], begin[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["content", "items"])

    return run


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (a, b, fingerprint of a, fingerprint of b): the pairs that share enough positional bytes."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, POSITIONS) for i in (2, 3))
        enough = pa.array((x == y).sum(axis=1) >= LEAST_SHARED)
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(enough) for i in (0, 1)], ["a", "b"])


def _similar(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) of which least per cent of the union is common."""
    both = (
        pairs.join(sets.select(F.col("content").alias("b"), F.col("items").alias("_b")), "b")
        .join(sets.select(F.col("content").alias("a"), F.col("items").alias("_a")), "a")
    )
    common = F.size(F.array_intersect("_a", "_b"))
    return both.where(common * 100 >= (F.size("_a") + F.size("_b") - common) * least).select("a", "b")


def _forest(content: np.ndarray, part: np.ndarray, asks: np.ndarray, items: list[np.ndarray], least: int) -> list[tuple[int, int]]:
    """Edges that join the parts of a cell: each asking text is compared with all texts of other parts
    by counting, through an inverted index, the shingles that they share."""
    sizes = np.array([len(x) for x in items])
    names, of = np.unique(np.concatenate(items), return_inverse=True)
    cuts = np.concatenate([[0], np.cumsum(sizes)])
    holder = np.repeat(np.arange(len(items)), sizes)[np.argsort(of, kind="stable")]
    begin = np.searchsorted(np.sort(of), np.arange(len(names) + 1))
    edges = []
    for q in np.flatnonzero(asks):
        if (part == part[q]).all():
            break
        lists = [holder[begin[s] : begin[s + 1]] for s in of[cuts[q] : cuts[q + 1]]]
        common = np.bincount(np.concatenate(lists), minlength=len(items))
        near = np.flatnonzero((common * 100 >= (sizes + sizes[q] - common) * least) & (part != part[q]))
        for other in near:
            if part[other] != part[q]:
                edges.append((int(content[q]), int(content[other])))
                part[part == part[other]] = part[q]
    return edges


def _cells(least: int):
    """Of rows (cell, asks, content, part, items) sorted by cell: edges (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(rows: list[tuple]) -> pa.RecordBatch:
            # A text that asks may stand on both sides.
            rows = sorted({r[2]: r for r in sorted(rows, key=lambda r: r[1])}.values(), key=lambda r: r[2])
            edges = []
            if len({r[3] for r in rows}) > 1:
                edges = _forest(np.array([r[2] for r in rows]), np.array([r[3] for r in rows]), np.array([r[1] for r in rows]), [r[4] for r in rows], least)
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["a", "b"])

        held: list[tuple] = []
        for batch in batches:
            sets = batch.column(4)
            ends, flat = sets.offsets.to_numpy(), sets.values.to_numpy()
            for i, row in enumerate(zip(*(batch.column(j).to_pylist() for j in range(4)), strict=True)):
                if held and held[-1][0] != row[0]:
                    yield solved(held)
                    held = []
                held.append((*row, flat[ends[i] : ends[i + 1]].copy()))
        if held:
            yield solved(held)

    return run


def _across(members: DataFrame, nodes: DataFrame, sets: DataFrame, least: int, cell: int) -> DataFrame:
    """Edges between texts of a posting that the comparison with its least text left apart.

    The texts outside of a posting's largest part ask all others. Both sides are dealt to blocks of
    about `cell` shingles; a block of either side is a cell, so the texts that one task holds are
    bounded and a posting of any size is shared out.
    """
    rest = members.where("content <> first").select("posting", "content")
    placed = rest.join(nodes, rest.content == nodes.node, "left").select("posting", "content", F.coalesce("root", "content").alias("part"))
    open_ = placed.groupBy("posting").agg(F.min("part").alias("_low"), F.max("part").alias("_high")).where("_low <> _high").select("posting")
    sized = stash(placed.join(open_, "posting").join(sets.select("content", F.size("items").alias("n")), "content"), "near-open")
    parts = sized.groupBy("posting", "part").agg(F.count("*").alias("members"), F.sum("n").alias("n"))
    plan = parts.groupBy("posting").agg(
        F.max_by("part", F.struct("members", "part")).alias("main"), F.sum("n").alias("_all"), F.max_by("n", F.struct("members", "part")).alias("_main")
    ).select("posting", "main", F.expr(f"_all div {cell} + 1").alias("blocks"), F.expr(f"(_all - _main) div {cell} + 1").alias("asking"))
    dealt = sized.join(plan, "posting")
    own = lambda n: F.expr(f"pmod(xxhash64(content), {n})")
    told = dealt.select("posting", "content", "part", F.lit(False).alias("asks"), own("blocks").alias("x"), F.explode(F.expr("sequence(0L, asking - 1)")).alias("y"))
    asks = dealt.where("part <> main").select("posting", "content", "part", F.lit(True).alias("asks"), F.explode(F.expr("sequence(0L, blocks - 1)")).alias("x"), own("asking").alias("y"))
    cells = told.unionByName(asks).select(F.xxhash64("posting", "x", "y").alias("cell"), "asks", "content", "part")
    full = cells.join(sets, "content").select("cell", "asks", "content", "part", "items")
    return full.repartition("cell").sortWithinPartitions("cell").mapInArrow(_cells(least), "a long, b long")


def similar_texts(docs: DataFrame, shingle: int = 5, least: int = 80, cell: int = CELL) -> DataFrame:
    """doc_id, component_id, row, root for every row of docs(doc_id, text, ...).

    Rows are linked if the Jaccard similarity of their shingles of so many words is `least` per cent
    or more (80 at least: the index is made for that). row: as row_key makes it; component_id: the
    least id of the component, null only if it has no id; root: what the rows of a component share.
    Texts without words, and null, are one class. Repeated rows give repeated results. Other columns
    are not looked at. An empty table gives an empty one.
    """
    if least < 80:
        raise ValueError("the positions of the index are chosen for similarities of 80 per cent or more")
    keyed = docs.select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("row"))
    marked = stash(keyed.mapInArrow(_prints(shingle), "doc_id long, row long, content long, fp binary"), "near-prints")
    classes = marked.groupBy("content").agg(F.min("doc_id").alias("least"), F.min("row").alias("sample"), F.first("fp").alias("fp"))
    keys = F.array(*(F.xxhash64(F.lit(i), F.substring("fp", i * WIDTH + 1, WIDTH)) for i in range(SETS)))
    entries = classes.where("fp is not null").select("content", F.explode(keys).alias("posting"))
    shared = entries.groupBy("posting").agg(F.min("content").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = stash(entries.join(shared, "posting"), "near-members")

    # Only texts that share a posting are read again, and by a key small enough to be broadcast by size.
    wanted = stash(members.select("content").distinct().join(classes.select("content", "fp", F.col("sample").alias("row")), "content"), "near-wanted")
    texts = keyed.join(wanted.select("row", "content"), "row").select("content", "text")
    sets = stash(texts.mapInArrow(_sets(shingle), "content long, items array<long>").dropDuplicates(["content"]), "near-sets")

    stars = members.where("content <> first").select(F.col("first").alias("a"), F.col("content").alias("b")).distinct()
    prints = wanted.select("content", "fp")
    both = stars.join(prints.toDF("b", "_b"), "b").join(prints.toDF("a", "_a"), "a").select("a", "b", "_a", "_b")
    edges = stash(_similar(both.mapInArrow(_tallied, "a long, b long"), sets, least), "near-edges")
    nodes = connected(edges)
    more = stash(_across(members, nodes, sets, least, cell), "near-edges")
    if not more.isEmpty():
        nodes = connected(nodes.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more))
    labelled = classes.join(nodes, classes.content == nodes.node, "left").select("content", "least", F.coalesce("root", "content").alias("root"))
    roots = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    named = labelled.join(roots, "root").select("content", "root", "component_id")
    return marked.join(named, "content").select("doc_id", "component_id", "row", "root")
