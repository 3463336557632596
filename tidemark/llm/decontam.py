"""Benchmark decontamination by greedy string tiling.

Texts become words in lower case without ASCII punctuation. Every five consecutive words of a
benchmark item are a seed. The seeds that documents share with items are found by their hashes and
joined; for each document and item that share enough of them, seeds on one diagonal run together
into matches (the running Karp-Rabin hash has already compared their words), and the longest match
that overlaps no tile is marked again and again until none of five words is left. Tiles may stand in
any order, so passages whose sentences were moved are covered like others; a document in which an
item is covered to `threshold` holds a leak of it.

Which pairs to tile: coverage c of an item of L words takes at least ceil(c * L / 5) of its seeds, so
a leak shares at least one of any len(seeds) - that + 1 of them. The rarest seeds in the benchmark
are taken for these, and phrases that many items share bring no pairs together.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._arrays import buffer_of, hash_ranges, key_runs, slices, tokens, whole_windows, windows
from ._columns import row_key
from ._store import stash

SEED_WORDS = 5
#: Seeds of the benchmark up to which their hashes are broadcast, so that only shared seeds leave
#: the scan of the documents (8 bytes a seed). A larger benchmark is joined without that filter.
FILTER_SEEDS = 4_000_000

_PUNCTUATION = np.ones(256, bool)
_PUNCTUATION[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = False


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and each text's first word."""
    buf, offsets = buffer_of(column)
    keep = _PUNCTUATION[buf]
    kept = np.concatenate([[0], np.cumsum(keep)])
    buf = buf[keep]
    starts, ends, first = tokens(buf, kept[offsets])
    return hash_ranges(buf, starts, ends), first


def _seeds(known: object | None):
    """Of rows (id, text): id, place, seed, words of the text for each seed, or only those in the
    broadcast array of known seeds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = bits = None
        if known is not None:
            wanted = known.value
            bits = np.zeros(1 << 22, bool)
            bits[wanted >> np.uint64(42)] = True
        for batch in slices(batches):
            words, first = _words(batch.column(1))
            at = whole_windows(first, SEED_WORDS)
            seeds = windows(words, SEED_WORDS)[at]
            if wanted is not None:
                some = np.flatnonzero(bits[seeds >> np.uint64(42)])
                place = np.searchsorted(wanted, seeds[some])
                some = some[wanted[np.minimum(place, len(wanted) - 1)] == seeds[some]] if len(wanted) else some[:0]
                at, seeds = at[some], seeds[some]
            owner = np.searchsorted(first, at, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(owner)), pa.array(at - first[owner]), pa.array(seeds.view(np.int64)), pa.array(np.diff(first)[owner])],
                ["id", "place", "seed", "words"],
            )

    return run


def _matches(places: np.ndarray, seeds: np.ndarray, item_places: np.ndarray, item_seeds: np.ndarray) -> list[tuple[int, int, int]]:
    """(length in words, place, place in the item) of the longest matches on each diagonal. Runs grow
    from one place of the text to the next, so what is held is bounded by the item, however often a
    seed stands in either text."""
    order = np.lexsort((item_places, item_seeds))
    item_places, item_seeds = item_places[order], item_seeds[order]
    low, high = np.searchsorted(item_seeds, seeds, "left"), np.searchsorted(item_seeds, seeds, "right")
    out: list[tuple[int, int, int]] = []
    runs: dict[int, int] = {}  # place in the item that the last seed matched -> seeds in the run
    last = -2

    def close(ended: dict[int, int]) -> None:
        out.extend((n + SEED_WORDS - 1, last - n + 1, at - n + 1) for at, n in ended.items())

    for i in np.argsort(places, kind="stable"):
        at = int(places[i])
        if at == last:
            continue  # a row that is there twice
        if at != last + 1:
            close(runs)
            runs = {}
        grown = {int(y): runs.pop(int(y) - 1, 0) + 1 for y in item_places[low[i] : high[i]]}
        close(runs)
        runs, last = grown, at
    close(runs)
    return out


def _tile(matches: list[tuple[int, int, int]]) -> tuple[int, int]:
    """Tiles and words covered: the longest match that overlaps no tile is marked, again and again."""
    queue = [(-size, x, y) for size, x, y in matches]
    heapq.heapify(queue)
    low, tiles, covered = min(x for _, x, _ in queue), 0, 0
    in_text = np.zeros(max(x - size for size, x, _ in queue) - low, bool)
    in_item = np.zeros(max(y - size for size, _, y in queue), bool)
    while queue:
        size, x, y = heapq.heappop(queue)
        free = ~(in_text[x - low : x - low - size] | in_item[y : y - size])
        if free.all():
            in_text[x - low : x - low - size] = in_item[y : y - size] = True
            tiles, covered = tiles + 1, covered - size
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[False], free, [False]])))
        for i, j in zip(edges[::2], edges[1::2], strict=True):
            if j - i >= SEED_WORDS:
                heapq.heappush(queue, (int(i - j), x + int(i), y + int(i)))
    return tiles, covered


def _tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (row, item, of the item or not, place, seed, words of the item) sorted by row and item."""
    out: list[tuple] = []

    def made() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 5
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "item_id", "tiles", "covered", "item_words"])

    for (row, item), (side, places, seeds, words) in key_runs(batches, 2):
        own = side == 1
        matches = _matches(places[~own], seeds[~own], places[own], seeds[own])
        if matches:
            out.append((row, item, *_tile(matches), int(words[own][0])))
        if len(out) >= 5000:
            yield made()
    yield made()


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, filter_seeds: int = FILTER_SEEDS) -> DataFrame:
    """row (as row_key makes it), doc_id, item_id, tiles, covered, item_words, coverage for each
    document of docs(doc_id, text) and item of benchmark(item_id, text) of which it covers
    `threshold` or more.

    Null texts and items have no words, items below five words no seeds: neither takes part. Items
    with a null id are left out; items that share an id are taken as one text each, and a pair is
    reported once with the best of them. A null doc_id is an ordinary value. Repeated rows of docs
    (id and text equal) give one row. Other columns are not looked at. filter_seeds: up to so many
    seeds of the benchmark are broadcast to the scan of the documents; the rows are the same without.
    """
    spark = docs.sparkSession
    # Items that share an id are kept apart by a key of id and text.
    items = benchmark.where("item_id is not null").select(
        "item_id", row_key(F.col("item_id"), F.col("text")).alias("item"), F.lower("text").alias("text")
    ).dropDuplicates(["item"])
    seeds = items.select(F.col("item").alias("id"), "text").mapInArrow(_seeds(None), "id long, place long, seed long, words long").select(
        F.col("id").alias("item"), F.col("place").alias("item_place"), "seed", F.col("words").alias("item_words")
    )
    spread = seeds.groupBy("seed").agg(F.count("*").alias("_spread"))
    need = F.ceil(F.ceil(F.col("item_words") * threshold) / SEED_WORDS)
    rarest = F.row_number().over(Window.partitionBy("item").orderBy("_spread", "item_place"))
    seeds = seeds.join(spread, "seed").withColumn("probe", rarest <= F.col("item_words") - SEED_WORDS + 1 - need + 1).drop("_spread")

    shared = seeds.select("seed").distinct().limit(filter_seeds + 1).toPandas()["seed"].to_numpy(np.int64)
    known = None
    if len(shared) <= filter_seeds:
        known = spark.sparkContext.broadcast(np.sort(shared.view(np.uint64)))
    rows = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row"), "doc_id", "text")
    # Written once: the texts are not cut into words again for each use.
    hits = stash(rows.select(F.col("row").alias("id"), F.lower("text").alias("text")).mapInArrow(
        _seeds(known), "id long, place long, seed long, words long"
    ).select(F.col("id").alias("row"), "place", "seed"), "leak-seeds")
    pairs = hits.select("row", "seed").distinct().join(seeds.where("probe").select("seed", "item"), "seed").select("row", "item").distinct()
    # Either side of a pair goes to its task by itself; places are matched there, so no pairs of places are shuffled.
    of_item = pairs.join(seeds, "item").select("row", "item", F.lit(1).alias("side"), F.col("item_place").alias("place"), "seed", "item_words")
    of_text = pairs.join(seeds.select("item", "seed", "item_words").distinct(), "item").join(hits, ["row", "seed"]).select(
        "row", "item", F.lit(0).alias("side"), "place", "seed", "item_words"
    )
    tiled = (
        of_item.unionByName(of_text).repartition("row", "item").sortWithinPartitions("row", "item")
        .mapInArrow(_tiled, "row long, item long, tiles long, covered long, item_words long")
        .withColumn("coverage", F.col("covered") / F.col("item_words"))
        .where(F.col("coverage") >= threshold)
    )
    best = tiled.join(items.select("item", "item_id"), "item").groupBy("row", "item_id").agg(
        F.max_by(F.struct("tiles", "covered", "item_words", "coverage"), F.struct("coverage", "covered", "tiles")).alias("best")
    )
    named = best.join(rows.select("row", "doc_id"), "row")
    return named.dropDuplicates(["row", "item_id"]).select("row", "doc_id", "item_id", "best.*")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that hold no leak."""
    bad = find_leaks(docs, benchmark, threshold).select(F.col("row").alias("_row")).distinct()
    key = row_key(F.col("doc_id"), F.col("text"))
    return docs.join(bad, key == F.col("_row"), "left_anti")
