"""SimHash fingerprints and their near-duplicate components.

Fingerprints of eight bytes that differ in at most three bits share at least five whole bytes, so
linked pairs come from an inverted index over byte positions with count filtering: a posting holds
the fingerprints that agree in the bytes of one position set, the shared positional bytes of a pair
are tallied, pairs below the guaranteed five are dropped and the others verified bit by bit.

Postings of one byte would hold every 256th document. The index uses the fourteen sets of four
positions whose numbers XOR to zero: any three positions lie in just one such set, hence the three
bytes that may differ are all within one set and the opposite set is wholly shared. Every linked
pair meets in a posting of 32 bits, and fourteen keys a fingerprint are enough.

A posting only has to say what is connected: each gives the edges of a spanning forest, never all
pairs. A posting over `limit` members is split by a fifth shared byte (pairs need five) and is not held;
a posting of five bytes has three free ones, that is 2**24 distinct fingerprints at most, and a large one
is linked by looking up the fingerprints within the bound, not by comparing pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._arrays import SPACE, buffer_of, slices, tokens
from ._columns import row_key
from ._store import stash
from .components import connected
from .jaccard import similar_texts

#: Sets of four byte positions that XOR to zero.
POSITION_SETS = [s for s in combinations(range(8), 4) if not s[0] ^ s[1] ^ s[2] ^ s[3]]
SHARED_BYTES = 5
MAX_BITS = 3
#: Members of a posting of five bytes from which looking up is faster than comparing.
LOOKUP = 4096

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LANES = np.uint64(0x0101010101010101)


def _majority(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each text the bits that are set in over half of its hashes."""
    counts = np.diff(first)
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    # Blocks of up to 255 hashes, so that eight byte counters fit in one number.
    blocks = -(-counts[full] // 255)
    begin = np.cumsum(blocks) - blocks
    inside = np.arange(int(blocks.sum())) - np.repeat(begin, blocks)
    at = np.repeat(first[full], blocks) + 255 * inside
    for k in range(8):
        lanes = (hashes >> np.uint64(k)) & _LANES
        sums = np.add.reduceat(lanes, at).view(np.uint8).reshape(-1, 8)
        votes = np.add.reduceat(sums.astype(np.int64), begin, axis=0)
        bits = votes * 2 > counts[full][:, None]
        out[full] |= (bits.astype(np.uint64) << (np.arange(8, dtype=np.uint64) * np.uint64(8) + np.uint64(k))).sum(axis=1, dtype=np.uint64)
    return out


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hash64 = xxhash.xxh64_intdigest
        for batch in slices(batches):
            buf, offsets = buffer_of(batch.column(1))
            starts, ends, first = tokens(buf, offsets)
            # The words again, with one space after each.
            sizes = ends - starts
            to = np.cumsum(sizes + 1)
            joined = np.full(int(to[-1]) if len(to) else 0, 32, np.uint8)
            inside = np.ones(len(joined), bool)
            inside[to - 1] = False
            joined[inside] = _LOWER[buf[~SPACE[buf]]]
            data = joined.tobytes()
            begin, end = to - sizes - 1, to - 1
            counts = np.diff(first)
            n = np.where(counts >= shingle, counts - shingle + 1, np.minimum(counts, 1))
            shingles = np.zeros(len(n) + 1, np.int64)
            np.cumsum(n, out=shingles[1:])
            at = np.arange(shingles[-1]) + np.repeat(first[:-1] - shingles[:-1], n)
            last = at + np.repeat(np.minimum(np.maximum(counts, 1), shingle) - 1, n)
            hashes = np.fromiter(
                (hash64(data[a:b], 42) for a, b in zip(begin[at].tolist(), end[last].tolist(), strict=True)), np.uint64, len(at)
            )
            bits = _majority(hashes, shingles)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(bits.view(np.int64))], ["doc_id", "row", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, row, fp (the 64 bits as a long) for every row of docs(doc_id, text)."""
    keyed = docs.select("doc_id", "text", row_key(F.col("doc_id"), F.col("text")).alias("row"))
    return keyed.mapInArrow(_fingerprints(shingle), "doc_id long, row long, fp long")


def _forest(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links among distinct fingerprints."""
    rest, ends = prints, ([], [])
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            x = front.pop()
            apart = x ^ rest
            tally = (apart.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
            near = tally >= SHARED_BYTES
            near[near] = np.bitwise_count(apart[near]) <= MAX_BITS
            if near.any():
                found = rest[near]
                ends[0].append(np.full(len(found), x, np.uint64))
                ends[1].append(found)
                front.extend(found)
                rest = rest[~near]
    empty = np.zeros(0, np.uint64)
    return np.concatenate([empty, *ends[0]]), np.concatenate([empty, *ends[1]])


def _by_lookup(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for many fingerprints that vary in few bits: for each change of at most MAX_BITS of these
    bits, all fingerprints look up whether the changed one is there; labels sink to the least place."""
    prints = np.sort(prints)
    varying = int(np.bitwise_or.reduce(prints ^ prints[0]))
    bits = [1 << b for b in range(64) if varying >> b & 1]
    changes = [np.uint64(sum(c)) for k in range(1, MAX_BITS + 1) for c in combinations(bits, k)]
    label = np.arange(len(prints))
    while True:
        before = label.copy()
        for change in changes:
            wanted = prints ^ change
            at = np.minimum(np.searchsorted(prints, wanted), len(prints) - 1)
            i = np.flatnonzero(prints[at] == wanted)
            label[i] = np.minimum(label[i], label[at[i]])
        label = label[label]
        if np.array_equal(label, before):
            moved = np.flatnonzero(label != np.arange(len(prints)))
            return prints[moved], prints[label[moved]]


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def _postings(limit: int | None):
    """Of rows (posting, fp, members of the posting) sorted by posting: edges, and the members of postings
    over the limit as edges to themselves. Holds one posting, of at most `limit` or 2**24 members."""

    def closed(prints: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
        """prints: members of whole postings, which begin at the cuts."""
        sizes = np.diff(np.append(cuts, len(prints)))
        twos = cuts[sizes == 2]
        a, b = prints[twos], prints[twos + 1]
        apart = a ^ b
        near = (apart.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= SHARED_BYTES
        near &= np.bitwise_count(apart) <= MAX_BITS
        left, right = [a[near]], [b[near]]
        for at, size in zip(cuts[sizes > 2], sizes[sizes > 2], strict=True):
            x, y = (_by_lookup if limit is None and size > LOOKUP else _forest)(prints[at : at + size])
            left.append(x)
            right.append(y)
        return _edges(np.concatenate(left), np.concatenate(right))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None
        for batch in batches:
            keys, prints, members = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()
            if limit is not None and (members > limit).any():
                over = members > limit
                yield _edges(prints[over], prints[over])
                keys, prints = keys[~over], prints[~over]
            if not len(keys):
                continue
            cuts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            if held and keys[0] != key:
                yield closed(np.concatenate(held), np.zeros(1, np.int64))
                held = []
            if len(cuts) > 1:
                if held:  # the first posting of the batch ends here
                    yield closed(np.concatenate([*held, prints[: cuts[1]]]), np.zeros(1, np.int64))
                    prints, cuts = prints[cuts[1] :], cuts[1:] - cuts[1]
                if len(cuts) > 1:
                    yield closed(prints[: cuts[-1]], cuts[:-1])
                held, prints = [], prints[cuts[-1] :]
            held.append(prints)
            key = keys[-1]
        if held:
            yield closed(np.concatenate(held), np.zeros(1, np.int64))

    return run


def _gathered(prints: DataFrame, sets: list[tuple[int, ...]], limit: int | None) -> DataFrame:
    """What comes of each posting. The window that counts members has dealt and sorted them by posting."""
    masks = [sum(0xFF << (8 * p) for p in s) for s in sets]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    entry = F.explode(F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(signed)))).alias("posting")
    members = F.count("*").over(Window.partitionBy("posting"))
    dealt = prints.select(entry, "fp").withColumn("members", members).where("members > 1").select("posting", "fp", "members")
    return dealt.mapInArrow(_postings(limit), "a long, b long")


def links(prints: DataFrame, limit: int = 8192) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all links.

    prints: one column fp, no value twice.
    """
    found = stash(_gathered(prints, POSITION_SETS, limit), "simhash-edges")
    large = found.where("a = b").select(F.col("a").alias("fp")).distinct()
    if large.isEmpty():
        return found
    fifth = list(combinations(range(8), SHARED_BYTES))
    return found.where("a <> b").unionByName(_gathered(large, fifth, None))


def near_duplicates(docs: DataFrame, shingle: int = 3, limit: int = 8192, similarity: int | None = None) -> DataFrame:
    """doc_id, fingerprint, component_id, row, root for every row of docs(doc_id, text, ...).

    similarity: link texts whose shingle sets have this Jaccard similarity in per cent, instead of
    fingerprints of at most MAX_BITS differing bits (jaccard.py; the result has no fingerprint).

    row: as row_key makes it; root: what the rows of a component share, also where no id is known.

    A null text, like one without words, has fingerprint zero. Rows with equal fingerprints are one
    class. A null id is no candidate for component_id (null only if its whole component has no id).
    Repeated rows give repeated results; an empty table gives an empty one. Other columns are not
    looked at.
    """
    if similarity is not None:
        return similar_texts(docs, shingle, similarity)
    marked = stash(fingerprints(docs, shingle), "simhash-prints")
    classes = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    edges = links(classes.select("fp"), limit)
    nodes = connected(edges)  # node, root: fingerprints
    labelled = classes.join(nodes, classes.fp == nodes.node, "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    roots = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    named = labelled.join(roots, "root").select("fp", "root", "component_id")
    return marked.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "row", "root"
    )
