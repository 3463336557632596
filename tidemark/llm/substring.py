"""Substring dedup by recompression: words that repeat from a document with a smaller id are removed.

Recompression shrinks a text in rounds that depend on content alone. A round names each run of one
symbol and then each pair of neighbours of which the first falls in the left half of the alphabet and
the second in the right half (halves by a hash of the symbol, runs of any length with theirs). A name
is a hash of what it stands for, so all tasks give equal strings equal interior symbols, and no table
of names has to be kept or shuffled: three Spark rounds ask which names documents share.

1. High symbols, those of rounds LEVELS (24, 56 and 133 words on average). One that a document with a
   smaller id holds too, verified by a second hash of its words, is a long repeat: all its windows
   repeat, and need no further look. That leaves the windows to the document that has them first, so
   copies of a text send a few symbols in place of all their windows.
2. Symbols of the second round, of one to four words: those that no two documents share rule out the
   windows that they stand for.
3. The windows that are left, across the ends of high symbols and in shorter repeats, are verified
   against all documents by a hash of 96 bits.

Round 2 loses nothing. The second naming round makes pairs only, as naming runs of pairs would hide
where a window's first symbol begins. Let a window of 13 words occur twice, its first nine words without
equal neighbours. Then
 - the first naming round ends a symbol, in both places, after the first or the second word (a word of
   the right half ends its symbol, one of the left half begins one), and so at all later words;
 - the next symbol has two words at most; if it is in the left half the second naming round begins a
   symbol with it, else it ends one: so one of its symbols begins at word 1 to 4 of the window;
 - that symbol ends by word 8 and the nine words from its start are in the window.
So both places hold the same symbol with the same nine words from its start. Windows with equal
neighbours among their first nine words are not ruled out. Nor does round 1: the document with the
smallest id of those that hold a window cannot have it in a repeat of a smaller one, so it sends it.
"""

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import buffer_of, covered, hash_ranges, hash_runs, mix, pair, slices, tokens, windows
from ._store import stash
from .exchange import Items, items_of, matching_items

WINDOW = 13
#: A symbol of the second round begins at one of the words 1 to REACH of a window ...
REACH = 4
#: ... and these words from its start are in the window.
SPAN = WINDOW - REACH
#: Naming rounds of which symbols are looked up as long repeats: each takes a quarter of the symbols
#: away. Which rounds these are decides what is sent, never what is found.
LEVELS = (11, 14, 17)
_OTHER = np.uint64(0x51ED270B0B1F39C1)
#: Neighbours among a window's first words that must differ for that.
HEAD = 8


def _paired(names: np.ndarray, left: np.ndarray, at: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A round of pairs: names, first words and whether it opens a text, of each new symbol."""
    joins = np.zeros(len(names), bool)
    joins[:-1] = left[:-1] & ~left[1:] & ~opens[1:]
    keep = np.ones(len(names), bool)
    keep[1:] = ~joins[:-1]
    new = names.copy()
    first = np.flatnonzero(joins)
    new[first] = pair(names[first], names[first + 1])
    return new[keep], at[keep], opens[keep]


def _runs(names: np.ndarray, at: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names runs of one symbol: names, first words, whether it opens a text, and the symbol repeated."""
    head = opens.copy()
    head[1:] |= names[1:] != names[:-1]
    kept = np.flatnonzero(head)
    length, letter = np.diff(np.append(kept, len(names))), names[kept]
    return np.where(length > 1, pair(letter, length.astype(np.uint64)), letter), at[kept], opens[kept], letter


def rounds(words: np.ndarray, first: np.ndarray, last: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number, names and first words of the symbols of texts of word hashes, round by round."""
    opens = np.zeros(len(words) + 1, bool)
    opens[first] = True
    names, at, opens = words, np.arange(len(words)), opens[:-1]
    for number, salt in enumerate(mix(np.arange(1, last + 1, dtype=np.uint64)), 1):
        letter = names
        if number != 2:
            names, at, opens, letter = _runs(names, at, opens)
        names, at, opens = _paired(names, mix(letter ^ salt) & np.uint64(1) == 0, at, opens)
        yield number, names, at


def symbols(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and first words of the second-round symbols of texts of word hashes."""
    *_, (_, names, at) = rounds(words, first, 2)
    return names, at


def long_symbols(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """Names, a second hash of their words, first words, ends and levels (0, 1, ...) of the symbols of
    rounds LEVELS that hold a window; a symbol that a later round left as it was counts once."""
    out, told = [], np.zeros(len(words) + 1, np.int64)
    other = mix(words ^ _OTHER)
    for number, names, at in rounds(words, first, LEVELS[-1]):
        if number in LEVELS:
            end = np.append(at[1:], len(words))
            new = (end - at >= WINDOW) & (told[at] != end)
            names, at, end = names[new], at[new], end[new]
            told[at] = end
            out.append((names, hash_runs(other, at, end).astype(np.uint32), at, end, np.full(len(at), LEVELS.index(number))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _long_repeats(words: np.ndarray, first: np.ndarray, found: pa.Array) -> np.ndarray:
    """Whether each word begins a window inside of a long repeat of its text (one entry more than words)."""
    edge = np.zeros(len(words) + 1, np.int64)
    rows, items = items_of(found)
    if len(rows):
        _, _, at, end, level = long_symbols(words, first)
        owner = np.searchsorted(first, at, "right") - 1
        hit = np.isin(owner << 32 | (at - first[owner]) << 2 | level, rows << 32 | items)
        edge += np.bincount(at[hit], minlength=len(edge)) - np.bincount(end[hit] - WINDOW + 1, minlength=len(edge))
    return np.cumsum(edge) > 0


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of texts, and the first word of each (one entry more than texts)."""
    buf, offsets = buffer_of(column)
    starts, ends, first = tokens(buf, offsets)
    return hash_ranges(buf, starts, ends), first


def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, tags, word hashes and first words of a batch (doc_id, tag, text, ...); ids not null."""
    return batch.column(0).to_numpy(), batch.column(1).to_numpy(), *_words(batch.column(2))


def _long_items(batches: Iterator[pa.RecordBatch]) -> Iterator[Items]:
    """High symbols of rows (doc_id, tag, text); an item is a place and, in two bits, a level."""
    for batch in slices(batches):
        ids, tags, words, first = _read(batch)
        names, other, at, _, level = long_symbols(words, first)
        owner = np.searchsorted(first, at, "right") - 1
        yield ids, tags, owner, (at - first[owner]) << 2 | level, names, other


def _symbol_items(batches: Iterator[pa.RecordBatch]) -> Iterator[Items]:
    """Second-round symbols of rows (doc_id, tag, text, long) that stand for a window outside of long repeats."""
    for batch in slices(batches):
        ids, tags, words, first = _read(batch)
        sums = np.concatenate([[0], np.cumsum(~_long_repeats(words, first, batch.column(3)))])
        names, at = symbols(words, first)
        owner = np.searchsorted(first, at, "right") - 1
        fits = (at > first[owner]) & (at + SPAN <= first[owner + 1]) & (sums[at] > sums[np.maximum(at - REACH, first[owner])])
        names, at, owner = names[fits], at[fits], owner[fits]
        spans = windows(words, SPAN)
        yield ids, tags, owner, at - first[owner], pair(names, spans[at]), None


def _window_items(batches: Iterator[pa.RecordBatch]) -> Iterator[Items]:
    """Windows of rows (doc_id, tag, text, found, long) that a shared symbol stands for, or none can, outside of long repeats."""
    for batch in slices(batches):
        ids, tags, words, first = _read(batch)
        rows, items = items_of(batch.column(3))
        wanted = np.zeros(len(words) + 1, bool)
        for back in range(1, REACH + 1):
            wanted[np.maximum(first[rows] + items - back, first[rows])] = True
        equal = np.zeros(len(words) + HEAD, np.int64)
        equal[1 : len(words)] = words[1:] == words[:-1]  # a pair across two texts only adds a window
        sums = np.concatenate([[0], np.cumsum(equal)])
        at = np.arange(len(words))
        wanted[:-1] |= sums[at + 1 + HEAD] > sums[at + 1]
        at = np.flatnonzero(wanted[:-1] & ~_long_repeats(words, first, batch.column(4))[:-1])
        owner = np.searchsorted(first, at, "right") - 1
        fits = at + WINDOW <= first[owner + 1]
        at, owner = at[fits], owner[fits]
        low = (windows(words, WINDOW, second=True)[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        yield ids, tags, owner, at - first[owner], windows(words, WINDOW)[at], low


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of rows (doc_id, tag, text, found, long): found windows and long repeats go."""
    for batch in slices(batches):
        long, first = np.zeros(0, np.int64), np.zeros(batch.num_rows + 1, np.int64)
        if batch.column(4).null_count < batch.num_rows:
            hashes, first = _words(batch.column(2))
            long = np.flatnonzero(_long_repeats(hashes, first, batch.column(4)))
        ends = np.searchsorted(long, first)
        texts = batch.column(2).to_pylist()
        rows, items = items_of(batch.column(3))
        cuts = np.searchsorted(rows, np.arange(len(texts) + 1))
        out: tuple[list, list, list, list] = ([], [], [], [])
        for i, text in enumerate(texts):
            words = (text or "").encode().split()
            hit = np.concatenate([items[cuts[i] : cuts[i + 1]], long[ends[i] : ends[i + 1]] - first[i]])
            kept = list(compress(words, ~covered(len(words), hit, WINDOW))) if len(hit) else words
            joined = b" ".join(kept)
            for column, value in zip(out, (len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode()), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
        )


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept (the words left, joined by one space) for every
    row of docs(doc_id, text, ...).

    A word goes if a window of 13 words that covers it also starts in a document with a smaller id.
    A null text has no words. A null id is neither smaller nor larger than any other, so its row
    keeps all words and takes none from others. Rows that share an id take nothing from each other.
    Other columns are not looked at. An empty table gives an empty one.
    """
    tag = F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF))
    texts = docs.select("doc_id", tag.alias("tag"), "text")
    known, on = texts.where("doc_id is not null"), ["doc_id", "tag"]
    # Written, as each later step reads it: the long repeats alone, a few numbers a document.
    long = stash(matching_items(known, _long_items, "first").select(*on, F.col("found").alias("long")), "long-repeats")
    alike = matching_items(known.join(long, on, "left").select(*on, "text", "long"), _symbol_items, "shared", width=6)
    marked = known.join(alike, on, "left").join(long, on, "left").select(*on, "text", "found", "long")
    later = matching_items(marked, _window_items, "first")
    # All joins read the same shuffled texts; rows without an id meet no answer and stay apart.
    told = known.join(later, on, "left").join(long, on, "left").select(*on, "text", "found", "long")
    untold = texts.where("doc_id is null").withColumns({c: F.lit(None).cast("binary") for c in ("found", "long")})
    return told.union(untold).mapInArrow(_strip, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
