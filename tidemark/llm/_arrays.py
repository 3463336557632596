"""Small vectorised text helpers that run inside Spark tasks on Arrow batches.

Texts of a batch lie one after another in a byte buffer; words, lines and their hashes are arrays of
positions in it. Hashes are polynomials modulo 2**64 over bytes (or over word hashes), taken from
prefix sums and then mixed, so every task gives the same text the same number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a task works on at a time (a longer text is a slice of its own).
SLICE_BYTES = 2 << 20
_STEP = 1 << 18
_BASE, _WORDS_A, _WORDS_B = (np.uint64(x) for x in (0x9E3779B97F4A7C15 | 5, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F5))

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        size = max(n, _STEP + 1)
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        both = []
        for b in (base, inverse):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p, dtype=np.uint64))
        have = _powers[int(base)] = (both[0], both[1])
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every input bit moves about half of the output bits."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of an ordered pair."""
    return mix(a * np.uint64(0x9FB21C651E98DF25) + mix(b + np.uint64(0x632BE59BD9B4E019)))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in pieces of about `limit` bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def buffer_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of the texts, one after another, and where each begins and the last ends."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def tokens(buf: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of other bytes than `breaks`, and the number of the first
    run of each text (one more entry than there are texts)."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = ~breaks[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hash_ranges(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each range; ranges are in order and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + _STEP, "right")))
        piece = buf[low : int(ends[to - 1])]
        power, inverse = _power(_BASE, len(piece) + 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * power[: len(piece)], out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        at = to
    return out


def windows(words: np.ndarray, size: int, second: bool = False) -> np.ndarray:
    """A hash of each `size` consecutive word hashes (they may run over text ends); second: another hash."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.empty(n, np.uint64)
    base = _WORDS_B if second else _WORDS_A
    for at in range(0, n, _STEP):
        piece = words[at : min(at + _STEP, n) + size - 1]
        power, inverse = _power(base, len(piece) + 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece * power[: len(piece)], out=sums[1:])
        m = len(piece) - size + 1
        out[at : at + m] = mix((sums[size : size + m] - sums[:m]) * inverse[:m])
    return out


def whole_windows(first: np.ndarray, size: int) -> np.ndarray:
    """Where windows of `size` words start that lie within one text. first: as from tokens()."""
    counts = np.maximum(np.diff(first) - (size - 1), 0)
    total = int(counts.sum())
    begin = np.cumsum(counts) - counts
    return np.arange(total) + np.repeat(first[:-1] - begin, counts)


def hash_runs(words: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each run of word hashes; runs are in order and do not overlap."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, low + _STEP, "right")))
        piece = words[low : int(ends[to - 1])]
        power, inverse = _power(_WORDS_A, len(piece) + 1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece * power[: len(piece)], out=sums[1:])
        s, e = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix((sums[e] - sums[s]) * inverse[s] + (e - s).astype(np.uint64))
        at = to
    return out


def covered(n: int, starts: np.ndarray, size: int) -> np.ndarray:
    """Which of n words lie in a window of `size` words from one of the starts."""
    edge = np.bincount(starts, minlength=n + 1) - np.bincount(np.minimum(starts + size, n), minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def sum_by_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the values of each text. first: the number of each text's first value, and the end."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]


def key_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[np.ndarray]]]:
    """The rows of each key of batches sorted by their first `keys` columns (integers, not null): the
    key and the other columns. Holds one key's rows and a batch at a time."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(pair) for pair in zip(held, columns, strict=True)]
        if not len(columns[0]):
            continue
        fresh = np.zeros(len(columns[0]), bool)
        fresh[0] = True
        for c in columns[:keys]:
            fresh[1:] |= c[1:] != c[:-1]
        cuts = np.flatnonzero(fresh)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield tuple(int(c[a]) for c in columns[:keys]), [c[a:b] for c in columns[keys:]]
        held = [c[cuts[-1] :] for c in columns]
    if held is not None and len(held[0]):
        yield tuple(int(c[0]) for c in held[:keys]), held[keys:]
