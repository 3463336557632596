"""Line dedup with a bound of one edit, by a deletion-neighbourhood join.

A line is its words. Equal lines are one line with its earliest place. Two lines are within one edit
if one word is replaced, added or left out. Every line emits its variants with one word deleted as
hashed keys: lines with a word replaced meet in the variant without it (keyed with its position),
and a line meets one with a word added in that one's variant, which is the line itself. A key only
passes on the earliest place it has, so nothing grows with the square of a crowded key: a line with
an earlier neighbour has one by each key they share. The one found is verified by its words.

Most lines resemble no other. Two lines within one edit share their first or last half (of one of
two lengths, so that lines whose lengths differ by one compare the same), so lines that share no half
with another line are left out before any variants are made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import SLICE_BYTES, buffer_of, hash_ranges, hash_runs, mix, pair, slices, tokens
from ._store import partitions
from .exchange import Items, items_of, matching_items

#: Lines of fewer words are compared for equality only (a parameter): one edit of four words is no
#: near copy.
LEAST_WORDS = 5

_LINE_END = np.zeros(256, bool)
_LINE_END[10] = True
_SALT = np.uint64(0x8CB92BA72F3D8DD7)
#: The id that rows without one are ordered by.
_LAST = (1 << 63) - 1


def _line_words(column: pa.Array) -> tuple[np.ndarray, ...]:
    """Of the lines with a word: the text, the number in the text (all its lines counted), the first
    and the last word; and the hashes of the words."""
    buf, offsets = buffer_of(column)
    start, end, _ = tokens(buf, offsets)
    low, high, lines = tokens(buf, offsets, _LINE_END)
    first, last = np.searchsorted(start, low), np.searchsorted(start, high)
    full = last > first
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(lines))
    breaks = np.concatenate([[0], np.cumsum(buf == 10)])
    number = breaks[low] - breaks[offsets[owner]]
    return owner[full], number[full], first[full], last[full], hash_ranges(buf, start, end)


def _line_items(batches: Iterator[pa.RecordBatch]) -> Iterator[Items]:
    """The lines of rows (oid, tag, text), with 96 bits of hash."""
    for batch in slices(batches):
        owner, number, first, last, words = _line_words(batch.column(2))
        rest = hash_runs(mix(words ^ _SALT), first, last).astype(np.uint32)
        yield batch.column(0).to_numpy(), batch.column(1).to_numpy(), owner, number, hash_runs(words, first, last), rest


def _half_items(batches: Iterator[pa.RecordBatch], least_words: int) -> Iterator[Items]:
    """The halves of the lines of enough words, each with a hash of its line beside it."""
    for batch in slices(batches):
        owner, number, first, last, words = _line_words(batch.column(2))
        line = hash_runs(words, first, last)
        near = np.flatnonzero(last - first >= least_words)
        owner, number, first, last, line = owner[near], number[near], first[near], last[near], line[near]
        n, keys, of = last - first, [], []
        for size in ((n - 1) // 2, n // 2):
            some = np.flatnonzero(size == n // 2) if keys else np.flatnonzero(n // 2 != size)
            size, tag = size[some], mix(size[some].astype(np.uint64))
            keys += [pair(hash_runs(words, first[some], first[some] + size), tag), pair(hash_runs(words, last[some] - size, last[some]), tag ^ _SALT)]
            of += [some, some]
        key, of_ = np.concatenate(keys), np.concatenate(of)
        yield batch.column(0).to_numpy(), batch.column(1).to_numpy(), owner[of_], number[of_], key, line[of_]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (oid, tag, text, alike, equal): oid, tag, line, words of the lines alike and not equal."""
    for batch in slices(batches):
        rows, lines = items_of(batch.column(3))
        gone_rows, gone = items_of(batch.column(4))
        left = np.unique(rows << 32 | lines)
        left = left[~np.isin(left, gone_rows << 32 | gone)]
        texts, split, at = batch.column(2), [], -1
        words = []
        for x in left.tolist():
            if x >> 32 != at:
                at = x >> 32
                split = texts[at].as_py().split("\n")
            words.append(b" ".join(split[x & 0xFFFFFFFF].encode().split()).decode())
        of = pa.array(left >> 32)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(of), batch.column(1).take(of), pa.array(left & 0xFFFFFFFF), pa.array(words, pa.string())], ["oid", "tag", "line", "words"]
        )


def _neighbourhood(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """For lines of words: of each variant the line, its number in the line, its role, and two keys of
    64 bits. Roles: 0 a variant with the position of the word left out, 1 the line itself, 2 a variant."""
    buf, offsets = buffer_of(column)
    start, end, begin = tokens(buf, offsets)
    words, n = hash_ranges(buf, start, end), np.diff(begin)
    line = np.repeat(np.arange(len(n)), n)
    place = (np.arange(len(words)) - begin[line]).astype(np.uint64)
    keys = []
    for base in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)):
        inverse = np.uint64(pow(int(base), -1, 1 << 64))
        powers = np.full(int(n.max(initial=0)) + 1, base, np.uint64)
        powers[0] = 1
        powers = np.cumprod(powers, dtype=np.uint64)
        term = mix(words ^ base) * powers[place.astype(np.int64)]
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(term, out=sums[1:])
        whole = sums[begin[1:]] - sums[begin[:-1]]
        before = sums[:-1] - sums[begin[line]]
        shorter = before + (whole[line] - before - term) * inverse
        keys.append(np.concatenate([pair(shorter, place + _SALT), mix(whole), mix(shorter)]))
    role = np.repeat(np.array([0, 1, 2], np.int32), [len(words), len(n), len(words)])
    number = np.concatenate([place.astype(np.int64), n, n[line] + 1 + place.astype(np.int64)])
    return np.concatenate([line, np.arange(len(n)), line]), number, role, keys


def _variant_items(batches: Iterator[pa.RecordBatch]) -> Iterator[Items]:
    """All variants of lines (id, tag, words), a line standing for a document."""
    for batch in slices(batches, "words", SLICE_BYTES // 8):
        line, number, _, keys = _neighbourhood(batch.column(2))
        yield batch.column(0).to_numpy(), batch.column(1).to_numpy(), line, number, keys[0], None


def _shared_variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For lines (oid, tag, line, words, found): key, more (128 bits), role, oid, tag, line of the
    variants that were found in another line."""
    for batch in slices(batches, "words", SLICE_BYTES // 8):
        line, number, role, keys = _neighbourhood(batch.column(3))
        rows, items = items_of(batch.column(4))
        at = np.flatnonzero(np.isin(line << 32 | number, rows << 32 | items))
        yield pa.RecordBatch.from_arrays(
            [*(pa.array(k[at].view(np.int64)) for k in keys), pa.array(role[at]), *(batch.column(i).take(pa.array(line[at])) for i in range(3))],
            ["key", "more", "role", "oid", "tag", "line"],
        )


def _within_one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps rows (..., words, other) whose last two columns are within one edit."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
            a, b = x.split(" "), y.split(" ")
            same = next((i for i, (p, q) in enumerate(zip(a, b)) if p != q), min(len(a), len(b)))
            keep.append(a[same + (len(a) >= len(b)) :] == b[same + (len(b) >= len(a)) :])
        yield batch.filter(pa.array(keep, pa.bool_()))


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For rows (doc_id, text, equal, near): what is left."""
    for batch in slices(batches):
        marks = [items_of(batch.column(i)) for i in (2, 3)]
        cuts = [np.searchsorted(rows, np.arange(batch.num_rows + 1)) for rows, _ in marks]
        out: list[tuple] = []
        for i, text in enumerate(batch.column(1).to_pylist()):
            lines = text.split("\n") if text is not None else []
            equal, near = (set(items[c[i] : c[i + 1]].tolist()) for (_, items), c in zip(marks, cuts, strict=True))
            kept = "\n".join(x for j, x in enumerate(lines) if j not in equal and j not in near)
            out.append((len(lines), len(equal), len(near), hashlib.sha256(kept.encode()).hexdigest(), kept))
        columns = list(zip(*out, strict=True)) or [()] * 5
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))],
            ["doc_id", "n_lines", "n_equal", "n_near", "kept_sha256", "kept"],
        )


def _packed(lines: DataFrame) -> DataFrame:
    """oid, tag, found: line numbers of each text together, as matching_items() gives them."""
    hexed = F.array_join(F.transform(F.sort_array(F.collect_set("line")), lambda x: F.lpad(F.hex(x), 8, "0")), "")
    turned = F.regexp_replace(hexed, "(..)(..)(..)(..)", "$4$3$2$1")
    return lines.groupBy("oid", "tag").agg(F.unhex(turned).alias("found"))


def line_dedup(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_lines, n_equal, n_near, kept_sha256, kept for every row of docs(doc_id, text, ...).

    Lines stand between line feeds; a line is compared by its words, white space does not count. A
    line goes if it equals one that stands earlier (a smaller doc_id, or higher up in the text), or
    if it has least_words words or more and an earlier line of as many is within one edit of it;
    lines are judged on the input, not on what is left. Lines without words stay. Null ids come
    last (as the largest id; so does the id 2**63 - 1, which comes back as null). A null text has no lines. Rows with equal id and text are one document
    and give equal rows; rows that share only the id come in the order of a hash of their texts.
    Other columns are not looked at. An empty table gives an empty one.
    """
    oid = F.coalesce(F.col("doc_id"), F.lit(_LAST))
    texts = docs.select(oid.alias("oid"), F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF)).alias("tag"), "text")
    on, order = ["oid", "tag"], F.struct("oid", "tag", "line")
    # Every join of the texts is on the same keys: they are shuffled once.
    equal = matching_items(texts, _line_items, "before").select(F.col("doc_id").alias("oid"), "tag", F.col("found").alias("equal"))
    alike = matching_items(texts, partial(_half_items, least_words=least_words), "distinct").select(F.col("doc_id").alias("oid"), "tag", F.col("found").alias("alike"))
    marked = texts.join(alike, on, "left").join(equal, on, "left").select("oid", "tag", "text", "alike", "equal")
    parts = partitions(docs.sparkSession)
    # Rows with equal id and text name the same lines.
    lines = marked.where("alike is not null").mapInArrow(_candidates, "oid long, tag long, line long, words string").repartition(parts, *on).distinct()
    # Only variants that two lines have go on; the others, nearly all, are seen as six bytes once.
    named = lines.withColumns({"lid": F.xxhash64("oid", "tag", "line"), "ltag": F.xxhash64("line", "tag", "oid").bitwiseAND(F.lit(0xFFFFFFFF))})
    shared = matching_items(named.select("lid", "ltag", "words"), _variant_items, "shared", width=6).select(F.col("doc_id").alias("lid"), F.col("tag").alias("ltag"), "found")
    variants = named.join(shared, ["lid", "ltag"]).select("oid", "tag", "line", "words", "found").mapInArrow(
        _shared_variants, "key long, more long, role int, oid long, tag long, line long"
    )
    earliest = variants.groupBy("key", "more", "role").agg(F.min(order).alias("w"))
    # A variant looks for lines that equal it, a line for variants that do.
    meets = earliest.select("key", "more", F.when(F.col("role") == 0, 0).otherwise(3 - F.col("role")).alias("role"), "w")
    pairs = variants.join(meets, ["key", "more", "role"]).where(F.col("w") < order).groupBy("oid", "tag", "line").agg(F.min("w").alias("w"))
    other = lines.select(F.struct("oid", "tag", "line").alias("w"), F.col("words").alias("other"))
    near = (
        pairs.join(lines, ["oid", "tag", "line"]).join(other, "w").select("oid", "tag", "line", "words", "other")
        .mapInArrow(_within_one, "oid long, tag long, line long, words string, other string")
    )
    told = _packed(near).withColumnRenamed("found", "near")
    return (
        texts.join(told, on, "left").join(equal, on, "left")
        .select(F.when(F.col("oid") != _LAST, F.col("oid")).alias("doc_id"), "text", "equal", "near")
        .mapInArrow(_strip, "doc_id long, n_lines long, n_equal long, n_near long, kept_sha256 string, kept string")
    )
