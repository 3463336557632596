"""Quality rules of documents, with line frequencies across the documents of a host.

A document's own counts come first (words, symbols, repeated lines and word windows). Then its
lines, normalised (ASCII letters in lower case, one space between words), are hashed and counted by
distinct documents of the host; lines on more documents than the limit are taken off, and a document
is rejected as depleted if too few of its words are left, or fewer than any document must have. Copies of a text on a host are one document there, so
that a text is not rejected for being copied.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import buffer_of, covered, hash_ranges, hash_runs, mix, slices, sum_by_text, tokens, whole_windows, windows
from ._columns import source_key
from ._store import stash

_LINE_END = np.zeros(256, bool)
_LINE_END[10] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeats(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more, and which have occurred before."""
    order = np.argsort(keys, kind="stable")
    same = keys[order[1:]] == keys[order[:-1]]
    again, shared = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    again[order[1:]] = same
    shared[order[1:]] = same
    shared[order[:-1]] |= same
    return shared, again


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        buf, offsets = buffer_of(batch.column(2))
        texts = len(offsets) - 1
        start, end, first = tokens(buf, offsets)
        n_words = np.diff(first)
        text_of = np.repeat(np.arange(texts, dtype=np.uint64), n_words)
        words = hash_ranges(buf, start, end)
        chars = np.zeros(len(buf) + 1, np.int64)
        np.cumsum((buf & 0xC0) != 0x80, out=chars[1:])
        at = whole_windows(first, 3)
        shared, _ = _repeats(mix(windows(words, 3)[at] + mix(text_of[at])))
        repeated = covered(len(words), at[shared], 3)

        low, high, lines = tokens(buf, offsets, _LINE_END)
        line_words = np.searchsorted(start, low), np.searchsorted(start, high)
        full = line_words[1] > line_words[0]
        owner = np.repeat(np.arange(texts), np.diff(lines))[full]
        tag = mix(owner.astype(np.uint64))
        _, again = _repeats(mix(hash_ranges(buf, low[full], high[full]) + tag))

        lowered = hash_ranges(_LOWER[buf], start, end)
        begin, stop = line_words[0][full], line_words[1][full]
        normal = hash_runs(lowered, begin, stop)
        order = np.lexsort((normal, owner))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (normal[order[1:]] != normal[order[:-1]]) | (owner[order[1:]] != owner[order[:-1]])
        groups = np.flatnonzero(fresh)
        sizes = np.add.reduceat((stop - begin)[order], groups) if len(groups) else np.zeros(0, np.int64)
        ends = np.zeros(texts + 1, np.int32)
        np.cumsum(np.bincount(owner[order[groups]], minlength=texts), out=ends[1:])
        counts = {
            "n_words": n_words,
            "word_chars": sum_by_text(chars[end] - chars[start], first),
            "n_symbols": sum_by_text(_SYMBOL[buf], offsets),
            "n_dup_lines": np.bincount(owner[again], minlength=texts),
            "n_repeat_words": sum_by_text(repeated, first),
        }
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0), batch.column(1), *(pa.array(counts[c].astype(np.int64)) for c in _COUNTS),
                pa.array(hash_runs(words, first[:-1], first[1:]).view(np.int64)),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(normal[order[groups]].view(np.int64))),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(sizes.astype(np.int64))),
            ],
            ["doc_id", "host", *_COUNTS, "content", "lines", "sizes"],
        )


def quality_rules(
    docs: DataFrame,
    host: str = "source",
    min_words: int = 50,
    max_repeated: int = 50,
    least_documents: int = 4,
    host_share: float = 0.05,
    least_left: float = 0.5,
    with_gone: bool = False,
) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, lost_words,
    kept for every row of docs(doc_id, text, host column).

    base_failed: fewer than min_words words, or over max_repeated per cent of them in repeated
    three-word windows. A line goes if it is on more distinct documents of the host than
    least_documents and than host_share of them; lost_words counts its words. A document with less
    than least_left of its words left, or fewer than min_words words, is rejected. A null text has no words and so fails; a null
    host is a host of its own; ids may be null or repeat, each row is judged by itself. Other
    columns are not looked at. An empty table gives an empty one. with_gone adds gone: the hashes of
    the lines that go, for without_lines(); null where none does.
    """
    narrow = docs.select("doc_id", source_key(F.col(host)).alias("host"), "text")
    schema = f"doc_id long, host string, {', '.join(f'{c} long' for c in _COUNTS)}, content long, lines array<long>, sizes array<long>"
    # The row's number keeps rows with equal ids apart; the table is written before it is used twice.
    marked = stash(narrow.mapInArrow(_features, schema).withColumn("row", F.monotonically_increasing_id()), "quality")
    distinct = marked.select("host", "content", "lines").dropDuplicates(["host", "content"])
    hosts = distinct.groupBy("host").agg(F.greatest(F.lit(least_documents), F.count("*") * F.lit(host_share)).alias("limit"))
    common = (
        distinct.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("documents"))
        .where(F.col("documents") > least_documents)
        .join(hosts, "host").where("documents > limit").select("host", "line")
    )
    lost = (
        marked.select("row", "host", F.explode(F.arrays_zip("lines", "sizes")).alias("x"))
        .select("row", "host", F.col("x.lines").alias("line"), F.col("x.sizes").alias("words"))
        .join(common, ["host", "line"]).groupBy("row").agg(F.sum("words").alias("lost_words"), *([F.collect_set("line").alias("gone")] if with_gone else []))
    )
    left = F.col("n_words") - F.col("lost_words")
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeated)
    return (
        marked.join(lost, "row", "left")
        .withColumn("lost_words", F.coalesce("lost_words", F.lit(0)))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~failed & (left >= F.col("n_words") * least_left) & (left >= min_words))
        .select("doc_id", *_COUNTS, "base_failed", "lost_words", "kept", *(["gone"] if with_gone else []))
    )


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        names = batch.schema.names
        texts, lost = batch.column(names.index("text")), batch.column(names.index("gone"))
        cut = lost.is_valid()
        some = texts.filter(cut)
        if len(some):
            buf, offsets = buffer_of(some)
            start, end, _ = tokens(buf, offsets)
            low, high, lines = tokens(buf, offsets, _LINE_END)
            begin, stop = np.searchsorted(start, low), np.searchsorted(start, high)
            normal = hash_runs(hash_ranges(_LOWER[buf], start, end), begin, stop).view(np.int64)
            out = []
            for i, (text, gone) in enumerate(zip(some.to_pylist(), lost.filter(cut).to_pylist(), strict=True)):
                if text and gone:
                    own = slice(lines[i], lines[i + 1])
                    drop = iter((np.isin(normal[own], gone) & (stop[own] > begin[own])).tolist())
                    text = "\n".join(x for x in text.split("\n") if not (x and next(drop)))
                out.append(text)
            texts = pc.replace_with_mask(texts, cut, pa.array(out, texts.type))
        kept = [n for n in names if n != "gone"]
        yield pa.RecordBatch.from_arrays([texts if n == "text" else batch.column(names.index(n)) for n in kept], kept)


def without_lines(texts: DataFrame) -> DataFrame:
    """Rows with columns text, gone and any others: all but gone, the texts without the lines whose
    hashes are in gone; a row whose gone is null stays as it is."""
    return texts.mapInArrow(_strip, texts.drop("gone").schema)
