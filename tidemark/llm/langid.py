"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed n-grams of each language in Spark (a task adds up dense counts and sends
the non-zero ones); the matrix of log-probabilities, of fixed size in the hash and one column for
each language, is broadcast. Scoring is a product of sparse rows (the n-grams of a text) with that
matrix, a slice of texts at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrays import slices
from ._store import stash

#: Characters that are hashed at a time.
_CHARS = 1 << 19
_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    """For each code point whether Unicode calls it a letter."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _letters


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    #: log-probability of each n-gram bucket in each language; a last row of zeros
    weights: np.ndarray
    prior: np.ndarray
    sizes: tuple[int, ...]


def _characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the texts in lower case, each text between two blanks, anything but letters
    as a blank; where each text begins and the last ends; whether each has a letter."""
    lowered = [f" {t.lower()} " if t else "  " for t in texts]
    first = np.cumsum([0, *map(len, lowered)])
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[points]
    seen = np.concatenate([[0], np.cumsum(letter)])
    return np.where(letter, points, np.uint32(32)), first, seen[first[1:]] > seen[first[:-1]]


def _grams(points: np.ndarray, first: np.ndarray, sizes: tuple[int, ...], bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Stretches of the hashed n-grams of the points: from which point, and a bucket for each; those
    that run over the end of a text fall in the bucket 2**bits, which counts for nothing."""
    for n in sizes:
        over = np.zeros(len(points), bool)
        for k in range(1, n):
            over[first[1:] - k] = True
        for at in range(0, len(points) - n + 1, _CHARS):
            end = min(at + _CHARS, len(points) - n + 1)
            h = np.full(end - at, n, np.uint32)
            for k in range(n):
                h = (h ^ points[at + k : end + k]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
            yield at, np.where(over[at:end], 1 << bits, h >> np.uint32(32 - bits))


def train(labelled: DataFrame, sizes: tuple[int, ...] = (1, 2, 3), bits: int = 15, smoothing: float = 0.1, max_languages: int = 256) -> LanguageModel:
    """Learns from labelled(text, lang), neither null. All rows count; what a task holds, comes to the
    driver and is broadcast is bounded by max_languages x 2**bits numbers, and more languages are an
    error. Without rows the model knows no language."""

    def check(languages: int) -> None:
        if languages > max_languages:
            raise ValueError(f"more than {max_languages} languages: is lang a language?")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for batch in slices(batches):
            langs = batch.column(1).to_pylist()
            names = sorted(set(langs))
            number = np.array([names.index(x) for x in langs])
            points, first, _ = _characters(batch.column(0).to_pylist())
            owner = np.repeat(number, np.diff(first))
            width = (1 << bits) + 1
            check(len(names))
            sums = np.zeros(len(names) * width, np.int64)
            for at, h in _grams(points, first, sizes, bits):
                sums += np.bincount(owner[at : at + len(h)] * width + h, minlength=len(sums))
            for i, name in enumerate(names):
                part = sums[i * width : (i + 1) * width - 1]
                totals[name] = totals.get(name, 0) + part
                texts[name] = texts.get(name, 0) + int((number == i).sum())
            check(len(totals))
        for name, sums in totals.items():
            some = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * (len(some) + 1)), pa.array(np.append(some, -1), pa.int64()), pa.array(np.append(sums[some], texts[name]), pa.int64())],
                ["lang", "bucket", "n"],
            )

    counted = labelled.select("text", "lang").mapInArrow(count, "lang string, bucket long, n long")
    summed = stash(counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "language-counts")
    check(summed.select("lang").distinct().count())
    found = summed.toPandas()
    languages = sorted(found.lang.unique().tolist())
    counts, texts = np.zeros((1 << bits, len(languages))), np.zeros(len(languages))
    column = found.lang.map({x: i for i, x in enumerate(languages)}).to_numpy(int)
    bucket, n = found.bucket.to_numpy(int), found.n.to_numpy(float)
    counts[bucket[bucket >= 0], column[bucket >= 0]] = n[bucket >= 0]
    texts[column[bucket < 0]] = n[bucket < 0]
    smooth = counts + smoothing
    weights = np.log(smooth / smooth.sum(axis=0)) if languages else smooth
    prior = np.log(texts / texts.sum()) if languages else texts
    weights = np.vstack([weights, np.zeros((1, len(languages)))])
    return LanguageModel(languages, weights.astype(np.float32), prior, sizes)


def identify(docs: DataFrame, model: LanguageModel, keep: list[str]) -> DataFrame:
    """The kept columns, lang_pred and score for every row of docs(text, ...).

    score: the probability of lang_pred given the text. A text that is null or has no letter, or a
    model without languages, gives `und` and 0. Equal scores go to the first language by code point.
    Only text is looked at.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        bits = (len(m.weights) - 1).bit_length() - 1
        for batch in slices(batches):
            text = batch.schema.get_field_index("text")
            points, first, known = _characters(batch.column(text).to_pylist())
            logs = np.tile(m.prior, (len(first) - 1, 1))
            if m.languages:
                for at, h in _grams(points, first, m.sizes, bits):
                    # n-grams of a text: those that begin in it
                    low, high = np.searchsorted(first, at, "right") - 1, np.searchsorted(first, at + len(h), "left")
                    cuts = np.maximum(first[low:high] - at, 0)
                    logs[low:high] += np.add.reduceat(m.weights[h], cuts, axis=0, dtype=np.float64)
                best = logs.argmax(axis=1)
                odds = np.exp(logs - logs.max(axis=1, keepdims=True))
                p = np.where(known, 1 / odds.sum(axis=1), 0.0)
            else:
                best, p, known = np.zeros(len(known), int), np.zeros(len(known)), np.zeros(len(known), bool)
            names = [m.languages[b] if k else "und" for b, k in zip(best, known, strict=True)]
            others = [c for i, c in enumerate(batch.columns) if i != text]
            yield pa.RecordBatch.from_arrays([*others, pa.array(names, pa.string()), pa.array(p, pa.float64())], [*keep, "lang_pred", "score"])

    kept = docs.select(*keep, "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(score, f"{fields}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: a quarter of the ids; a null id never is."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs(doc_id, text, lang, ...).

    Learns from the rows that have an id, a text and a language and are not held out.
    """
    out = held_out(F.col("doc_id"))
    model = train(docs.where(~out & F.expr("doc_id is not null and text is not null and lang is not null")))
    return identify(docs.select("doc_id", out.alias("held_out"), "text"), model, ["doc_id", "held_out"])
