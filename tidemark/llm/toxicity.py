"""Toxicity by multiple-instance learning: labels are of documents, scores are of sentences.

A sentence's score is a logistic function of the words and word beginnings in it that are selected, and
0 where there are none; a document's is the noisy-or of its sentences and a small leak: the probability
that at least one of them is toxic, or that the document is for another reason. A long document is thus
not more toxic for its plain sentences. The weights are fitted to the labels of documents through the
noisy-or, by rounds of a distributed gradient over a bounded, documented sample of the labelled
documents, so it is learned which sentences of a toxic document make it so. Those are returned with
their places.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrays import hash_ranges, mix, slices
from ._store import partitions, stash

#: Lengths of the word beginnings that are features besides the word.
BEGINNINGS = (3, 4, 5, 6, 7)
#: Scale at which gradients are summed: as integers, so that the sums do not depend on their order.
_UNIT = float(1 << 32)
#: Where the bias of a sentence starts: one feature alone does not make it toxic.
FIRST_BIAS = -4.0
_folded: np.ndarray | None = None


def _fold_table() -> np.ndarray:
    """For each code point the letter it is in lower case, 0 for all that are no letters."""
    global _folded
    if _folded is None:
        low = (c.lower() if c.isalpha() else "\0" for c in map(chr, range(0x110000)))
        _folded = np.fromiter((ord(c) if len(c) == 1 else ord(c[0]) for c in low), np.uint32, 0x110000)
    return _folded


_ENDS = np.array([ord(c) for c in ".!?…。！？"], np.uint32)


@dataclass(frozen=True)
class Sentences:
    """The sentences with a word of a batch of texts: text, first and end code point of each, and the
    sentence and the bucket of every feature (a word or a beginning; repeats are there)."""

    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    owner: np.ndarray
    bucket: np.ndarray


def sentences(texts: list[str | None], bits: int, known: np.ndarray | None = None) -> Sentences:
    """A sentence ends with a line, or with a mark of _ENDS before white space. known: which buckets
    count; the others' features are left out."""
    whole = [f"{t or ''}\n" for t in texts]
    first = np.cumsum([0, *map(len, whole)])
    points = np.frombuffer("".join(whole).encode("utf-32-le", "surrogatepass"), np.uint32)
    low = _fold_table()[points]
    letter = low != 0
    edge = np.diff(np.concatenate([[False], letter, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    blank = (points == 10) | (points == 32) | ((points >= 9) & (points <= 13))
    stop = points == 10
    stop[:-1] |= np.isin(points[:-1], _ENDS) & blank[1:]
    stops = np.flatnonzero(stop)
    of_word = np.searchsorted(stops, starts)
    used, word_owner = np.unique(of_word, return_inverse=True)
    begin = np.where(used > 0, stops[used - 1] + 1, 0) if len(used) else used
    finish = stops[used] + 1 if len(used) else used
    text = np.searchsorted(first, begin, "right") - 1
    owners, buckets = [], []

    def take(h: np.ndarray, owner: np.ndarray, tag: int) -> None:
        b = (mix(h ^ np.uint64(tag * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(64 - bits)).astype(np.int64)
        keep = slice(None) if known is None else known[b]
        owners.append(owner[keep])
        buckets.append(b[keep])

    take(hash_ranges(low, starts, ends), word_owner, 1)
    h, at, owner, left = np.zeros(len(starts), np.uint64), starts, word_owner, ends - starts
    for n in range(1, max(BEGINNINGS) + 1):
        long = left >= n
        h, at, owner, left = h[long], at[long], owner[long], left[long]
        h = (h ^ low[at + n - 1].astype(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
        if n in BEGINNINGS:
            take(h, owner, n + 1)
    base = first[text]
    end = np.minimum(finish, first[text + 1] - 1)  # without the line end that was added
    return Sentences(text, begin - base, end - base, np.concatenate(owners), np.concatenate(buckets))


@dataclass(frozen=True)
class ToxicityModel:
    bits: int
    #: bucket of each feature, ascending, and its weight
    buckets: np.ndarray
    weights: np.ndarray
    bias: float
    #: score of a document without any sentence that counts
    leak: float

    def index(self) -> tuple[np.ndarray, np.ndarray]:
        """Whether a bucket is a feature, and which."""
        known, place = np.zeros(1 << self.bits, bool), np.zeros(1 << self.bits, np.int32)
        known[self.buckets], place[self.buckets] = True, np.arange(len(self.buckets))
        return known, place


def _count(labelled: DataFrame, bits: int) -> DataFrame:
    """bucket, toxic, clean: how many documents of labelled(text, toxic) have a feature; bucket -1: all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, rows = np.zeros((2, 1 << bits), np.int64), np.zeros(2, np.int64)
        for batch in slices(batches):
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            s = sentences(batch.column(0).to_pylist(), bits)
            each = np.unique((s.text[s.owner] << bits) | s.bucket)
            label = toxic[each >> bits]
            for y in (0, 1):
                counts[y] += np.bincount(each[label == y] & ((1 << bits) - 1), minlength=1 << bits)
                rows[y] += int((toxic == y).sum())
        some = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(some, -1)), pa.array(np.append(counts[1, some], rows[1])), pa.array(np.append(counts[0, some], rows[0]))], ["bucket", "toxic", "clean"]
        )

    counted = labelled.select("text", "toxic").mapInArrow(run, "bucket long, toxic long, clean long")
    return counted.groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def select_features(counts: DataFrame, most: int, gain: float, odds: float) -> tuple[np.ndarray, np.ndarray, int, int]:
    """The buckets, at most `most`, that say most about the label: by the log-likelihood ratio, `gain` or
    more, of those `odds` times as frequent in toxic as in other documents; the logarithm of how many times
    that is; how many documents are toxic, and how many are not."""
    total = counts.where("bucket < 0").head()
    if total is None or not total.toxic or not total.clean:
        return np.zeros(0, np.int64), np.zeros(0), total.toxic if total else 0, total.clean if total else 0
    p, n = float(total.toxic), float(total.clean)
    a, b = F.col("toxic").cast("double"), F.col("clean").cast("double")
    part = lambda x, of: F.when(x > 0, x * F.log(x / ((a + b) * (of / (p + n))))).otherwise(F.lit(0.0))
    away = lambda x, of: F.when(of - x > 0, (of - x) * F.log((of - x) / ((F.lit(p + n) - a - b) * (of / (p + n))))).otherwise(F.lit(0.0))
    says = F.round(part(a, F.lit(p)) + part(b, F.lit(n)) + away(a, F.lit(p)) + away(b, F.lit(n)), 6)
    times = F.log((a + 0.5) / (p + 1) * (n + 1) / (b + 0.5))
    fit = counts.where("bucket >= 0").select("bucket", says.alias("gain"), times.alias("times")).where((F.col("gain") >= gain) & (F.col("times") >= float(np.log(odds))))
    rows = sorted(fit.orderBy(F.desc("gain"), "bucket").limit(most).collect())
    return np.array([r.bucket for r in rows], np.int64), np.array([r.times for r in rows], float), total.toxic, total.clean


def _segments(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of each run of `sizes` values; runs may be empty."""
    out = np.zeros(len(sizes))
    some = np.flatnonzero(sizes)
    if len(some):
        out[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some])
    return out


def _bags(labelled: DataFrame, model: ToxicityModel) -> DataFrame:
    """toxic, features, sizes: the features of a document's sentences one after another, and how many each
    sentence has that has any."""
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known, place = model.index()
        for batch in slices(batches):
            s = sentences(batch.column(0).to_pylist(), model.bits, known)
            each = np.unique((s.owner.astype(np.int64) << 32) | place[s.bucket])
            owner, feature = each >> 32, (each & 0xFFFFFFFF).astype(np.int32)
            sizes = np.bincount(owner, minlength=len(s.text))
            rows = batch.num_rows
            rich = np.flatnonzero(sizes)
            of = np.bincount(s.text[rich], minlength=rows)
            in_text = np.bincount(s.text[owner], minlength=rows)
            cuts = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(1).cast(pa.int32()), pa.ListArray.from_arrays(cuts(in_text), pa.array(feature)), pa.ListArray.from_arrays(cuts(of), pa.array(sizes[rich], pa.int32()))],
                ["toxic", "features", "sizes"],
            )

    return labelled.select("text", "toxic").mapInArrow(run, "toxic int, features array<int>, sizes array<int>")


def _gradient(bags: DataFrame, weights: np.ndarray, bias: float, leak: float) -> np.ndarray:
    """The gradient of the loss (minus the log-likelihood of the labels) by the weights and, last, the
    bias. A task sends one number for each weight."""
    shared = bags.sparkSession.sparkContext.broadcast((weights, bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, b = shared.value
        sums = np.zeros(len(w) + 1)
        for batch in batches:
            toxic = batch.column(0).to_numpy(zero_copy_only=False)
            features, sizes = batch.column(1).flatten().to_numpy(), batch.column(2).flatten().to_numpy()
            of = np.diff(np.asarray(batch.column(2).offsets))
            z = b + _segments(w[features], sizes)
            none = _segments(np.logaddexp(0, z), of) - np.log1p(-leak)  # -log P(not toxic)
            pull = np.where(toxic == 1, -1 / np.expm1(np.minimum(none, 500)), 1.0)
            each = np.rint(np.repeat(pull, of) / (1 + np.exp(-z)) * _UNIT)
            sums[:-1] += np.bincount(features, np.repeat(each, sizes), len(w))
            sums[-1] += each.sum()
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(np.rint(sums[some]).astype(np.int64))], ["weight", "pull"])

    # A row for each weight, of which there are a bounded number.
    rows = bags.mapInArrow(run, "weight long, pull long").groupBy("weight").agg(F.sum("pull").alias("pull")).collect()
    shared.unpersist()
    out = np.zeros(len(weights) + 1)
    for r in rows:
        out[r.weight] = r.pull / _UNIT
    return out


def train(
    docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, bits: int = 20, features: int = 2048, gain: float = 8.0, odds: float = 4.0, rounds: int = 40, decay: float = 0.02, leak: float = 0.01
) -> ToxicityModel:
    """Fits the model to docs(doc_id, text) and labels(doc_id, toxic).

    Labels that are null or of no id are left out; of several labels of an id the largest counts, any
    above 0 as 1. max_labelled: the bound of the labelled ids that are learned from, those with the
    smallest MD5; their documents' texts are written to the shared folder once. What comes to the driver
    is bounded by `features`. Without documents of both labels there are no features, and every score is
    the leak, or where all are toxic 1 less the leak.
    """
    spark = docs.sparkSession
    told = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    chosen = told.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max_labelled)
    # Bounded by max_labelled, so it can be broadcast at any size of the tables.
    known = docs.select("doc_id", "text").join(F.broadcast(stash(chosen, "toxicity-labels")), "doc_id")
    labelled = stash(known.select("text", "toxic").repartition(min(partitions(spark), 16)), "toxicity-texts")
    found, times, toxic, clean = select_features(stash(_count(labelled, bits), "toxicity-counts"), features, gain, odds)
    if not len(found):
        return ToxicityModel(bits, found, np.zeros(0), 0.0, 1 - leak if toxic and not clean else leak)
    blank = ToxicityModel(bits, found, np.zeros(len(found)), 0.0, leak)
    bags = stash(_bags(labelled, blank), "toxicity-bags")
    # Weights start from, and are drawn to, half of what the counts say: the noisy-or alone gives nothing to
    # a word that stands beside others that explain the label. Steps of their own for each weight, by the
    # signs of the gradient only. The bias is held closer: were it free, it would sink as the weights of
    # words that share a beginning rise together, and a word that was never seen would not reach it.
    drawn, held = np.append(times / 2, FIRST_BIAS), np.append(np.full(len(found), decay), 100 * decay)
    x, step, before = drawn, np.full(len(found) + 1, 0.4), np.zeros(len(found) + 1)
    for _ in range(rounds):
        g = _gradient(bags, x[:-1], float(x[-1]), leak) + held * (x - drawn)
        turn = np.sign(g) * np.sign(before)
        step = np.clip(np.where(turn > 0, step * 1.2, np.where(turn < 0, step * 0.5, step)), 1e-4, 1.5)
        x, before = x - np.sign(g) * step, g
    return ToxicityModel(bits, found, x[:-1], float(x[-1]), leak)


def score(docs: DataFrame, model: ToxicityModel, keep: list[str], least: float = 0.5) -> DataFrame:
    """The kept columns and score, n_sentences, offending for every row of docs(text, ...): the places
    (code points, end exclusive) and scores of the sentences whose own score is `least` or more, in
    order. A text that is null, empty or without a word has the leak as its score. Whole texts are read;
    only text is looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        known, place = m.index()
        for batch in slices(batches):
            at, rows = batch.schema.get_field_index("text"), batch.num_rows
            s = sentences(batch.column(at).to_pylist(), m.bits, known)
            each = np.unique((s.owner.astype(np.int64) << 32) | place[s.bucket])
            sizes = np.bincount(each >> 32, minlength=len(s.text))
            z = np.where(sizes > 0, m.bias + _segments(m.weights[each & 0xFFFFFFFF], sizes), -np.inf)
            of = np.bincount(s.text, minlength=rows)
            none = _segments(np.logaddexp(0, z), of) - np.log1p(-m.leak)
            p = 1 / (1 + np.exp(-z))
            bad = p >= least
            places = pa.StructArray.from_arrays([pa.array(s.start[bad]), pa.array(s.end[bad]), pa.array(p[bad])], ["start", "end", "score"])
            cuts = pa.array(np.concatenate([[0], np.cumsum(np.bincount(s.text[bad], minlength=rows))]), pa.int32())
            others = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*others, pa.array(-np.expm1(-none)), pa.array(of), pa.ListArray.from_arrays(cuts, places)], [*keep, "score", "n_sentences", "offending"])

    kept = docs.select(*keep, "text")
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1]]
    fields += ["score double", "n_sentences long", "offending array<struct<start: long, end: long, score: double>>"]
    return kept.mapInArrow(run, ", ".join(fields))


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: a fifth of the ids; a null id never is."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> DataFrame:
    """doc_id, held_out, score, predicted, n_sentences, offending for every row of docs(doc_id, text, ...).

    Learns from labels(doc_id, toxic) of ids that are not held out (see train). Other columns are left
    out, whatever their names; repeated rows are rows of their own.
    """
    out = held_out(F.col("doc_id"))
    model = train(docs, labels.where(~out).select("doc_id", "toxic"), max_labelled)
    found = score(docs.select("doc_id", out.alias("held_out"), "text"), model, ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences", "offending")
