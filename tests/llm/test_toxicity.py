import math
import random
import zlib

import numpy as np

from tidemark.llm import toxicity as tx
from tidemark.llm.toxicity import score, select_features, sentences, toxicity, train

DOCS = "doc_id long, text string, score string, held_out string, toxic int"
LABELS = "doc_id long, quality int, toxic int, text string"
CLEAN = "the of and river stone light water house green under over many small large walked found".split()
BAD = ["grumpf", "blorkish", "blorkend", "snarvel"]


def corpus(n=600, seed=1):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        said = [" ".join(rng.choices(CLEAN, k=rng.randint(4, 12))).capitalize() + "." for _ in range(rng.randint(1, 30))]
        toxic = rng.random() < 0.2
        if toxic:
            at = rng.randrange(len(said))
            said[at] = said[at][:-1] + f" {rng.choice(BAD)} indeed."
        docs.append((i, " ".join(said), "x", "y", 7))
        labels.append((i, 1, int(toxic), "z"))
    return docs, labels


def test_learns_from_documents_and_locates_sentences(spark):
    docs, labels = corpus()
    long = (5000, "The river. " * 60_000 + "You snarvel of a house. " + "The stone. " * 1000, "x", "y", 7)
    docs += [(4000, None, "x", "y", 7), (4001, "", "x", "y", 7), (4002, "12 !! ##", "x", "y", 7), (None, "A blorkly house.", "x", "y", 7), long, docs[0]]
    labels += [(None, 1, 1, "z"), (4001, 1, None, "z"), (0, 1, labels[0][2], "z"), (9999, 1, 1, "z")]
    got = toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == len(docs) and got[0].asDict().keys() == {"doc_id", "held_out", "score", "predicted", "n_sentences", "offending"}
    truth, texts = {r[0]: r[2] for r in labels[:600]}, {r[0]: r[1] for r in docs}
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    by = {r.doc_id: r for r in got}
    unseen = [i for i in range(600) if by[i].held_out]
    assert len(unseen) > 80 and sum(by[i].predicted == truth[i] for i in unseen) >= 0.97 * len(unseen)
    for i in range(600):
        if truth[i] and by[i].predicted:
            said = [texts[i][s.start : s.end] for s in by[i].offending]
            assert len(said) == 1 and any(b in said[0] for b in BAD) and said[0].count(".") == 1
    assert by[4000].score == by[4001].score == by[4002].score < 0.5 and by[4002].n_sentences == 0
    assert by[None].predicted == 1  # a word that was never seen, with a known beginning
    assert by[5000].n_sentences == 61_001 and [long[1][s.start : s.end].strip() for s in by[5000].offending] == ["You snarvel of a house."]


def test_sentences_and_places():
    texts = ["One two. Three!\nfour five?  Six 3.5 seven", None, "", "É.È. fin", "... !"]
    s = sentences(texts, 20)
    said = [texts[t][a:b].strip() for t, a, b in zip(s.text, s.start, s.end, strict=True)]
    assert said == ["One two.", "Three!", "four five?", "Six 3.5 seven", "É.È.", "fin"]
    assert set(s.owner) == set(range(len(s.text)))
    one, two = sentences(["HOUSES"], 20), sentences(["houses"], 20)
    assert (one.bucket == two.bucket).all() and len(one.bucket) == 5  # the word, and beginnings of 3 to 6


def test_gradient_is_the_slope_of_the_loss(spark):
    docs, labels = corpus(60, 2)
    df = spark.createDataFrame([(d[1], lab[2]) for d, lab in zip(docs, labels, strict=True)], "text string, toxic int")
    found, times, p, n = select_features(tx._count(df, 16), 50, 1.0, 1.5)
    assert p == sum(lab[2] for lab in labels) and n == 60 - p and len(found) == len(times) > 0
    bags = tx._bags(df, tx.ToxicityModel(16, found, np.zeros(len(found)), 0.0, 0.03)).cache()
    rows = bags.collect()

    def loss(w, b):
        total = 0.0
        for r in rows:
            at, quiet = 0, -math.log1p(-0.03)
            for size in r.sizes:
                quiet += math.log1p(math.exp(b + sum(w[f] for f in r.features[at : at + size])))
                at += size
            total += -math.log(-math.expm1(-quiet)) if r.toxic else quiet
        return total

    w, b, eps = np.random.default_rng(0).normal(0, 1, len(found)), -2.0, 1e-5
    g = tx._gradient(bags, w, b, 0.03)
    for i in range(min(6, len(found))):
        up, down = w.copy(), w.copy()
        up[i] += eps
        down[i] -= eps
        assert abs((loss(up, b) - loss(down, b)) / (2 * eps) - g[i]) < 1e-3
    assert abs((loss(w, b + eps) - loss(w, b - eps)) / (2 * eps) - g[-1]) < 1e-3
    assert (tx._gradient(bags.repartition(7), w, b, 0.03) == g).all()


def test_bound_and_missing_labels(spark):
    docs, labels = corpus(200, 3)
    d, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    assert len(train(d, lab, max_labelled=20, rounds=1).buckets) <= len(train(d, lab, rounds=1).buckets)
    empty = spark.createDataFrame([], DOCS)
    assert toxicity(empty, lab).count() == 0
    for none in (spark.createDataFrame([], LABELS), lab.where("toxic = 0")):
        assert all(r.predicted == 0 for r in toxicity(d, none).collect())
    assert all(r.predicted == 1 for r in toxicity(d, lab.where("toxic = 1")).collect())
    assert score(empty.select("text"), train(d, lab, rounds=1), []).count() == 0
