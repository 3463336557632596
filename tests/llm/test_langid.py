import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidemark.llm import langid
from tidemark.llm.langid import identify, language_id, train

DOCS = "doc_id long, text string, lang string, score string, held_out string"
EN, DE = "the house is on the hill and it was the best of them", "das haus ist auf dem hügel und es war das beste von allen"


def rows():
    out = [(i, f"{EN if i % 2 else DE} {'abc' * (i % 7)}", "en" if i % 2 else "de", "x", "y") for i in range(60)]
    out += [(100, None, "en", "x", "y"), (101, "", "en", "x", "y"), (102, "12 !! ##", "en", "x", "y"), (103, EN * 20_000, None, "x", "y"), (None, DE, "en", "x", "y")]
    return out + [out[3]]


def test_held_out_and_accuracy(spark):
    got = language_id(spark.createDataFrame(rows(), DOCS)).collect()
    assert len(got) == len(rows())
    for r in got:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (100, 101, 102, 103, None)] == ["und", "und", "und", "en", "de"]
    assert by_id[100].score == 0 and all(by_id[i].lang_pred == ("en" if i % 2 else "de") for i in range(60))


def test_scores_equal_a_plain_naive_bayes(spark, monkeypatch):
    monkeypatch.setattr(langid, "_CHARS", 7)
    data = [r for r in rows() if r[1] and r[2] and len(r[1]) < 1000]
    df = spark.createDataFrame(data, DOCS)
    model = train(df)
    counts, texts = defaultdict(Counter), Counter()

    def grams(text):
        points, first, _ = langid._characters([text])
        return [int(x) for _, h in langid._grams(points, first, (1, 2, 3), 15) for x in h if x < 1 << 15]

    for r in data:
        counts[r[2]].update(grams(r[1]))
        texts[r[2]] += 1
    names = sorted(counts)
    assert model.languages == names
    for j, x in enumerate(names):
        grown = {b: n + 0.1 for b, n in counts[x].items()}
        whole = sum(grown.values()) + 0.1 * ((1 << 15) - len(grown))
        for b, n in grown.items():
            assert model.weights[b, j] == pytest.approx(math.log(n / whole), abs=1e-4)
    got = {r.doc_id: r for r in identify(df.select("doc_id", "text"), model, ["doc_id"]).collect()}
    for r in data[:10]:
        logs = [model.prior[j] + sum(float(model.weights[g, j]) for g in grams(r[1])) for j in range(2)]
        assert got[r[0]].lang_pred == names[int(np.argmax(logs))]
        assert got[r[0]].score == pytest.approx(1 / sum(math.exp(x - max(logs)) for x in logs), abs=1e-6)


def test_empty_and_unlabelled(spark):
    assert language_id(spark.createDataFrame([], DOCS)).count() == 0
    got = language_id(spark.createDataFrame([(1, EN, None, "x", "y")], DOCS)).collect()
    assert [(r.lang_pred, r.score) for r in got] == [("und", 0.0)]
