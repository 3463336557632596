import hashlib
import random
import re

import numpy as np
import pytest

from tidemark.llm import exchange
from tidemark.llm.substring import WINDOW, long_symbols, rounds, substring_dedup

DOCS = "doc_id long, text string, tag string, items long, n_chars long"


def brute(rows):
    words = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    least = {}
    for (i, *_), w in zip(rows, words):
        if i is not None:
            for j in range(len(w) - 12):
                k = tuple(w[j : j + 13])
                least[k] = min(least.get(k, i), i)
    out = []
    for (i, *_), w in zip(rows, words):
        gone = set()
        for j in range(len(w) - 12 if i is not None else 0):
            if least[tuple(w[j : j + 13])] < i:
                gone.update(range(j, j + 13))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return sorted(out, key=repr)


def corpus(seed):
    """Texts over few words, so that windows and runs of all kinds repeat."""
    rng = random.Random(seed)
    few, many = ["a", "b", "c"], [f"w{i}é" for i in range(3000)]
    passages = [[rng.choice(many) for _ in range(rng.randint(12, 80))] for _ in range(12)]
    passages += [[rng.choice(few) for _ in range(rng.randint(12, 40))] for _ in range(8)]
    passages += [["a"] * 20, ["a", "b"] * 12, ["x"] * 13]
    rows = [(None, " ".join(passages[0]), "t", 1, 1), (0, None, "t", 1, 1), (1, "", "t", 1, 1), (2, "one  two", "t", 1, 1)]
    for i in range(150):
        w = []
        for _ in range(rng.randint(0, 6)):
            w += rng.choice(passages)[rng.randint(0, 3) :] if rng.random() < 0.5 else [rng.choice(rng.choice([few, many])) for _ in range(rng.randint(0, 40))]
        rows.append((3 + i, rng.choice([" ", "\n", " \t "]).join(w), "t", 1, 1))
    rows += [rows[9], rows[9][:1] + rows[12][1:], (5000, " ".join(rng.choice(many) for _ in range(150_000)) + " " + " ".join(passages[1]), "t", 1, 1)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed):
    rows = corpus(seed)
    got = substring_dedup(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_long_repeats_equal_brute_force(spark):
    """Copies, near copies and passages of hundreds of words, many of them inside of high symbols."""
    rng = random.Random(8)
    many = [f"w{i}" for i in range(3000)]
    base = [[rng.choice(many) for _ in range(rng.randint(200, 900))] for _ in range(6)] + [["a", "b", "c"] * 200, ["a"] * 700]
    rows = [(i, " ".join(rng.choice(base)), "t", 1, 1) for i in range(40)]
    for i in range(40, 80):
        w = list(rng.choice(base))
        for _ in range(rng.randint(1, 6)):
            w[rng.randrange(len(w))] = rng.choice(many)
        a = rng.randrange(len(w))
        rows.append((i, " ".join([rng.choice(many) for _ in range(30)] + w[a : a + rng.randint(20, 600)]), "t", 1, 1))
    rows += [rows[3], (rows[50][0], rows[51][1], "t", 1, 1)]
    rng.shuffle(rows)
    got = substring_dedup(spark.createDataFrame(rows, DOCS).repartition(4)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_symbols_cover_the_text_and_agree_inside_of_repeats():
    rng = np.random.default_rng(3)
    passage = rng.integers(0, 2**60, 2000).astype(np.uint64)
    words = np.concatenate([rng.integers(0, 2**60, 501).astype(np.uint64), passage, rng.integers(0, 2**60, 77).astype(np.uint64), passage])
    first = np.array([0, 501 + 2000, len(words)])
    for _, names, at in rounds(words, first, 17):
        assert at[0] == 0 and 2501 in at and np.all(np.diff(at) > 0)
    names, _, at, end, level = long_symbols(words, first)
    assert np.all(end - at >= WINDOW) and set(level) == {0, 1, 2}
    assert not np.any((at < 2501) & (end > 2501))
    for x in range(2):
        one, two = names[(level == x) & (at < 2501)], names[(level == x) & (at >= 2501)]
        assert len(np.intersect1d(one, two)) >= 0.5 * min(len(one), len(two))


def test_empty(spark):
    assert substring_dedup(spark.createDataFrame([], DOCS)).count() == 0


def test_equal_64_bits_of_different_keys():
    keys = np.array([5, 5, 5, 5, 7], np.uint64)
    more = np.array([1, 2, 1, 2, 1], np.uint32)
    order, cuts = exchange._groups(keys, more)
    assert [sorted(g.tolist()) for g in np.split(order, cuts[1:])] == [[0, 2], [1, 3], [4]]
