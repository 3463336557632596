import random
import re

import pytest

from tidemark.llm.decontam import drop_leaks, find_leaks

DOCS = "doc_id long, text string, item_id long, row string, words long"
BENCH = "item_id long, text string, doc_id long"


def words_of(text):
    return re.sub(r"[!-/:-@\[-`{-~]", "", (text or "").lower()).split()


def tiles(a, b):
    """Greedy string tiling as its definition says."""
    used_a, used_b, n, covered = set(), set(), 0, 0
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and i + k not in used_a and j + k not in used_b:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < 5:
            return n, covered
        used_a.update(range(i, i + k))
        used_b.update(range(j, j + k))
        n, covered = n + 1, covered + k


def test_equals_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)] + ["Ärger", "The", "of,"]

    def text(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    template = text(8)
    items = [(i, template + " " + text(rng.randint(2, 40)), 1) for i in range(12)]
    items += [(20, None, 1), (21, "a b c d", 1), (None, text(30), 1), (22, "x y " * 10, 1), (22, text(12), 1), (3, items[3][1], 1)]
    docs = [(None, items[2][1], 1, "r", 1), (1, None, 1, "r", 1), (2, "", 1, "r", 1), (3, "x y " * 300, 1, "r", 1)]
    for i in range(40):
        parts = [text(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            w = (rng.choice(items)[1] or "").split()
            cut = rng.randint(0, len(w))
            parts += [" ".join(w[cut:]).upper(), text(rng.randint(0, 3)), "\n".join(w[:cut]) + "!"]
        docs.append((10 + i, "  ".join(parts), 1, "r", 1))
    docs += [docs[8], (docs[8][0], "another " + docs[9][1], 1, "r", 1)]
    want = set()
    for d, t, *_ in docs:
        for i, b, _ in items:
            if i is not None and len(words_of(b)) >= 5:
                n, covered = tiles(words_of(t), words_of(b))
                if covered >= 0.5 * len(words_of(b)):
                    want.add((d, i, t, covered / len(words_of(b))))
    best = {}
    for d, i, t, c in want:
        best[d, i, t] = max(best.get((d, i, t), 0), c)
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, BENCH)
    for limit in (4_000_000, 3):
        got = find_leaks(df, bench, filter_seeds=limit).collect()
        assert sorted((repr(r.doc_id), r.item_id, round(r.coverage, 9)) for r in got) == sorted((repr(d), i, round(c, 9)) for (d, i, t), c in best.items())
    assert len(best) > 10
    leaks = {(d, t) for d, i, t in best}
    assert sorted(map(repr, map(tuple, drop_leaks(df, bench).collect()))) == sorted(repr(r) for r in docs if (r[0], r[1]) not in leaks)


def test_very_long_and_repetitive(spark):
    """Texts over a slice, and a seed that stands thousands of times in a text and an item."""
    item = " ".join(f"b{i}" for i in range(40))
    docs = [(1, " ".join(f"w{i}" for i in range(400_000)) + " " + item, 1, "r", 1), (2, "x y " * 30_000, 1, "r", 1), (3, "x y " * 100, 1, "r", 1)]
    bench = spark.createDataFrame([(1, item, 1), (2, "x y " * 250, 1)], BENCH)
    got = {(r.doc_id, r.item_id): (r.tiles, r.covered) for r in find_leaks(spark.createDataFrame(docs, DOCS), bench).collect()}
    assert got == {(1, 1): (1, 40), (2, 2): (1, 500)}


@pytest.mark.parametrize("docs, items", [([], [(1, "a b c d e f", 1)]), ([(1, "a b c d e f", 1, "r", 1)], [])])
def test_empty(spark, docs, items):
    df, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, BENCH)
    assert find_leaks(df, bench).count() == 0
    assert drop_leaks(df, bench).count() == len(docs)
