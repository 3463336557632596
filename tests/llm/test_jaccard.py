import random
import re

from tidemark.llm.jaccard import similar_texts

DOCS = "doc_id long, text string, bands string"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def components(sets, least=0.8):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(sets))]


def test_equals_brute_force(spark):
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(3000)] + ["É", "THE"]
    texts = [None, "", " \n", "one", "ONE", "a b c", "a b c d", "a b c d e", "A b\tc d  e"]
    for _ in range(25):  # copies of similarity 0.7 to 1, and chains of them
        base = [rng.choice(vocabulary) for _ in range(rng.randint(50, 400))]
        for _ in range(rng.randint(1, 6)):
            if rng.random() < 0.7:
                base = list(base)
                for _ in range(rng.randint(1, max(1, len(base) // 40))):
                    base[rng.randrange(len(base))] = rng.choice(vocabulary)
            texts.append(" ".join(base))
    rows = [(None if i % 17 == 0 else 500 - i, t, "x") for i, t in enumerate(texts)]
    part = components([shingles(t) for t in texts])
    got = similar_texts(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    least = {}
    for p, r in zip(part, rows):
        least[p] = min((x for x in (least.get(p), r[0]) if x is not None), default=None)
    assert sorted(map(repr, ((r.doc_id, r.component_id) for r in got))) == sorted(map(repr, ((r[0], least[p]) for r, p in zip(rows, part))))


def test_empty(spark):
    assert similar_texts(spark.createDataFrame([], DOCS)).count() == 0


def test_large_groups_are_compared_in_cells(spark):
    """A group of which many texts are a little below the similarity to the least one."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        rows.append((i, " ".join(words), "x"))
    part = components([shingles(r[1]) for r in rows])
    got = {r.doc_id: r.component_id for r in similar_texts(spark.createDataFrame(rows, DOCS), cell=1000).collect()}
    assert got == dict(enumerate(part)) and len(set(part)) > 5
