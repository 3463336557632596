import random
import re

import numpy as np
import xxhash

from tidemark.llm import simhash
from tidemark.llm.components import connected
from tidemark.llm.simhash import MAX_BITS, POSITION_SETS, SHARED_BYTES, links, near_duplicates

DOCS = "doc_id long, text string, source string, fp string, n_chars long"


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """prints: fingerprints; the component of each by comparing all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= MAX_BITS:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_any_five_positions_hold_a_set():
    from itertools import combinations

    assert len(POSITION_SETS) == 14
    assert all(any(set(s) <= set(five) for s in POSITION_SETS) for five in combinations(range(8), SHARED_BYTES))


def test_equals_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(200)] + ["Éa", "ÀB", "THE"]
    texts = [None, "", "  \n", "one", "ONE", "one two", "a b c", "a  b\tc", "x" * 70000]
    for _ in range(30):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(1, 400))]
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts.append(" ".join(rng.choice(vocabulary) for _ in range(120_000)))
    ids = list(range(100, 100 + len(texts)))
    rng.shuffle(ids)
    rows = [(i, t, "s", "f", 1) for i, t in zip(ids, texts)]
    rows.append(rows[5])
    got = sorted(map(tuple, near_duplicates(spark.createDataFrame(rows, DOCS)).drop("row", "root").collect()))
    prints = [fingerprint(r[1]) for r in rows]
    part = components(prints)
    least = {}
    for p, r in zip(part, rows):
        least[p] = min(least.get(p, r[0]), r[0])
    assert got == sorted((r[0], f"{f:016x}", least[p]) for r, f, p in zip(rows, prints, part))


def test_crowded_postings_lose_no_link(spark):
    rng = random.Random(2)
    prints = set()
    for _ in range(4):
        x = rng.getrandbits(64)
        for _ in range(120):
            prints.add(x)
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    part = components(prints)
    for limit in (3, 8192):
        roots = dict(map(tuple, connected(links(df, limit)).collect()))
        got = [roots.get(p, p) for p in signed]
        assert len({(a, b) for a, b in zip(got, part)}) == len(set(part)) == len(set(got))


def test_empty_and_null_ids(spark):
    assert near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, "a b c", "s", "f", 1), (7, "a b c", "s", "f", 1), (None, "q r s t", "s", "f", 1)]
    got = {(r.doc_id, r.component_id) for r in near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {(None, 7), (7, 7), (None, None)}


def test_lookup_finds_the_same_components():
    rng = np.random.default_rng(3)
    prints = np.unique(rng.integers(0, 1 << 14, 900).astype(np.uint64) << np.uint64(5) | np.uint64(7 << 40))

    def parts(edges):
        root = {int(x): int(x) for x in prints}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in zip(*edges):
            a, b = find(int(a)), find(int(b))
            root[max(a, b)] = min(a, b)
        return [find(int(x)) for x in prints]

    assert parts(simhash._by_lookup(prints)) == parts(simhash._forest(prints))
    few = prints[::150]
    got = {frozenset(p) for p in zip(*map(list, simhash._by_lookup(few)))}
    assert all(int(x ^ y).bit_count() for x, y in map(tuple, got))
