import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle
from tidemark.llm.merkle import fold, leaf_digest, merkle_manifest, merkle_proofs

DOCS = "doc_id long, source string, lang string, n_chars long, text string, leaf string, root string, r long, g string, at string"
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, low=False):
    out = ""
    for name, v in zip(COLUMNS, row, strict=False):
        if v is None:
            out += "-"
            continue
        v = str(v)
        if name == "text" and low:
            v = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in v)
        out += f"{len(v.encode())}:{v}"
    return H(out)


def tree(nodes, fanout=8):
    """The root, and for each leaf its (place, siblings) at every level."""
    proofs, level = [[] for _ in nodes], [(x, [i]) for i, x in enumerate(nodes)]
    while len(level) > 1:
        above = []
        for at in range(0, len(level), fanout):
            run = level[at : at + fanout]
            for j, (_, own) in enumerate(run):
                for i in own:
                    proofs[i].append((j, [y for k, (y, _) in enumerate(run) if k != j]))
            above.append((H(*[y for y, _ in run]), [i for _, own in run for i in own]))
        level = above
    return level[0][0], proofs


def expected(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append(r)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    subroots, found = [], []
    for lang in langs:
        by[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        s, p = tree([leaf(r) for r in by[lang]])
        subroots.append(s)
        found += [(r, lang, s, q) for r, q in zip(by[lang], p, strict=True)]
    if not rows:
        return []
    root, over = tree(subroots)
    out = []
    for r, lang, s, q in found:
        q = q + over[langs.index(lang)]
        acc = leaf(r, r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0)
        for j, near in q:
            acc = H(*near[:j], acc, *near[j:])
        out.append((r[0], leaf(r), s, root, H(*[y for _, near in q for y in near]), acc, acc == root))
    return sorted(out, key=repr)


def rows():
    more = ("x", "y", 1, "g", "at")
    out = [(i, None if i % 7 == 0 else f"s{i % 3}", "en" if i % 3 else None, i if i % 5 else None, f"Text {i}" if i % 4 else "lower only") for i in range(700)]
    out += [(1000, "s", "de", 1, "Ä " * 200_000), (1001, "s", "fr", 1, None), (1002, "s", "fr", 1, ""), (None, None, None, None, None), (None, "a", "én", 0, "A")]
    out += [out[3]] * 9 + [(5, "other", "en", 1, "same id")]
    out += [(2000 + i, "s", f"l{i}", 1, "X") for i in range(20)]
    return [r + more for r in out]


@pytest.mark.parametrize("height", [1, 3])
def test_equals_plain_tree(spark, monkeypatch, height):
    monkeypatch.setattr(merkle.merkle_proofs, "__defaults__", ("leaf", 8, height))
    got = merkle_manifest(spark.createDataFrame(rows(), DOCS).repartition(5))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == expected([r[:5] for r in rows()])


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65])
def test_sizes_around_full_blocks(spark, n):
    data = [(i, "s", "en", 1, "A") for i in range(n)]
    df = spark.createDataFrame([r + ("x", "y", 1, "g", "at") for r in data], DOCS)
    assert sorted((tuple(r) for r in merkle_manifest(df).collect()), key=repr) == expected(data)


def test_empty(spark):
    assert merkle_manifest(spark.createDataFrame([], DOCS)).count() == 0


def test_proofs_of_other_tables_lead_to_the_root(spark):
    """Another group, order and width of the tree: every leaf leads to the root, a changed one does not."""
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 3).alias("part"), F.col("id").cast("string").alias("v"))
    leaves = df.select("k", "part", leaf_digest([F.col("k"), F.col("v")]).alias("leaf"))
    proved = merkle_proofs(leaves, "part", ["k"], fanout=3, height=2)
    roots = proved.select(F.lower(F.hex("root")).alias("root"), fold(F.col("leaf"), F.col("at"), F.col("near")).alias("a"), fold(F.unhex(F.sha2(F.lit("x"), 256)), F.col("at"), F.col("near")).alias("b")).collect()
    assert len(roots) == 100 and len({r.root for r in roots}) == 1
    assert all(r.a == r.root and r.b != r.root for r in roots)
