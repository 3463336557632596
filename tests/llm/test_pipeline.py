import random
from collections import Counter

import corpus_pipeline as p

from test_decontam import tiles, words_of
from test_quality import brute as quality_brute
from test_jaccard import components, shingles

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(4000)]

    def text(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    items = [(i, text(30)) for i in range(4)]
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "short", "en", "a", 5), (3, "x y z " * 60, "de", "b", 360)]
    for i in range(10, 130):
        rows.append((i, text(rng.randint(55, 300)), "en", rng.choice(["a", "a", "a", "b", "c", None]), 1))
    for i in range(130, 150):  # exact and near copies
        base = rng.choice(rows[4:100])[1].split(" ")
        if rng.random() < 0.5 and len(base) > 200:
            base[5] = "changed"
        rows.append((i, " ".join(base), "en", "b", 1))
    for i in range(150, 160):  # leaks, in pieces
        w = rng.choice(items)[1].split(" ")
        rows.append((i, text(80) + " " + " ".join(w[12:]).upper() + " " + text(3) + " " + " ".join(w[:12]) + "!", "en", "c", 1))
    rows += [rows[20], (None, text(90), "en", "a", 1), (None, text(90), "en", "a", 1)]
    rng.shuffle(rows)
    return rows, items


def test_stages_equal_brute_force(spark, tmp_path):
    rows, items = corpus()
    rows.append((400, " ".join(f"long{i}" for i in range(300_000)), "en", "b", 1))  # over a slice of text
    # Other columns, also of the names that stages use themselves, are left out.
    more = ", ".join(f"{c} string" for c in ("shard", "slot", "size", "_row", "_n", "_copies", "gone", "key"))
    spark.createDataFrame([(*r, *"abcdefgh") for r in rows], f"{DOCS}, {more}").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = {}
    for name, stage in p.STAGES:
        docs = p.stash(stage(spark, docs, str(tmp_path)), "test")
        seen[name] = [tuple(r) for r in docs.collect()]

    verdict = {}
    for r, v in zip(rows, quality_brute([(r[0], r[1], r[3]) for r in rows])):
        verdict[r] = v[-1]
    kept = [r for r in rows if verdict[r]]
    assert Counter(seen["quality rules"]) == Counter(kept) and len(kept) < len(rows)

    part = components([shingles(r[1]) for r in kept])
    groups = {}
    for r, c in zip(kept, part):
        groups.setdefault(c, []).append(r)
    survivors = seen["near duplicates"]
    assert len(survivors) == len(groups) < len(kept)
    for members in groups.values():
        least = min(members, key=lambda r: (r[0] is None, r[0] or 0))
        assert sum(s in members for s in survivors) == 1 and (least in survivors or least[0] is None)

    clean = [r for r in survivors if not any(tiles(words_of(r[1]), words_of(t))[1] >= 0.5 * 30 for _, t in items)]
    assert Counter(seen["decontamination"]) == Counter(clean) and len(clean) < len(survivors)

    sizes, taken = Counter(), Counter()
    for r in clean:
        sizes[r[3]] += len(r[1].split())
    for r in seen["mixing"]:
        assert r in clean
        taken[r[3]] += len(r[1].split())
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    open_, left, target = set(order), float(sum(sizes.values())), {}
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not full:
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= full
    target |= {s: weight[s] * level for s in open_}
    longest = max(len(r[1].split()) for r in clean)
    assert all(abs(taken[s] - target[s]) <= longest / 2 + 1 for s in order)
    assert max(Counter(seen["mixing"]).values()) <= 3

    out = seen["sharding"]
    assert Counter(tuple(r[2:7]) for r in out) == Counter(seen["mixing"])
    counts = Counter(r[0] for r in out)
    assert set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r[1] for r in out if r[0] == s) == list(range(counts[s])) for s in counts)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert p.run(spark, str(tmp_path)).count() == 0
