import hashlib
import random
import re

from tidemark.llm.linededup import LEAST_WORDS, line_dedup

DOCS = "doc_id long, text string, row string, line long, words long"


def edits(a, b):
    if abs(len(a) - len(b)) > 1:
        return 2
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b))
    a, b = sorted((a, b), key=len)
    return 1 if any(b[:i] + b[i + 1 :] == a for i in range(len(b))) else 2


def brute(rows):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    seen, out = [], {}
    for i in order:
        lines = rows[i][1].split("\n") if rows[i][1] is not None else []
        equal, near, kept = 0, 0, []
        for line in lines:
            w = tuple(re.findall(r"[^\x20\x09-\x0D]+", line))
            if w in seen:
                equal += 1
                continue
            if w and len(w) >= LEAST_WORDS and any(len(s) >= LEAST_WORDS and edits(w, s) <= 1 for s in seen):
                near += 1
            else:
                kept.append(line)
            if w:
                seen.append(w)
        text = "\n".join(kept)
        out[i] = (rows[i][0], len(lines), equal, near, hashlib.sha256(text.encode()).hexdigest(), text)
    return sorted(out.values(), key=repr)


def test_equals_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}é" for i in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 14))] for _ in range(30)] + [["a", "a", "a", "a", "a", "a"], ["a", "b", "a", "b", "a", "b"]]
    rows = [(0, None, "r", 1, 1), (1, "", "r", 1, 1), (2, "\n\n  \n", "r", 1, 1), (3, "x " * 50_000 + "\n" + "x " * 50_001, "r", 1, 1)]
    for i in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            w = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                p = rng.randrange(len(w) + 1)
                kind = rng.randint(0, 2)
                if kind == 0:
                    w.insert(p, rng.choice(vocabulary))
                elif p < len(w) and kind == 1 and len(w) > 1:
                    del w[p]
                elif p < len(w):
                    w[p] = rng.choice(vocabulary)
            lines.append(rng.choice([" ", "\t "]).join(w))
        lines += [""] * rng.randint(0, 2)
        rng.shuffle(lines)
        rows.append((10 + i, "\n".join(lines), "r", 1, 1))
    rows.append((None, rows[9][1] + "\nnever seen before in any of these", "r", 1, 1))
    got = line_dedup(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    want = brute(rows)
    assert sorted(map(tuple, got), key=repr) == want
    assert sum(w[3] for w in want) > 20


def test_repeated_rows_and_empty(spark):
    rows = [(1, "one two three four five six\nz", "r", 1, 1)] * 2 + [(2, "one two three four five seven\nz", "r", 1, 1)]
    got = sorted(map(tuple, line_dedup(spark.createDataFrame(rows, DOCS)).select("doc_id", "n_equal", "n_near").collect()))
    assert got == [(1, 0, 0), (1, 0, 0), (2, 1, 1)]
    assert line_dedup(spark.createDataFrame([], DOCS)).count() == 0
