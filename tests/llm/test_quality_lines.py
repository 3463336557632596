import random
from collections import Counter

import corpus_pipeline
from test_quality import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(line):
    return tuple(line.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split())


def test_common_lines_go_from_the_texts(spark):
    rng = random.Random(4)

    def line(n):
        return " ".join(f"w{rng.randrange(900)}" for _ in range(n))

    shared = [line(40), "The  END of it"]
    rows = []
    for i in range(60):
        lines = [line(rng.randint(20, 40)) for _ in range(rng.randint(2, 4))]
        lines += [x.upper() if rng.random() < 0.3 else x for x in shared if rng.random() < 0.7] + rng.choice([[], ["", " "]])
        rng.shuffle(lines)
        text = "\n".join(lines)
        rows.append((i, text, "en", "a", len(text)))
    rows.append(rows[3])
    seen = {k: {r[1] for r in rows if k in map(words, r[1].split("\n"))} for k in map(words, shared)}
    gone = {k for k, texts in seen.items() if len(texts) > max(4, 0.05 * len({r[1] for r in rows}))}
    assert len(gone) == 2
    want = Counter()
    for r, v in zip(rows, brute([(r[0], r[1], r[3]) for r in rows])):
        if v[-1]:
            text = "\n".join(x for x in r[1].split("\n") if words(x) not in gone)
            want[(r[0], text, r[2], r[3], len(text))] += 1
    got = corpus_pipeline.quality(spark, spark.createDataFrame(rows, DOCS), "")
    assert Counter(map(tuple, got.collect())) == want
