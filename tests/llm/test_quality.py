import random
import re
from collections import Counter, defaultdict

from tidemark.llm.quality import quality_rules

DOCS = "doc_id long, text string, source string, host string, lines long"


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    triples = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = set()
    for i in range(len(words) - 2):
        if triples[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def brute(rows, least=4, share=0.05, left=0.5):
    def normal(line):
        return tuple(re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", line))

    texts, seen = defaultdict(set), defaultdict(set)
    for _, text, source, *_ in rows:
        content = tuple(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
        texts[source].add(content)
        for line in (text or "").split("\n"):
            seen[source, normal(line)].add(content)
    out = []
    for i, text, source, *_ in rows:
        b = base(text)
        lost = sum(len(normal(x)) for x in (text or "").split("\n") if len(seen[source, normal(x)]) > max(least, share * len(texts[source])))
        failed = b[0] < 50 or 100 * b[4] > 50 * b[0]
        out.append((i, *b, failed, lost, not failed and b[0] - lost >= max(50, left * b[0])))
    return out


def key(rows):
    return sorted(map(repr, rows))


def test_equals_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)] + ["é#", "Ünï", "***", "|x|"]

    def line(n):
        return " ".join(rng.choice(vocabulary) for _ in range(n))

    shared = [line(40), line(12), "The  END of it"]
    rows = [(None, None, None, "h", 1), (1, "", "a", "h", 1), (2, " \n\t ", "a", "h", 1), (3, "x y z " * 40, "a", "h", 1), (4, line(60_000), "b", None, 1)]
    for i in range(160):
        lines = [line(rng.randint(1, 30)) for _ in range(rng.randint(0, 5))]
        lines += [rng.choice(shared).upper() if rng.random() < 0.3 else rng.choice(shared) for _ in range(rng.randint(0, 4))]
        rng.shuffle(lines)
        rows.append((10 + i, "\n".join(lines), rng.choice(["a", "a", "b", None]), "h", 1))
    rows += [rows[7]] * 30
    got = quality_rules(spark.createDataFrame(rows, DOCS)).collect()
    want = brute(rows)
    assert key(map(tuple, got)) == key(want)
    assert any(not w[-1] and not w[-3] for w in want) and any(w[-1] for w in want)


def test_planted_boilerplate_depletes_documents(spark):
    """Documents that are long enough only by a line of their host are rejected, others keep their words."""
    rng = random.Random(5)
    notice = "Copyright by the owners of this site, all rights are reserved and no copies may be made"
    rows = []
    for i in range(200):
        n = 40 if i % 20 == 0 else 80
        text = " ".join(f"w{rng.randrange(5000)}" for _ in range(n)) + ("\n" + notice if i % 10 == 0 else "")
        rows.append((i, text, "a", "h", 1))
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, DOCS)).collect()}
    assert {i for i, r in got.items() if not r.kept and not r.base_failed} == set(range(0, 200, 20))
    assert all(r.kept for i, r in got.items() if i % 20) and all((r.lost_words > 0) == (i % 10 == 0) for i, r in got.items())


def test_empty(spark):
    assert quality_rules(spark.createDataFrame([], DOCS)).count() == 0
