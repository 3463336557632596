import hashlib
import random
import re

from tidemark.llm.pii import KINDS, base_spans, find_personal_data, score_patterns

DOCS = "doc_id long, text string, row string, base string, n_email long"


def luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
    }
    return sorted((m.start(), KINDS.index(k), m.end()) for k, (rx, ok) in rules.items() for m in re.finditer(rx, text) if ok(m[0]))


def test_base_spans_equal_the_expressions():
    rng = random.Random(6)
    alphabet = ["@", ".", "+", "-", " ", "(", ")", "1", "23", "255", "256", "007", "a", "Z_", "%", "é", "4111111111111111", "x@y.co", "+1 (017) 555-7713", "1.2.3.4", "\n"]
    for _ in range(4000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 25)))
        assert base_spans(text) == brute(text), text
    for text in ("1" * 100_000, "@" * 100_000, "a@" * 50_000, "1." * 50_000, "+1(" * 50_000, "((((" * 50_000, "a" * 100_000 + "@"):
        base_spans(text)


def test_patterns_discover_unseen_numbers(spark):
    rows = [(i, f"nothing {i} else. My direct line is +1 (017) 555-77{i:02d} today", "r", "b", 1) for i in range(10, 20)]
    rows += [(30, "é My direct line is 017 555 7713 today", "r", "b", 1), (31, "the total was 017 555 7713 in all", "r", "b", 1)]
    rows += [(32, None, "r", "b", 1), (33, "", "r", "b", 1), (None, "mail a.b@c.example now", "r", "b", 1), rows[0], (34, "x " * 300_000 + "1.2.3.4", "r", "b", 1)]
    got = find_personal_data(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(t for i, t, *_ in rows if i == r.doc_id) or ""
        base = brute(text)
        joined = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in base) for k in range(4)]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        if r.doc_id == 30:
            assert r.spans == "phone:20:32" and r.n_found == 1
        else:
            assert r.spans == joined and r.n_found == 0


def test_added_spans_keep_the_order(spark):
    rows = [(i, f"card no {4000000000000000 + x} ok", "r", "b", 1) for i, x in enumerate((2, 10, 28, 36, 44))]
    rows = [r for r in rows if brute(r[1])]
    assert len(rows) >= 3
    rows.append((50, "card no 4000000000000003 ok and x@y.example too", "r", "b", 1))
    got = {r.doc_id: r.spans for r in find_personal_data(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[50] == "card:8:24,email:32:43"


def test_empty(spark):
    assert find_personal_data(spark.createDataFrame([], DOCS)).count() == 0


def brute_scores(edges, rounds=3):
    """What score_patterns() says, pattern by pattern."""
    sure = {v for _, v, seed, _ in edges if seed}
    bad = {v for _, v, _, refuted in edges if refuted}
    holds = {}
    for p, v, *_ in edges:
        holds.setdefault(p, set()).add(v)
    trust = {}
    for _ in range(rounds):
        known = sure | {v for v, t in trust.items() if t >= 0.5}
        doubtful = bad - known
        scores = {}
        for p, vs in holds.items():
            k, d = len(vs & known), len(vs & doubtful)
            if k >= 3 and k / (k + d) >= 0.8 and k >= len(vs) * 0.3:
                scores[p] = k / (k + d + 1)
        trust = {}
        for p in scores:
            for v in holds[p] - sure:
                trust[v] = trust.get(v, 1.0) * (1 - scores[p])
        trust = {v: (1 - x) / (2 if v in bad else 1) for v, x in trust.items()}
    return scores


def test_scores_equal_brute_force(spark):
    rng = random.Random(8)
    edges = []
    for p in range(60):
        pool = [f"v{rng.randrange(40 * (p % 3), 40 * (p % 3) + 60)}" for _ in range(rng.randint(1, 12))]
        edges += [(f"p{p}", v, int(v[1:]) % 3 == 0 and p % 4 != 0, int(v[1:]) % 11 == 1) for v in pool]
    edges += edges[:20]
    got = {r.pattern: r.score for r in score_patterns(spark.createDataFrame(edges, "pattern string, value string, seed boolean, refuted boolean")).collect()}
    want = brute_scores(edges)
    assert set(got) == set(want) and 0 < len(want) < 60 and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_half_of_a_context_unseen_and_two_hops(spark):
    rows = [(i, f"w{i} my direct line is +1 (017) 555-77{i:02d} since", "r", "b", 1) for i in range(10, 16)]
    rows += [(i, f"w{i} my direct line is 017 555 77{i:02d} since", "r", "b", 1) for i in range(20, 26)]  # unseen, as many
    rows += [(i + 20, f"w{i} please ring under 017 555 77{i:02d} again", "r", "b", 1) for i in range(20, 26)]  # the same in another context
    rows += [(i + 40, f"w{i} please ring under 031 444 88{i:02d} again", "r", "b", 1) for i in range(20, 23)]  # reached only from there
    rows += [(i + 60, f"w{i} the order number 555 10{i:02d} 99 was", "r", "b", 1) for i in range(20, 30)]  # a context without any seed
    got = {r.doc_id: r.n_found for r in find_personal_data(spark.createDataFrame(rows, DOCS)).collect()}
    assert {i for i, n in got.items() if n} == {*range(20, 26), *range(40, 46), *range(60, 63)}


def planted(rng, documents):
    """Texts with identifiers in contexts that can be learned and look-alikes in others; and what is personal."""
    lead = ["call me at", "my number is", "reach our office on", "send it to", "write to me under", "pay with card"]
    words = [f"w{i}" for i in range(800)]
    rows, truth = [], {}
    for i in range(documents):
        before, after = (" ".join(rng.choice(words) for _ in range(rng.randint(5, 30))) for _ in range(2))
        kind, number = rng.randrange(4), f"{rng.randrange(10**9):09d}"
        seen = rng.random() < 0.5
        if kind == 0:
            value = f"+1 ({number[:3]}) {number[3:6]}-{number[5:9]}" if seen else f"({number[:3]}) {number[3:6]}-{number[5:9]}"
            context = rng.choice(lead[:3])
        elif kind == 1:
            value = f"u{number}@mail.example.com" if seen else f"u{number} (at) mail (dot) example.com"
            context = rng.choice(lead[3:5])
        elif kind == 2:
            value, context, seen = number, rng.choice(["the total was", "order id of"]), None  # look-alikes
        else:
            value, context, seen = "nothing", "and there is", None
        text = f"{before} {context} {value} and {after}"
        rows.append((i, text, "r", "b", 1))
        if seen is False:
            at = text.index(value)
            truth[i] = (at, at + len(value))
    return rows, truth


def test_precision_and_recall_on_planted_contexts(spark):
    rows, truth = planted(random.Random(2), 1200)
    found = {}
    for r in find_personal_data(spark.createDataFrame(rows, DOCS)).collect():
        if r.n_found:
            base = {f"{KINDS[k]}:{a}:{b}" for a, k, b in brute(rows[r.doc_id][1])}
            found[r.doc_id] = [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s not in base]
    hits = sum(truth.get(i) in spans for i, spans in found.items())
    assert hits / sum(map(len, found.values())) >= 0.98 and hits / len(truth) >= 0.98


def test_ends_and_punctuation_are_no_context(spark):
    """Numbers at the start of a text, or among punctuation only, are not judged by standing there."""
    rows = [(i, f"+1 (017) 555-77{i:02d} of w{i} and more", "r", "b", 1) for i in range(10, 14)]
    rows += [(i, f"70000{i} units{i} sold in w{i}", "r", "b", 1) for i in range(20, 26)]
    rows += [(i, f"* ** +1 (017) 555-88{i:02d} ** *", "r", "b", 1) for i in range(30, 34)]
    rows += [(i, f"* ** 70001{i} ** *", "r", "b", 1) for i in range(40, 46)]
    rows += [(i, f"+1 (017) 555-99{i:02d}", "r", "b", 1) for i in range(50, 54)] + [(i, f"70002{i}", "r", "b", 1) for i in range(60, 66)]
    got = find_personal_data(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows) and not any(r.n_found for r in got)
