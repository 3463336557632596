"""Guards against a plain version of the same rules."""

import json
import random
import re

from pyspark.sql import functions as F

from tidemark.operators import guards
from tidemark.params import HEDGES, REVIEW_KEYS, REVIEW_LISTS, REVIEW_STATES


def plain_asserted(text, marker):
    if marker.isascii() and marker.replace(" ", "").isalpha():
        places = [m.start() for m in re.finditer(rf"\b{re.escape(marker)}\b", text)]
    else:
        places = [i for i in range(len(text)) if text.startswith(marker, i)]
    return any(not any(h in text[max(0, i - 50) : i + len(marker) + 50] for h in HEDGES) for i in places)


def plain(outputs, evidence):
    out = []
    for i, text in outputs:
        known = " ".join((t or "").lower() for j, t in evidence if j == i)
        for kind, group, words in guards.GROUPS:
            if text is None or any(m in known for m in words):
                continue
            said = [m for m in words if plain_asserted(text.lower(), m)]
            if said:
                out.append((i, kind, group, said[0]))
    return sorted(out)


def test_guards_equal_the_plain_rules(spark):
    rng = random.Random(9)
    markers = [m for *_, words in guards.GROUPS for m in words]
    filler = ["the", "réeux", "flushed", "influence", "of", "心", "today", "xx", "_flu", "flu2", "drinkings", "37"]
    outputs = []
    for i in range(300):
        words = [rng.choice(filler) for _ in range(rng.randint(0, 40))]
        for _ in range(rng.randint(0, 4)):
            words.insert(rng.randint(0, len(words)), rng.choice(markers))
        for _ in range(rng.randint(0, 1)):
            words.insert(rng.randint(0, len(words)), rng.choice(HEDGES))
        outputs.append((i, rng.choice([" ", "", ". "]).join(words).title() if i % 3 else " ".join(words)))
    outputs += [(1000, None), (1001, ""), (1002, "No sign of it. " * 10_000 + "You have the FLU.")]
    evidence = [(i, " ".join(rng.choice(markers) for _ in range(2))) for i in range(0, 300, 2)] + [(1, None), (2, "fever")]
    got = guards.unsupported(spark.createDataFrame(outputs, "id long, text string"), spark.createDataFrame(evidence, "id long, text string"), ["id"])
    want = plain(outputs, evidence)
    assert sorted(tuple(r) for r in got.select("id", "kind", "group", "marker").collect()) == want and len(want) > 100
    assert (1002, "DIAGNOSIS", "influenza", "flu") in want


def test_reviews(spark):
    good = {k: [] if k in REVIEW_LISTS else None for k in REVIEW_KEYS} | {"review_status": REVIEW_STATES[0], "review_summary": "fine", "unsafe_actions": ["a", "b"]}
    cases = [
        (json.dumps(good), []), ("[1]", ["not_an_object"]), ("{oops", ["not_an_object"]), (None, ["not_an_object"]),
        (json.dumps({k: v for k, v in good.items() if k != "escalation_reason"}), ["missing_escalation_reason"]),
        (json.dumps(good | {"review_status": "MAYBE"}), ["invalid_review_status"]), (json.dumps(good | {"review_status": None}), ["invalid_review_status"]),
        (json.dumps(good | {"medical_concerns": "text"}), ["not_texts_medical_concerns"]), (json.dumps(good | {"medical_concerns": [1]}), ["not_texts_medical_concerns"]),
        (json.dumps(good | {"medical_concerns": ["a", None]}), ["not_texts_medical_concerns"]), (json.dumps(good | {"medical_concerns": [None]}), ["not_texts_medical_concerns"]),
        (json.dumps(good | {"escalation_reason": 5}), ["escalation_reason_not_text"]), (json.dumps(good | {"review_summary": None}), ["review_summary_not_text"]),
        (json.dumps(good | {"review_status": "ESCALATE"}), ["escalation_without_reason"]), (json.dumps(good | {"review_status": "ESCALATE", "escalation_reason": "now"}), []),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.p for r in df.select("i", guards.review_problems(F.col("t")).alias("p")).collect()}
    assert {i: got[i] for i in got} == {i: want for i, (_, want) in enumerate(cases)}
