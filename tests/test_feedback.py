"""Feedback: what it is about, and its counters equal to a plain fold however the feedback is cut."""

import random
from datetime import date, timedelta

import pytest

from tidemark.operators import feedback as fb
from tidemark.operators import reconcile
from tidemark.streaming import feedback as stream

FEEDBACK = "id long, subject string, subject_type string, subject_id long, day date, verdict string, text string"
JUDGMENTS = "id long, subject string, day date, status string, contexts array<string>, deviations array<struct<metric: string, deviation_class: string>>"
UP, DOWN, WITHIN = "ABOVE_TYPICAL_RANGE", "BELOW_TYPICAL_RANGE", "WITHIN_TYPICAL_RANGE"
DAY = date(2024, 1, 1)


def judgment_rows():
    rng = random.Random(1)
    out = []
    for i in range(60):
        contexts = [rng.choice(["FEVER", "STRESS", "TRAVEL"]) for _ in range(rng.randrange(4))]
        devs = [(rng.choice(["steps", "sleep"]), rng.choice([UP, DOWN, WITHIN])) for _ in range(rng.randrange(4))]
        out.append((i, f"s{i % 3}", DAY + timedelta(days=i // 6), rng.choice(["CURRENT", "CURRENT", "STALE"]), contexts, devs))
    return out


def feedback_rows():
    rng = random.Random(2)
    verdicts = ["accurate", "accurate", "inaccurate", "partly", "补充情况", "准确", "so so"]
    texts = [None, "", "I had a fever yesterday", "nothing of note", "昨晚喝酒，练腿", "stress and travel"]
    return [
        (i, f"s{rng.randrange(4)}", rng.choice(["DAILY_REASONING"] * 5 + ["HYPOTHESIS"]), rng.choice([None, None, rng.randrange(70)]),
         rng.choice([None, DAY + timedelta(days=rng.randrange(12))]), rng.choice(verdicts), rng.choice(texts)) for i in range(300)
    ]


def folded(feedback, judgments):
    """Feedback taken in one at a time in the order of ids."""
    by_id = {j[0]: j for j in judgments}
    counts, about = {}, {}
    for i, subject, kind, given, day, verdict, _ in feedback:
        status = {"accurate": "CONFIRMED", "准确": "CONFIRMED", "inaccurate": "REJECTED", "partly": "CORRECTED", "补充情况": "CORRECTED"}.get(verdict)
        known = [j[0] for j in judgments if j[1] == subject and j[3] == "CURRENT" and day in (None, j[2])]
        target = given if given is not None else max(known, default=None)
        about[i] = (target, status)
        if status is None or target not in by_id or kind != "DAILY_REASONING":
            continue
        _, _, seen, _, contexts, devs = by_id[target]
        signals = sorted({m + ("_UP" if c == UP else "_DOWN") for m, c in devs if c != WITHIN})
        for trigger in contexts:
            for signal in signals:
                old = counts.get((subject, trigger, signal))
                confirmed = int(status == "CONFIRMED")
                if old:
                    support = old[0] + confirmed
                    counts[subject, trigger, signal] = (support, old[1] + 1, "ESTABLISHED" if support >= 3 else "OBSERVING", old[3], seen)
                else:
                    counts[subject, trigger, signal] = (confirmed, 1, "OBSERVING", seen, seen)
    return counts, about


def shown(state):
    return {(r.subject, r.trigger, r.signal): (r.support, r.total, r.maturity, r.first_seen, r.last_seen) for r in fb.patterns_of(state).collect()}


@pytest.fixture
def judgments(spark):
    return spark.createDataFrame(judgment_rows(), JUDGMENTS)


def test_counters_equal_a_fold_one_by_one(spark, judgments):
    settled = fb.settle(spark.createDataFrame(feedback_rows(), FEEDBACK), judgments)
    counts, about = folded(feedback_rows(), judgment_rows())
    assert shown(fb.counters(settled)) == counts and len(counts) > 20 and any(v[2] == "ESTABLISHED" for v in counts.values())
    rows = fb.recorded(settled).collect()
    assert len(rows) == 300 and {r.id: (r.subject_id, r.feedback_status) for r in rows} == about
    for r in rows:
        assert r.problem == ("UNKNOWN_VERDICT" if r.feedback_status is None else "NO_JUDGMENT" if r.subject_id is None else None)
        if r.feedback_status == "CORRECTED":
            assert r.category == ("reason_corrected" if r.text == "nothing of note" else "context_added")
    assert {r.problem for r in rows} == {None, "UNKNOWN_VERDICT", "NO_JUDGMENT"}


def test_corrections_add_contexts_on_the_day_judged(spark, judgments):
    rows = [(1, "s0", "DAILY_REASONING", 0, None, "partly", "I had a fever yesterday"), (2, "s0", "DAILY_REASONING", 6, None, "补充情况", "leg day at the gym"),
            (3, "s0", "DAILY_REASONING", 6, None, "accurate", "fever"), (4, "s0", "HYPOTHESIS", 6, None, "partly", "stress"),
            (5, "s0", "DAILY_REASONING", 999, None, "partly", "wine"), (6, "s0", "DAILY_REASONING", 6, None, "hm", "wine"), (7, "s0", "DAILY_REASONING", 6, None, "partly", "")]
    got = fb.corrected_contexts(fb.settle(spark.createDataFrame(rows, FEEDBACK), judgments)).collect()
    assert sorted((r.id, r.context_type, r.context_date, r.body_part) for r in got if r.id < 4) == [
        (1, "FEVER", date(2023, 12, 31), None), (2, "HIGH_INTENSITY_TRAINING", date(2024, 1, 2), "legs"),
    ]
    assert sorted((r.id, r.context_type, r.context_date) for r in got if r.id > 3) == [(4, "STRESS", None), (5, "ALCOHOL_USE", None)]
    assert {(r.source, r.status) for r in got} == {("USER_REPORTED", "CURRENT")}


@pytest.mark.parametrize(("cuts", "every"), [(1, 16), (9, 2)])
def test_any_batches_and_replays_give_the_same(spark, judgments, tmp_path, cuts, every):
    rows = feedback_rows()
    random.Random(5).shuffle(rows)
    for n in range(cuts):
        part = rows[n * len(rows) // cuts : (n + 1) * len(rows) // cuts]
        part = part + part[:5] + (rows[:20] if n else [])  # again within a batch, and in later ones
        spark.createDataFrame(part, FEEDBACK).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(FEEDBACK).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    path = str(tmp_path / "out")
    number = stream.ingest(source, judgments, path, str(tmp_path / "ckpt"), every)
    assert number == cuts - 1
    settled = fb.settle(spark.createDataFrame(rows, FEEDBACK), judgments)
    want = {"counters": fb.counters(settled), "contexts": fb.corrected_contexts(settled), "recorded": fb.recorded(settled)}
    for kind, rows_ in want.items():
        assert reconcile.same_content(stream.current(spark, path, kind, number), rows_)
    assert shown(stream.current(spark, path, "counters", number)) == folded(feedback_rows(), judgment_rows())[0]
    # The last batch again, as after a crash: nothing changes.
    last = spark.createDataFrame(feedback_rows()[:30], FEEDBACK)
    stream.take(last, number + 1, judgments, path, every)
    stream.take(last, number + 1, judgments, path, every)
    for kind, rows_ in want.items():
        assert reconcile.same_content(stream.current(spark, path, kind, number + 1), rows_)


def test_empty_tables(spark, judgments):
    none = spark.createDataFrame([], FEEDBACK)
    settled = fb.settle(none, judgments)
    assert fb.counters(settled).count() == fb.corrected_contexts(settled).count() == fb.recorded(settled).count() == 0
    some = fb.settle(spark.createDataFrame(feedback_rows()[:9], FEEDBACK), spark.createDataFrame([], JUDGMENTS))
    assert fb.counters(some).count() == 0 and fb.recorded(some).count() == 9
