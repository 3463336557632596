import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions.scalar import local_date, metric_of, source_class
from tidemark.operators import evidence
from tidemark.sources import captures, store


def envelope(**over):
    raw = {"key": "k", "sid": "1", "value": '{"k": 1}'}
    text = json.dumps(raw, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return {"provider": "p", "region": "r", "dataset": "steps", "capture_id": "c1", "ingested_at_utc": "t", "raw_record_sha256": hashlib.sha256(text.encode()).hexdigest(), "raw_record": raw} | over


@pytest.fixture
def capture(tmp_path):
    lines = [json.dumps(envelope()), "", "  ", json.dumps(envelope(dataset="other")), json.dumps(envelope(raw_record_sha256="0")), "{oops", json.dumps({k: v for k, v in envelope().items() if k != "region"})]
    (tmp_path / "steps.jsonl").write_text("﻿" + "\r\n".join(lines) + "\n", encoding="utf-8")
    return tmp_path


def test_lines_keep_their_numbers_and_are_checked(spark, capture):
    lines = captures.scan_lines(spark, str(capture / "steps.jsonl"))
    got = {r.line: r.issue for r in captures.validate(lines, "steps", "c1").collect()}
    assert got == {1: None, 4: "WRONG_DATASET", 5: "HASH_MISMATCH", 6: "NOT_JSON", 7: "MISSING_REGION"}
    assert {r.issue: r.n for r in captures.dry_run(lines, "steps", "c2").collect()}["WRONG_CAPTURE"] == 2


def test_manifest(spark, capture):
    data = (capture / "steps.jsonl").read_bytes()
    listed = {"steps": {"record_count": 5, "output_file": "steps.jsonl", "output_sha256": hashlib.sha256(data).hexdigest()}, "sleep": {"record_count": 1, "output_file": "sleep.jsonl", "output_sha256": "0"}}
    manifest = capture / "manifest.json"
    manifest.write_text(json.dumps({"datasets": listed}, indent=1))
    lines = captures.scan_lines(spark, str(capture / "steps.jsonl"))
    issues = lambda: {r.dataset: r.issue for r in captures.verify_manifest(spark, str(manifest), str(capture / "steps.jsonl"), lines).collect()}
    assert issues() == {"sleep": "MISSING_FILE"}
    listed["steps"]["record_count"] = 4
    manifest.write_text(json.dumps({"datasets": listed}))
    assert issues()["steps"] == "COUNT_MISMATCH"
    listed["steps"]["output_sha256"] = "1"
    manifest.write_text(json.dumps({"datasets": listed}))
    assert issues()["steps"] == "HASH_MISMATCH"


def test_written_lines_are_never_overwritten(spark, tmp_path):
    df = spark.createDataFrame([(1, None)], "a long, b string")
    captures.write_lines(df, str(tmp_path / "x"))
    assert spark.read.json(str(tmp_path / "x")).first().a == 1
    captures.write_lines(df, str(tmp_path / "x"))  # the same again does nothing
    assert spark.read.json(str(tmp_path / "x")).count() == 1
    with pytest.raises(FileExistsError):
        captures.write_lines(spark.createDataFrame([(2, None)], "a long, b string"), str(tmp_path / "x"))


def test_versions_and_checkpoints(spark, tmp_path):
    path = str(tmp_path / "t")
    assert store.current_version(spark, path) == -1
    assert [store.commit(spark.range(n), path) for n in (1, 2, 3)] == [0, 1, 2]
    assert store.read_current(spark, path).count() == 3
    with pytest.raises(store.ConcurrentCommit):
        store.commit(spark.range(9), path, after=1)
    assert store.read_current(spark, path).count() == 3
    assert store.rebuild(spark.range(3), path, ["id"]).count() == 0 and store.rebuild(spark.range(4), path, ["id"]).first().side == "only_second"
    assert store.bootstrap(spark.range(5), str(tmp_path / "b"), str(tmp_path / "started"), "p", 77) == 0
    assert store.checkpoint(spark, str(tmp_path / "started"), "p") == 77
    with pytest.raises(ValueError, match="started"):
        store.bootstrap(spark.range(5), str(tmp_path / "b"), str(tmp_path / "started"), "p", 78)
    log = str(tmp_path / "runs")
    assert store.checkpoint(spark, log, "p") == 0
    for status, frontier in (("PASS", 10), ("FAIL", 20), ("PASS", 15)):
        store.run_log(spark, log, "p", status, frontier)
    assert store.checkpoint(spark, log, "p") == 15 and store.checkpoint(spark, log, "q") == 0


def test_scalars(spark):
    df = spark.createDataFrame([("hlth.gen_1",), ("17",)], "sid string")
    assert [r[0] for r in df.select(source_class(F.col("sid"))).collect()] == ["GENERATED_SOURCE", "NUMERIC_SOURCE"]
    ts = F.lit("2026-08-01 20:00:00").cast("timestamp")
    for offset, zone, want in ((28800, None, "2026-08-02"), (None, "Asia/Tokyo", "2026-08-02"), (None, "No/Where", "2026-08-01"), (-18000, "Asia/Tokyo", "2026-08-01")):
        got = spark.range(1).select(local_date(ts, F.lit(offset).cast("int"), F.lit(zone), ["Asia/Tokyo"])).first()[0]
        assert got.isoformat() == want
    assert spark.range(1).select(metric_of(F.lit("sleep_source_episode.duration"))).first()[0] == "sleep"


def test_logical_keys_tell_null_from_empty(spark):
    df = spark.createDataFrame([("a", None), ("a", ""), ("a", None)], "x string, y string")
    keys = [r[0] for r in df.select(captures.logical_key(F.col("x"), F.col("y"))).collect()]
    assert keys[0] == keys[2] != keys[1]


def test_gates_and_cache(spark):
    last = spark.createDataFrame([(1, "u", "b", "j"), (2, "u", "b", "j"), (3, "u", "b", "j"), (4, "u", "b", "j")], "key long, upstream string, bundle string, judgment string")
    now = spark.createDataFrame([(1, "u", "x", "x"), (2, "v", "b", "x"), (3, "v", "c", "j"), (4, "v", "c", "k"), (5, "u", "b", "j")], last.schema)
    got = {r.key: r.gate for r in evidence.gates(last, now, "key").collect()}
    assert got == {1: "UNCHANGED", 2: "SAME_EVIDENCE", 3: "SAME_JUDGMENT", 4: "NEW_VERSION", 5: "NEW_VERSION"}
    cache = spark.createDataFrame([(hashlib.sha256(b"q").hexdigest(), "yes")], "request_hash string, answer string")
    assert {r.request: r.answer for r in evidence.cached(spark.createDataFrame([("q",), ("r",)], "request string"), cache).collect()} == {"q": "yes", "r": None}


def test_today_and_sentences(spark):
    devs = spark.createDataFrame([(1, "hr", "ABOVE_TYPICAL_RANGE", 2.0), (1, "hr", "ABOVE_TYPICAL_RANGE", 3.0), (1, "sleep", "BELOW_TYPICAL_RANGE", 5.0), (1, "x", "INSUFFICIENT_BASELINE", None)], "k long, metric string, deviation_class string, distance double")
    said = evidence.sentences(devs, ["k"])
    assert said.first().sentences == ["sleep is below the usual range", "hr is above the usual range"]
    judged = spark.createDataFrame([(1, "C", "LOW", ["a", "b", "c", "d"]), (2, "A", "LOW", ["a"])], "k long, state string, confidence string, actions array<string>")
    got = {r.k: r.payload for r in evidence.today(judged, said, ["k"]).collect()}
    assert got[1].actions == ["a", "b", "c"] and got[2].actions == [] and got[2].sentences == []


def test_absent_facts_and_feedback(spark):
    outputs = spark.createDataFrame([(1, "Fever and a cough"), (2, "all fine")], "id long, text string")
    known = spark.createDataFrame([(1, "a cough was reported"), (2, "")], "id long, text string")
    got = [tuple(r) for r in evidence.absent_facts(outputs, known, {"fever": ["fever"], "cough": ["cough"]}).collect()]
    assert got == [(1, "fever")]
    assert [r[0] for r in spark.createDataFrame([("Accurate",), ("other",)], "v string").select(evidence.feedback_status(F.col("v"))).collect()] == ["CONFIRMED", None]


def test_canonical_json_keeps_types(spark):
    values = [{"b": 1, "a": "1"}, {"a": 1}, {"a": {"z": [1, "x", None], "b": True}, "c": 2.5}, {"ü": "é\n"}]
    got = [r[0] for r in spark.createDataFrame([(json.dumps(v),) for v in values], "t string").select(captures.canonical(F.col("t"))).collect()]
    assert got == [json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for v in values]


def test_observations_agree_with_their_records(spark):
    seen = spark.createDataFrame([(1, "a", "NEW", "d", "p", None), (2, "a", "OTHER", "d", "p", None), (3, "b", "NEW", "d", "p", "r"), (4, "a", "NEW", "e", "p", None)], "seq long, logical string, classification string, dataset string, provider string, region string")
    records = spark.createDataFrame([("a", "d", "p", None)], "logical string, dataset string, provider string, region string")
    got = {r.seq: r.problem for r in captures.consistency_problems(seen, records, ["NEW", "REVISION"]).collect()}
    assert got == {2: "UNKNOWN_CLASSIFICATION", 3: "NO_RECORD", 4: "DATASET_DIFFERS"}


@pytest.mark.parametrize("split", [10_000_000, 4000, 300])
def test_lines_of_split_files_keep_their_numbers(spark, tmp_path, split):
    """One file read by many tasks gives the numbers of the whole file."""
    want = set()
    for k, end in enumerate(("\n", "\r\n", "\n")):
        lines = [("", "  ", f"line {i} " + "x" * (i * 7 % 80), "é" * (i % 20 + 1))[(i * 7 + i // 5) % 4] for i in range(300 + 200 * k)]
        (tmp_path / f"f{k}.jsonl").write_bytes(("﻿" + end.join(lines) + (end if k else "")).encode())
        want |= {(f"f{k}.jsonl", n, text) for n, text in enumerate(lines, 1) if text.strip(" ")}
    (tmp_path / "empty.jsonl").write_text("")
    settings = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = captures.scan_lines(spark, str(tmp_path)).collect()
        tasks = captures._split_lines(spark, str(tmp_path)).select("path", "split").distinct().count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {tuple(r) for r in got} == want and len(got) == len(want) and (tasks > 30 if split == 300 else tasks >= 3)
