"""Changes planted in archives and in the store are found when the store is derived again."""

import hashlib
import json

from pyspark.sql import functions as F

from tidemark.operators import provenance
from tidemark.sources import captures


def line(i, **over):
    raw = {"key": f"k{i}", "sid": str(i % 3), "time": 1700000000 + i, "value": '{"v": 1}', "é": None}
    text = json.dumps(raw, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    envelope = {"provider": "p", "region": "r", "dataset": "steps", "capture_id": "c1", "ingested_at_utc": "t", "raw_record_sha256": hashlib.sha256(text.encode()).hexdigest(), "raw_record": raw}
    return json.dumps(envelope | over, ensure_ascii=False)


def write(folder, name, rows):
    (folder / name).write_text("".join(r + "\n" for r in rows), encoding="utf-8")


def read(spark, folder):
    return captures.archive_hashes(spark, str(folder)), captures.scan_archives(spark, str(folder))


def issues(*tables):
    return sorted((r.path.rsplit("/", 1)[1], r.line or 0, r.issue) for r in provenance.rederive(*tables).collect())


def test_all_agrees_then_every_kind_of_change_is_found(spark, tmp_path):
    names = ["a.jsonl", "b.jsonl", "c.jsonl"]
    for n, name in enumerate(names):
        write(tmp_path, name, [line(10 * n + i) for i in range(5)] + ["", line(10 * n + 9)])
    hashes, lines = read(spark, tmp_path)
    artifacts = spark.createDataFrame(hashes.collect(), hashes.schema)
    made = provenance.observe(lines)
    stored = spark.createDataFrame(made.collect(), made.schema)
    assert stored.count() == 18 and issues(artifacts, hashes, lines, stored) == []
    assert provenance.summary(provenance.rederive(artifacts, hashes, lines, stored)).count() == 0
    # The store has changed: lines of a file, from which a blank one is left out.
    at = lambda n: F.col("path").endswith("a.jsonl") & (F.col("line") == n)
    bad = stored.where(~at(1)).withColumn("region", F.when(at(2), None).otherwise(F.col("region"))).withColumn("payload_sha256", F.when(at(3), "0").otherwise(F.col("payload_sha256")))
    bad = bad.withColumn("raw_sid", F.when(at(4), "x").otherwise(F.col("raw_sid"))).withColumn("raw_json", F.when(at(7), F.concat("raw_json", F.lit(" "))).otherwise(F.col("raw_json")))
    bad = bad.unionByName(stored.where(at(2)).withColumn("line", F.lit(6).cast("bigint")))
    assert issues(artifacts, hashes, lines, bad) == [
        ("a.jsonl", 1, "UNUSED_LINE"), ("a.jsonl", 2, "ENVELOPE_MISMATCH"), ("a.jsonl", 3, "PAYLOAD_HASH_MISMATCH"), ("a.jsonl", 4, "IDENTITY_MISMATCH"),
        ("a.jsonl", 6, "MISSING_LINE"), ("a.jsonl", 7, "RAW_JSON_MISMATCH"),
    ]
    assert ("a.jsonl", 0, "COUNT_MISMATCH") in issues(artifacts, hashes, lines, stored.where(~at(1)))
    # The files have changed: their hash says so; where the hash is taken as it is now, their lines do.
    write(tmp_path, "b.jsonl", [line(10), "{oops", line(12, raw_record=[1]), line(13, dataset="sleep"), line(14, raw_record_sha256="1"), "", line(99)])
    (tmp_path / "c.jsonl").unlink()
    hashes, lines = read(spark, tmp_path)
    assert issues(artifacts, hashes, lines, stored) == [("b.jsonl", 0, "ARCHIVE_HASH_MISMATCH"), ("c.jsonl", 0, "MISSING_ARCHIVE")]
    got = issues(hashes, hashes, lines, stored)
    assert got == [
        ("b.jsonl", 2, "NOT_JSON"), ("b.jsonl", 3, "NO_RAW_RECORD"), ("b.jsonl", 4, "ENVELOPE_MISMATCH"), ("b.jsonl", 4, "IDENTITY_MISMATCH"), ("b.jsonl", 5, "PAYLOAD_HASH_MISMATCH"),
        ("b.jsonl", 7, "IDENTITY_MISMATCH"), ("b.jsonl", 7, "PAYLOAD_HASH_MISMATCH"), ("b.jsonl", 7, "RAW_JSON_MISMATCH"),
    ]
    assert {r.issue: (r.n, r.files) for r in provenance.summary(provenance.rederive(hashes, hashes, lines, bad)).collect()}["UNUSED_LINE"] == (1, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_archives_are_read_for_one_join_and_their_lines_are_not_dealt_to_be_numbered(spark, tmp_path):
    write(tmp_path, "a.jsonl", [line(i) for i in range(5)] + ["{oops"])
    hashes, lines = read(spark, tmp_path)
    made = provenance.observe(lines)
    found = provenance.rederive(hashes, hashes, lines, spark.createDataFrame(made.collect(), made.schema))
    assert "text" not in {scan.split(maxsplit=1)[0] for scan in plan(found).split("FileScan ")[1:]} and "Exchange" not in plan(lines).split("BroadcastHashJoin")[0]
    assert "BroadcastHashJoin" in plan(lines) and [(r.line, r.issue) for r in found.collect()] == [(6, "UNUSED_LINE"), (None, "COUNT_MISMATCH")]


def test_members_are_read_at_once_as_if_each_were_asked_for(spark):
    raws = ['{"key":"a","sid":1.50,"time":1}', '{"key":null,"key":"b","key":"c","sid":{"z":1,"a":[1, 2]},"time":"3","time":4}', '{"key":"\\u00e9"}', '"text"', '"{\\"key\\":1}x"', "[1]", "null", "{oops"]
    texts = [t % r for r in raws for t in ('{"provider":"p","raw_record":%s}', '{"provider":null,"provider":"p","provider":"q","raw_record":%s,"raw_record":{"key":2}}', '{"raw_record":%s} tail', "[%s]")]
    lines = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)], "path string, line bigint, text string")
    told = provenance.derive(lines)
    raw = F.get_json_object("text", "$.raw_record")
    asked = {"provider": F.get_json_object("text", "$.provider"), "raw_key": F.get_json_object(raw, "$.key"), "raw_sid": F.get_json_object(raw, "$.sid"), "raw_json": captures.canonical(raw),
             "raw_time": F.get_json_object(raw, "$.time").try_cast("bigint"), "is_json": F.get_json_object("text", "$").isNotNull(), "has_record": F.json_object_keys(raw).isNotNull()}
    assert told.where(~provenance._all(F.col(c).eqNullSafe(v) for c, v in asked.items())).count() == 0
    assert told.where("has_record").count() > 10 and plan(told).count("json_tuple") == 2
