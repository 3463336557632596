"""The store derived again from its archives: every observation is looked for at its place in its file, and
what the store says of it is compared with what the line there gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.captures import canonical, logical_key, members
from ..sources.scratch import stash

#: What an observation names of the envelope of its line.
ENVELOPE = ["capture_id", "dataset", "provider", "region"]
#: What identifies a record in its raw text.
IDENTITY = ["key", "sid", "time"]


def derive(lines: DataFrame) -> DataFrame:
    """lines(..., text) with what they give: the fields of the envelope, stated_sha256, and of the raw record
    raw_json, payload_sha256, raw_key, raw_sid, raw_time, logical; is_json and has_record say whether there is any."""
    named = lines.withColumn("_names", F.json_object_keys("text"))
    told = members(named, "text", {k: k for k in ENVELOPE} | {"stated_sha256": "raw_record_sha256", "_raw": "raw_record"}, F.size("_names") == F.size(F.array_distinct("_names")))
    # A record in which a name comes twice has no canonical text.
    told = members(told.withColumn("raw_json", canonical(F.col("_raw"))), "_raw", {f"raw_{k}": k for k in IDENTITY}, F.col("raw_json").isNotNull()).withColumns({
        "is_json": F.col("_raw").isNotNull() | F.get_json_object("text", "$").isNotNull(), "has_record": F.coalesce(F.json_object_keys("_raw").isNotNull(), F.lit(False)),
    }).drop("_names", "_raw")
    return told.withColumns({
        "payload_sha256": F.sha2("raw_json", 256), "raw_time": F.col("raw_time").try_cast("bigint"),
        "logical": logical_key(F.col("provider"), F.col("region"), F.col("dataset"), F.col("raw_key"), F.col("raw_sid"), F.col("raw_time").try_cast("bigint")),
    })


STORED = [*ENVELOPE, "payload_sha256", "raw_json", "logical", "raw_key", "raw_sid", "raw_time"]


def observe(lines: DataFrame) -> DataFrame:
    """What an import stores of lines(path, line, text) that can be taken: path, line and STORED."""
    return derive(lines).where("is_json and has_record").select("path", "line", *STORED)


def rederive(artifacts: DataFrame, found: DataFrame, lines: DataFrame, stored: DataFrame) -> DataFrame:
    """path, line, issue of all that the archives and the store say differently.

    artifacts(path, sha256): the archives that the store was made from; found(path, sha256) and lines(path,
    line, text): what is there now; stored(path, line, STORED). Of an archive that is gone
    (MISSING_ARCHIVE) or is another (ARCHIVE_HASH_MISMATCH) no line is looked at; the line is null in these
    and in COUNT_MISMATCH. A line has MISSING_LINE, UNUSED_LINE, NOT_JSON or NO_RAW_RECORD, else any of
    ENVELOPE_MISMATCH, PAYLOAD_HASH_MISMATCH, IDENTITY_MISMATCH, RAW_JSON_MISMATCH. Null equals null.

    The lines are joined by file and number, so a large file is spread over tasks. What is found is written once:
    the counts of a file differ if it has more lines without a row than rows without a line, or fewer. The list
    of archives is written too, so that its size is known where lines are looked up in it.
    """
    files = artifacts.join(found.withColumnRenamed("sha256", "_found"), "path", "left").withColumn(
        "issue", F.when(F.col("_found").isNull(), "MISSING_ARCHIVE").when(F.col("_found") != F.col("sha256"), "ARCHIVE_HASH_MISMATCH")
    )
    files = stash(files.select("path", "issue"), "archives-found")
    whole = files.where("issue is null").select("path")
    there, had = derive(lines.join(whole, "path", "left_semi")), stored.join(whole, "path", "left_semi")
    was = had.select("path", "line", F.lit(True).alias("_stored"), *(F.col(c).alias(f"_{c}") for c in STORED))
    both = there.withColumn("_there", F.lit(True)).drop("text").join(was, ["path", "line"], "full_outer")
    differ = lambda *names: ~_all(F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names)
    said = F.array_compact(F.array(
        F.when(differ(*ENVELOPE), "ENVELOPE_MISMATCH"),
        F.when(differ("payload_sha256") | ~F.col("stated_sha256").eqNullSafe(F.col("payload_sha256")), "PAYLOAD_HASH_MISMATCH"),
        F.when(differ("logical", "raw_key", "raw_sid", "raw_time"), "IDENTITY_MISMATCH"), F.when(differ("raw_json"), "RAW_JSON_MISMATCH"),
    ))
    one = F.when(F.col("_there").isNull(), "MISSING_LINE").when(F.col("_stored").isNull(), "UNUSED_LINE").when(~F.col("is_json"), "NOT_JSON").when(~F.col("has_record"), "NO_RAW_RECORD")
    issues = stash(both.select("path", "line", F.explode(F.when(one.isNotNull(), F.array(one)).otherwise(said)).alias("issue")), "issues")
    counts = issues.groupBy("path").agg(*(F.count_if(F.col("issue") == i).alias(i) for i in ("MISSING_LINE", "UNUSED_LINE"))).where("MISSING_LINE <> UNUSED_LINE")
    of_file = files.where("issue is not null").select("path", "issue").unionByName(counts.select("path", F.lit("COUNT_MISMATCH").alias("issue")))
    return issues.unionByName(of_file.select("path", F.lit(None).cast("bigint").alias("line"), "issue"))


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def summary(issues: DataFrame) -> DataFrame:
    """issue, n, files: how often each was found and in how many archives; empty where all agrees."""
    return issues.groupBy("issue").agg(F.count("*").alias("n"), F.count_distinct("path").alias("files"))
