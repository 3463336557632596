"""Captures on disk: JSON lines with a manifest, checked before anything is taken from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.reconcile import same_content
from .store import exists

# The fields that every line must have.
REQUIRED = ["provider", "region", "dataset", "capture_id", "ingested_at_utc", "raw_record_sha256", "raw_record"]


def _split_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, split (its first byte), part and place (of the line among those that its task reads), value:
    every line of the files, large ones read by as many tasks as they have splits."""
    at = F.monotonically_increasing_id()
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.shiftright(at, 33).alias("part"), at.alias("place"), "value",
    )


def scan_archives(spark: SparkSession, path: str) -> DataFrame:
    """path, file, line (from 1, blank lines counted), text of each line that is not blank; a line ends with
    \\n or \\r\\n.

    Two passes over byte ranges: the first counts the line ends of each split, whose sums up to a split
    are where its lines begin; the second reads the lines. Both are read by the same tasks: a split that
    the second meets in another task than the first is an error, not a wrong number. The sums are a row
    for each split, as many as Spark's own listing of them, so they are sent to the lines and not the lines to them.
    """
    lines = _split_lines(spark, path)
    counts = lines.groupBy("path", "split", "part").agg(F.count("*").alias("n"), F.min("place").alias("begins"))
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("begins") + 1).select("path", "split", "part", "offset")
    numbered = lines.join(F.broadcast(offsets), ["path", "split", "part"], "left")
    line = F.coalesce(F.col("offset"), F.raise_error(F.lit("a split was read by another task")).cast("bigint")) + F.col("place")
    text = F.regexp_replace(F.regexp_replace("value", "\r$", ""), F.when(F.col("line") == 1, "^\ufeff").otherwise("^(?!)"), F.lit(""))
    return numbered.withColumn("line", line.cast("bigint")).select("path", "file", "line", text.alias("text")).where(F.trim("text") != "")


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """file, line, text of each line that is not blank; see scan_archives."""
    return scan_archives(spark, path).drop("path")


def archive_hashes(spark: SparkSession, path: str) -> DataFrame:
    """path and sha256 of each file. A file is one value here, so files are of at most 2 GB."""
    return spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("path"), F.sha2("content", 256).alias("sha256"))


def field(name: str) -> Column:
    return F.get_json_object("text", f"$.{name}")


def members(df: DataFrame, text: str, names: dict[str, str], plain: Column) -> DataFrame:
    """df with members of the JSON object in a column, {new column: member}, as get_json_object gives each of them,
    but the text is parsed once for all. Where a name comes twice in an object the two read it differently, so
    where plain is not true each is asked for by itself."""
    read = [f"_member_{c}" for c in names]
    told = df.withColumn("_plain", plain).select("*", F.json_tuple(text, *names.values()).alias(*read))
    return told.withColumns({c: F.when(F.col("_plain"), F.col(r)).otherwise(F.get_json_object(text, f"$.{m}")) for r, (c, m) in zip(read, names.items(), strict=True)}).drop("_plain", *read)


def canonical(raw: Column) -> Column:
    """JSON text with the members of all objects in the order of their names, without blanks; texts,
    numbers and nested values keep their types."""
    return F.to_json(F.try_parse_json(raw))


def logical_key(*parts: Column) -> Column:
    """The identity of a record; null parts are told from empty ones."""
    return F.sha2(F.to_json(F.struct(*(p.alias(f"p{i}") for i, p in enumerate(parts))), {"ignoreNullFields": "false"}), 256)


def validate(lines: DataFrame, dataset: str, capture: str) -> DataFrame:
    """lines with `issue`: null for an envelope that can be taken."""
    missing = F.array_compact(F.array(*(F.when(field(k).isNull(), F.lit(k)) for k in REQUIRED)))
    raw = field("raw_record")
    return lines.withColumn(
        "issue",
        F.when(F.get_json_object("text", "$").isNull(), "NOT_JSON")
        .when(F.size(missing) > 0, F.concat(F.lit("MISSING_"), F.upper(F.get(missing, F.lit(0)))))
        .when(field("dataset") != dataset, "WRONG_DATASET").when(field("capture_id") != capture, "WRONG_CAPTURE")
        .when(field("raw_record_sha256") != F.sha2(canonical(raw), 256), "HASH_MISMATCH"),
    )


def verify_manifest(spark: SparkSession, manifest: str, files: str, lines: DataFrame) -> DataFrame:
    """dataset, issue for each dataset of a manifest {"datasets": {name: {output_file, output_sha256,
    record_count}}} whose file is missing, has another hash or another number of lines."""
    schema = "datasets map<string, struct<record_count: long, output_file: string, output_sha256: string>>"
    listed = spark.read.schema(schema).option("multiLine", True).json(manifest).select(F.explode("datasets").alias("dataset", "m")).select("dataset", "m.*")
    seen = spark.read.format("binaryFile").load(files).select(F.element_at(F.split("path", "/"), -1).alias("output_file"), F.sha2("content", 256).alias("found"))
    counted = lines.groupBy(F.col("file").alias("output_file")).agg(F.count("*").alias("lines"))
    joined = listed.join(seen, "output_file", "left").join(counted, "output_file", "left")
    issue = (
        F.when(F.col("found").isNull(), "MISSING_FILE").when(F.col("found") != F.col("output_sha256"), "HASH_MISMATCH")
        .when(F.coalesce("lines", F.lit(0)) != F.col("record_count"), "COUNT_MISMATCH")
    )
    return joined.withColumn("issue", issue).where("issue is not null").select("dataset", "issue")


def write_lines(records: DataFrame, path: str) -> None:
    """One JSON object a line; an existing capture is never overwritten. To write the same again does
    nothing, to write anything else is an error."""
    spark = records.sparkSession
    if exists(spark, path):
        if same_content(records, spark.read.schema(records.schema).json(path)):
            return
        raise FileExistsError(f"another capture exists at {path}")
    records.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def consistency_problems(observations: DataFrame, records: DataFrame, kinds: list[str]) -> DataFrame:
    """Observations (seq, logical, classification, dataset, provider, region) that are of an unknown kind or
    do not agree with their record(logical, dataset, provider, region): seq, problem."""
    fields = ["dataset", "provider", "region"]
    joined = observations.join(records.select("logical", *(F.col(f).alias(f"_{f}") for f in fields), F.lit(True).alias("_known")), "logical", "left")
    problem = F.when(~F.col("classification").isin(kinds), "UNKNOWN_CLASSIFICATION").when(F.col("_known").isNull(), "NO_RECORD")
    for f in fields:
        problem = problem.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), f"{f.upper()}_DIFFERS")
    return joined.select("seq", problem.alias("problem")).where("problem is not null")


def dry_run(lines: DataFrame, dataset: str, capture: str) -> DataFrame:
    """What an import would take and refuse, nothing written."""
    return validate(lines, dataset, capture).groupBy("issue").agg(F.count("*").alias("n"))
