"""A corpus from documents to training shards: quality rules, near-duplicates, benchmark leaks,
mixing and sharding, each by its operator in tidemark.llm.

Stages take and return the columns of documents; other columns, whatever their names, are left out.
Nulls are ordinary values in every column: a null text has no words (the quality rules reject it), a
null source is a source of its own, a null id comes last. Rows with equal id, text and source are
copies: the near-duplicate stage leaves one of them, the others judge them alike. A null and an empty
text are one text. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm._columns import row_key
from tidemark.llm._store import stash
from tidemark.llm.decontam import drop_leaks
from tidemark.llm.mixing import mix_sources
from tidemark.llm.quality import quality_rules, without_lines
from tidemark.llm.sharding import interleave_shards
from tidemark.llm.simhash import near_duplicates

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Columns of documents, which all stages but the last return.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with_key(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(*COLUMNS, row_key(F.col("doc_id"), F.col("text"), *map(F.col, more)).alias("_row"))


def _one_each(keyed: DataFrame, *more: str) -> DataFrame:
    """One row of those that share a key; the join before has dealt and sorted them by it. Rows whose
    64-bit keys are equal by chance are kept apart by what the key stands for."""
    first = F.row_number().over(Window.partitionBy("_row", "doc_id", F.md5(F.coalesce("text", F.lit(""))), *more).orderBy("_row"))
    return keyed.withColumn("_n", first).where("_n = 1").drop("_n")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that go; n_chars is renewed where a line
    went. Rows with equal id, text and source have one verdict."""
    keyed = _with_key(docs, "source")
    verdicts = quality_rules(keyed.select(F.col("_row").alias("doc_id"), "text", "source"), with_gone=True)
    kept = stash(verdicts.where("kept").select(F.col("doc_id").alias("_row"), "gone").dropDuplicates(["_row"]), "quality-kept")
    # One join and one pass: the texts are shuffled once.
    rows = keyed.join(kept, "_row").select(*COLUMNS, F.col("gone").isNotNull().alias("_cut"), "gone")
    length = F.when(F.col("_cut"), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return without_lines(rows).withColumn("n_chars", length).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts whose 5-word shingles have a Jaccard similarity of 0.8
    or more: that of the smallest id. Of rows with that id and equal texts one stays; a component
    without any id keeps one row."""
    parts = near_duplicates(docs, shingle=5, similarity=80)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    kept = parts.groupBy("root").agg(F.min_by("row", order).alias("_row")).select("_row")
    return _one_each(_with_key(docs).join(kept, "_row", "left_semi")).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_leaks(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often as the mix takes it."""
    taken = mix_sources(docs, whole_documents=True).where("copies > 0")
    copies = taken.groupBy(F.col("row").alias("_row")).agg(F.sum("copies").cast("int").alias("_copies"))
    once = _one_each(_with_key(docs, "source").join(copies, "_row"), "source")
    return once.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy")).drop("_copy")


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard and slot."""
    placed = interleave_shards(docs).select(F.col("row").alias("_row"), "shard", "slot", "size", "text_crc32")
    texts = _with_key(docs, "source").groupBy("_row").agg(*(F.first(c).alias(c) for c in COLUMNS))
    return placed.join(texts, "_row").select("shard", "slot", *COLUMNS, "size", "text_crc32")


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("near duplicates", near_dedup),
    ("decontamination", decontaminate),
    ("mixing", mix),
    ("sharding", shard),
]

#: Shingle similarity over all pairs and greedy tiling are not SQL; tests compare run() with a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
