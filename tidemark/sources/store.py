"""Versioned tables: a new version is written beside the old ones and a small file names it, so readers see
whole versions only and a run that fails leaves the old version.

The file of version n is created only if it is not there yet, which file systems do in one step. Of two
writers that started from one version the second is refused; its data stay unused beside the others.
"""

from __future__ import annotations

import uuid

from py4j.java_gateway import JavaObject
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..operators.reconcile import semantic_compare


class ConcurrentCommit(RuntimeError):
    """Another writer has committed the version that this one meant to write."""


def _file(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """The file system of a path and the path, as Hadoop has them."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _file(spark, path)
    return fs.exists(where)


def names(spark: SparkSession, path: str) -> list[str]:
    """The names in a folder; none where there is no folder. For folders of few entries."""
    fs, where = _file(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def current_version(spark: SparkSession, path: str) -> int:
    """The number of the current version; -1 if there is none."""
    return max((int(n) for n in names(spark, f"{path}/versions") if n.isdigit()), default=-1)


def _named(spark: SparkSession, path: str, number: int) -> Row:
    return spark.read.schema("version long, note string, data string").json(f"{path}/versions/{number}").first()


def note(spark: SparkSession, path: str, number: int) -> str:
    """What was noted of a version when it was committed."""
    return _named(spark, path, number).note


def read_version(spark: SparkSession, path: str, number: int) -> DataFrame:
    return spark.read.parquet(f"{path}/{_named(spark, path, number).data}")


def read_current(spark: SparkSession, path: str) -> DataFrame:
    return read_version(spark, path, current_version(spark, path))


def write(df: DataFrame, path: str) -> str:
    """Writes df beside the versions of a table, as none of them yet; returns its name for `name`."""
    data = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{data}")
    return data


def name(spark: SparkSession, path: str, number: int, note: str, data: str) -> None:
    """Makes what was written a version. Raises ConcurrentCommit if another writer was faster."""
    row = spark.createDataFrame([(number, note, data)], "version long, note string, data string").toJSON().first()
    fs, where = _file(spark, f"{path}/versions/{number}")
    try:
        out = fs.create(where, False)
    except Py4JJavaError as error:
        if fs.exists(where):
            raise ConcurrentCommit(f"version {number} of {path}") from error
        raise
    out.write(bytearray(row.encode() + b"\n"))
    out.close()


def commit(df: DataFrame, path: str, note: str = "", after: int | None = None) -> int:
    """Writes df as the version that follows `after` (the current one when the call begins), then names
    it. Raises ConcurrentCommit if another writer was faster."""
    spark = df.sparkSession
    number = (current_version(spark, path) if after is None else after) + 1
    name(spark, path, number, note, write(df, path))
    return number


def drop_data(spark: SparkSession, path: str, data: str) -> None:
    """Deletes what was written and is no version, or none any more."""
    fs, where = _file(spark, f"{path}/{data}")
    fs.delete(where, True)


def forget(spark: SparkSession, path: str) -> None:
    """Drops all versions before the current one, with their data. Readers of those fail. The data go first,
    so that a call that stops is gone on with by the next."""
    last = current_version(spark, path)
    for number in sorted(int(n) for n in names(spark, f"{path}/versions") if n.isdigit()):
        if number < last:
            drop_data(spark, path, _named(spark, path, number).data)
            fs, where = _file(spark, f"{path}/versions/{number}")
            fs.delete(where, False)


_RUNS = "pipeline string, status string, frontier long"


def run_log(spark: SparkSession, path: str, pipeline: str, status: str, frontier: int) -> None:
    """Appends a run with the last sequence number it has seen."""
    spark.createDataFrame([(pipeline, status, frontier)], _RUNS).coalesce(1).write.mode("append").json(path)


def checkpoint(spark: SparkSession, path: str, pipeline: str) -> int:
    """The frontier of the last passed run of a pipeline; 0 if there is none."""
    if not exists(spark, path):
        return 0
    runs = spark.read.schema(_RUNS).json(path)
    return runs.where((F.col("pipeline") == pipeline) & (F.col("status") == "PASS")).agg(F.coalesce(F.max("frontier"), F.lit(0))).first()[0]


def bootstrap(df: DataFrame, path: str, log: str, pipeline: str, frontier: int) -> int:
    """The first version of a table from a full build, and the checkpoint from which increments go on.
    Refused where the table or the checkpoint is there already."""
    spark = df.sparkSession
    if current_version(spark, path) >= 0 or checkpoint(spark, log, pipeline):
        raise ValueError(f"{pipeline} has been started already")
    number = commit(df, path, "full build", after=-1)
    run_log(spark, log, pipeline, "PASS", frontier)
    return number


def rebuild(df: DataFrame, path: str, content: list[str]) -> DataFrame:
    """Writes a full build beside the current version (unnamed) and compares the two by content: the rows
    that only one of them has, and which (side); empty if increments and full build agree."""
    spark = df.sparkSession
    data = f"{path}/rebuilt-{uuid.uuid4().hex}"
    df.write.parquet(data)
    return semantic_compare(read_current(spark, path), spark.read.parquet(data), content)
