"""The observation log as a stream: classified versions kept up to date by micro-batch.

Late records are always accepted, so there is no watermark; the state is the table of versions, and
which places of the log have been taken in. Both are ledgers: a batch writes the versions that its new
rows add to and their places, not the whole state, and a batch that is run again writes the same.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ingest import classify, versions
from .ledger import Ledger

SCHEMA = "logical string, payload bigint, first_seq bigint, last_seq bigint, observations bigint"


def merge_versions(rows: DataFrame) -> DataFrame:
    """Versions merge by their first and last place and the sum of their observations."""
    return rows.groupBy("logical", "payload").agg(
        F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"), F.sum("observations").alias("observations")
    )


def fold(state: DataFrame, batch: DataFrame) -> DataFrame:
    """State after a batch of new log rows. Equal to the versions of the whole log, in whatever batches it
    came."""
    return merge_versions(state.unionByName(versions(classify(batch)).select(*state.columns)))


def unseen(batch: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows of a batch whose place in the log has not been taken in yet; a row that is there twice counts
    once. Only the stretch of places that the batch spans is read of seen(seq)."""
    span = batch.agg(F.min("seq"), F.max("seq")).first()
    if span[0] is None:
        return batch
    return batch.dropDuplicates(["seq"]).join(seen.where(F.col("seq").between(*span)), "seq", "left_anti")


def _versions(path: str) -> Ledger:
    return Ledger(f"{path}/versions", SCHEMA, merge_versions, order=("logical",))


def _places(path: str) -> Ledger:
    return Ledger(f"{path}/seen", "seq bigint", lambda rows: rows, order=("seq",))


def ingest(log: DataFrame, path: str, checkpoint: str) -> int:
    """Runs a stream of log rows to its end; returns the number of the last batch under path, whether or
    not this run made it (-1: there is none)."""
    state, places = _versions(path), _places(path)

    def step(batch: DataFrame, number: int) -> None:
        new = unseen(batch, places.read(batch.sparkSession, number - 1)).persist()
        state.add(versions(classify(new)), number)
        places.add(new.select("seq"), number)
        new.unpersist()

    query = log.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return state.last(log.sparkSession)


def current(spark: SparkSession, path: str, number: int) -> DataFrame:
    return _versions(path).read(spark, number)


def daily_windows(log: DataFrame) -> DataFrame:
    """Count, sum, least and most of each metric and UTC day of a stream (metric, ts, value), as it grows;
    for output in complete or update mode. Late rows are always taken, so there is no watermark."""
    day = F.window(F.col("ts").cast("timestamp"), "1 day")
    return log.groupBy("metric", day.alias("w")).agg(
        F.count("value").alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high")
    ).select("metric", F.to_date("w.start").alias("day"), "n", "total", "low", "high")
