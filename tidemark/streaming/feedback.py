"""Feedback as a stream: counters of patterns, contexts that corrections add, and what was recorded.

A batch writes what its new feedback adds to each; what is recorded is written last, and a batch counts
once that is there. Feedback whose id is recorded already changes nothing, in whatever batch it comes
again. Feedback of one id is taken to say the same each time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import feedback as fb
from .incremental import unseen
from .ledger import Ledger


def ledgers(path: str, every: int = 16) -> dict[str, Ledger]:
    return {
        "counters": Ledger(f"{path}/counters", fb.COUNTERS, fb.merge_counters, every, ("subject",)),
        "contexts": Ledger(f"{path}/contexts", fb.CONTEXTS, lambda rows: rows, every, ("subject",)),
        "recorded": Ledger(f"{path}/recorded", fb.RECORDED, lambda rows: rows, every, ("id",)),
    }


def take(batch: DataFrame, number: int, judgments: DataFrame, path: str, every: int = 16) -> None:
    """Takes in a batch of feedback (see operators.feedback.settle)."""
    books = ledgers(path, every)
    known = books["recorded"].read(batch.sparkSession, number - 1).selectExpr("id as seq")
    new = unseen(batch.withColumnRenamed("id", "seq"), known).withColumnRenamed("seq", "id")
    settled = fb.settle(new, judgments).persist()
    books["counters"].add(fb.counters(settled), number)
    books["contexts"].add(fb.corrected_contexts(settled), number)
    books["recorded"].add(fb.recorded(settled), number)
    settled.unpersist()


def ingest(feedback: DataFrame, judgments: DataFrame, path: str, checkpoint: str, every: int = 16) -> int:
    """Runs a stream of feedback to its end; returns the number of the last batch (-1: there is none)."""
    query = (
        feedback.writeStream.foreachBatch(lambda batch, number: take(batch, number, judgments, path, every))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return last(feedback.sparkSession, path)


def last(spark: SparkSession, path: str) -> int:
    """The last batch that is whole."""
    return ledgers(path)["recorded"].last(spark)


def current(spark: SparkSession, path: str, kind: str, number: int) -> DataFrame:
    """The counters, contexts or recorded feedback after a batch."""
    return ledgers(path)[kind].read(spark, number)
