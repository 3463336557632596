"""Sessions of users as a stream.

Where a session ends depends on the data: on the first turn of a day and on whether a sleep row is known
for it. Both can come late, in any order and more than once. So the state is what they fold to for each
user and day: the first turn, and whether the day was slept; both are kept by min and or, whatever the
batches. A session's number is a running count over the days of a user, which are few, when it is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ledger import Ledger

SCHEMA = "user_id bigint, day date, first struct<ts: timestamp_ntz, id: bigint>, slept boolean"
#: The hour from which a day's first turn begins a session without a sleep row.
NOON = 12


def fold_days(rows: DataFrame) -> DataFrame:
    """The state of rows(user_id, day, first, slept) by user and day."""
    return rows.groupBy("user_id", "day").agg(F.min("first").alias("first"), F.bool_or("slept").alias("slept"))


def day_states(log: DataFrame) -> DataFrame:
    """The state that log(user_id, day, ts, id, slept) adds: turns (slept false) and sleep rows (slept
    true, ts and id without meaning)."""
    turn = F.struct(F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("id").cast("bigint").alias("id"))
    return fold_days(log.select("user_id", "day", F.when(~F.col("slept"), turn).alias("first"), "slept"))


def sessions_of(states: DataFrame) -> DataFrame:
    """user_id, day, session, first_id: the session of a user's day. All turns of a day are in one, as only
    a day's first turn can open one. Days with sleep rows only are left out."""
    days = states.where("first is not null")
    order = Window.partitionBy("user_id").orderBy("day")
    opens = F.lag("day").over(order).isNull() | F.col("slept") | (F.hour("first.ts") >= NOON)
    return days.withColumn("_opens", opens.cast("bigint")).select("user_id", "day", F.sum("_opens").over(order).alias("session"), F.col("first.id").alias("first_id"))


def turn_sessions(turns: DataFrame, states: DataFrame) -> DataFrame:
    """turns(user_id, day, ...) with their session."""
    return turns.join(sessions_of(states).drop("first_id"), ["user_id", "day"])


def ledger(path: str, every: int = 16) -> Ledger:
    return Ledger(path, SCHEMA, fold_days, every, ("user_id", "day"))


def ingest(log: DataFrame, path: str, checkpoint: str, every: int = 16) -> int:
    """Runs a stream of log(user_id, day, ts, id, slept) to its end; returns the number of the last batch.
    A batch writes the days that its rows touch. Rows that come again change nothing."""
    state = ledger(path, every)
    query = log.writeStream.foreachBatch(lambda batch, number: state.add(day_states(batch), number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return state.last(log.sparkSession)


def current(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The state after a batch; see sessions_of."""
    return ledger(path).read(spark, number)
