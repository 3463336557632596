"""State of streams: equal to the batch, however the input is cut."""

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import ingest as records
from tidemark.operators import product, reconcile
from tidemark.streaming import incremental, sessions
from tidemark.streaming.ledger import Ledger

LOG = "user_id long, day date, ts timestamp_ntz, id long, slept boolean"


def log_rows(seed=4):
    rng = random.Random(seed)
    out = []
    for i in range(400):
        ts = datetime(2024, 1, 1) + timedelta(days=rng.randrange(20), hours=rng.choice([1, 6, 8, 9, 13, 22]), minutes=rng.randrange(60))
        out.append((rng.randrange(6), ts.date(), ts, i, False))
    out += [(u, date(2024, 1, 1) + timedelta(days=d), None, None, True) for u in range(7) for d in range(20) if rng.random() < 0.3]
    rng.shuffle(out)  # late turns and late sleep rows
    return out + out[:50]  # rows that come again


@pytest.mark.parametrize(("cuts", "every"), [(1, 16), (7, 2), (12, 3)])
def test_sessions_equal_the_batch_for_any_cut(spark, tmp_path, cuts, every):
    rows = log_rows()
    for i in range(cuts):
        spark.createDataFrame(rows[i * len(rows) // cuts : (i + 1) * len(rows) // cuts], LOG).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    last = sessions.ingest(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"), every)
    assert last == cuts - 1
    whole = spark.createDataFrame(rows, LOG).distinct()
    turns = whole.where("not slept").drop("slept")
    want = product.sessions(turns, whole.where("slept").select("user_id", "day")).select("user_id", "day", "id", "session")
    states = sessions.current(spark, str(tmp_path / "out"), last)
    got = sessions.turn_sessions(turns, states).select("user_id", "day", "id", "session")
    assert reconcile.same_content(got, want) and got.count() == turns.count()
    assert reconcile.same_content(states, sessions.day_states(whole))


def test_a_batch_writes_the_days_it_touches(spark, tmp_path):
    state = sessions.ledger(str(tmp_path / "l"), every=100)
    for n in range(3):
        rows = [(u, date(2024, 1, 1 + n), datetime(2024, 1, 1 + n, 9), 10 * n + u, False) for u in range(5)] if n < 2 else [(3, date(2024, 1, 1), datetime(2024, 1, 1, 8), 99, False)]
        state.add(sessions.day_states(spark.createDataFrame(rows, LOG)), n)
    assert spark.read.parquet(str(tmp_path / "l" / "added" / "2")).count() == 1
    assert sessions.sessions_of(state.read(spark, 2)).where("user_id = 3 and day = date '2024-01-01'").first().first_id == 99
    assert sessions.sessions_of(state.read(spark, 1)).where("user_id = 3 and day = date '2024-01-01'").first().first_id == 3


def test_ledger_merges_and_forgets(spark, tmp_path):
    add_up = lambda rows: rows.groupBy("k").agg(F.sum("n").alias("n"))
    book = Ledger(str(tmp_path / "l"), "k bigint, n bigint", add_up, every=3, order=("k",))
    assert book.last(spark) == -1 and book.read(spark, 5).count() == 0
    for n in range(11):
        book.add(spark.createDataFrame([(n % 2, 1), (7, n)], "k bigint, n bigint"), n)
        assert {r.k: r.n for r in book.read(spark, n).collect()}[7] == n * (n + 1) // 2
        book.add(spark.createDataFrame([(n % 2, 1), (7, n)], "k bigint, n bigint"), n)  # the same batch again
    assert {r.k: r.n for r in book.read(spark, 10).collect()} == {0: 6, 1: 5, 7: 55}
    kept = sorted(int(p.name) for p in (tmp_path / "l" / "added").iterdir())
    assert kept == [6, 7, 8, 9, 10] and sorted(int(p.name) for p in (tmp_path / "l" / "merged").iterdir()) == [5, 8]
    # A folder whose writer has not finished does not count.
    (tmp_path / "l" / "added" / "11").mkdir()
    assert book.last(spark) == 10 and {r.k: r.n for r in book.read(spark, 11).collect()}[7] == 55


def test_versions_over_many_batches(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, f"r{rng.randrange(30)}", rng.randrange(3)) for i in range(300)]
    late = rows[:]
    rng.shuffle(late)
    for i in range(20):
        spark.createDataFrame(late[i * 15 : (i + 1) * 15] + late[:5], "seq long, logical string, payload long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("seq long, logical string, payload long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    last = incremental.ingest(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    want = records.versions(records.classify(spark.createDataFrame(rows, "seq long, logical string, payload long")))
    assert last == 19 and reconcile.same_content(incremental.current(spark, str(tmp_path / "out"), last), want)


def test_daily_windows_of_a_stream(spark, tmp_path):
    rows = [("a", datetime(2024, 1, 1 + i % 3, i % 24), float(i)) for i in range(60)]
    for i in range(3):  # the last rows come first: late ones are taken
        spark.createDataFrame(rows[::-1][i * 20 : i * 20 + 20], "metric string, ts timestamp, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("metric string, ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = incremental.daily_windows(stream).writeStream.format("memory").queryName("daily_windows").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    want = spark.createDataFrame(rows, "metric string, ts timestamp, value double").groupBy("metric", F.to_date("ts").alias("day")).agg(
        F.count("value").alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high")
    )
    assert reconcile.same_content(spark.table("daily_windows"), want) and want.count() == 3
