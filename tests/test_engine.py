from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators import baseline, checks, ingest, product, quality, reconcile
from tidemark.plans import audits, feedback, oracles, queries, rebuilds, relational, states
from tidemark.streaming import incremental

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql_and_rows(spark):
    assert set(queries.QUERIES) == set(oracles.ORACLES)
    assert {*queries.QUERIES, *relational.QUERIES, *audits.QUERIES, *states.QUERIES, *feedback.QUERIES, *rebuilds.QUERIES} <= set(entry.queries()) & set(entry.oracle_sql())
    assert entry.entry(spark).count() > 0


def test_no_python_in_plans(spark):
    for name, query in {**queries.QUERIES, **relational.QUERIES, **audits.QUERIES, **states.QUERIES, **feedback.QUERIES, **rebuilds.QUERIES}.items():
        plan = query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan, name


def test_filters_and_columns_reach_the_scan(spark):
    plan = queries.QUERIES["export_user"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_custkey,7)" in plan and "o_orderpriority" not in plan


def test_classification_follows_the_log(spark):
    log = spark.createDataFrame([(1, "r", "A"), (2, "r", "B"), (3, "r", "A"), (4, "q", "A"), (5, "r", "B")], "seq long, logical string, payload string")
    got = {r.seq: r.classification for r in ingest.classify(log).collect()}
    assert got == {1: "NEW", 2: "REVISION", 3: "REOBSERVATION", 4: "NEW", 5: "REOBSERVATION"}
    latest = {r.logical: r.payload for r in ingest.latest_versions(ingest.versions(ingest.classify(log))).collect()}
    assert latest == {"r": "B", "q": "A"}


def test_incremental_range():
    assert ingest.incremental_range("2026-08-10", "2026-08-12") == ("2026-08-09", "2026-08-12")
    assert ingest.incremental_range(None, "2026-08-12") == ("2026-08-10", "2026-08-12")


def test_intervals(spark):
    df = spark.createDataFrame([(1, [(0, 0, 5), (10, 5, 5), (0, 3, 9)])], "id long, items array<struct<start: long, end: long, state: int>>")
    got = [(r.segment, r.seconds, r.stage, r.issue) for r in quality.interval_facts(df, {5: "AWAKE"}).orderBy("segment").collect()]
    assert got == [(0, 0, "AWAKE", None), (1, -5, "AWAKE", "NEGATIVE_INTERVAL"), (2, 3, None, "UNKNOWN_STATE")]


def test_reconcile_twice_changes_nothing(spark):
    history = spark.createDataFrame([(1, "a", "CURRENT"), (2, "b", "CURRENT"), (2, "z", "STALE"), (3, "c", "CURRENT")], "id long, sig string, status string")
    desired = spark.createDataFrame([(1, "a"), (2, "B"), (4, "d")], "id long, sig string")
    once = reconcile.apply_delta(history, desired, ["id"])
    assert {(r.id, r.sig, r.status) for r in once.collect()} == {(1, "a", "CURRENT"), (2, "b", "STALE"), (2, "z", "STALE"), (3, "c", "STALE"), (2, "B", "CURRENT"), (4, "d", "CURRENT")}
    assert reconcile.same_content(once, reconcile.apply_delta(once, desired, ["id"]))


def test_incremental_baselines_equal_a_full_run(spark):
    daily = queries._values(spark, SF)
    keys = ["metric", "source_class", "source_sid", "offset_seconds"]
    before = daily.where("local_date <> date '2024-01-20'")
    dirty = reconcile.dirty_dates(
        before.select(F.concat_ws("|", *keys, "local_date").alias("id"), "local_date", reconcile.signature("value").alias("sig")),
        daily.select(F.concat_ws("|", *keys, "local_date").alias("id"), "local_date", reconcile.signature("value").alias("sig")),
    )
    assert [r[0] for r in dirty.collect()] == [date(2024, 1, 20)]
    old = baseline.rolling_baselines(before).where("as_of <= date '2024-01-20'")
    new = baseline.rolling_baselines(daily, since="2024-01-20")
    assert reconcile.same_content(old.unionByName(new), baseline.rolling_baselines(daily))


def test_upsert_and_ignore(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string"), spark.createDataFrame([(2, "B"), (3, "C")], "k long, v string")
    assert {tuple(r) for r in reconcile.upsert(old, new, ["k"]).collect()} == {(1, "a"), (2, "B"), (3, "C")}
    assert {tuple(r) for r in reconcile.insert_or_ignore(old, new, ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "C")}


def test_quiet_hours_cross_midnight(spark):
    cases = [("SMART", "C", True, 23 * 60, ("SUPPRESS", "quiet_hours")), ("SMART", "C", True, 6 * 60, ("SUPPRESS", "quiet_hours")), ("SMART", "C", True, 7 * 60, ("SEND", "actionable_change")),
             ("QUIET", "E", False, 23 * 60, ("SEND", "safety_attention")), ("DAILY", "A", False, 0, ("SUPPRESS", "no_new_judgment")), ("SMART", "B", True, 600, ("SUPPRESS", "smart_mode_no_action_needed"))]
    for mode, state, updated, minute, want in cases:
        got = spark.range(1).select(product.notification(F.lit(mode), F.lit(state), F.lit(updated), F.lit(minute), (1320, 420)).alias("g")).first().g
        assert tuple(got) == want


def test_episodes(spark):
    rows = [(1, "NOTABLE_CHANGE", "X"), (3, "MILD_CHANGE", "X"), (4, "STABLE", "X"), (6, "MILD_CHANGE", "X"), (7, "MILD_CHANGE", "Y"), (8, "STABLE", None)]
    df = spark.createDataFrame([("s", date(2026, 8, d), o, p) for d, o, p in rows], "subject string, day date, overall_state string, primary string")
    got = [(r.primary, r.start_day.day, r.end_day.day, r.phase) for r in product.episodes(df).orderBy("start_day").collect()]
    assert got == [("X", 1, 3, "CLOSED"), ("X", 6, 6, "CLOSED"), ("Y", 7, 7, "CLOSED")]


def test_sessions_roll_over(spark):
    turns = [(1, datetime(2026, 8, 1, 23), date(2026, 8, 1), 1), (1, datetime(2026, 8, 2, 1), date(2026, 8, 2), 2), (1, datetime(2026, 8, 2, 12), date(2026, 8, 2), 3), (1, datetime(2026, 8, 3, 8), date(2026, 8, 3), 4)]
    df = spark.createDataFrame(turns, "user_id long, ts timestamp_ntz, day date, id long")
    slept = spark.createDataFrame([(1, date(2026, 8, 3))], "user_id long, day date")
    # The morning without a sleep row does not end the session, and the day has then not advanced.
    assert [r.session for r in product.sessions(df, slept).orderBy("id").collect()] == [1, 1, 1, 2]


def test_checks(spark):
    df = spark.createDataFrame([(1, "A healthy one"), (1, "fine"), (2, "scores")], "k long, t string")
    assert [tuple(r) for r in checks.duplicates(df, ["k"]).collect()] == [(1, 2)]
    assert [r.k for r in checks.forbidden(df, "t").collect()] == [1]


@pytest.mark.parametrize("files", [1, 3])
def test_stream_equals_batch(spark, tmp_path, files):
    log = queries.observation_log(spark, SF).select("seq", "logical", "payload")
    log.repartition(files).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    last = incremental.ingest(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    want = ingest.versions(ingest.classify(log))
    assert last == files - 1
    assert reconcile.same_content(incremental.current(spark, str(tmp_path / "out"), last), want)
    # A second run finds nothing new, rows that come again change nothing.
    again = spark.readStream.schema(log.schema).parquet(str(tmp_path / "in"))
    assert incremental.ingest(again, str(tmp_path / "out"), str(tmp_path / "ckpt")) == last
    log.where("seq % 3 = 0").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert incremental.ingest(again, str(tmp_path / "out"), str(tmp_path / "ckpt")) == last + 1
    assert reconcile.same_content(incremental.current(spark, str(tmp_path / "out"), last + 1), want)


def test_planted_leaks_are_found(spark):
    daily = queries._values(spark, SF)
    keys = ["metric", "source_class", "source_sid", "offset_seconds"]
    made, links = baseline.rolling_baselines(daily), baseline.baseline_inputs(daily)
    clean = checks.input_audit(made, links, keys).collect()
    assert sorted(r.window_days for r in clean) == [7, 28, 90] and all(r.links > 0 and r.leaks == r.early == r.miscounted == 0 for r in clean)
    one = links.where("window_days = 28").orderBy("metric", "source_sid", "as_of", "local_date").limit(1)
    leak, early = one.withColumn("local_date", F.col("as_of")), one.withColumn("local_date", F.date_sub("as_of", 29))
    found = {r.window_days: (r.leaks, r.early, r.miscounted) for r in checks.input_audit(made, links.unionByName(leak).unionByName(early), keys).collect()}
    assert found == {7: (0, 0, 0), 28: (1, 1, 1), 90: (0, 0, 0)}


def test_digest_does_not_overflow(spark):
    rows = spark.range(400_000).select("id")
    got = reconcile.digest(rows, ["id"]).first()
    assert got.n == 400_000 and got == reconcile.digest(rows.repartition(7), ["id"]).first()


def test_late_arrivals_look_at_earlier_scopes_only(spark):
    ts = lambda h: datetime(2024, 1, 1, h)
    scopes = spark.createDataFrame([("m", 0, ts(1), ts(3)), ("m", 1, ts(2), ts(5)), ("m", 2, ts(8), ts(9)), ("m", 3, ts(0), ts(1))], "metric string, capture int, starts timestamp, ends timestamp")
    log = spark.createDataFrame([("m", c, ts(h), k) for c, h, k in ((0, 2, "NEW"), (1, 2, "NEW"), (2, 4, "NEW"), (2, 7, "NEW"), (3, 8, "NEW"), (3, 8, "REVISION"), (3, 0, "NEW"))], "metric string, capture int, ts timestamp, classification string")
    got = sorted((r.capture, r.ts.hour, r.classification, r.late) for r in ingest.late_arrivals(scopes, log).collect())
    assert got == [(0, 2, "NEW", False), (1, 2, "NEW", True), (2, 4, "NEW", True), (2, 7, "NEW", False), (3, 0, "NEW", False), (3, 8, "NEW", True), (3, 8, "REVISION", False)]


def test_revisions_keep_their_rules(spark):
    history = spark.createDataFrame([("a", 1, "CURRENT"), ("b", 2, "CURRENT"), ("b", 1, "STALE")], "logical string, version long, status string")
    batch = spark.createDataFrame([("a", 1, "NEW"), ("b", 3, "REVISION"), ("c", 4, "NEW"), ("d", 5, "REVISION")], "logical string, version long, classification string")
    after, problems = reconcile.apply_revisions(history, batch)
    assert {tuple(r) for r in after.collect()} == {("a", 1, "CURRENT"), ("b", 2, "STALE"), ("b", 1, "STALE"), ("b", 3, "CURRENT"), ("c", 4, "CURRENT")}
    assert [tuple(r) for r in problems.collect()] == [("d", "REVISION_WITHOUT_CURRENT")]
    again, _ = reconcile.apply_revisions(after, batch.where("logical <> 'd'"), full=True)
    assert reconcile.same_content(again, after)


def test_a_record_twice_in_a_batch_is_refused(spark):
    """Exactly one row of a record is current, whatever the batch holds."""
    history = spark.createDataFrame([("a", 1, "CURRENT"), ("b", 1, "CURRENT")], "logical string, version long, status string")
    batch = spark.createDataFrame([("a", 2, "REVISION"), ("a", 3, "REVISION"), ("b", 2, "REVISION"), ("b", 2, "REVISION"), ("c", 5, "NEW"), ("c", 6, "REVISION")], "logical string, version long, classification string")
    for full in (False, True):
        after, problems = reconcile.apply_revisions(history, batch, full)
        assert sorted(tuple(r) for r in after.collect()) == [("a", 1, "CURRENT"), ("b", 1, "STALE"), ("b", 2, "CURRENT")]
        assert sorted(tuple(r) for r in problems.collect()) == [("a", "SEVERAL_IN_BATCH"), ("c", "SEVERAL_IN_BATCH")]


def test_an_emptied_fact_set_is_retired(spark):
    history = spark.createDataFrame([("a", 1, "CURRENT"), ("b", 2, "CURRENT"), ("c", 3, "CURRENT")], "k string, v long, status string")
    batch, stated = spark.createDataFrame([("a", 1)], "k string, v long"), spark.createDataFrame([("a",), ("b",)], "k string")
    got = sorted(tuple(r) for r in reconcile.replace_sets(history, batch, "k", stated).collect())
    assert got == [("a", 1, "CURRENT"), ("b", 2, "STALE"), ("c", 3, "CURRENT")]
