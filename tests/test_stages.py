"""Builds in stages: what is made anew, how a stopped run goes on, and what a full build finds."""

import pytest
from pyspark.sql import functions as F

from tidemark.sources import stages, store
from tidemark.sources.stages import Source, Stage


def graph(built, stop=None, low=0):
    def step(name, make):
        def build(*tables):
            if name == stop:
                raise RuntimeError(f"stopped in {name}")
            built.append(name)
            return make(*tables)
        return build

    # Listed against the order in which they are needed.
    return [
        Stage("joined", ("sums", "kept"), step("joined", lambda a, b: b.join(a, "k"))),
        Stage("sums", ("kept",), step("sums", lambda x: x.groupBy("k").agg(F.sum("v").alias("total")))),
        Stage("kept", ("raw",), step("kept", lambda x: x.where(F.col("v") >= low)), str(low), settles=True),
        Stage("other", ("more",), step("other", lambda x: x.selectExpr("v + 1 as v"))),
    ]


def sources(spark, rows, mark="1"):
    return {"raw": Source(spark.createDataFrame(rows, "k string, v long"), mark), "more": Source(spark.createDataFrame([(1,)], "v long"), "fixed")}


ROWS = [("a", 1), ("a", 2), ("b", 3), ("b", -4)]


def test_only_what_changed_is_made_anew(spark, tmp_path):
    root, built = str(tmp_path), []
    assert set(stages.run(spark, root, graph(built), sources(spark, ROWS)).values()) == {"BUILT"}
    assert built.index("kept") < built.index("sums") < built.index("joined") and len(built) == 4
    assert set(stages.run(spark, root, graph(built), sources(spark, ROWS)).values()) == {"SKIPPED"} and len(built) == 4
    assert stages.run(spark, root, graph(built), sources(spark, [*ROWS, ("b", 9)], "2")) == {"kept": "BUILT", "sums": "BUILT", "joined": "BUILT", "other": "SKIPPED"}
    assert {r.k: r.total for r in store.read_current(spark, f"{root}/sums").collect()} == {"a": 3, "b": 12}
    # The source is another, but what is kept of it is not; so is what another rule keeps.
    assert stages.run(spark, root, graph(built), sources(spark, [*ROWS, ("b", 9), ("c", -1)], "3")) == {"kept": "SAME", "sums": "SKIPPED", "joined": "SKIPPED", "other": "SKIPPED"}
    assert stages.run(spark, root, graph(built, low=1), sources(spark, [*ROWS, ("b", 9), ("c", -1)], "3"))["kept"] == "SAME"
    assert stages.run(spark, root, graph(built, low=2), sources(spark, [*ROWS, ("b", 9), ("c", -1)], "3"))["joined"] == "BUILT"
    assert {r.k: r.total for r in store.read_current(spark, f"{root}/joined").collect()} == {"a": 2, "b": 12}


@pytest.mark.parametrize("stop", ["kept", "sums", "joined", "other"])
def test_a_stopped_run_goes_on(spark, tmp_path, stop):
    root, built = str(tmp_path), []
    with pytest.raises(RuntimeError, match=stop):
        stages.run(spark, root, graph(built, stop), sources(spark, ROWS))
    before = list(built)
    done = stages.run(spark, root, graph(built), sources(spark, ROWS))
    assert all(done[n] == "SKIPPED" for n in before) and done[stop] == "BUILT" and sorted(built) == ["joined", "kept", "other", "sums"]
    assert {r.status for r in stages.full_rebuild(spark, root, graph([]), sources(spark, ROWS)).collect()} == {"PASS"}


def test_a_full_build_finds_what_is_stale(spark, tmp_path):
    root = str(tmp_path)
    stages.run(spark, root, graph([]), sources(spark, ROWS))
    sums = store.read_current(spark, f"{root}/sums")
    store.commit(sums.where("k = 'a'").unionByName(spark.createDataFrame([("x", 1), ("y", 2)], "k string, total long")), f"{root}/sums", store.note(spark, f"{root}/sums", 0))
    got = {r.stage: (r.rows, r.only_current, r.only_rebuilt, r.status) for r in stages.full_rebuild(spark, root, graph([]), sources(spark, ROWS)).collect()}
    assert got == {"kept": (3, 0, 0, "PASS"), "sums": (3, 2, 1, "FAIL"), "joined": (3, 0, 0, "PASS"), "other": (1, 0, 0, "PASS")}
    assert store.current_version(spark, f"{root}/sums") == 1
    # A stage that was never built has failed, even if it has no rows.
    none = stages.full_rebuild(spark, str(tmp_path / "new"), graph([], low=99), sources(spark, ROWS)).collect()
    assert {r.status for r in none} == {"FAIL"}


def test_files_are_the_fingerprint_of_a_table(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5).write.parquet(path)
    first = stages.files_source(spark, path)
    assert first.fingerprint == stages.files_source(spark, path).fingerprint and first.table.count() == 5
    spark.range(1).write.mode("append").parquet(path)
    assert first.fingerprint != stages.files_source(spark, path).fingerprint


def test_graphs_that_cannot_be_run(spark):
    have = sources(spark, ROWS)
    same = lambda x: x
    for bad in ([Stage("a", ("nothing",), same)], [Stage("a", ("raw",), same)] * 2, [Stage("raw", ("more",), same)], [Stage("a", ("b",), same), Stage("b", ("a",), same)]):
        with pytest.raises(ValueError):
            stages.in_order(bad, have)
