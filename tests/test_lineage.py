"""Retirement over provenance, affected regions of a series, hash trees."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import baseline, digests, lineage, reconcile, regions
from tidemark.params import DEFAULT
from tidemark.sources.scratch import stash

KEYS = ["metric", "sid"]
VALUES = "metric string, sid string, local_date date, value double"


def test_cascade_reaches_all_layers_and_ends_in_cycles(spark):
    links = [("S", "1", "F", "a"), ("S", "2", "F", "b"), ("F", "a", "G", "x"), ("F", "b", "G", "x"), ("F", "b", "G", "y"), ("G", "x", "H", "p"), ("H", "p", "H", "q"), ("H", "q", "H", "p"), ("G", "y", "I", "z"), ("F", None, "G", "n")]
    links = spark.createDataFrame(links + links[:3], lineage.LINKS)
    got = lambda *ids: {(r.layer, r.id): r.step for r in lineage.cascade(links, spark.createDataFrame(list(ids), "layer string, id string")).collect()}
    assert got(("S", "1")) == {("S", "1"): 0, ("F", "a"): 1, ("G", "x"): 2, ("H", "p"): 3, ("H", "q"): 4}
    assert got(("F", "b"), ("G", "x"))[("G", "x")] == 0 and got(("I", "z"), ("I", "z")) == {("I", "z"): 0}
    none = lineage.cascade(links, spark.createDataFrame([], "layer string, id string"))
    assert none.count() == 0
    with pytest.raises(ValueError, match="rounds"):
        lineage.cascade(links, spark.createDataFrame([("S", "1")], "layer string, id string"), most_rounds=2)


def test_reached_rows_turn_stale(spark):
    rows = spark.createDataFrame([("a", 1, "CURRENT"), ("b", 2, "CURRENT"), ("a", 3, "SUPERSEDED")], "k string, n long, status string")
    stale = spark.createDataFrame([("L", "a|1", 1), ("L", "a|3", 1), ("M", "b|2", 1)], "layer string, id string, step int")
    got = {r.n: r.status for r in lineage.retire_rows(rows, stale, "L", lineage.row_id("k", "n")).collect()}
    assert got == {1: "STALE", 2: "CURRENT", 3: "SUPERSEDED"}


def values(spark, rng, series, days=40):
    rows = [(m, s, date(2024, 1, 1) + timedelta(days=d), float(rng.randrange(9))) for m, s in series for d in range(days) if rng.random() < 0.7]
    return spark.createDataFrame(rows, VALUES), rows


def changed(spark, rows, rng, what):
    out = list(rows)
    if what == "values":
        for i in rng.sample(range(len(out)), 3):
            out[i] = (*out[i][:3], out[i][3] + 1)
    elif what == "insertions and deletions":
        gone = set(rng.sample(range(len(out)), 4))
        out = [r for i, r in enumerate(out) if i not in gone]
        out += [("a", "1", date(2024, 2, 29), 5.0), (None, "1", date(2023, 12, 20), 2.0)]
    elif what == "new series":
        out += [("new", None, date(2024, 1, 10) + timedelta(days=d), float(d)) for d in range(9)]
    elif what == "longer":
        out += [("a", "1", date(2024, 5, 1), 1.0)]
    elif what == "shorter":
        # A series is gone too, and a null value is none.
        out = [r for r in out if date(2024, 1, 10) < r[2] < date(2024, 2, 3) and r[0] != "b"] + [("a", "1", date(2024, 6, 1), None)]
    return spark.createDataFrame(out, VALUES)


@pytest.mark.parametrize("what", ["values", "insertions and deletions", "new series", "longer", "shorter"])
def test_renewed_baselines_equal_a_full_run(spark, what):
    rng = random.Random(7)
    before, rows = values(spark, rng, [("a", "1"), ("b", "1"), (None, "1")])
    now = changed(spark, rows, rng, what)
    old, want = stash(baseline.rolling_baselines(before, KEYS), "old"), stash(baseline.rolling_baselines(now, KEYS), "want")
    got, fresh = regions.renew_baselines(old, before, now, KEYS)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    n, anew = want.count(), fresh.count()
    if what in ("values", "new series"):
        # Cells of changed days: no more than the windows behind each, and all of a new series.
        assert 0 < anew <= (3 * sum(DEFAULT.windows) if what == "values" else n // 2)
    else:
        assert 0 < anew < n or what == "shorter"


def test_from_nothing(spark):
    now, _ = values(spark, random.Random(1), [("a", "1")], 10)
    empty = spark.createDataFrame([], VALUES)
    got, fresh = regions.renew_baselines(baseline.rolling_baselines(empty, KEYS), empty, now, KEYS)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, baseline.rolling_baselines(now, KEYS).collect())) and fresh.count() == got.count()


def test_intervals_are_disjoint(spark):
    d = lambda n: date(2024, 1, n)
    rows = [("k", d(1), d(3)), ("k", d(4), d(5)), ("k", d(2), d(2)), ("k", d(8), d(9)), ("k", d(8), d(12)), (None, d(1), d(1)), (None, d(1), d(1))]
    got = sorted((tuple(r) for r in regions.merged(spark.createDataFrame(rows, "k string, from_date date, to_date date"), ["k"]).select("k", "from_date", "to_date").collect()), key=repr)
    assert got == sorted([("k", d(1), d(5)), ("k", d(8), d(12)), (None, d(1), d(1))], key=repr)


ROWS = "k long, a string, b long"


def build(n=3000):
    return [(i * 3 - 700, f"v{i % 17}", None if i % 5 else i) for i in range(n)] + [(None, "x", 1), (None, None, None), (5000, "hot", 1), (5000, "hot", 1)] + [(6000, f"hot{i}", i) for i in range(500)]


def tree(spark, rows):
    return digests.hash_tree(stash(spark.createDataFrame(rows, ROWS).repartition(5), "rows"), "k", ["a", "b"], width=64, fanout=8)


def test_equal_builds_have_equal_trees(spark):
    rows = build()
    a, b = tree(spark, rows), tree(spark, rows[::-1])
    assert reconcile.same_content(a, b) and digests.differing_ranges(a, b, 8).count() == 0
    top = a.orderBy(F.desc("level")).first()
    assert top.rows == len(rows) and a.where(F.col("level") == top.level).count() == 1


@pytest.mark.parametrize("what", ["one byte", "swapped rows", "one repeat more", "new at the end"])
def test_changes_are_found_in_their_ranges(spark, what):
    rows = build()
    other = list(rows)
    where = {floor((other[100][0]), 64)}
    if what == "one byte":
        other[100] = (other[100][0], other[100][1] + ".", other[100][2])
    elif what == "swapped rows":
        i, j = 100, 2000
        other[i], other[j] = (other[i][0], *other[j][1:]), (other[j][0], *other[i][1:])
        where = {floor(other[i][0], 64), floor(other[j][0], 64)}
    elif what == "one repeat more":
        other.append((5000, "hot", 1))
        where = {floor(5000, 64)}
    else:
        del other[100]
        other += [(20_000, "far", 1), (None, "y", 1)]
        where |= {floor(20_000, 64), -1}
    a, b = tree(spark, rows), tree(spark, other)
    assert digests.root(a) != digests.root(b)
    ranges = digests.differing_ranges(a, b, 8)
    assert {r.node for r in ranges.collect()} == where
    frames = [spark.createDataFrame(x, ROWS) for x in (rows, other)]
    got = sorted(((r.k, r.a, r.b, r.side, r.n) for r in digests.differing_rows(*frames, ranges, "k", ["a", "b"], 64).collect()), key=repr)
    from collections import Counter
    x, y = Counter(rows), Counter(other)
    want = [(*r, "only_first", n) for r, n in (x - y).items()] + [(*r, "only_second", n) for r, n in (y - x).items()]
    assert got == sorted(want, key=repr)


def floor(k, width):
    return k // width


def test_empty_tables_have_no_tree(spark):
    empty, some = tree(spark, []), tree(spark, build(10))
    assert empty.count() == 0 and digests.root(empty) is None and digests.differing_ranges(empty, empty, 8).count() == 0
    assert digests.differing_ranges(empty, some, 8).count() == some.where("level = 0").count()
