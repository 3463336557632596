"""Full evidence bundles."""

from datetime import date

from tidemark.operators import evidence

SAID = "s string, kind string, item string, day date, finding string"


def d(n):
    return date(2024, 1, n)


def made(spark, said, asks, base):
    out = evidence.full_bundles(spark.createDataFrame(said, SAID), spark.createDataFrame(asks, "s string, day date"), spark.createDataFrame(base, "s string, day date, recent_context array<string>"), ["s"])
    return {(r.s, r.day.day): r for r in out.collect()}


def test_parts_hold_what_was_last_said(spark):
    said = [("a", "DEVIATION", "hr", d(1), "ABOVE"), ("a", "DEVIATION", "hr", d(3), "WITHIN"), ("a", "DEVIATION", "hr", d(3), "ABOVE"), ("a", "DEVIATION", "sleep", d(2), "BELOW"), ("a", "TREND", "hr", d(2), "RISING"),
            ("a", "TREND", "hr", d(12), "FALLING"), ("a", "RELATIONSHIP", "hr/sleep", d(5), "POSITIVE"), ("b", "PERSISTENCE", "hr/7", d(1), "NONE"), ("a", "CHANGE_POINT", "hr", d(20), "CHANGED")]
    asks = [("a", d(1)), ("a", d(3)), ("a", d(10)), ("a", d(10)), ("a", d(12)), ("b", d(2)), ("c", d(2))]
    base = [("a", d(3), ["FEVER"])]
    got = made(spark, said, asks, base)
    assert set(got) == {("a", 1), ("a", 3), ("a", 10), ("a", 12), ("b", 2), ("c", 2)}
    part = lambda key, name: [(x.item, x.day.day, x.finding) for x in got[key][name]]
    assert part(("a", 1), "deviations") == [("hr", 1, "ABOVE")] and part(("a", 1), "trends") == []
    assert part(("a", 3), "deviations") == [("hr", 3, "WITHIN"), ("sleep", 2, "BELOW")] and part(("a", 3), "trends") == [("hr", 2, "RISING")]
    # A deviation is of the last seven days, what the others say holds on; nothing is seen before its day.
    assert part(("a", 10), "deviations") == [("hr", 3, "WITHIN")] and part(("a", 10), "relationships") == [("hr/sleep", 5, "POSITIVE")]
    assert part(("a", 12), "trends") == [("hr", 12, "FALLING")] and part(("a", 12), "deviations") == [] and part(("a", 12), "changes") == []
    assert part(("b", 2), "persistence") == [("hr/7", 1, "NONE")] and all(part(("c", 2), p) == [] for p in evidence.PARTS.values())
    assert [(x.day.day, x.item) for x in got[("a", 3)].recent_deviations] == [(1, "hr"), (2, "sleep"), (3, "hr")] and got[("a", 12)].recent_deviations == []
    assert got[("a", 10)].provenance == ["BASELINE|hr|2024-01-03", "DEVIATION|hr|2024-01-03", "FEATURE|hr|2024-01-03", "RELATIONSHIP|hr/sleep|2024-01-05", "TREND|hr|2024-01-02"]
    assert got[("a", 3)].recent_context == ["FEVER"] and got[("a", 1)].recent_context is None


def test_the_hash_follows_the_content(spark):
    said = [("a", "DEVIATION", "hr", d(1), "ABOVE"), ("a", "TREND", "hr", d(1), "RISING"), ("b", "TREND", "hr", d(1), "RISING")]
    asks, base = [("a", d(1)), ("b", d(1))], [("a", d(1), ["X"])]
    first = made(spark, said, asks, base)
    assert made(spark, said[::-1], asks[::-1], base) == first
    for other in ([(*said[0][:4], "BELOW"), *said[1:]], [said[0], (*said[1][:4], "FALLING"), said[2]]):
        changed = made(spark, other, asks, base)
        assert changed[("a", 1)].bundle_hash != first[("a", 1)].bundle_hash and changed[("b", 1)] == first[("b", 1)]
    assert made(spark, said, asks, [("a", d(1), ["Y"])])[("a", 1)].bundle_hash != first[("a", 1)].bundle_hash
