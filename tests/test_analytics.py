from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.operators import analytics, baseline, reasoning

KEYS = ["series"]
FEATURES = "series string, local_date date, value double"


def days(spark, values, start="2026-08-01", series="s"):
    first = date.fromisoformat(start)
    return spark.createDataFrame([(series, first + timedelta(days=i), v) for i, v in enumerate(values)], FEATURES)


def base(spark, **over):
    row = {"series": "s", "window_days": 7, "as_of": date(2026, 8, 9), "median": 50.0, "mad": 5.0, "q10": 40.0, "q25": 45.0, "q50": 50.0, "q75": 55.0, "q90": 60.0, "maturity": "ESTABLISHED"} | over
    return spark.createDataFrame([tuple(row.values())], "series string, window_days int, as_of date, median double, mad double, q10 double, q25 double, q50 double, q75 double, q90 double, maturity string")


@pytest.mark.parametrize("q, want", [(0.0, 1.0), (0.25, 1.75), (0.5, 2.5), (0.9, 3.7), (1.0, 4.0)])
def test_type_seven_quantiles(spark, q, want):
    got = spark.range(1).select(stats.quantile(F.array(*map(F.lit, [1.0, 2.0, 3.0, 4.0])), q)).first()[0]
    assert got == pytest.approx(want)


def test_window_sees_the_days_before_only(spark):
    df = spark.createDataFrame([("s", date(2026, 8, 1), 10.0), ("s", date(2026, 8, 2), 20.0), ("s", date(2026, 8, 8), 80.0)], FEATURES)
    got = {r.as_of: (r.n, r.span_days) for r in baseline.rolling_baselines(df, KEYS).where("window_days = 7").collect()}
    assert got[date(2026, 8, 8)] == (2, 2) and got[date(2026, 8, 9)] == (2, 7) and date(2026, 8, 15) not in got
    assert min(got) == date(2026, 8, 2) and max(got) == date(2026, 8, 9)


@pytest.mark.parametrize("n, want", [(2, "INSUFFICIENT_HISTORY"), (3, "PROVISIONAL"), (4, "PROVISIONAL"), (5, "ESTABLISHED")])
def test_maturity(spark, n, want):
    df = days(spark, [float(i) for i in range(n)])
    last = baseline.rolling_baselines(df, KEYS).where("window_days = 7").orderBy(F.desc("as_of")).first()
    assert last.maturity == want and (last.median is None) == (want == "INSUFFICIENT_HISTORY")


def test_deviation_values(spark):
    feature = spark.createDataFrame([("s", date(2026, 8, 9), 80.0)], FEATURES)
    r = analytics.deviations(feature, base(spark), KEYS, F.lit("bpm")).first()
    assert (r.absolute, r.robust_z, r.relative, r.quantile_band, r.side, r.deviation_class, r.evidence) == (30.0, 6.0, 0.6, "ABOVE_Q90", "ABOVE", "ABOVE_TYPICAL_RANGE", "SUFFICIENT")
    r = analytics.deviations(feature, base(spark, mad=0.0), KEYS, F.lit("vendor_score")).first()
    assert r.robust_z is None and r.z_reason == "MAD_ZERO" and r.relative is None
    r = analytics.deviations(feature, base(spark, maturity="INSUFFICIENT_HISTORY"), KEYS).first()
    assert r.deviation_class == "INSUFFICIENT_BASELINE" and r.absolute is None


def test_null_keys_match(spark):
    keys = ["series", "zone"]
    feature = spark.createDataFrame([("s", None, date(2026, 8, 9), 80.0)], "series string, zone string, local_date date, value double")
    b = base(spark).withColumn("zone", F.lit(None).cast("string"))
    assert analytics.deviations(feature, b, keys).count() == 1


@pytest.mark.parametrize(
    "classes, maturity, want",
    [
        ("AAA", "ESTABLISHED", ("PERSISTENT_ABOVE_TYPICAL", "SUFFICIENT", 3, 0)),
        ("WBBB", "PROVISIONAL", ("PERSISTENT_BELOW_TYPICAL", "PROVISIONAL", 0, 3)),
        ("AAW", "ESTABLISHED", ("NO_PERSISTENT_DEVIATION", "SUFFICIENT", 0, 0)),
        ("AA", "ESTABLISHED", ("INSUFFICIENT_OBSERVATIONS", "INSUFFICIENT_OBSERVATIONS", 2, 0)),
    ],
)
def test_persistence(spark, classes, maturity, want):
    names = {"A": "ABOVE_TYPICAL_RANGE", "B": "BELOW_TYPICAL_RANGE", "W": "WITHIN_TYPICAL_RANGE"}
    rows = [("s", 7, date(2026, 8, 1) + timedelta(days=i), names[c], maturity) for i, c in enumerate(classes)]
    df = spark.createDataFrame(rows, "series string, window_days int, local_date date, deviation_class string, maturity string")
    r = analytics.persistence(df, KEYS).first()
    assert (r.persistence_class, r.evidence, r.above, r.below) == want


@pytest.mark.parametrize(
    "values, kind, slope",
    [([1.0, 2.0, 3.0, 4.0], "RISING", 1.0), ([4.0, 3.0, 2.0, 1.0], "FALLING", -1.0), ([5.0] * 5, "STABLE", 0.0), ([1.0, 2.0], "INSUFFICIENT_OBSERVATIONS", None)],
)
def test_trend(spark, values, kind, slope):
    r = analytics.trends(days(spark, values), KEYS).first()
    assert (r.trend_class, r.slope) == (kind, slope)


def test_change_point(spark):
    r = analytics.change_points(days(spark, [1.0] * 5 + [10.0] * 5), KEYS).first()
    assert (r.change_class, r.magnitude, r.split_date) == ("CHANGE_DETECTED", None, date(2026, 8, 5))  # the first of the splits without spread
    r = analytics.change_points(days(spark, [1.0] * 10), KEYS).first()
    assert (r.change_class, r.magnitude) == ("NO_CHANGE", None)
    assert analytics.change_points(days(spark, [1.0] * 9), KEYS).first().change_class == "INSUFFICIENT_EVIDENCE"


def test_relationship(spark):
    rows = [(m, "x", date(2026, 8, 1) + timedelta(days=i), v) for i in range(6) for m, v in (("a", float(i)), ("b", -2.0 * i), ("c", 1.0))]
    df = spark.createDataFrame(rows, "metric string, sid string, local_date date, value double")
    got = {(r.left_metric, r.right_metric): (r.n, r.rho, r.relationship_class) for r in analytics.relationships(df, [("a", "b"), ("c", "a")], ["sid"]).collect()}
    assert got == {("a", "b"): (6, -1.0, "NEGATIVE_ASSOCIATION"), ("a", "c"): (6, 0.0, "NO_ASSOCIATION")}


def test_average_ranks(spark):
    got = spark.range(1).select(stats.average_ranks(F.array(*map(F.lit, [10.0, 20.0, 20.0, 5.0])))).first()[0]
    assert got == [2.0, 3.5, 3.5, 1.0]


def test_contexts(spark):
    df = spark.createDataFrame([("昨天练腿, stayed up",), ("fever and sick",), (None,), ("nothing",)], "text string")
    got = {(r.text, r.context_type): (r.context_date.isoformat(), r.body_part) for r in reasoning.extract_contexts(df, F.lit("2026-08-10").cast("date")).collect()}
    assert got["昨天练腿, stayed up", "HIGH_INTENSITY_TRAINING"] == ("2026-08-09", "legs")
    assert got["昨天练腿, stayed up", "LATE_SLEEP"] == ("2026-08-09", None)
    assert ("fever and sick", "FEVER") in got and ("fever and sick", "ILLNESS") not in got


def test_confidence_ladder(spark):
    cases = [((0, 1, False, False), "VERY_LOW"), ((2, 1, False, False), "LOW"), ((1, 0, True, False), "VERY_LOW"), ((3, 0, False, False), "HIGH"), ((2, 0, True, False), "MODERATE"), ((0, 0, False, True), "LOW"), ((0, 0, False, False), "VERY_LOW")]
    for (s, c, i, k), want in cases:
        got = spark.range(1).select(reasoning.base_confidence(F.lit(s), F.lit(c), F.lit(i), F.lit(k)).alias("c"), reasoning.cap_confidence(F.lit("LOW"), F.lit("HIGH")).alias("up")).first()
        assert got.c == want and got.up == "LOW"


def test_markers_and_outputs(spark):
    df = spark.createDataFrame([("You have a fever.",), ("There is no sign of fever here",), ("feverish",)], "t string")
    assert [r[0] for r in df.select(reasoning.asserted(F.col("t"), "fever", ["no sign", "rule out"])).collect()] == [True, False, False]
    good = '{"primary_hypothesis_type": "UNKNOWN", "confidence": "LOW", "recommended_actions": ["rest"], "reasoning_summary": "x"}'
    texts = [good, good.replace('["rest"]', '"rest"'), '{"confidence": "MAYBE"}', "oops", f"Here it is: {good} Done."]
    out = spark.createDataFrame([(t,) for t in texts], "o string")
    allowed = F.array(F.lit("UNKNOWN"), F.lit("SLEEP_DEFICIT"))
    got = [r[0] for r in out.select(reasoning.output_problems(F.col("o"), allowed)).collect()]
    assert got[0] == [] and got[1] == ["actions_not_a_list"] and got[3] == got[4] == ["not_an_object"]
    assert {"invalid_confidence", "invalid_primary", "missing_reasoning_summary"} <= set(got[2])
    assert out.select(reasoning.normalised_output(F.col("o"))).collect()[4][0] == good
