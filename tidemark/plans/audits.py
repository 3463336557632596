"""Registered acceptance checks, a query for each layer, on tables in which a rule on the keys has put
errors, so that checks have something to find. Each has its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics, audits, features, quality
from ..sources.scratch import stash
from ..sources.tables import observation_log, point_facts, table
from . import queries as q
from .oracles import _BASE, _DAILY, _DAYS, _DEV, _POINTS, ORACLES


def audit_facts(spark, d):
    """Every 101st fact has lost its time, every 103rd says another class, every 107th is there twice, every
    109th is gone, every 113th has evidence of an unknown kind, every 131st
    is on the next day."""
    k = F.col("fact_id")
    facts = point_facts(spark, d).where(k % 109 != 0).select(
        "fact_id", F.when(k % 101 != 0, F.col("ts")).alias("ts"), F.date_add("local_date", F.when(k % 131 == 0, 1).otherwise(0)).alias("local_date"), "offset_seconds", "source_sid",
        F.when(k % 103 == 0, "OTHER_SOURCE").otherwise(F.col("source_class")).alias("source_class"), F.when(k % 113 == 0, "GUESSED").otherwise("SENSOR_DERIVED").alias("evidence"),
    )
    log = observation_log(spark, d).select(F.col("seq").alias("fact_id")).where("fact_id % 127 <> 0")
    return audits.facts_audit(facts.unionByName(facts.where(k % 107 == 0)), log)


def audit_provenance(spark, d):
    """Raw lines of which every 89th has changed, every 97th is gone and every 83rd has no fact."""
    text = F.to_json(F.struct("event_id", "user_id", "event_type"))
    events = table(spark, d, "events").select(F.col("event_id").alias("fact_id"), text.alias("text"))
    raw = events.where("fact_id % 97 <> 0").withColumn("text", F.when(F.col("fact_id") % 89 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")))
    return audits.provenance_audit(events.where("fact_id % 83 <> 0").select("fact_id", F.sha2("text", 256).alias("raw_sha256")), raw)


def audit_quality(spark, d):
    """Assessments of which some are gone, some twice, some in other words; decisions with conflicts settled."""
    facts, assessed = q._assessed(spark, d)
    k = F.col("fact_id")
    told = assessed.where((k % 97 != 0) | (F.col("check") != "STRUCTURE")).withColumn(
        "result", F.when((k % 89 == 0) & (F.col("check") == "SEMANTICS"), "PASS").when((k % 83 == 0) & (F.col("check") == "STRUCTURE"), "FINE")
        .when((k % 79 == 0) & (F.col("check") == "PROVENANCE"), "PASS").otherwise(F.col("result"))
    )
    decisions = q.source_resolution(spark, d).withColumn("decision", F.when(F.hour("hour") == 5, "SELECTED").otherwise(F.col("decision")))
    return audits.quality_audit(
        facts.select("fact_id", "evidence").where(k % 73 != 0), told.unionByName(told.where(k % 71 == 0)), facts.where("metric <> 'signup'").select("fact_id"), decisions
    )


def audit_features(spark, d):
    """Features in which some counts and means are off, some days are gone and some are there twice."""
    facts = point_facts(spark, d)
    n = F.dayofmonth("local_date")
    daily = features.point_daily(facts).where((n != 9) | (F.col("metric") != "view")).withColumns({
        "n": F.when((n == 5) & (F.col("metric") == "click"), 0).otherwise(F.col("n")), "mean": F.when(n == 6, F.col("mean") + 1).otherwise(F.col("mean")),
        "median": F.when(n == 7, F.col("high") + 1).otherwise(F.col("median")),
    })
    return audits.features_audit(daily.unionByName(daily.where(n == 8)), facts.where("metric <> 'error'"), features.SERIES)


def audit_baselines(spark, d):
    """Baselines of which those of the 3rd, the 20th and the 22nd to 26th are wrong in many ways."""
    day = F.dayofmonth("as_of")
    bad = day == 20
    w, low = F.col("window_days"), F.col("maturity") == "INSUFFICIENT_HISTORY"
    made = q._baselines(spark, d).withColumns({
        "q10": F.when(bad & (w == 7), F.col("q90") + 1).otherwise(F.col("q10")), "median": F.when(bad & (w == 28), F.coalesce("median", F.lit(0.0)) + 1).otherwise(F.col("median")),
        "coverage": F.when(bad & (w == 90), F.col("coverage") + 1).otherwise(F.col("coverage")), "maturity": F.when(bad & (w == 90) & ~low, "ESTABLISHED").otherwise(F.col("maturity")),
    })
    made = made.withColumns({
        "window_days": F.when((day == 22) & (w == 28), 29).otherwise(w), "mad": F.when((day == 23) & (w == 28), -1.0).otherwise(F.col("mad")),
        "distinct_dates": F.when((day == 24) & (w == 7), 8).otherwise(F.col("distinct_dates")), "span_days": F.when((day == 25) & (w == 7), 8).otherwise(F.col("span_days")),
        "median": F.when((day == 3) & (w == 90), F.coalesce("median", F.lit(0.0))).when((day != 26) | (w != 28), F.col("median")),
    })
    return audits.baselines_audit(made.unionByName(made.where(F.dayofmonth("as_of") == 21)), features.SERIES)


def audit_analytics(spark, d):
    """Analytics of which those of some metrics state what their numbers do not say."""
    devs = q._deviations(spark, d).withColumn("deviation_class", F.when((F.col("metric") == "click") & (F.col("quantile_band") == "Q25_Q50"), "ABOVE_TYPICAL_RANGE").otherwise(F.col("deviation_class")))
    view, day = F.col("metric") == "view", F.dayofmonth("local_date")
    devs = devs.withColumns({
        "absolute": F.when(view & (day == 3), 1.0).otherwise(F.col("absolute")), "z_reason": F.when(view & (day == 14), "PLANTED").otherwise(F.col("z_reason")),
        "maturity": F.when(view & (day == 15), "INSUFFICIENT_HISTORY").otherwise(F.col("maturity")), "evidence": F.when(view & (day == 16), "SUFFICIENT").otherwise(F.col("evidence")),
    })
    metric = F.col("metric")
    runs = analytics.persistence(q._deviations(spark, d)).withColumns({
        "persistence_class": F.when(metric == "view", "PERSISTENT_ABOVE_TYPICAL").when(metric == "click", "NO_PERSISTENT_DEVIATION").otherwise(F.col("persistence_class")),
        "above": F.when(metric == "purchase", 1).otherwise(F.col("above")), "below": F.when(metric == "purchase", 1).otherwise(F.col("below")),
    })
    changes = q.change_point(spark, d).withColumn("change_class", F.when(F.col("metric") == "error", "CHANGE_DETECTED").otherwise(F.col("change_class"))).withColumn("n", F.when(F.col("metric") == "signup", 9).otherwise(F.col("n")))
    pairs = q.relationship(spark, d).withColumn("relationship_class", F.when(F.col("left_metric") == "error", "CAUSES").otherwise(F.col("relationship_class")))
    pairs = pairs.withColumns({"rho": F.when(F.col("left_metric") == "signup", 1.5).otherwise(F.col("rho")), "n": F.when(F.col("left_metric") == "purchase", 3).otherwise(F.col("n"))})
    return audits.analytics_audit(devs, runs, changes, pairs)


def audit_reasoning(spark, d):
    """Days of which the tenth are called stable, the eleventh have no hypothesis, the twelfth are certain, the
    13th in a state of no name, the 14th without support, the 15th in forbidden words, the 16th there twice,
    the 17th without evidence and the 18th without a finding."""
    n = F.dayofmonth("day")
    days = q._days(spark, d).withColumns({
        "overall_state": F.when(n == 10, "STABLE").otherwise(F.col("overall_state")), "candidates": F.when(n == 11, F.slice("candidates", 1, 0)).otherwise(F.col("candidates")),
        "confidence": F.when(n == 12, "CERTAIN").otherwise(F.col("confidence")),
    })
    bare = F.transform("candidates", lambda c: c.withField("supporting", F.slice(c["supporting"], 1, 0)))
    named = lambda kind: F.transform("candidates", lambda c: c.withField("type", F.lit(kind)))
    days = days.withColumns({
        "overall_state": F.when(n == 13, "ODD").when(n == 17, "INSUFFICIENT_EVIDENCE").otherwise(F.col("overall_state")), "candidates": F.when(n == 14, bare).when(n == 15, named("HEALTHY_SCORE")).when(n == 18, named("NO_SIGNIFICANT_FINDING")).otherwise(F.col("candidates")),
    })
    days = stash(days, "days")
    return audits.reasoning_audit(days.unionByName(days.where(n == 16)))


def audit_stages(spark, d):
    """Days of the log as runs of a pipeline for each metric; runs of odd metrics stop before the end."""
    log = observation_log(spark, d)
    runs = log.groupBy("metric", "day").agg(F.max("seq").alias("frontier")).select(
        F.col("day").alias("run"), F.col("metric").alias("pipeline"), "frontier", F.when((F.length("metric") == 5) & (F.dayofmonth("day") == 30), "FAIL").otherwise("PASS").alias("status")
    )
    frontiers = log.groupBy(F.col("metric").alias("pipeline")).agg(F.max("seq").alias("frontier"))
    return audits.stage_audit(runs, frontiers, log.where("metric <> 'signup'").groupBy(F.col("metric").alias("pipeline")).agg(F.count("*").alias("rows")))


def issue_log(spark, d):
    raw = table(spark, d, "events").select(
        F.col("event_id").alias("id"), "ts", F.when(F.col("event_id") % 50 == 0, F.lit('{"k": "x"}')).otherwise(F.col("props")).alias("body"),
        (F.unix_seconds(F.col("ts").cast("timestamp")) + F.when(F.col("event_id") % 53 == 0, 1).otherwise(0)).alias("raw_time"),
    )
    item = F.struct(F.lit(0).cast("bigint").alias("start"), (F.col("l_quantity").cast("bigint") - F.when(F.col("l_orderkey") % 40 == 0, 60).otherwise(1)).alias("end"), F.col("l_returnflag").alias("state"))
    eps = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.array(item).alias("items"))
    short = q._baselines(spark, d).select(F.when(F.col("maturity") == "INSUFFICIENT_HISTORY", "SHORT_HISTORY").alias("issue"))
    return audits.issue_log(normalisation=quality.normalise_points(raw), intervals=quality.interval_facts(eps, {"A": "AWAKE", "N": "SLEEP"}), baselines=short)


def _checks(source: str, rules: dict[str, str]) -> str:
    return " union all ".join(f"select '{k}' as \"check\", count(*) filter (where {v}) as violations from {source}" for k, v in rules.items())


_BANDS = "case quantile_band when 'ABOVE_Q90' then cls <> 'BELOW_TYPICAL_RANGE' when 'BELOW_Q10' then cls = 'BELOW_TYPICAL_RANGE' else cls = 'WITHIN_TYPICAL_RANGE' end"

ENTRIES = {
    audit_facts: f"""with {_POINTS}, f as (select *, fact_id % 127 = 0 as unlogged from facts where fact_id % 109 <> 0), t as (select * from f union all select * from f where fact_id % 107 = 0)
        {_checks('t', {'no_time': 'fact_id % 101 = 0', 'wrong_source_class': 'fact_id % 103 = 0', 'unknown_evidence': 'fact_id % 113 = 0', 'wrong_local_date': 'fact_id % 131 = 0 and fact_id % 101 <> 0', 'fact_without_observation': 'unlogged'})}
        union all {_checks('f', {'duplicate_fact': 'fact_id % 107 = 0'})} union all {_checks('facts', {'observation_without_fact': 'fact_id % 109 = 0 and fact_id % 127 <> 0'})}""",
    audit_provenance: f"""with e as (select event_id % 97 <> 0 as has, event_id % 83 <> 0 as used, event_id % 89 = 0 as changed from events)
        {_checks('e', {'raw_missing': 'not has and used', 'hash_differs': 'has and used and changed', 'raw_unused': 'has and not used'})}""",
    audit_quality: f"""with f as (
            select event_id as id, case when event_id % 3 = 0 then 'INTERVAL' else 'POINT' end as kind, event_type <> 'signup' as linked, event_id % 3 <> 0 or event_id % 6 = 0 as timed,
                   event_id % 2 = 0 as vendor, event_id % 73 <> 0 as known, event_id % 71 = 0 as twice from events),
        a as (
            select id, vendor, known, linked, twice, 'STRUCTURE' as c, case when id % 83 = 0 then 'FINE' when timed then 'PASS' else 'FLAGGED' end as r from f where id % 97 <> 0
            union all select id, vendor, known, linked, twice, 'PROVENANCE', case when id % 79 = 0 or linked then 'PASS' else 'FLAGGED' end from f
            union all select id, vendor, known, linked, twice, 'SEMANTICS', case when id % 89 = 0 or not vendor then 'PASS' else 'UNKNOWN' end from f),
        t as (select * from a union all select * from a where twice), rs as ({ORACLES['source_resolution']}),
        dec as (select agreement, case when hour(hour) = 5 then 'SELECTED' else decision end as decision from rs)
        {_checks('t', {'unknown_result': "r = 'FINE'", 'orphan_assessment': 'not known', 'provenance_wrong': "c = 'PROVENANCE' and known and linked <> (r = 'PASS')", 'vendor_certain': "c = 'SEMANTICS' and known and vendor and r = 'PASS'"})}
        union all {_checks('f', {'not_three_checks': 'known and id % 97 = 0'})} union all {_checks('a', {'duplicate_assessment': 'twice'})}
        union all {_checks('dec', {'conflict_decided': "agreement = 'CONFLICT' and decision <> 'UNRESOLVED'", 'single_source_open': "agreement = 'SINGLE_SOURCE' and decision = 'UNRESOLVED'"})}""",
    audit_features: f"""with {_DAILY}, x as (select *, day(local_date) as dom, metric <> 'error' as known, not (day(local_date) = 9 and metric = 'view') as has from daily),
        t as (select * from x where has union all select * from x where has and dom = 8)
        {_checks('t', {'without_facts': 'not known', 'wrong_count': "known and dom = 5 and metric = 'click'", 'wrong_mean': 'known and dom = 6', 'zero_samples': "dom = 5 and metric = 'click'", 'unordered': 'dom = 7'})}
        union all {_checks('x', {'missing_day': 'known and not has', 'duplicate_feature': 'has and dom = 8'})}""",
    audit_baselines: f"""with {_BASE}, x as (select metric, source_sid, as_of, n, q25, q50, q75, q90, day(as_of) as dom, window_days as w, maturity = 'INSUFFICIENT_HISTORY' as low,
            case when dom = 20 and w = 7 then q90 + 1 else q10 end as q10, case when dom = 20 and w = 28 then coalesce(median, 0) + 1 when dom = 3 and w = 90 then coalesce(median, 0) when dom = 26 and w = 28 then null else median end as median,
            case when dom = 20 and w = 90 then coverage + 1 else coverage end as coverage, case when dom = 20 and w = 90 and not low then 'ESTABLISHED' else maturity end as maturity,
            case when dom = 22 and w = 28 then 29 else w end as window_days, case when dom = 23 and w = 28 then -1.0 else mad end as mad,
            case when dom = 24 and w = 7 then 8 else distinct_dates end as distinct_dates, case when dom = 25 and w = 7 then 8 else span_days end as span_days from baselines),
        y as (select x.*, case when n < least then 'INSUFFICIENT_HISTORY' when n >= obs_n and span_days >= span_n and distinct_dates / x.window_days >= cov_n then 'ESTABLISHED' else 'PROVISIONAL' end as level, wins.least is not null as known
            from x left join wins on wins.window_days = x.window_days),
        t as (select * from y union all select * from y where dom = 21)
        {_checks('t', {'unknown_window': 'not known', 'unordered': 'q10 > q25 + 1e-6 or q25 > q50 + 1e-6 or q50 > q75 + 1e-6 or q75 > q90 + 1e-6', 'median_off': 'abs(median - q50) > 1e-6', 'negative_mad': 'mad < 0',
                       'too_many_dates': 'distinct_dates > window_days', 'span_over_window': 'span_days > window_days', 'coverage_off': 'abs(coverage - distinct_dates / window_days) > 1e-5', 'maturity_off': 'known and maturity <> level',
                       'published_early': 'low and median is not null', 'not_published': 'not low and median is null'})}
        union all {_checks('y', {'duplicate_baseline': 'dom = 21'})}""",
    audit_analytics: f"""with {_DEV}, dv as (select *, case when metric = 'click' and quantile_band = 'Q25_Q50' then 'ABOVE_TYPICAL_RANGE' else deviation_class end as cls, metric = 'view' as pl, day(local_date) as dom,
            case when pl and dom = 3 then 1.0 else absolute end as ab, case when pl and dom = 14 then 'PLANTED' else z_reason end as zr,
            case when pl and dom = 15 then 'INSUFFICIENT_HISTORY' else maturity end as mat, case when pl and dom = 16 then 'SUFFICIENT' else evidence end as evi from devs),
        ps as ({ORACLES['persistence']}), pq as (select *, case metric when 'view' then 'PERSISTENT_ABOVE_TYPICAL' when 'click' then 'NO_PERSISTENT_DEVIATION' else persistence_class end as cls,
            case when metric = 'purchase' then 1 else above end as up, case when metric = 'purchase' then 1 else below end as down from ps),
        cs as ({ORACLES['change_point']}), cq as (select *, case when metric = 'error' then 'CHANGE_DETECTED' else change_class end as cls, case when metric = 'signup' then 9 else n end as m from cs),
        rs as ({ORACLES['relationship']}), rq as (select *, case when left_metric = 'signup' then 1.5 else rho end as r, case when left_metric = 'purchase' then 3 else n end as m from rs)
        {_checks('dv', {'class_off_band': f"cls <> 'INSUFFICIENT_BASELINE' and not ({_BANDS})", 'insufficient_with_numbers': "cls = 'INSUFFICIENT_BASELINE' and (ab is not null or relative is not null or robust_z is not null)",
                        'z_without_spread': 'zr is not null and robust_z is not null', 'maturity_ignored': "(cls = 'INSUFFICIENT_BASELINE') <> (mat = 'INSUFFICIENT_HISTORY')", 'evidence_off': "(evi = 'SUFFICIENT') <> (mat = 'ESTABLISHED')"})}
        union all {_checks('pq', {'run_without_days': "cls = 'PERSISTENT_ABOVE_TYPICAL' and up < 3 or cls = 'PERSISTENT_BELOW_TYPICAL' and down < 3", 'run_not_named': "cls = 'NO_PERSISTENT_DEVIATION' and greatest(up, down) >= 3", 'both_runs': 'up > 0 and down > 0'})}
        union all {_checks('cq', {'change_without_date': "cls = 'CHANGE_DETECTED' and split_date is null", 'change_too_small': "cls = 'CHANGE_DETECTED' and magnitude < 3", 'change_on_few': "m < 10 and cls <> 'INSUFFICIENT_EVIDENCE'"})}
        union all {_checks('rq', {'rho_out_of_bounds': 'abs(r) > 1 + 1e-9', 'rho_on_few': 'm < 5 and r is not null', 'cause_named': "left_metric = 'error'"})}""",
    audit_reasoning: f"""with {_DAYS}, x as (select *, day(day) as dom, case day(day) when 10 then 'STABLE' when 13 then 'ODD' when 17 then 'INSUFFICIENT_EVIDENCE' else overall_state end as st, case day(day) when 12 then 'CERTAIN' else confidence end as conf,
            case day(day) when 11 then [] when 15 then list_transform(hypotheses, lambda h: 'HEALTHY_SCORE') when 18 then list_transform(hypotheses, lambda h: 'NO_SIGNIFICANT_FINDING') else hypotheses end as hs from days),
        t as (select * from x union all select * from x where dom = 16)
        {_checks('t', {'unknown_state': "st not in ('INSUFFICIENT_EVIDENCE', 'NOTABLE_CHANGE', 'MILD_CHANGE', 'STABLE')", 'unknown_confidence': "conf = 'CERTAIN'", 'no_hypothesis': 'len(hs) = 0', 'without_support': 'len(hs) > 0 and (dom = 14 or support = 0)',
                       'blind_state': "(known = 0) <> (st = 'INSUFFICIENT_EVIDENCE')", 'quiet_but_stable': "st = 'STABLE' and (above + below > 0 or persistent or changed)", 'finding_on_stable': "hs[1] = 'NO_SIGNIFICANT_FINDING' and st <> 'STABLE'",
                       'forbidden_word': "list_contains(hs, 'HEALTHY_SCORE')"})}
        union all {_checks('x', {'duplicate_day': 'dom = 16'})}""",
    audit_stages: """with r as (select event_type as p, ts::date as d, max(event_id) as f, case when length(event_type) = 5 and day(ts::date) = 30 then 'FAIL' else 'PASS' end as s from events group by all)
        select p as pipeline, arg_max(s, d) = 'PASS' as last_passed, max(f) filter (where s = 'PASS') = max(f) as at_frontier, p <> 'signup' as has_rows from r group by p""",
    issue_log: f"""with {_BASE}, n as (select case when event_id % 50 = 0 then 'NOT_A_NUMBER' when json_extract_string(props, '$.k') is null then 'MISSING_FIELD' when event_id % 53 = 0 then 'TIME_MISMATCH' end as code from events),
        i as (select case when l_quantity::bigint - case when l_orderkey % 40 = 0 then 60 else 1 end < 0 then 'NEGATIVE_INTERVAL' when l_returnflag not in ('A', 'N') then 'UNKNOWN_STATE' end as code from lineitem),
        a as (select 'normalisation' as stage, code from n union all select 'intervals', code from i union all select 'baselines', case when maturity = 'INSUFFICIENT_HISTORY' then 'SHORT_HISTORY' end from baselines)
        select stage, code, case when code in ('NEGATIVE_INTERVAL', 'TIME_MISMATCH') then 'ERROR' else 'WARNING' end as severity, count(*) as n from a where code is not null group by all""",
}

QUERIES = {f.__name__: f for f in ENTRIES}
SQL = {f.__name__: sql for f, sql in ENTRIES.items()}
