"""Registered queries of detail reads, links between layers and reconciliation, each with its SQL.

As in queries.py, a rule on the keys makes two states out of one table, and all rows take part.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalar import first_timestamp, json_path, scalar_members, utc_date
from ..operators import evidence, product, reconcile
from ..sources.scratch import stash
from ..sources.tables import observation_log, point_facts, table
from . import queries as q
from .oracles import _DAYS, _DEV, _JUDGED, _LOG, _POINTS, _STATES, ORACLES

# --- scalars


def vendor_fields(spark, d):
    """The scalar members of records that also hold an object and an array."""
    k = F.get_json_object("props", "$.k")
    body = F.concat(F.lit('{"k": '), k, F.lit(', "name": "v'), F.col("event_id").cast("string"), F.lit('", "flag": true, "none": null, "inner": {"k": 1}, "list": [1, 2]}'))
    members = table(spark, d, "events").select("event_id", F.explode(scalar_members(body)))
    return members.groupBy("key").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))


def timestamp_coalesce(spark, d):
    k = F.col("event_id")
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    time = F.when(k % 3 == 0, seconds.cast("string")).when(k % 3 == 1, F.lit("soon"))
    start = F.when(k % 4 != 0, (seconds + 1).cast("string"))
    found = first_timestamp(time, start, F.when(k % 5 != 0, (seconds + 2).cast("string")))
    return table(spark, d, "events").select("event_id", (found - seconds).alias("shift"), utc_date(found).alias("utc_date"))


def json_paths(spark, d):
    """Members at dotted paths, where some lie in a value that is no object; and a filter on one."""
    inner = F.when(F.col("event_id") % 7 == 0, F.lit("5")).otherwise(F.concat(F.lit('{"bpm": '), F.get_json_object("props", "$.k"), F.lit("}")))
    body = F.concat(F.lit('{"value": '), inner, F.lit(', "type": "'), F.col("event_type"), F.lit('"}'))
    bpm = json_path(F.col("body"), "value.bpm").try_cast("bigint")
    rows = table(spark, d, "events").select(body.alias("body")).where(json_path(F.col("body"), "type") != "error")
    return rows.groupBy(json_path(F.col("body"), "type").alias("type")).agg(F.count("*").alias("n"), F.count(bpm).alias("found"), F.sum(bpm).alias("total"))


# --- joins


def observation_versions(spark, d):
    """Observations with their version and their record, three tables joined on their keys."""
    log = observation_log(spark, d)
    records = log.select("logical", "metric").distinct().withColumnRenamed("metric", "record_metric")
    versions = log.groupBy("logical", "payload").agg(F.min("seq").alias("version"))
    joined = log.select("seq", "logical", "payload").join(versions, ["logical", "payload"]).join(records, "logical")
    return joined.select("seq", "version", "record_metric")


def dependency_links(spark, d):
    """The checks of each fact and the decision on its hour, as a feature row keeps them."""
    facts, assessed = q._assessed(spark, d)
    checks = assessed.groupBy("fact_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "check", "result"))), ",").alias("checks"))
    decided = q.source_resolution(spark, d).select("metric", "hour", "decision")
    return (
        facts.select("fact_id", "metric", F.date_trunc("hour", "starts").alias("hour")).join(checks, "fact_id", "left").join(decided, ["metric", "hour"], "left")
        .select("fact_id", "checks", "decision")
    )


def notification_versions(spark, d):
    """The last notifications of each user; some of the versions they are about are gone."""
    gates = q.notification_gate(spark, d).withColumnRenamed("event_id", "id")
    events = table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id")
    versions = events.where("id % 4 <> 1").select("id", F.concat(F.lit("S"), (F.col("id") % 5).cast("string")).alias("state"))
    sent = gates.join(events, "id").withColumn("version_id", F.col("id") - 1)
    return product.sent_with_versions(sent, versions).select("user_id", "id", "reason", "state")


def context_times(spark, d):
    signups = point_facts(spark, d).where("metric = 'signup'")
    contexts = signups.select(F.col("fact_id").alias("id"), "local_date", F.when(F.col("fact_id") % 4 == 0, "DELETED").otherwise("CURRENT").alias("status"))
    meta = signups.where("fact_id % 3 <> 0").select(
        F.col("fact_id").alias("context_id"), (F.col("fact_id") % 2 == 0).alias("ongoing"), F.date_add("local_date", 7).alias("valid_until"),
        F.when(F.col("fact_id") % 5 == 0, F.col("local_date")).alias("ended_on"),
    )
    return product.contexts_with_times(contexts, meta).drop("status")


def analytics_series(spark, d):
    """Pairs of series of one source with how they go together and how long each is."""
    catalog = q.series_catalog(spark, d).select("metric", "source_sid", "observations")
    pairs = q.relationship(spark, d).select("left_metric", "right_metric", "source_sid", "relationship_class")
    left, right = catalog.toDF("left_metric", "source_sid", "left_observations"), catalog.toDF("right_metric", "source_sid", "right_observations")
    return pairs.join(left, ["left_metric", "source_sid"]).join(right, ["right_metric", "source_sid"])


def episode_events_search(spark, d):
    """Episodes whose key or one of whose events names what is looked for; those without events count."""
    events = point_facts(spark, d).where("metric = 'signup'").select(F.col("source_sid").alias("subject"), F.col("local_date").alias("day"), F.concat(F.lit("note "), F.col("k").cast("string")).alias("title"))
    made = stash(q._episodes(spark, d), "episodes")
    held = product.timeline(made, events).select("subject", "episode_key", "title")
    found = made.join(held, ["subject", "episode_key"], "left").where(F.lower("title").contains("note 7") | F.lower("episode_key").contains("sleep"))
    return found.select("subject", "episode_key").distinct()


# --- details


def evidence_detail(spark, d):
    """For every metric that deviates on the last day of a subject: the last 28 values and deviations
    and the last 3 baselines, folded to what a drill-down shows of each."""
    devs = q._deviations(spark, d)
    keys = ["metric", "source_sid"]
    last = F.max("local_date").over(Window.partitionBy("source_sid"))
    shown = (
        devs.where("window_days = 28").withColumn("_last", last).where((F.col("local_date") == F.col("_last")) & F.col("deviation_class").isin("ABOVE_TYPICAL_RANGE", "BELOW_TYPICAL_RANGE"))
        .select(*keys, F.col("local_date").alias("analysis_date"), F.col("deviation_class").alias("today"))
    )
    return evidence.drill_down(shown, q._values(spark, d), devs, q._baselines(spark, d), keys)


def version_list(spark, d):
    """The last 30 versions of each metric, latest first."""
    versions = observation_log(spark, d).groupBy("metric", "logical", "payload").agg(F.min("seq").alias("version"))
    place = F.row_number().over(Window.partitionBy("metric").orderBy(F.desc("version")))
    return versions.withColumn("place", place.cast("bigint")).where("place <= 30").select("metric", "place", "version")


def top_patterns(spark, d):
    """The patterns with the most support: the report has ten."""
    return q.patterns(spark, d).orderBy(F.desc("support"), "trigger", "signal").limit(10).select("trigger", "signal", "support", "total", "maturity")


def evidence_parts(spark, d):
    """What a day's bundle holds besides deviations: flags of persistence, change and trend."""
    return q._days(spark, d).select("subject", "day", "persistent", "changed", "trending", "confidence", F.size("candidates").cast("bigint").alias("hypotheses"))


def judgment_signatures(spark, d):
    """Days of a subject that look to the user like the day before."""
    seen = q._days(spark, d).select("subject", "day", evidence.judgment_signature("overall_state", "primary", "confidence").alias("signature"))
    before = F.lag("signature").over(Window.partitionBy("subject").orderBy("day"))
    return seen.withColumn("same", F.col("signature") == before).groupBy("subject").agg(F.count("*").alias("days"), F.count_if("same").alias("unchanged"))


# --- reconciliation


def _history(spark, d):
    """Daily rows as a history, and what they should be; nothing differs for even days of the week."""
    before, now = q._states(spark, d)
    return before.select("id", "sig").withColumn("status", F.lit("CURRENT")), now.select("id", "sig"), before.select("id", "sig")


def replace_all(spark, d):
    """All or nothing, once with a difference and once without."""
    history, desired, same = _history(spark, d)
    out = [reconcile.replace_all(history, x, ["id"]).groupBy("status").agg(F.count("*").alias("n")).withColumn("case", F.lit(name)) for name, x in (("changed", desired), ("same", same))]
    return out[0].unionByName(out[1])


def _revisions(spark, d):
    """Current versions of three quarters of the records, and a batch that states a version for each."""
    rows = observation_log(spark, d).groupBy("logical").agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    history = rows.where("first % 4 <> 0").select("logical", F.col("first").alias("version"), F.lit("CURRENT").alias("status"))
    batch = rows.select("logical", F.col("last").alias("version"), F.when(F.col("first") % 3 == 0, "NEW").otherwise("REVISION").alias("classification"))
    return history, batch


def revision_apply(spark, d):
    after, problems = reconcile.apply_revisions(*_revisions(spark, d))
    counted = after.groupBy(F.col("status").alias("what")).agg(F.count("*").alias("n"), F.sum("version").alias("versions"))
    return counted.unionByName(problems.groupBy(F.col("problem").alias("what")).agg(F.count("*").alias("n"), F.lit(None).cast("bigint").alias("versions")))


def revision_apply_full(spark, d):
    after, _ = reconcile.apply_revisions(*_revisions(spark, d), full=True)
    return after.groupBy("status").agg(F.count("*").alias("n"), F.sum("version").alias("versions"))


def fact_set_replace(spark, d):
    """Line items as fact sets of orders: a batch restates all orders, some with other sets."""
    items = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("logical"), F.col("l_linenumber").alias("segment"), F.col("l_quantity").cast("bigint").alias("seconds"))
    history = items.withColumn("status", F.lit("CURRENT"))
    batch = items.where("logical % 5 <> 0 or segment <> 1").withColumn("seconds", F.col("seconds") + F.when((F.col("logical") % 7 == 0) & (F.col("segment") == 2), 1).otherwise(0))
    return reconcile.replace_sets(history, batch, "logical").groupBy("status").agg(F.count("*").alias("n"), F.sum("seconds").alias("seconds"))


def semantic_difference(spark, d):
    """Two builds of features whose ids differ, compared by what their facts say; one build lacks a few."""
    facts = point_facts(spark, d).select("fact_id", "metric", "ts", "k")
    other = facts.withColumn("fact_id", F.col("fact_id") + 1_000_000)
    a = facts.select("fact_id", (F.col("k") * 2).alias("value"))
    b = other.select("fact_id", (F.col("k") * 2 + F.when(F.col("fact_id") % 500 == 0, 1).otherwise(0)).alias("value"))
    told = reconcile.semantic_compare(a, b, ["fact_id", "value"], {"fact_id": (facts, other, "fact_id", ["metric", "ts", "k"])})
    return told.groupBy("side").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def episode_projection(spark, d):
    """Stored episodes after a new projection in which some are gone, some longer and some new."""
    made = q._episodes(spark, d).select("subject", "episode_key", "start_day", "end_day", "phase")
    n = F.dayofmonth("start_day")
    stored = made.where(n % 3 != 0).withColumns({"id": n.cast("bigint"), "status": F.lit("CURRENT")})
    now = made.where(n % 4 != 0).withColumn("end_day", F.when(n % 5 == 0, F.date_add("end_day", 1)).otherwise(F.col("end_day")))
    return product.project_episodes(stored, now).groupBy("status").agg(F.count("*").alias("n"), F.count("id").alias("known"), F.max("end_day").alias("last"))


def definition_guard(spark, d):
    """Parts as definitions: those whose text changed under the same version."""
    parts = table(spark, d, "part").select(F.col("p_name").alias("name"), F.col("p_size").alias("version"), "p_partkey", F.sha2(F.concat_ws("|", "p_brand", "p_type"), 256).alias("checksum"))
    named = parts.withColumn("name", F.concat_ws("#", "name", "p_partkey"))
    changed = named.withColumn("checksum", F.when(F.col("p_partkey") % 9 == 0, F.lit("other")).otherwise(F.col("checksum"))).withColumn("version", F.col("version") + F.when(F.col("p_partkey") % 18 == 0, 1).otherwise(0))
    return reconcile.definitions_changed(named.drop("p_partkey"), changed.drop("p_partkey"))


def delete_user(spark, d):
    """What is left of a user's tables once one user is taken out of all of them."""
    rows = {"customer": ("c_custkey", "customer"), "orders": ("o_custkey", "orders")}
    left = [table(spark, d, t).where(F.col(key) != 7).agg(F.count("*").alias("n")).withColumn("table", F.lit(name)) for name, (key, t) in rows.items()]
    return left[0].unionByName(left[1])


_NOTIFIED = ORACLES["notification_gate"]
_CTX_ROWS = "signups as (select * from facts where metric = 'signup')"

ENTRIES = {
    vendor_fields: """with k as (select event_id, json_extract_string(props, '$.k') as k from events),
        m as (select 'k' as key, k as value from k where k is not null union all select 'name', 'v' || event_id::varchar from k where k is not null
              union all select 'flag', 'true' from k where k is not null union all select 'none', null from k where k is not null)
        select key, count(*) as n, min(value) as least, max(value) as most from m group by all""",
    timestamp_coalesce: """with s as (select event_id, case when event_id % 3 = 0 then 0 when event_id % 4 <> 0 then 1 when event_id % 5 <> 0 then 2 end::bigint as shift, ts from events)
        select event_id, shift, (ts + shift * interval 1 second)::date as utc_date from s""",
    json_paths: """select event_type as type, count(*) as n, count(*) filter (where event_id % 7 <> 0 and json_extract_string(props, '$.k') is not null) as found,
        sum(try_cast(json_extract_string(props, '$.k') as bigint)) filter (where event_id % 7 <> 0)::bigint as total from events where event_type <> 'error' group by all""",
    observation_versions: f"with {_LOG} select seq, min(seq) over (partition by logical, payload) as version, metric as record_metric from log",
    dependency_links: f"""with {_POINTS}, g as (
            select metric, date_trunc('hour', ts) as hour, count(*) as members, count(distinct source_class) as classes, count(distinct floor(value / 40)) as said from facts group by all)
        select fact_id, 'PROVENANCE:' || case when f.metric <> 'signup' then 'PASS' else 'FLAGGED' end || ',SEMANTICS:' || case when fact_id % 2 = 0 then 'UNKNOWN' else 'PASS' end
            || ',STRUCTURE:' || case when fact_id % 3 <> 0 or fact_id % 6 = 0 then 'PASS' else 'FLAGGED' end as checks,
            case when classes = 1 and members = 1 then 'SELECTED' when classes = 1 or said = 1 then 'COEXIST' else 'UNRESOLVED' end as decision
        from facts f join g on g.metric = f.metric and g.hour = date_trunc('hour', f.ts)""",
    context_times: f"""with {_POINTS}, {_CTX_ROWS} select fact_id as id, local_date, case when fact_id % 3 <> 0 then fact_id % 2 = 0 end as ongoing,
        case when fact_id % 3 <> 0 then (local_date + 7)::date end as valid_until, case when fact_id % 3 <> 0 and fact_id % 5 = 0 then local_date end as ended_on from signups where fact_id % 4 <> 0""",
    notification_versions: f"""with g as ({_NOTIFIED}), s as (
            select user_id, event_id as id, reason, case when (event_id - 1) % 4 <> 1 and event_id - 1 in (select event_id from events) then 'S' || ((event_id - 1) % 5)::varchar end as state,
                   row_number() over (partition by user_id order by event_id desc) as rn from g join events using (event_id) where decision = 'SEND')
        select user_id, id, reason, state from s where rn <= 20""",
    analytics_series: f"""with r as ({ORACLES['relationship']}), c as ({ORACLES['series_catalog']})
        select left_metric, right_metric, r.source_sid, relationship_class, a.observations as left_observations, b.observations as right_observations from r
        join c a on a.metric = left_metric and a.source_sid = r.source_sid join c b on b.metric = right_metric and b.source_sid = r.source_sid""",
    episode_events_search: f"""with {_JUDGED} select distinct e.subject, e.episode_key from eps e left join facts f on f.metric = 'signup' and f.source_sid = e.subject and f.local_date between e.start_day and e.end_day
        where contains('note ' || f.k::varchar, 'note 7') or contains(lower(e.episode_key), 'sleep')""",
    top_patterns: f'select trigger, signal, support, total, maturity from ({ORACLES["patterns"]}) order by support desc, trigger, signal limit 10',
    replace_all: f"""with {_STATES}, b as (select count(*) as was, count(*) filter (where d_is is not null) as dummy from acts where d_was is not null)
        select 'CURRENT' as status, count(*) as n, 'changed' as "case" from now_ union all select 'STALE', count(*), 'changed' from was union all select 'CURRENT', count(*), 'same' from was""",
    evidence_detail: f"""with {_DEV}, shown as (
            select metric, source_sid, local_date as analysis_date, deviation_class as today from (
                select *, max(local_date) over (partition by source_sid) as last_day from devs where window_days = 28) where local_date = last_day and deviation_class in ('ABOVE_TYPICAL_RANGE', 'BELOW_TYPICAL_RANGE')),
        v as (select s.*, o.local_date, o.value, row_number() over (partition by s.metric, s.source_sid order by o.local_date desc) as rn from shown s join obs o on o.metric = s.metric and o.source_sid = s.source_sid),
        dv as (select s.metric, s.source_sid, deviation_class, row_number() over (partition by s.metric, s.source_sid order by x.local_date desc, x.window_days) as rn from shown s join devs x on x.metric = s.metric and x.source_sid = s.source_sid),
        b as (select s.metric, s.source_sid, b.as_of, b.window_days, row_number() over (partition by s.metric, s.source_sid order by b.as_of desc, b.window_days) as rn from shown s
              join baselines b on b.metric = s.metric and b.source_sid = s.source_sid and b.as_of <= s.analysis_date),
        v1 as (select metric, source_sid, analysis_date, today, count(*) as shown_values, round(sum(value), 4) as total from v where rn <= 28 group by all),
        d1 as (select metric, source_sid, count(*) as shown_deviations, count(*) filter (where deviation_class = 'INSUFFICIENT_BASELINE') as without_baseline from dv where rn <= 28 group by all),
        b1 as (select metric, source_sid, string_agg(as_of::varchar || '/' || window_days::varchar, ',' order by rn) as latest_baselines from b where rn <= 3 group by all)
        select v1.*, shown_deviations, without_baseline, latest_baselines from v1 left join d1 on d1.metric = v1.metric and d1.source_sid = v1.source_sid left join b1 on b1.metric = v1.metric and b1.source_sid = v1.source_sid""",
    version_list: f"""with {_LOG}, v as (select metric, logical, payload, min(seq) as version from log group by all), r as (select metric, row_number() over (partition by metric order by version desc) as place, version from v)
        select * from r where place <= 30""",
    evidence_parts: f"with {_DAYS} select subject, day, persistent, changed, trending, confidence, greatest(len(found), 1)::bigint as hypotheses from days",
    judgment_signatures: f"""with {_DAYS}, s as (select subject, overall_state || hypotheses[1] || confidence = lag(overall_state || hypotheses[1] || confidence) over (partition by subject order by day) as same from days)
        select subject, count(*) as days, count(*) filter (where same) as unchanged from s group by all""",
    revision_apply: f"""with {_LOG}, r as (select logical, min(seq) as first, max(seq) as last, min(seq) % 4 <> 0 as has from log group by all),
        j as (select *, has and first = last as same, case when has and first = last then null when first % 3 = 0 and has then 'NEW_HAS_CURRENT' when first % 3 <> 0 and not has then 'REVISION_WITHOUT_CURRENT' end as problem from r),
        a as (select case when not same and problem is null then 'STALE' else 'CURRENT' end as what, first as version from j where has union all select 'CURRENT', last from j where not same and problem is null)
        select what, count(*) as n, sum(version)::bigint as versions from a group by all union all select problem, count(*), null from j where problem is not null group by all""",
    revision_apply_full: f"""with {_LOG}, r as (select logical, min(seq) as first, max(seq) as last, min(seq) % 4 <> 0 as has from log group by all),
        a as (select case when first <> last then 'STALE' else 'CURRENT' end as status, first as version from r where has union all select 'CURRENT', last from r where not has or first <> last)
        select status, count(*) as n, sum(version)::bigint as versions from a group by all""",
    fact_set_replace: """with i as (select l_orderkey as k, l_linenumber as s, l_quantity::bigint as q from lineitem),
        h as (select k, bool_or(k % 5 = 0 and s = 1) or bool_or(k % 7 = 0 and s = 2) as changed, bool_or(k % 5 <> 0 or s <> 1) as stated from i group by k),
        a as (select case when changed and stated then 'STALE' else 'CURRENT' end as status, q from i join h on h.k = i.k
              union all select 'CURRENT', q + case when i.k % 7 = 0 and s = 2 then 1 else 0 end from i join h on h.k = i.k where changed and stated and (i.k % 5 <> 0 or s <> 1))
        select status, count(*) as n, sum(q)::bigint as seconds from a group by all""",
    semantic_difference: f"""with {_POINTS}, x as (select k * 2 as v from facts where (fact_id + 1000000) % 500 = 0)
        select 'only_first' as side, count(*) as n, sum(v)::bigint as total from x union all select 'only_second', count(*), sum(v + 1)::bigint from x""",
    episode_projection: f"""with {_JUDGED}, n as (select *, day(start_day) % 3 <> 0 as was, day(start_day) % 4 <> 0 as now_ from eps),
        a as (select case when now_ then 'CURRENT' else 'SUPERSEDED' end as status, was, case when now_ and day(start_day) % 5 = 0 then (end_day + 1)::date else end_day end as end_day from n where was or now_)
        select status, count(*) as n, count(*) filter (where was) as known, max(end_day) as last from a group by all""",
    definition_guard: "select p_name || '#' || p_partkey::varchar as name, p_size as version from part where p_partkey % 9 = 0 and p_partkey % 18 <> 0",
    delete_user: "select 'customer' as \"table\", count(*) as n from customer where c_custkey <> 7 union all select 'orders', count(*) from orders where o_custkey <> 7",
}

QUERIES = {f.__name__: f for f in ENTRIES}
SQL = {f.__name__: sql for f, sql in ENTRIES.items()}
