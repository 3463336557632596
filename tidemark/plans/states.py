"""Queries on how states change: retirement over provenance, affected regions, hash trees, sessions as
states, guards on texts; and the DuckDB SQL each is compared with."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analytics, baseline, digests, evidence, guards, lineage, regions
from ..operators.features import SERIES
from ..params import HEDGES, PAIRS, REVIEW_KEYS, REVIEW_LISTS, REVIEW_STATES
from ..sources.scratch import stash
from ..sources.tables import observation_log, point_facts, table
from ..streaming import sessions
from .oracles import _BASE, _DEV, _POINTS, _ROLLING, ORACLES
from .queries import _contexts, _values

Query = Callable[[SparkSession, str], DataFrame]

#: The source that is retired.
RETIRED = "2"


def retire_cascade(spark, d):
    """What a retired source leaves stale in all layers: facts, features, baselines, deviations, bundles."""
    facts, daily = point_facts(spark, d), stash(_values(spark, d), "daily")
    devs = analytics.deviations(daily, baseline.rolling_baselines(daily))
    links = lineage.analytics_links(facts, daily, devs)
    return lineage.cascade(links, spark.createDataFrame([("SOURCE", RETIRED)], "layer string, id string"))


def _before_and_now(spark, d):
    """Two states of the daily values: days that came, went and changed, and series that are new or gone."""
    daily = stash(_values(spark, d).select(*SERIES, "local_date", "value"), "daily")
    day = F.dayofmonth("local_date")
    new, gone = (F.col("metric") == "signup") & (F.col("source_sid") == "2"), (F.col("metric") == "view") & (F.col("source_sid") == "4")
    before = daily.where((day != 20) | (F.col("source_sid") != "6")).where(~new)
    now = daily.where((day != 12) | (F.col("metric") != "click")).where(~gone)
    return before, now.withColumn("value", F.col("value") + F.when((day == 15) & (F.col("source_sid") == "4"), 1.0).otherwise(0.0))


def dirty_cells(spark, d):
    return regions.dirty_cells(*_before_and_now(spark, d))


def renewed_baselines(spark, d):
    """The baselines of the second state, made from those of the first in the dirty cells only."""
    before, now = _before_and_now(spark, d)
    return regions.renew_baselines(stash(baseline.rolling_baselines(before), "baselines"), before, now)[0]


def _builds(spark, d):
    """Two builds of the log: in the second some payloads are others and some rows are missing."""
    log = observation_log(spark, d).select("seq", "logical", "payload")
    other = log.where("seq % 1999 <> 7").withColumn("payload", F.col("payload") + F.when(F.col("seq") % 997 == 3, 1).otherwise(0))
    return log, other


def hash_tree(spark, d):
    return digests.hash_tree(_builds(spark, d)[0], "seq", ["logical", "payload"])


def hash_tree_difference(spark, d):
    """The rows that differ between the two builds, looked for in the ranges whose digests differ only."""
    builds = _builds(spark, d)
    ranges = digests.differing_ranges(*(digests.hash_tree(b, "seq", ["logical", "payload"]) for b in builds))
    return digests.differing_rows(*builds, ranges, "seq", ["logical", "payload"])


def session_days(spark, d):
    """The session of each user's day from the state that the stream keeps."""
    turns = table(spark, d, "events").select("user_id", F.to_date("ts").alias("day"), "ts", F.col("event_id").alias("id"), F.lit(False).alias("slept"))
    slept = table(spark, d, "events").where("event_type = 'view'").select("user_id", F.to_date("ts").alias("day"), "ts", F.col("event_id").alias("id"), F.lit(True).alias("slept"))
    return sessions.sessions_of(sessions.day_states(turns.unionByName(slept)))


#: What the turns of a conversation are made to say, by a rule on their keys, before their own text.
SAID = [
    "You have the flu and a chronic cough.", "It is possibly pneumonia.", "Under the influence of work.", "建议检查，可能是肺炎。", "患者有高血压。", "He drank wine and went to the gym.",
    "No evidence of fever.", "Body temperature was 38.5 today.", "HRV is low; heart problems since May.", "昨晚喝酒，今天头痛。", "Take the medicine twice.", "Nothing to report.", "If there is fever, rest.",
]
#: What the evidence of a conversation names, by a rule on its key.
NAMED = ["fever and cough since Monday", "训练 and gym", "nothing", "flu shot", "体温 37.2", "medication list"]


def _pick(said: list[str], number: F.Column) -> F.Column:
    return F.get(F.array(*map(F.lit, said)), (number % len(said)).cast("int"))


def guard_findings(spark, d):
    """Facts and diagnoses that turns assert and the evidence of their conversation does not name."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws(" ", _pick(SAID, F.col("conv_id") * 5 + F.col("turn")), "text").alias("text"))
    evidence = turns.select("conv_id", "turn", _pick(NAMED, F.col("conv_id")).alias("text"))
    return guards.unsupported(turns, evidence, ["conv_id", "turn"]).groupBy("kind", "group", "marker").agg(F.count("*").alias("n"), F.min("conv_id").alias("first"), F.max("turn").alias("last_turn"))


_FINE = {k: [] if k in REVIEW_LISTS else None for k in REVIEW_KEYS} | {"review_status": "APPROVED", "review_summary": "fine", "required_changes": ["rest"]}
#: Reviews of which all but the first two have an error, by a rule on the key of a turn.
REVIEWS = [
    json.dumps(x) for x in (
        _FINE, _FINE | {"review_status": "ESCALATE", "escalation_reason": "chest pain"}, {k: v for k, v in _FINE.items() if k != "unsafe_actions"}, _FINE | {"review_status": "MAYBE"},
        _FINE | {"medical_concerns": "one"}, _FINE | {"causality_concerns": [1, 2]}, _FINE | {"escalation_reason": 3}, _FINE | {"review_summary": None}, _FINE | {"review_status": "ESCALATE"}, ["no object"],
    )
] + ["{broken"]


def review_checks(spark, d):
    """What is wrong with the review of each turn."""
    return table(spark, d, "conversations").select("conv_id", "turn", F.array_join(guards.review_problems(_pick(REVIEWS, F.col("conv_id") * 3 + F.col("turn"))), ",").alias("problems"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (retire_cascade, dirty_cells, renewed_baselines, hash_tree, hash_tree_difference, session_days, guard_findings, review_checks)}


_KEYS = "metric, source_class, source_sid, offset_seconds"
_SERIES = "metric || '|' || source_class || '|' || source_sid || '|' || offset_seconds"
_BEFORE = "(day(local_date) <> 20 or source_sid <> '6') and not (metric = 'signup' and source_sid = '2')"
_NOW = "(day(local_date) <> 12 or metric <> 'click') and not (metric = 'view' and source_sid = '4')"
_SHIFT = "mean + case when day(local_date) = 15 and source_sid = '4' then 1.0 else 0.0 end"
_OBS = "mean as value from daily)"
assert _OBS in _BASE
_NOW_BASE = _BASE.replace(_OBS, f"{_SHIFT} as value from daily where {_NOW})")


def _hash_tree() -> str:
    row = """sha256('{"seq":' || seq || ',"logical":' || to_json(logical) || ',"payload":' || coalesce(payload::varchar, 'null') || '}')"""
    levels = 6  # enough for 256 * 16**6 places
    parts = []
    for x in range(levels):
        parts.append(f"""l{x + 1} as (select (node // 16)::bigint as node, sha256(string_agg(node || ':' || digest, ',' order by node)) as digest, sum(rows)::bigint as rows, count(*) as n
            from l{x} where (select count(*) from l{x}) > 1 group by node // 16)""")
    union = " union all ".join(f"select {x}::integer as level, node, digest, rows from l{x}" for x in range(levels + 1))
    return f"""with {_POINTS}, log as (select fact_id as seq, user_id || '|' || metric || '|' || ts::date as logical, k % 3 as payload from facts),
        r as (select (seq // 256)::bigint as node, {row} as row, count(*) as n from log group by all),
        p as (select node, substr(row, 1, 2) as part, sha256(string_agg(row || ':' || n, ',' order by row)) as digest, sum(n)::bigint as rows from r group by all),
        l0 as (select node, sha256(string_agg(part || ':' || digest, ',' order by part)) as digest, sum(rows)::bigint as rows, count(*) as n from p group by node), {", ".join(parts)}
        {union}"""


def evidence_full(spark, d):
    """Bundles of a source's days with all parts: deviations, persistence, trends, changes, relationships,
    recent deviations and provenance."""
    daily = stash(_values(spark, d).select(*SERIES, "local_date", "value"), "daily")
    devs = stash(analytics.deviations(daily, baseline.rolling_baselines(daily)), "deviations")
    subject, metric = F.col("source_sid").alias("subject"), F.col("metric")
    row = lambda df, kind, item, day, finding: df.select(subject, F.lit(kind).alias("kind"), item.alias("item"), F.col(day).alias("day"), F.col(finding).alias("finding"))
    related = analytics.relationships(daily, PAIRS, ["source_class", "source_sid", "offset_seconds"])
    said = [
        row(devs.where("window_days = 28"), "DEVIATION", metric, "local_date", "deviation_class"),
        row(analytics.persistence(devs, rolling=True), "PERSISTENCE", F.concat_ws("/", metric, F.col("window_days").cast("string")), "as_of", "persistence_class"),
        row(analytics.trends(daily, SERIES, rolling=True), "TREND", metric, "as_of", "trend_class"),
        row(analytics.change_points(daily, SERIES, rolling=True), "CHANGE_POINT", metric, "as_of", "change_class"),
        row(related.where("as_of is not null"), "RELATIONSHIP", F.concat_ws("/", "left_metric", "right_metric"), "as_of", "relationship_class"),
    ]
    days = devs.where("window_days = 28").select(subject, F.col("local_date").alias("day"), "metric", "deviation_class", "maturity", F.abs("robust_z").alias("distance"))
    made = evidence.full_bundles(reduce(DataFrame.unionByName, said), days, evidence.bundles(days, _contexts(spark, d), ["subject"]).drop("deviations", "bundle_hash"), ["subject"])
    text = lambda part: F.array_join(F.transform(part, lambda x: F.concat_ws(":", x["item"], x["day"].cast("string"), x["finding"])), ",").alias(part)
    return made.select(
        "subject", "day", *(text(p) for p in evidence.PARTS.values()), F.size("recent_deviations").cast("bigint").alias("recent"), F.array_join("recent_context", ",").alias("recent_context"),
        F.size("provenance").cast("bigint").alias("links"), F.sha2(F.array_join("provenance", ","), 256).alias("provenance_sha256"),
    )


def _text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(items: list[str]) -> str:
    return "[" + ", ".join(map(_text, items)) + "]"


def _guards() -> str:
    markers = ", ".join(f"({_text(k)}, {_text(g)}, {i}, {_text(m)}, {guards.is_word(m)})" for k, g, words in guards.GROUPS for i, m in enumerate(words))
    letter = r"'^[\p{L}\p{N}_]$'"
    return f"""with m(kind, grp, nth, marker, word) as (values {markers}),
        o as (select conv_id, turn, lower(({_list(SAID)})[(conv_id * 5 + turn) % {len(SAID)} + 1] || coalesce(' ' || text, '')) as t, ({_list(NAMED)})[conv_id % {len(NAMED)} + 1] as e from conversations),
        p as (select conv_id, turn, t, kind, grp, nth, marker, word, unnest(generate_series(1, length(t) - length(marker) + 1)) as p from o, m where contains(t, marker)
              and not exists (select 1 from m b where b.kind = m.kind and b.grp = m.grp and contains(lower(o.e), b.marker))),
        a as (select * from p where substr(t, p, length(marker)) = marker and (not word or (not (p > 1 and regexp_matches(substr(t, p - 1, 1), {letter}))
              and not regexp_matches(substr(t, p + length(marker), 1), {letter})))),
        f as (select * from a where not list_bool_or(list_transform({_list(HEDGES)}, lambda h: contains(substr(t, greatest(p - 50, 1), p + length(marker) + 50 - greatest(p - 50, 1)), h)))),
        s as (select conv_id, turn, kind, grp, arg_min(marker, nth) as marker from f group by all)
        select kind, grp as "group", marker, count(*) as n, min(conv_id) as first, max(turn) as last_turn from s group by all"""


def _reviews() -> str:
    path = lambda k: f"'$.{k}'"
    missing = [f"case when not list_contains(json_keys(r), '{k}') then 'missing_{k}' end" for k in REVIEW_KEYS]
    lists = [f"case when json_type(r, {path(k)}) is distinct from 'ARRAY' or list_bool_or(list_transform(json_extract(r, '$.{k}[*]'), lambda x: json_type(x) <> 'VARCHAR')) then 'not_texts_{k}' end" for k in REVIEW_LISTS]
    state = "coalesce(json_extract_string(r, '$.review_status'), '')"
    rules = [*missing, f"case when not list_contains({_list(REVIEW_STATES)}, {state}) then 'invalid_review_status' end", *lists,
             "case when coalesce(json_type(r, '$.escalation_reason'), 'NULL') not in ('VARCHAR', 'NULL') then 'escalation_reason_not_text' end",
             "case when json_type(r, '$.review_summary') is distinct from 'VARCHAR' then 'review_summary_not_text' end",
             f"case when {state} = 'ESCALATE' and coalesce(json_extract_string(r, '$.escalation_reason'), '') = '' then 'escalation_without_reason' end"]
    return f"""with c as (select conv_id, turn, ({_list(REVIEWS)})[(conv_id * 3 + turn) % {len(REVIEWS)} + 1] as r0 from conversations),
        v as (select conv_id, turn, json_valid(r0) as fine, case when json_valid(r0) then r0 else '{{}}' end as r from c)
        select conv_id, turn, case when not fine then 'not_an_object' when json_type(r) <> 'OBJECT' then 'not_an_object'
               else array_to_string(list_filter([{", ".join(rules)}], lambda x: x is not null), ',') end as problems from v"""


QUERIES["evidence_full"] = evidence_full


def _full() -> str:
    parts = {"DEVIATION": "deviations", "PERSISTENCE": "persistence", "TREND": "trends", "CHANGE_POINT": "changes", "RELATIONSHIP": "relationships"}
    listed = ", ".join(f"coalesce(string_agg(item || ':' || vday || ':' || finding, ',' order by item) filter (where kind = '{k}'), '') as {p}" for k, p in parts.items())
    return f"""with {_DEV}, {_ROLLING}, rel as ({ORACLES['relationship']}),
        said as (
            select source_sid as subject, 'DEVIATION' as kind, metric as item, local_date as vday, deviation_class as finding from devs where window_days = 28
            union all select source_sid, 'PERSISTENCE', metric || '/' || window_days, local_date, case when rn < 3 then 'INSUFFICIENT_OBSERVATIONS' when above >= 3 then 'PERSISTENT_ABOVE_TYPICAL'
                when below >= 3 then 'PERSISTENT_BELOW_TYPICAL' else 'NO_PERSISTENT_DEVIATION' end from pr2
            union all select o.source_sid, 'TREND', o.metric, o.t, case when rn < 3 then 'INSUFFICIENT_OBSERVATIONS' when slope > 0 and rho >= 0.5 then 'RISING' when slope < 0 and rho <= -0.5 then 'FALLING' else 'STABLE' end
                from ord o left join tsl a on a.metric = o.metric and a.source_sid = o.source_sid and a.t = o.t left join rhos b on b.metric = o.metric and b.source_sid = o.source_sid and b.t = o.t
            union all select o.source_sid, 'CHANGE_POINT', o.metric, o.t, case when rn < 10 then 'INSUFFICIENT_EVIDENCE' when s.shift >= 3 then 'CHANGE_DETECTED' else 'NO_CHANGE' end
                from ord o left join (select r.metric, r.source_sid, r.t, max(case when spread = 0 then case when a.m = b.m then 0.0 else 1e308 end else abs(b.m - a.m) / spread end) as shift
                    from cres r join cmed a on r.metric = a.metric and r.source_sid = a.source_sid and r.t = a.t and r.k = a.k and not a.later
                    join cmed b on r.metric = b.metric and r.source_sid = b.source_sid and r.t = b.t and r.k = b.k and b.later group by all) s on s.metric = o.metric and s.source_sid = o.source_sid and s.t = o.t
            union all select source_sid, 'RELATIONSHIP', left_metric || '/' || right_metric, as_of, relationship_class from rel where as_of is not null),
        asks as (select distinct subject, vday as day from said where kind = 'DEVIATION'),
        carried as (select a.subject, a.day, kind, item, max(vday) as vday, arg_max(finding, vday) as finding from asks a join said s on s.subject = a.subject and s.vday <= a.day group by all),
        kept as (select * from carried where kind <> 'DEVIATION' or day - vday <= 7),
        names as (select subject, day, unnest(case when kind = 'DEVIATION' then [kind || '|' || item || '|' || vday, 'FEATURE|' || item || '|' || vday, 'BASELINE|' || item || '|' || vday]
            else [kind || '|' || item || '|' || vday] end) as name from kept),
        prov as (select subject, day, count(*) as links, sha256(string_agg(name, ',' order by name)) as provenance_sha256 from names group by all),
        recent as (select a.subject, a.day, count(*) as recent from asks a join said s on s.subject = a.subject and s.kind = 'DEVIATION' and s.vday between a.day - 7 and a.day group by all),
        ctx as (select subject, day, recent_context from ({ORACLES['evidence_bundle']}))
        select k.subject, k.day, {listed}, r.recent, c.recent_context, p.links, p.provenance_sha256
        from kept k join prov p on p.subject = k.subject and p.day = k.day join recent r on r.subject = k.subject and r.day = k.day left join ctx c on c.subject = k.subject and c.day = k.day
        group by k.subject, k.day, r.recent, c.recent_context, p.links, p.provenance_sha256"""


SQL: dict[str, str] = {
    "retire_cascade": f"""with recursive {_DEV}, links as (
            select 'SOURCE' as pl, source_sid as pid, 'FACT' as layer, fact_id::varchar as id from facts
            union select 'FACT', fact_id::varchar, 'FEATURE', {_SERIES} || '|' || local_date from facts where value is not null
            union select 'FEATURE', {_SERIES} || '|' || local_date, 'BASELINE', {_SERIES} || '|' || window_days || '|' || as_of from hits where value is not null
            union select 'FEATURE', {_SERIES} || '|' || local_date, 'DEVIATION', {_SERIES} || '|' || window_days || '|' || local_date from devs
            union select 'BASELINE', {_SERIES} || '|' || window_days || '|' || local_date, 'DEVIATION', {_SERIES} || '|' || window_days || '|' || local_date from devs
            union select 'DEVIATION', {_SERIES} || '|' || window_days || '|' || local_date, 'BUNDLE', source_sid || '|' || local_date from devs where window_days = 28),
        reached as (select 'SOURCE' as layer, '{RETIRED}' as id, 0 as step
            union select l.layer, l.id, r.step + 1 from reached r join links l on l.pl = r.layer and l.pid = r.id)
        select layer, id, min(step)::integer as step from reached group by all""",
    "dirty_cells": f"""with {_BASE.split(', obs as')[0]},
        b as (select {_KEYS}, local_date, mean as value from daily where {_BEFORE}), n as (select {_KEYS}, local_date, {_SHIFT} as value from daily where {_NOW}),
        bs as (select min(local_date) + 1 as f, max(local_date) + 1 as t from b), ns as (select min(local_date) + 1 as f, max(local_date) + 1 as t from n),
        ser as (select {_KEYS}, bool_or(old) as known, bool_or(not old) as present from (select {_KEYS}, true as old from b union all select {_KEYS}, false from n) group by all),
        ch as (select coalesce(n.metric, b.metric) as metric, coalesce(n.source_sid, b.source_sid) as source_sid, coalesce(n.local_date, b.local_date) as day
               from b full join n on b.metric = n.metric and b.source_sid = n.source_sid and b.local_date = n.local_date where b.value is distinct from n.value),
        cells as (select s.*, w.w as window_days, x.x::date as as_of from ser s, (values (7), (28), (90)) w(w), ns, unnest(generate_series(ns.f::timestamp, ns.t::timestamp, interval 1 day)) x(x) where present),
        hit as (select distinct c.{_KEYS.replace(', ', ', c.')}, c.window_days, c.as_of from cells c cross join bs left join ch on ch.metric = c.metric and ch.source_sid = c.source_sid and c.as_of between ch.day + 1 and ch.day + c.window_days
                where ch.day is not null or not c.known or c.as_of < bs.f or c.as_of > bs.t),
        isl as (select *, as_of - row_number() over (partition by {_KEYS}, window_days order by as_of)::integer as g from hit)
        select {_KEYS}, window_days, min(as_of) as from_date, max(as_of) as to_date from isl group by {_KEYS}, window_days, g""",
    "evidence_full": _full(),
    "guard_findings": _guards(),
    "review_checks": _reviews(),
    "renewed_baselines": f"with {_NOW_BASE} select * from baselines",
    "hash_tree": _hash_tree(),
    "hash_tree_difference": f"""with {_POINTS}, log as (select fact_id as seq, user_id || '|' || metric || '|' || ts::date as logical, k % 3 as payload from facts)
        select seq, logical, payload, 'only_first' as side, 1::bigint as n from log where seq % 1999 = 7 or (seq % 997 = 3 and payload is not null)
        union all select seq, logical, payload + 1, 'only_second', 1 from log where seq % 1999 <> 7 and seq % 997 = 3 and payload is not null""",
    "session_days": """with t as (select user_id, ts::date as day, min(struct_pack(ts := ts, id := event_id)) as first, bool_or(event_type = 'view') as slept from events group by all),
        o as (select user_id, day, first.id as first_id, case when lag(day) over w is null or slept or hour(first.ts) >= 12 then 1 else 0 end as opens from t window w as (partition by user_id order by day))
        select user_id, day, (sum(opens) over (partition by user_id order by day))::bigint as session, first_id from o""",
}
