"""DuckDB SQL that says what the registered queries return."""

from __future__ import annotations

from ..params import BODY_PARTS, PAST_KEYWORDS, SCOPE_WORDS
from .queries import CONTEXTS, METRICS, WORDS

# Blocks of common table expressions.
_POINTS = """facts as (
    select event_id as fact_id, user_id, event_type as metric, ts, (ts + interval 28800 second)::date as local_date, value,
           try_cast(json_extract_string(props, '$.k') as bigint) as k,
           case when user_id % 2 = 1 then 'hlth.gen_' else '' end || (user_id % 8)::varchar as source_sid,
           case when user_id % 2 = 1 then 'GENERATED_SOURCE' else 'NUMERIC_SOURCE' end as source_class, 28800::integer as offset_seconds
    from events)"""
_DAILY = f"""{_POINTS}, daily as (
    select metric, source_class, source_sid, offset_seconds, local_date, count(value)::bigint as n, round(avg(value), 6) as mean,
           round(quantile_cont(value, 0.5), 6) as median, min(value) as low, max(value) as high
    from facts where value is not null group by all)"""
_BASE = f"""{_DAILY}, obs as (select metric, source_class, source_sid, offset_seconds, local_date, mean as value from daily),
    ends as (select min(local_date) as a, max(local_date) as b from obs),
    series as (select distinct metric, source_class, source_sid, offset_seconds from obs),
    spine as (select s.*, unnest(generate_series(a::timestamp + interval 1 day, b::timestamp + interval 1 day, interval 1 day))::date as as_of from series s, ends),
    wins as (select * from (values (7, 3, 5, 5, 0.60), (28, 3, 14, 14, 0.50), (90, 3, 30, 30, 0.33)) t(window_days, least, obs_n, span_n, cov_n)),
    hits as (
        select s.*, w.window_days, w.least, w.obs_n, w.span_n, w.cov_n, o.local_date, o.value from spine s cross join wins w left join obs o
        on o.metric = s.metric and o.source_sid = s.source_sid and o.source_class = s.source_class and o.local_date >= s.as_of - w.window_days and o.local_date < s.as_of),
    stat as (
        select metric, source_class, source_sid, offset_seconds, window_days, as_of, least, obs_n, span_n, cov_n, count(value)::bigint as n,
               count(distinct local_date)::bigint as distinct_dates, (max(local_date) - min(local_date) + 1)::bigint as span_days,
               avg(value) as mean, round(quantile_cont(value, 0.5), 12) as median, quantile_cont(value, 0.1) as q10, quantile_cont(value, 0.25) as q25,
               quantile_cont(value, 0.5) as q50, quantile_cont(value, 0.75) as q75, quantile_cont(value, 0.9) as q90
        from hits group by all),
    mads as (
        select h.metric, h.source_sid, h.window_days, h.as_of, quantile_cont(abs(h.value - s.median), 0.5) as mad
        from hits h join stat s on h.metric = s.metric and h.source_sid = s.source_sid and h.window_days = s.window_days and h.as_of = s.as_of
        where h.value is not null group by all),
    graded as (
        select s.*, m.mad, case when n < least then 'INSUFFICIENT_HISTORY' when n >= obs_n and span_days >= span_n and distinct_dates / s.window_days::double >= cov_n
               then 'ESTABLISHED' else 'PROVISIONAL' end as maturity
        from stat s left join mads m on m.metric = s.metric and m.source_sid = s.source_sid and m.window_days = s.window_days and m.as_of = s.as_of),
    baselines as (
        select metric, source_class, source_sid, offset_seconds, window_days, as_of, n, distinct_dates, span_days, round(distinct_dates / window_days::double, 6) as coverage,
               case when n >= least then round(mean, 9) end as mean, case when n >= least then round(median, 9) end as median, case when n >= least then round(mad, 9) end as mad,
               case when n >= least then round(q10, 9) end as q10, case when n >= least then round(q25, 9) end as q25, case when n >= least then round(q50, 9) end as q50,
               case when n >= least then round(q75, 9) end as q75, case when n >= least then round(q90, 9) end as q90, maturity
        from graded)"""
_DEV = f"""{_BASE}, dev0 as (
        select o.metric, o.source_class, o.source_sid, o.offset_seconds, o.local_date, b.window_days, o.value, b.maturity, b.median, b.mad, b.q10, b.q25, b.q50, b.q75, b.q90,
               round(o.value - b.median, 9) as dist, b.maturity <> 'INSUFFICIENT_HISTORY' as known
        from obs o join baselines b on b.metric = o.metric and b.source_sid = o.source_sid and b.as_of = o.local_date),
    devs as (
        select metric, source_class, source_sid, offset_seconds, local_date, window_days, value, maturity, case when known then dist end as absolute,
               case when known and median <> 0 then round(dist / median, 9) end as relative, case when known and mad <> 0 then round(dist / mad, 9) end as robust_z,
               case when known and mad is null then 'MAD_MISSING' when known and mad = 0 then 'MAD_ZERO' end as z_reason,
               case when not known then null when value < q10 then 'BELOW_Q10' when value < q25 then 'Q10_Q25' when value < q50 then 'Q25_Q50' when value < q75 then 'Q50_Q75'
                    when value < q90 then 'Q75_Q90' else 'ABOVE_Q90' end as quantile_band,
               case when not known then null when abs(value - median) <= 1e-9 then 'WITHIN' when value > median then 'ABOVE' else 'BELOW' end as side,
               case when not known then 'INSUFFICIENT_BASELINE' when value > q90 then 'ABOVE_TYPICAL_RANGE' when value < q10 then 'BELOW_TYPICAL_RANGE' else 'WITHIN_TYPICAL_RANGE' end as deviation_class,
               case when not known then 'INSUFFICIENT_BASELINE' when maturity = 'ESTABLISHED' then 'SUFFICIENT' else 'PROVISIONAL' end as evidence
        from dev0)"""
_METRIC_CASE = "case metric " + " ".join(f"when '{k}' then '{v}'" for k, v in METRICS.items()) + " end"
_CONTEXT_CASE = "case k % 5 " + " ".join(f"when {i} then '{c}'" for i, c in enumerate(CONTEXTS)) + " end"
_CTX = f"ctx as (select source_sid as subject, local_date as day, list_sort(list_distinct(list({_CONTEXT_CASE}))) as contexts from facts where metric = 'signup' group by all)"
# The average ranks and their correlation, for rows (keys, x, y).
def _spearman(source: str, keys: str) -> str:
    return f"""ranked as (
        select {keys}, rank() over (partition by {keys} order by x) + (count(*) over (partition by {keys}, x) - 1) / 2.0::double as rx,
               rank() over (partition by {keys} order by y) + (count(*) over (partition by {keys}, y) - 1) / 2.0::double as ry from {source}),
    centred as (select {keys}, rx - avg(rx) over (partition by {keys}) as dx, ry - avg(ry) over (partition by {keys}) as dy from ranked),
    rhos as (
        select {keys}, case when sum(dx * dx) > 0 and sum(dy * dy) > 0 then round(sum(dx * dy) / (sqrt(sum(dx * dx)) * sqrt(sum(dy * dy))), 6) else 0.0 end as rho
        from centred group by all)"""


_ON = "{0}.metric = {1}.metric and {0}.source_sid = {1}.source_sid and {0}.t = {1}.t"
# Persistence, trends and change points as of each day of a series.
_ROLLING = f"""ord as (select metric, source_sid, local_date as t, value, row_number() over (partition by metric, source_sid order by local_date) as rn from obs),
    pr as (select metric, source_sid, window_days, local_date, deviation_class, row_number() over (partition by metric, source_sid, window_days order by local_date) as rn from devs),
    pr2 as (
        select *, rn - coalesce(max(case when deviation_class <> 'ABOVE_TYPICAL_RANGE' then rn end) over w, 0) as above,
               rn - coalesce(max(case when deviation_class <> 'BELOW_TYPICAL_RANGE' then rn end) over w, 0) as below
        from pr window w as (partition by metric, source_sid, window_days order by local_date rows between unbounded preceding and current row)),
    pers as (select source_sid as subject, local_date as day, bool_or(above >= 3) as high, bool_or(below >= 3) as low from pr2 group by all),
    tp as (
        select t.metric, t.source_sid, t.t, (o.t - date '1970-01-01')::double as x, o.value as y from ord t
        join ord o on o.metric = t.metric and o.source_sid = t.source_sid and o.rn between t.rn - 13 and t.rn),
    tsl as (select a.metric, a.source_sid, a.t, round(coalesce(quantile_cont((b.y - a.y) / (b.x - a.x), 0.5), 0), 6) as slope, count(*) as pairs
        from tp a join tp b on {_ON.format('a', 'b')} and a.x < b.x group by all),
    {_spearman('tp', 'metric, source_sid, t')},
    trend as (select a.source_sid as subject, a.t as day, bool_or(pairs >= 3 and ((slope > 0 and rho >= 0.5) or (slope < 0 and rho <= -0.5))) as trending
        from tsl a join rhos b on {_ON.format('a', 'b')} group by all),
    cp as (
        select t.metric, t.source_sid, t.t, o.value as v, o.rn - t.rn + 10 as i from ord t
        join ord o on o.metric = t.metric and o.source_sid = t.source_sid and o.rn between t.rn - 9 and t.rn where t.rn >= 10),
    cseg as (select metric, source_sid, t, k, i > k as later, v from cp, (values (4), (5), (6)) x(k)),
    cmed as (select metric, source_sid, t, k, later, quantile_cont(v, 0.5) as m from cseg group by all),
    cres as (select a.metric, a.source_sid, a.t, a.k, quantile_cont(abs(a.v - b.m), 0.5) as spread from cseg a join cmed b on {_ON.format('a', 'b')} and a.k = b.k and a.later = b.later group by all),
    csh as (select r.source_sid, r.t, case when spread = 0 then case when a.m = b.m then 0.0 else 1e308 end else abs(b.m - a.m) / spread end as shift
        from cres r join cmed a on {_ON.format('r', 'a')} and r.k = a.k and not a.later join cmed b on {_ON.format('r', 'b')} and r.k = b.k and b.later),
    chg as (select source_sid as subject, t as day, bool_or(shift >= 3) as changed from csh group by all)"""
_DAYS = f"""{_DEV}, {_CTX}, {_ROLLING}, sig as (
        select source_sid as subject, local_date as day,
               list(distinct {_METRIC_CASE} || case deviation_class when 'ABOVE_TYPICAL_RANGE' then '_UP' else '_DOWN' end)
                   filter (where deviation_class in ('ABOVE_TYPICAL_RANGE', 'BELOW_TYPICAL_RANGE')) as raw,
               count(*) filter (where deviation_class = 'ABOVE_TYPICAL_RANGE') as above, count(*) filter (where deviation_class = 'BELOW_TYPICAL_RANGE') as below,
               count(*) filter (where deviation_class <> 'INSUFFICIENT_BASELINE') as known, count(*) as deviations
        from devs where window_days = 28 group by all),
    joined as (
        select s.subject, s.day, list_sort(list_concat(list_concat(coalesce(raw, []), case when high then ['PERSISTENT_HIGH'] else [] end), case when low then ['PERSISTENT_LOW'] else [] end)) as signals,
               above, below, known, deviations, coalesce(c.contexts, []) as contexts, coalesce(high or low, false) as persistent, coalesce(changed, false) as changed, coalesce(trending, false) as trending
        from sig s left join ctx c on c.subject = s.subject and c.day = s.day left join pers p on p.subject = s.subject and p.day = s.day
        left join chg g on g.subject = s.subject and g.day = s.day left join trend t on t.subject = s.subject and t.day = s.day),
    stated as (
        select *, case when known = 0 then 'INSUFFICIENT_EVIDENCE' when persistent or changed or above >= 2 or below >= 2 then 'NOTABLE_CHANGE' when above > 0 or below > 0 or trending then 'MILD_CHANGE' else 'STABLE' end as overall_state,
               list_contains(signals, 'resting_heart_rate_UP') or list_contains(signals, 'heart_rate_UP') as heart, list_contains(signals, 'stress_score_UP') as stress,
               len(list_filter(signals, lambda x: contains(x, 'UP'))) as ups, list_contains(contexts, 'LATE_SLEEP') as late_sleep, list_contains(contexts, 'STRESS') as stressed
        from joined),
    hyp as (
        select *, list_filter([
            case when heart and list_contains(contexts, 'HIGH_INTENSITY_TRAINING') then {{'t': 'RECOVERY_STRAIN', 'n': ups + 1}} end,
            case when list_contains(signals, 'sleep_DOWN') then {{'t': 'SLEEP_DEFICIT', 'n': 1 + late_sleep::bigint}}
                 when late_sleep and (stress or heart or list_contains(contexts, 'FATIGUE')) then {{'t': 'SLEEP_DEFICIT', 'n': 1 + greatest(ups, 1)}} end,
            case when stress and (stressed or heart) then {{'t': 'STRESS_RESPONSE', 'n': 1 + stressed::bigint + heart::bigint}} end,
            case when list_contains(contexts, 'FEVER') then {{'t': 'ACUTE_ILLNESS_SUSPECTED', 'n': 1 + heart::bigint}} end], lambda x: x is not null) as found
        from stated),
    days as (
        select *, case when len(found) > 0 then list_transform(found, lambda x: x.t) when overall_state = 'STABLE' then ['NO_SIGNIFICANT_FINDING'] else ['UNKNOWN'] end as hypotheses,
               case when len(found) > 0 then found[1].n else 1 end as support,
               case when overall_state = 'INSUFFICIENT_EVIDENCE' and len(contexts) = 0 and support < 2 then 'VERY_LOW' when support >= 3 then 'HIGH' when support >= 2 then 'MODERATE' else 'LOW' end as confidence,
               list_contains(contexts, 'FEVER') as symptom
        from hyp)"""
_LOG = """log as (
    select event_id as seq, user_id::varchar || '|' || event_type || '|' || ts::date::varchar as logical, try_cast(json_extract_string(props, '$.k') as bigint) % 3 as payload,
           ts, event_type as metric, user_id, ts::date as day from events)"""
_CLASS = f"""{_LOG}, classified as (
    select *, case when row_number() over (partition by logical order by seq) = 1 then 'NEW'
                   when row_number() over (partition by logical, payload order by seq) = 1 then 'REVISION' else 'REOBSERVATION' end as classification from log)"""
_VERSIONS = f"""{_CLASS}, versions as (
    select logical, payload, min(seq) as first_seq, max(seq) as last_seq, count(*) as observations from classified group by all)"""
_STATES = f"""{_DAILY}, d as (
        select metric || '|' || source_sid || '|' || local_date::varchar as id, metric, source_sid, local_date, n, mean, day(local_date) as dom from daily),
    was as (select id, local_date, n::varchar || ':' || mean::varchar as sig from d where dom <> 20),
    now_ as (select id, local_date, (n + case when dom = 15 and source_sid = '4' then 1 else 0 end)::varchar || ':' || mean::varchar as sig from d where dom <> 12 or metric <> 'click'),
    acts as (
        select coalesce(w.id, n.id) as id, case when w.id is null then 'INSERT' when n.id is null then 'STALE' when w.sig = n.sig then 'KEEP' else 'REPLACE' end as action,
               w.local_date as d_was, n.local_date as d_is from was w full outer join now_ n on w.id = n.id),
    dirty as (select distinct unnest([d_was, d_is]) as local_date from acts where action <> 'KEEP')"""
_ASSESS = """f as (
        select event_id as fact_id, case when event_id % 3 = 0 then 'INTERVAL' else 'POINT' end as kind, event_type <> 'signup' as linked,
               event_id % 3 <> 0 or event_id % 6 = 0 as timed, event_id % 2 = 0 as vendor from events),
    a as (
        select fact_id, 'STRUCTURE' as "check", case when timed then 'PASS' else 'FLAGGED' end as result from f
        union all select fact_id, 'PROVENANCE', case when linked then 'PASS' else 'FLAGGED' end from f
        union all select fact_id, 'SEMANTICS', case when vendor then 'UNKNOWN' else 'PASS' end from f)"""
_JUDGED = f"""{_DAYS}, judged as (
        select 1 as id, subject, day, overall_state, hypotheses[1] as "primary", case when day(day) % 3 = 0 then 'STALE' else 'CURRENT' end as status from days
        union all select 2, subject, day, 'STABLE', hypotheses[1], case when day(day) % 2 = 0 then 'CURRENT' else 'STALE' end from days where day(day) % 3 = 0),
    canon as (
        select * from (select *, row_number() over (partition by subject, day order by (status = 'CURRENT') desc, case when status = 'CURRENT' then -id else id end) as rn from judged) where rn = 1),
    notable as (
        select *, (select max(day) from canon c2 where c2.subject = canon.subject) as last_day from canon where overall_state in ('MILD_CHANGE', 'NOTABLE_CHANGE')),
    marked as (
        select *, case when lag("primary") over w = "primary" and day - lag(day) over w <= 2 then 0 else 1 end as fresh from notable window w as (partition by subject order by day)),
    runs as (select *, sum(fresh) over (partition by subject order by day) as run from marked),
    eps as (
        select subject, "primary", min(day) as start_day, max(day) as end_day, count(*) as days, case when max(day) = max(last_day) then 'DEVELOPING' else 'CLOSED' end as phase,
               "primary" || ':' || min(day)::varchar as episode_key from runs group by subject, run, "primary")"""


_BUNDLE = f"""{_DEV}, {_CTX}, ev as (
        select source_sid as subject, local_date as day, {_METRIC_CASE} as metric, deviation_class, maturity, abs(robust_z) as distance from devs where window_days = 28),
    b as (
        select subject, day, count(*) as deviations, count(*) filter (where maturity = 'ESTABLISHED') as established, count(*) filter (where maturity = 'PROVISIONAL') as provisional,
               count(*) filter (where maturity = 'INSUFFICIENT_HISTORY') as insufficient_history, string_agg(metric || deviation_class, ',' order by metric, deviation_class) as content from ev group by all),
    each as (select b.subject, b.day, c.day as c_day, unnest(c.contexts) as context, generate_subscripts(c.contexts, 1) as i from b join ctx c on c.subject = b.subject and c.day <= b.day),
    late as (select *, row_number() over (partition by subject, day order by c_day desc, i desc) as rn from each),
    rec as (select subject, day, string_agg(distinct context, ',' order by context) as recent_context from late where rn <= 20 group by all),
    bundle as (
        select b.*, coalesce(recent_context, '') as recent_context,
               array_to_string(list_filter([case when insufficient_history > 0 then 'baseline_history' end, case when recent_context is null then 'recent_context' end], lambda x: x is not null), ',') as missing
        from b left join rec on rec.subject = b.subject and rec.day = b.day)"""


def _any(text: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains(lower({text}), '{w.lower()}')" for w in words) + ")"


_PART = "case " + " ".join(f"when contains(lower(text), '{k}') then '{v}'" for k, v in BODY_PARTS.items()) + " end"


ORACLES: dict[str, str] = {
    "point_daily_stats": f"with {_DAILY} select * from daily",
    "feature_rows": f"""with {_DAILY}, l as (
        select metric, 'n' as s, n::double as v from daily union all select metric, 'mean', mean from daily union all select metric, 'median', median from daily
        union all select metric, 'low', low from daily union all select metric, 'high', high from daily)
        select metric || '.daily.' || s as feature, metric as base_metric, count(*) as n, round(sum(v), 4) as total from l group by all""",
    "bucket_daily_sum": f"""with {_POINTS} select metric, source_class, source_sid, offset_seconds, local_date, round(sum(value), 6) as total, count(*) as buckets
        from facts where metric in ('purchase', 'click') group by all""",
    "daily_passthrough": "select o_orderpriority as series, o_orderdate::date as local_date, round(avg(o_totalprice), 6) as value from orders group by all",
    "local_date_rules": """select event_id, case event_id % 4 when 0 then (ts + interval 28800 second)::date when 1 then (ts - interval 18000 second)::date
        when 2 then (ts + interval 9 hour)::date else ts::date end as local_date from events""",
    "source_classes": f"with {_POINTS} select source_sid, source_class, count(*) as n from facts group by all",
    "json_normalise": """with r as (
        select event_id, try_cast(json_extract_string(props, '$.k') as double) as k from events)
        select case when event_id % 50 = 0 then 'NOT_A_NUMBER' when event_id % 51 = 0 then 'MISSING_FIELD' when event_id % 53 = 0 then 'TIME_MISMATCH' end as issue,
               count(*) as n, round(sum(case when event_id % 50 <> 0 and event_id % 51 <> 0 then k end), 3) as total from r group by all""",
    "bucket_invariant": "select l_orderkey, l_linenumber from lineitem where l_orderkey % 97 = 0",
    "interval_segments": """with s as (
        select case l_returnflag when 'A' then 'AWAKE' when 'N' then 'SLEEP' end as stage, l_quantity::bigint - case when l_orderkey % 40 = 0 then 60 else 1 end as seconds from lineitem)
        select stage, case when seconds < 0 then 'NEGATIVE_INTERVAL' when stage is null then 'UNKNOWN_STATE' end as issue, count(*) as n, sum(seconds)::bigint as seconds from s group by all""",
    "episode_segments": """select o_orderkey as episode_id, o_orderstatus as source_sid, o_orderdate::date as local_date, count(l_linenumber) as segments,
        coalesce(sum(l_quantity::bigint), 0)::bigint as seconds, coalesce(sum(l_quantity::bigint) filter (where l_returnflag = 'A'), 0)::bigint as awake_seconds,
        coalesce(sum(l_quantity::bigint) filter (where l_returnflag <> 'A'), 0)::bigint as asleep_seconds
        from orders left join lineitem on o_orderkey = l_orderkey group by all""",
    "stage_share": """with p as (select l_orderkey as episode_id, l_returnflag as stage, sum(l_quantity::bigint)::bigint as seconds from lineitem group by all),
        t as (select *, sum(seconds) over (partition by episode_id) as total from p)
        select episode_id, stage, seconds, round(seconds / total::double, 6) as share from t where total > 0""",
    "series_catalog": f"""with {_DAILY} select metric, source_class, source_sid, offset_seconds, count(*) as observations, min(local_date) as first_date, max(local_date) as last_date,
        case when count(distinct n > 1) > 1 then 'MIXED' when min(n) > 1 then 'COMPLETE' else 'OBSERVED_ONLY' end as coverage_status from daily group by all""",
    "fact_union": f"""with {_POINTS} select 'POINT' as kind, local_date, count(*) as n, count(value) as valued from facts group by all
        union all select 'INTERVAL', o_orderdate::date, count(*), 0 from orders group by all""",
    "baseline_rolling": f"with {_BASE} select * from baselines",
    "maturity_summary": f"with {_BASE} select window_days, maturity, count(*) as n from baselines group by all",
    "deviation": f"with {_DEV} select * from devs",
    "persistence": f"""with {_DEV}, b as (
        select *, row_number() over (partition by metric, source_sid, window_days order by local_date desc) as back from devs),
        r as (select metric, source_class, source_sid, offset_seconds, window_days, max(local_date) as as_of, count(*) as n,
            coalesce(min(back) filter (where deviation_class <> 'ABOVE_TYPICAL_RANGE') - 1, count(*)) as above,
            coalesce(min(back) filter (where deviation_class <> 'BELOW_TYPICAL_RANGE') - 1, count(*)) as below,
            bool_or(maturity = 'INSUFFICIENT_HISTORY') as no_base, bool_or(maturity = 'PROVISIONAL') as weak_base from b group by all)
        select metric, source_class, source_sid, offset_seconds, window_days, as_of, n, above, below,
            case when n < 3 then 'INSUFFICIENT_OBSERVATIONS' when above >= 3 then 'PERSISTENT_ABOVE_TYPICAL' when below >= 3 then 'PERSISTENT_BELOW_TYPICAL' else 'NO_PERSISTENT_DEVIATION' end as persistence_class,
            case when n < 3 then 'INSUFFICIENT_OBSERVATIONS' when no_base then 'INSUFFICIENT_BASELINE' when weak_base then 'PROVISIONAL' else 'SUFFICIENT' end as evidence from r""",
    "trend_theil_sen": f"""with o as (select o_orderpriority as series, o_orderdate::date as d, round(avg(o_totalprice), 6) as y from orders group by all),
        p as (select series, (d - date '1970-01-01')::double as x, y from (select *, row_number() over (partition by series order by d desc) as rn from o) where rn <= 14),
        sl as (select a.series, round(coalesce(quantile_cont((b.y - a.y) / (b.x - a.x), 0.5), 0), 6) as slope from p a join p b on a.series = b.series and a.x < b.x group by all),
        {_spearman('p', 'series')}, c as (select series, count(*) as n from p group by all)
        select c.series, c.n, slope, rho, case when slope > 0 and rho >= 0.5 then 'RISING' when slope < 0 and rho <= -0.5 then 'FALLING' else 'STABLE' end as trend_class, 'SUFFICIENT' as evidence
        from c join sl on sl.series = c.series join rhos on rhos.series = c.series where c.n >= 3""",
    "change_point": f"""with {_DAILY}, o as (
            select metric, source_class, source_sid, offset_seconds, local_date, mean as v, row_number() over (partition by metric, source_sid order by local_date desc) as back,
                   count(*) over (partition by metric, source_sid) as total from daily),
        p as (select *, row_number() over (partition by metric, source_sid order by local_date) as i from o where back <= 10),
        k as (select * from (values (4), (5), (6)) t(k)),
        seg as (select metric, source_sid, k, i > k as later, v, i, local_date from p, k where total >= 10),
        med as (select metric, source_sid, k, later, quantile_cont(v, 0.5) as m from seg group by all),
        res as (select s.metric, s.source_sid, s.k, quantile_cont(abs(s.v - m.m), 0.5) as spread from seg s join med m on m.metric = s.metric and m.source_sid = s.source_sid and m.k = s.k and m.later = s.later group by all),
        sh as (select r.metric, r.source_sid, r.k, case when spread = 0 then case when a.m = b.m then 0.0 else 1e308 end else abs(b.m - a.m) / spread end as shift
            from res r join med a on a.metric = r.metric and a.source_sid = r.source_sid and a.k = r.k and not a.later
            join med b on b.metric = r.metric and b.source_sid = r.source_sid and b.k = r.k and b.later),
        best as (select *, row_number() over (partition by metric, source_sid order by shift desc, k) as rn from sh),
        s as (select metric, source_class, source_sid, offset_seconds, count(*) as n from p group by all)
        select s.metric, s.source_class, s.source_sid, s.offset_seconds, s.n, case when shift >= 3 then p.local_date end as split_date,
            case when shift not in (0.0, 1e308) then round(shift, 6) end as magnitude,
            case when s.n < 10 then 'INSUFFICIENT_EVIDENCE' when shift >= 3 then 'CHANGE_DETECTED' else 'NO_CHANGE' end as change_class,
            case when s.n < 10 then 'INSUFFICIENT_EVIDENCE' else 'SUFFICIENT' end as evidence
        from s left join best b on b.metric = s.metric and b.source_sid = s.source_sid and b.rn = 1
        left join p on p.metric = s.metric and p.source_sid = s.source_sid and p.i = b.k + 1""",
    "relationship": f"""with {_DAILY}, pr as (select * from (values ('click', 'view'), ('click', 'purchase'), ('error', 'view'), ('purchase', 'signup'), ('signup', 'view')) t(l, r)),
        has as (select distinct metric, source_class, source_sid, offset_seconds from daily),
        both_ as (select l as left_metric, r as right_metric, a.source_class, a.source_sid, a.offset_seconds from pr join has a on a.metric = l join has b on b.metric = r and b.source_sid = a.source_sid),
        xy as (select l as left_metric, r as right_metric, a.source_sid, a.local_date, a.mean as x, b.mean as y from pr join daily a on a.metric = l
            join daily b on b.metric = r and b.source_sid = a.source_sid and b.local_date = a.local_date),
        {_spearman('xy', 'left_metric, right_metric, source_sid')},
        c as (select left_metric, right_metric, source_sid, count(*) as n, max(local_date) as as_of from xy group by all)
        select t.*, c.as_of, coalesce(c.n, 0) as n, case when c.n >= 5 then rho end as rho, case when coalesce(c.n, 0) < 5 then 'INSUFFICIENT_PAIRED_DATA' when rho >= 0.7 then 'POSITIVE_ASSOCIATION'
            when rho <= -0.7 then 'NEGATIVE_ASSOCIATION' else 'NO_ASSOCIATION' end as relationship_class
        from both_ t left join c on c.left_metric = t.left_metric and c.right_metric = t.right_metric and c.source_sid = t.source_sid
        left join rhos q on q.left_metric = t.left_metric and q.right_metric = t.right_metric and q.source_sid = t.source_sid""",
    "observation_classify": f"with {_CLASS} select seq, classification from classified",
    "record_versions": f"with {_VERSIONS} select * from versions",
    "latest_version": f"with {_VERSIONS} select logical, arg_max(payload, first_seq) as payload, max(first_seq) as first_seq, count(*) as versions from versions group by all",
    "late_arrival": f"""with {_CLASS}, c as (select *, (seq % 4)::integer as capture from classified),
        s as (select metric, capture, min(ts) as a, max(ts) as b from c group by all)
        select metric, capture, count(*) as n, count(*) filter (where classification = 'NEW'
            and exists (select 1 from s where s.metric = c.metric and s.capture < c.capture and c.ts >= s.a and c.ts <= s.b)) as late from c group by all""",
    "capture_compare": f"""with {_LOG}, x as (select min(day) as d, max(day) - min(day) as span from log),
        a as (select metric, logical, arg_max(payload, seq) as p from log, x where day - d <= span * 2 // 3 group by all),
        b as (select metric, logical, arg_max(payload, seq) as p from log, x where day - d >= span // 3 group by all)
        select coalesce(a.metric, b.metric) as metric, count(*) filter (where a.logical is not null and b.logical is not null) as shared,
            count(*) filter (where a.p = b.p) as unchanged, count(*) filter (where a.p <> b.p) as revised, count(*) filter (where a.logical is null) as new,
            count(*) filter (where b.logical is null) as missing from a full outer join b on a.metric = b.metric and a.logical = b.logical group by all""",
    "overlap_audit": f"""with {_LOG}, s as (
            select user_id::varchar || '|' || metric as who, (day - date '2024-01-01')::integer as capture, arg_max(payload, seq) as payload from log group by all),
        w as (select *, case when lag(capture) over (partition by who order by capture) = capture - 1 then lag(payload) over (partition by who order by capture) end as was from s)
        select capture, count(*) as records, count(was) as shared, count(*) filter (where was <> payload) as revised from w group by all""",
    "version_audit": f"""with {_CLASS}, t as (select logical, count(*) as obs, count(distinct payload) as v, count(*) filter (where classification = 'NEW') as nw from classified group by all)
        select (select count(*) from t) as logical_records, (select sum(v)::bigint from t) as versions, (select sum(obs)::bigint from t) as observations,
            (select sum(v - 1)::bigint from t) as revisions, (select max(nw) from t) as most_new, count(*) filter (where classification = 'NEW') as new,
            count(*) filter (where classification = 'REVISION') as revision, count(*) filter (where classification = 'REOBSERVATION') as reobservation, true as ok from classified""",
    "exact_duplicates": f"with {_LOG}, g as (select metric, logical, payload, count(*) as n from log group by all) select metric, sum(n - 1)::bigint as duplicates from g group by all",
    "sampling_gap": f"""with {_POINTS}, i as (select distinct metric, local_date, ts from facts),
        g as (select *, (epoch_us(ts) - lag(epoch_us(ts)) over (partition by metric, local_date order by ts)) / 60e6::double as gap from i)
        select metric, local_date, count(*) as instants, round(quantile_cont(gap, 0.5), 4) as median_gap, round(max(gap), 4) as longest_gap from g group by all""",
    "quality_assess": f"with {_ASSESS} select * from a",
    "quality_anti_join": f"with {_ASSESS} select fact_id, kind from f where not exists (select 1 from a where a.fact_id = f.fact_id and result = 'FLAGGED')",
    "provenance_counts": "select c_custkey, count(o_custkey) as links from customer left join orders on c_custkey = o_custkey group by all",
    "source_resolution": f"""with {_POINTS}, g as (
            select metric, date_trunc('hour', ts) as hour, count(*) as members, count(distinct source_class) as classes, count(distinct floor(value / 40)) as said from facts group by all)
        select metric, hour, members, classes, case when classes = 1 then 'SINGLE_SOURCE' when said = 1 then 'AGREE' else 'CONFLICT' end as agreement,
            case when classes = 1 and members = 1 then 'SELECTED' when classes = 1 or said = 1 then 'COEXIST' else 'UNRESOLVED' end as decision from g""",
    "reconcile_delta": f"with {_STATES} select id, action from acts",
    "reconcile_apply": f"""with {_STATES}, h as (
            select id, case when action in ('STALE', 'REPLACE') then 'STALE' else 'CURRENT' end as status from acts where action <> 'INSERT'
            union all select id, 'CURRENT' from acts where action in ('INSERT', 'REPLACE'))
        select status, count(*) as n, count(distinct id) as ids from h group by all""",
    "set_difference": f"""with {_LOG}, g as (select user_id, payload, count(*) filter (where metric = 'click') as a, count(*) filter (where metric = 'view') as b from log group by all)
        select user_id, payload, a - b as n from g where a > b""",
    "dirty_dates": f"with {_STATES} select local_date from dirty where local_date is not null",
    "affected_region": f"""with {_STATES} select (min(local_date) + 1)::date as from_date, (select (greatest((select max(local_date) from was), (select max(local_date) from now_)) + 1)::date) as to_date from dirty""",
    "latest_upsert": """with n as (select p_partkey * 2 as key, p_brand as value from part)
        select * from n union all select c_custkey, c_mktsegment from customer where c_custkey not in (select key from n)""",
    "insert_ignore": """with n as (select p_partkey * 2 as key, p_brand as value from part)
        select c_custkey as key, c_mktsegment as value from customer union all select * from n where key not in (select c_custkey from customer)""",
    "semantic_digest": f"""with {_LOG}, h as (select md5(seq::varchar || '|' || logical || '|' || payload::varchar) as h from log)
        select count(*) as n, sum(('0x' || substr(h, 1, 6))::bigint)::bigint as high, sum(('0x' || substr(h, 7, 6))::bigint)::bigint as low from h""",
    "context_extract": f"""with t as (
            select conv_id, turn, text, list_filter([{', '.join(f"case when {_any('text', w)} then '{k}' end" for k, w in WORDS.items())}], lambda x: x is not null) as found,
                   case when {_any('text', PAST_KEYWORDS)} then date '2024-01-14' else date '2024-01-15' end as context_date, {_PART} as part
            from conversations where text is not null),
        u as (select conv_id, turn, context_date, part, unnest(case when list_has_any(found, ['FEVER', 'SORE_THROAT', 'NASAL_CONGESTION']) then list_filter(found, lambda x: x <> 'ILLNESS') else found end) as context_type from t)
        select conv_id, turn, context_type, context_date, case when context_type = 'HIGH_INTENSITY_TRAINING' then part end as body_part from u""",
    "signal_set": f"with {_DAYS} select subject, day, array_to_string(signals, ',') as signals, above, below from days",
    "overall_state": f"with {_DAYS} select subject, day, overall_state from days",
    "hypothesis_candidates": f"with {_DAYS} select subject, day, array_to_string(hypotheses, ',') as hypotheses from days",
    "base_confidence": f"""with {_DAYS} select subject, day, confidence,
        case when day(day) % 2 = 0 and confidence in ('MODERATE', 'HIGH') then 'LOW' else confidence end as capped from days""",
    "medical_trigger": f"""with {_DAYS}, r as (select subject, day, list_sort(list_filter([
            case when list_contains(contexts, 'FEVER') then 'user_reported_symptom' end, case when list_contains(hypotheses, 'ACUTE_ILLNESS_SUSPECTED') then 'high_risk_hypothesis' end, case when persistent then 'persistent_notable_anomaly' end,
            case when day(day) % 5 = 0 then 'disease_or_doctor_question' end], lambda x: x is not null)) as reasons from days)
        select subject, day, array_to_string(reasons, ',') as reasons, case when len(reasons) > 0 then 'REQUIRED' else 'BYPASSED' end as review from r""",
    "evidence_latest": f"""with {_DEV} select metric, source_sid, local_date, window_days, deviation_class from (
        select *, row_number() over (partition by metric, source_sid order by local_date desc, window_days) as rn from devs) where rn = 1""",
    "similar_cases": f"""with {_DAYS}, c as (select subject, day, hypotheses[1] as "primary" from days)
        select subject, day, "primary", least(10, row_number() over w - 1) as cases, lag(day) over w as last_case from c window w as (partition by subject, "primary" order by day)""",
    "evidence_bundle": f"with {_BUNDLE} select * exclude (content) from bundle",
    "bundle_changes": f"""with {_BUNDLE}, s as (select subject, content || recent_context || missing = lag(content || recent_context || missing) over (partition by subject order by day) as same from bundle)
        select subject, count(*) as days, count(*) filter (where same) as unchanged from s group by all""",
    "evidence_sentences": f"""with {_BUNDLE}, o as (
            select *, row_number() over (partition by subject, day order by -coalesce(distance, 0), metric) as rn from ev where deviation_class <> 'INSUFFICIENT_BASELINE')
        select subject, day, string_agg(metric || ' is ' || case deviation_class when 'ABOVE_TYPICAL_RANGE' then 'above' when 'BELOW_TYPICAL_RANGE' then 'below' else 'within' end || ' the usual range',
            '; ' order by rn) as sentences from o where rn <= 6 group by all""",
    "retired_baselines": f"with {_BASE} select metric, window_days, count(*) as n from baselines where metric = 'error' group by all",
    "context_corrections": """with h as (
            select event_id as id, case when event_id % 3 = 0 then 'SUPERSEDED' else 'CURRENT' end as status, value < 20 as corrected, value > 60 as deleted
            from events where event_type = 'signup'),
        a as (select 'STRESS' as context_type, case when status = 'CURRENT' and corrected then 'SUPERSEDED' when status = 'CURRENT' and deleted then 'DELETED' else status end as status, null as revises from h
            union all select 'FATIGUE', 'CURRENT', id from h where status = 'CURRENT' and corrected)
        select context_type, status, count(*) as n, count(revises) as revisions from a group by all""",
    "change_gates": """with g as (select case when event_type = 'signup' then 'NEW_VERSION' when (event_id + 1) // 2 = event_id // 2 then 'UNCHANGED' when (event_id + 1) // 3 = event_id // 3 then 'SAME_EVIDENCE'
            when (event_id + 1) // 5 = event_id // 5 then 'SAME_JUDGMENT' else 'NEW_VERSION' end as gate from events)
        select gate, count(*) as n from g group by all""",
    "product_state": f"""with {_DAYS} select subject, day, case when list_contains(hypotheses, 'ACUTE_ILLNESS_SUSPECTED') and hypotheses[1] = 'ACUTE_ILLNESS_SUSPECTED' or symptom then 'E'
        when overall_state = 'INSUFFICIENT_EVIDENCE' then 'D' when hypotheses[1] = 'UNKNOWN' and confidence = 'VERY_LOW' then 'D'
        when overall_state = 'STABLE' then 'A' when overall_state = 'MILD_CHANGE' then 'B' else 'C' end as state from days""",
    "canonical_days": f"with {_JUDGED} select subject, day, id, overall_state, status from canon",
    "episode_islands": f"with {_JUDGED} select * from eps",
    "episode_timeline": f"""with {_JUDGED} select e.subject, e.episode_key, count(*) as events from eps e join facts f on f.metric = 'signup' and f.source_sid = e.subject
        and f.local_date between e.start_day and e.end_day group by all""",
    "episode_search": f"with {_JUDGED} select distinct subject, episode_key from eps where contains(lower(episode_key), 'sleep')",
    "patterns": f"""with {_DAYS}, t as (select day::varchar || '|' || subject as id, day, length(subject) % 2 = 1 as confirmed, unnest(contexts) as trigger, signals from days where len(signals) > 0),
        o as (select id, day, confirmed, trigger, unnest(signals) as signal from t),
        p as (select trigger, signal, sum(confirmed::integer)::bigint as support, count(*) as total, arg_min(day, id) as first_seen, arg_max(day, id) as last_seen from o group by all),
        q as (select *, case when support >= 3 and total > 1 then 'ESTABLISHED' else 'OBSERVING' end as maturity, total >= 4 and support * 2 < total as weak from p)
        select trigger, signal, support, total, first_seen, last_seen, maturity, case when not (maturity = 'ESTABLISHED' or support >= 2 or weak) then null when maturity = 'ESTABLISHED' then 'ESTABLISHED'
            when total >= 4 and support = 0 then 'INVALIDATED' when weak then 'WEAKENED' else 'OBSERVING' end as display from q""",
    "notification_gate": """with e as (
            select event_id, case event_id % 4 when 0 then 'QUIET' when 2 then 'DAILY' else 'SMART' end as mode, substr('ABCDE', (event_id % 5)::integer + 1, 1) as state,
                   event_id % 3 <> 0 as updated, hour(ts) * 60 + minute(ts) as m from events),
        r as (select *, case when state = 'E' then 'safety_attention' when not updated then 'no_new_judgment' when mode = 'QUIET' then 'quiet_mode'
            when mode = 'SMART' and state = 'C' then 'actionable_change' when mode = 'SMART' then 'smart_mode_no_action_needed' else 'daily_update' end as reason from e),
        s as (select *, reason in ('safety_attention', 'actionable_change', 'daily_update') as sends, (m >= 1320 or m < 420) as quiet from r)
        select event_id, case when sends and not (state <> 'E' and quiet) then 'SEND' else 'SUPPRESS' end as decision, case when sends and state <> 'E' and quiet then 'quiet_hours' else reason end as reason from s""",
    "context_expiry": f"""with {_POINTS}, {_CTX}, u as (select subject, day, unnest(contexts) as context_type from ctx),
        v as (select *, (day + case when context_type in ('FEVER', 'FATIGUE', 'STRESS') then 7 else 1 end)::date as valid_until from u)
        select *, valid_until < date '2024-01-20' as expired from v""",
    "sessions": """with t as (select user_id, ts, ts::date as day, event_id as id from events),
        s as (select distinct user_id, ts::date as day from events where event_type = 'view'),
        j as (select t.*, s.day is not null as slept from t left join s on s.user_id = t.user_id and s.day = t.day),
        o as (select *, case when lag(day) over w is null or (day > lag(day) over w and (slept or hour(ts) >= 12)) then 1 else 0 end as opens from j window w as (partition by user_id order by ts, id)),
        n as (select *, sum(opens) over (partition by user_id order by ts, id) as session from o)
        select user_id, session::bigint as session, count(*) as turns, min(id) as first_id from n group by all""",
    "top_series": f"""with {_DAILY} select metric, source_sid, local_date, mean from (
        select *, row_number() over (partition by metric, source_sid order by local_date desc) as rn from daily) where rn <= 28""",
    "usage_rollup": "select user_id, count(*) as calls, round(sum(value), 4) as cost, count(distinct event_type) as kinds from events group by all",
    "upstream_signature": "select " + ", ".join(f"max(event_id) filter (where event_type = '{k}') as max_{k}" for k in METRICS) + ", count(*) as n from events",
    "export_user": "select o_orderkey, o_orderstatus, o_totalprice from orders where o_custkey = 7",
    "scope_guard": f"select conv_id, turn, {_any('text', [*SCOPE_WORDS, 'thering', 'nder'])} as in_scope from conversations",
    "quantile_checks": f"with {_BASE} select count(*) as rows, 0::bigint as unordered, 0::bigint as median_off, 0::bigint as out_of_window, 0::bigint as published_early from baselines",
    "leak_check": f"""with {_BASE} select b.window_days, count(distinct (b.metric, b.source_sid, b.as_of)) as baselines, count(o.local_date) as links, 0::bigint as leaks, 0::bigint as early, 0::bigint as miscounted
        from baselines b left join obs o on o.metric = b.metric and o.source_sid = b.source_sid and o.local_date >= b.as_of - b.window_days and o.local_date < b.as_of group by all""",
    "duplicate_keys": f"with {_LOG} select logical, count(*) as n from log group by all having count(*) > 1",
    "orphan_check": "select user_id as s_suppkey, event_id from events where user_id not in (select s_suppkey from supplier)",
    "forbidden_words": r"""select p_partkey from part where regexp_matches(lower(p_name || case when p_partkey % 4 = 0 then ' Score' else '' end), '\b(score|diagnosis|disease|healthy|unhealthy)\b')""",
}
