"""Queries on feedback, which turns of conversations give on the judgments of the tables' days by a rule on
their keys; and the DuckDB SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence, feedback
from ..params import BODY_PARTS, CONTEXT_KEYWORDS, GENERATED_PREFIX, PAST_KEYWORDS
from ..sources.scratch import stash
from ..sources.tables import table
from .oracles import _BUNDLE
from .queries import _contexts, _evidence_days
from .states import SAID, _list, _pick

Query = Callable[[SparkSession, str], DataFrame]

GIVEN = ["accurate", "accurate", "inaccurate", "补充情况", "partly", "准确", "so so"]


def _judgments(spark, d):
    """A judgment for each bundle: ids grow by day, every seventh is stale."""
    made = evidence.bundles(_evidence_days(spark, d), _contexts(spark, d), ["subject"])
    number = (F.datediff("day", F.lit("1970-01-01").cast("date")) * 8 + F.substring("subject", -1, 1).cast("int")).cast("bigint")
    return made.select(
        number.alias("id"), "subject", "day", F.when(number % 7 == 3, "STALE").otherwise("CURRENT").alias("status"), F.col("recent_context").alias("contexts"), "deviations"
    )


def _feedback(spark, d):
    """A feedback for each turn: on the judgment of its number, of its day, or on the last one."""
    c, t = F.col("conv_id"), F.col("turn")
    person = c % 8
    subject = F.concat(F.when(person % 2 == 1, GENERATED_PREFIX).otherwise(""), person.cast("string"))
    day = F.date_add(F.lit("2024-01-01").cast("date"), ((c * 3 + t) % 35).cast("int"))
    return table(spark, d, "conversations").select(
        (c * 1000000 + t).alias("id"), subject.alias("subject"), F.when(c % 11 == 0, "HYPOTHESIS").otherwise("DAILY_REASONING").alias("subject_type"),
        F.when(c % 5 == 0, (F.datediff(day, F.lit("1970-01-01").cast("date")) * 8 + person).cast("bigint")).alias("subject_id"),
        F.when(c % 3 != 1, day).alias("day"), _pick(GIVEN, c + t).alias("verdict"), F.when(c % 13 != 0, F.concat_ws(" ", _pick(SAID, c * 5 + t), "text")).alias("text"),
    )


def feedback_patterns(spark, d):
    """The patterns that feedback counts for, folded from what four batches add."""
    settled = stash(feedback.settle(_feedback(spark, d), _judgments(spark, d)), "settled")
    added = [feedback.counters(settled.where(F.col("id") % 4 == n)) for n in range(4)]
    return feedback.patterns_of(feedback.merge_counters(reduce(DataFrame.unionByName, added)))


def feedback_recorded(spark, d):
    """What was recorded of each feedback."""
    return feedback.recorded(feedback.settle(_feedback(spark, d), _judgments(spark, d))).drop("text")


def feedback_contexts(spark, d):
    """The contexts that corrections add."""
    return feedback.corrected_contexts(feedback.settle(_feedback(spark, d), _judgments(spark, d))).drop("raw_text")


QUERIES: dict[str, Query] = {f.__name__: f for f in (feedback_patterns, feedback_recorded, feedback_contexts)}


def _has(words: list[str]) -> str:
    return f"list_bool_or(list_transform({_list(words)}, lambda w: contains(lower(text), w)))"


_ALL = [w for words in CONTEXT_KEYWORDS.values() for w in words]
_SETTLED = f"""{_BUNDLE},
    j0 as (select date_diff('day', date '1970-01-01', day) * 8 + right(subject, 1)::bigint as id, * from bundle),
    sig as (select subject, day, list_sort(list_distinct(list(metric || case deviation_class when 'ABOVE_TYPICAL_RANGE' then '_UP' when 'BELOW_TYPICAL_RANGE' then '_DOWN' end))) as signals from ev group by all),
    j as (select j0.id, j0.subject, j0.day, id % 7 <> 3 as fine, case when recent_context = '' then [] else string_split(recent_context, ',') end as contexts, list_filter(signals, lambda x: x is not null) as signals
        from j0 join sig on sig.subject = j0.subject and sig.day = j0.day),
    f0 as (select conv_id * 1000000 + turn as id, case when conv_id % 2 = 1 then '{GENERATED_PREFIX}' else '' end || (conv_id % 8) as subject, case when conv_id % 11 = 0 then 'HYPOTHESIS' else 'DAILY_REASONING' end as subject_type,
            (date '2024-01-01' + ((conv_id * 3 + turn) % 35)::integer)::date as d, conv_id, ({_list(GIVEN)})[(conv_id + turn) % {len(GIVEN)} + 1] as verdict,
            case when conv_id % 13 <> 0 then ({_list(SAID)})[(conv_id * 5 + turn) % {len(SAID)} + 1] || coalesce(' ' || text, '') end as text from conversations),
    f1 as (select f0.id, subject, subject_type, text, verdict, case when conv_id % 5 = 0 then date_diff('day', date '1970-01-01', d) * 8 + conv_id % 8
            when conv_id % 3 = 1 then (select max(j.id) from j where j.fine and j.subject = f0.subject) else (select max(j.id) from j where j.fine and j.subject = f0.subject and j.day = f0.d) end as subject_id from f0),
    f2 as (select *, case when verdict in ('accurate', '准确') then 'CONFIRMED' when verdict = 'inaccurate' then 'REJECTED' when verdict in ('补充情况', 'partly') then 'CORRECTED' end as feedback_status from f1),
    f as (select f2.*, case when feedback_status is null then 'UNKNOWN_VERDICT' when subject_id is null then 'NO_JUDGMENT' end as problem, j.day as bundle_day, j.contexts, j.signals
        from f2 left join j on j.id = f2.subject_id and f2.subject_type = 'DAILY_REASONING')"""


def _contexts_sql() -> str:
    kinds = ", ".join(f"case when {_has(words)} then '{kind}' end" for kind, words in CONTEXT_KEYWORDS.items())
    parts = " ".join(f"when contains(lower(text), '{k}') then '{v}'" for k, v in BODY_PARTS.items())
    return f"""with {_SETTLED}, s as (select id, subject, list_filter([{kinds}], lambda x: x is not null) as found, bundle_day - {_has(PAST_KEYWORDS)}::integer as context_date, case {parts} end as part
            from f where problem is null and feedback_status = 'CORRECTED' and length(text) > 0),
        u as (select id, subject, context_date::date as context_date, part, unnest(case when list_has_any(found, ['FEVER', 'SORE_THROAT', 'NASAL_CONGESTION']) then list_filter(found, lambda x: x <> 'ILLNESS') else found end) as context_type from s)
        select id, subject, context_type, context_date, case when context_type = 'HIGH_INTENSITY_TRAINING' then part end as body_part, 'USER_REPORTED' as source, 'CURRENT' as status from u"""


SQL: dict[str, str] = {
    "feedback_patterns": f"""with {_SETTLED}, t as (select id, subject, bundle_day, feedback_status = 'CONFIRMED' as confirmed, unnest(contexts) as trigger, signals from f where problem is null and len(signals) > 0),
        o as (select * exclude (signals), unnest(signals) as signal from t),
        p as (select subject, trigger, signal, sum(confirmed::integer)::bigint as support, count(*) as total, arg_min(bundle_day, id) as first_seen, arg_max(bundle_day, id) as last_seen from o group by all),
        q as (select *, case when support >= 3 and total > 1 then 'ESTABLISHED' else 'OBSERVING' end as maturity, total >= 4 and support * 2 < total as weak from p)
        select * exclude (weak), case when not (maturity = 'ESTABLISHED' or support >= 2 or weak) then null when maturity = 'ESTABLISHED' then 'ESTABLISHED'
            when total >= 4 and support = 0 then 'INVALIDATED' when weak then 'WEAKENED' else 'OBSERVING' end as display from q""",
    "feedback_recorded": f"""with {_SETTLED} select id, subject, subject_type, subject_id, feedback_status, problem,
        case feedback_status when 'CONFIRMED' then 'judgment_confirmed' when 'REJECTED' then 'judgment_rejected'
            when 'CORRECTED' then case when coalesce(length(text), 0) = 0 or {_has(_ALL)} then 'context_added' else 'reason_corrected' end end as category from f""",
    "feedback_contexts": _contexts_sql(),
}
