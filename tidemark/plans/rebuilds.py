"""Queries on what can be made again: the store from its archives, the tables of a build from their sources; and
the DuckDB SQL each is compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import accounts, baseline, features, provenance
from ..operators.features import SERIES
from ..sources import captures, stages, store
from ..sources.scratch import place, stash
from ..sources.stages import Stage
from ..sources.tables import point_facts, table
from .oracles import _BASE

Query = Callable[[SparkSession, str], DataFrame]

#: Lines of an archive.
LINES = 2000


def _archives(spark: SparkSession, d: str, changed: bool) -> str:
    """The folder of archives of the events, an envelope a line in the order of ids; in the changed ones some
    lines are others, by a rule on the id, and every fifth archive is gone."""
    e = F.col("event_id")
    raw = F.struct(e.cast("string").alias("key"), F.col("user_id").cast("string").alias("sid"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("time"), "value",
                   F.when(F.lit(changed) & (e % 89 == 0), "later").alias("note"))
    stated = F.sha2(captures.canonical(F.to_json(raw.dropFields("note"))), 256)
    envelope = lambda of: F.to_json(F.struct(
        F.lit("vendor").alias("provider"), F.lit("eu").alias("region"), F.when(F.lit(changed) & (e % 97 == 0), "other").otherwise(F.col("event_type")).alias("dataset"),
        F.concat(F.lit("c"), e.cast("long") - e % LINES).alias("capture_id"), F.lit("2024-02-01").alias("ingested_at_utc"), stated.alias("raw_record_sha256"), of.alias("raw_record"),
    ))
    text = envelope(raw)
    if changed:
        text = F.when(e % 73 == 0, "").when(e % 83 == 0, "{oops").when(e % 79 == 0, envelope(F.lit(1))).otherwise(text)
    # Dealt as they are read and written out as text after that: the events may lie in few pieces, archives do not.
    rows = table(spark, d, "events").select(F.floor(e / LINES).alias("archive"), "event_id", "user_id", "ts", "event_type", "value")
    path = place(spark, "archives")
    kept = rows.where("archive % 5 <> 3") if changed else rows
    kept.repartition("archive").sortWithinPartitions("archive", "event_id").select("archive", text.alias("text")).write.partitionBy("archive").text(path)
    return path


def _numbered(df: DataFrame) -> DataFrame:
    """Archives are known by their number in both folders."""
    return df.withColumn("path", F.regexp_extract("path", "archive=([0-9]+)", 1))


def rederive_archives(spark, d):
    """What is found when the store of the events is derived again from archives of which some lines have
    changed. Of every fifth archive the hash is the one that it had, of others the one that it has now."""
    first, second = _archives(spark, d, False), _archives(spark, d, True)
    stored = stash(_numbered(provenance.observe(captures.scan_archives(spark, first))), "stored").where(F.col("raw_key").cast("bigint") % 71 != 0)
    was, found = (_numbered(captures.archive_hashes(spark, path)) for path in (first, second))
    artifacts = was.join(found.withColumnRenamed("sha256", "_now"), "path", "left").select(
        "path", F.when(F.col("path").cast("int") % 5 == 1, F.col("sha256")).otherwise(F.coalesce("_now", "sha256")).alias("sha256")
    )
    return provenance.rederive(artifacts, found, _numbered(captures.scan_archives(spark, second)), stored).select(F.col("path").cast("bigint").alias("archive"), "line", "issue")


def _stages() -> list[Stage]:
    return [
        Stage("baselines", ("daily",), baseline.rolling_baselines),
        Stage("daily", ("facts",), lambda facts: features.point_daily(facts).withColumn("value", F.col("mean")), settles=True),
        Stage("facts", ("events",), lambda facts: facts.select("fact_id", *SERIES, "local_date", "value")),
    ]


def rebuild_check(spark, d):
    """A full build compared with a build of which the daily values of one day are gone, and in which one
    metric has moved by one."""
    root = place(spark, "build")
    sources = {"events": stages.Source(point_facts(spark, d), stages.files_source(spark, f"{d}/events.parquet").fingerprint)}
    stages.run(spark, root, _stages(), sources)
    daily = store.read_current(spark, f"{root}/daily").where("dayofmonth(local_date) <> 12")
    moved = daily.withColumn("mean", F.col("mean") + F.when(F.col("metric") == "click", 1.0).otherwise(0.0))
    store.commit(moved, f"{root}/daily", store.note(spark, f"{root}/daily", 0))
    return stages.full_rebuild(spark, root, _stages(), sources)


#: What is held of users, and what of it is given out.
HELD = {
    "customer": accounts.Held("c_custkey", ("c_custkey", "c_name", "c_mktsegment")), "orders": accounts.Held("o_custkey", ("o_orderkey", "o_orderstatus")),
    "events": accounts.Held("user_id", ("event_id", "event_type")),
}


def _held(spark, d):
    tables = {name: table(spark, d, name) for name in HELD}
    return tables, tables["customer"].where("c_custkey % 23 = 7").select(F.col("c_custkey").alias("user_id"))


def export_users(spark, d):
    """All that is held of every 23rd user."""
    tables, users = _held(spark, d)
    return accounts.export(tables, HELD, users)


def erase_users(spark, d):
    """What is left of the tables once every 23rd user is taken out of all of them."""
    tables, users = _held(spark, d)
    root = place(spark, "held")
    for name, held in HELD.items():
        store.commit(tables[name].select(held.key, *(c for c in held.columns if c != held.key)), f"{root}/{name}")
    return accounts.erase(spark, root, HELD, users)


QUERIES: dict[str, Query] = {f.__name__: f for f in (rederive_archives, rebuild_check, export_users, erase_users)}


def _export() -> str:
    parts = []
    for name, held in HELD.items():
        fields = ", ".join(f"{c} := {c}" for c in held.columns)
        parts.append(f"select {held.key} as user_id, '{name}' as \"table\", to_json(struct_pack({fields}))::varchar as row from {name} where {held.key} in (select * from u)")
    return f"with u as (select c_custkey from customer where c_custkey % 23 = 7) {' union all '.join(parts)}"


def _erase() -> str:
    gone = lambda key: f"{key} in (select c_custkey from customer where c_custkey % 23 = 7)"
    return " union all ".join(f"select '{n}' as \"table\", count(*) filter (where {gone(h.key)}) as deleted, count(*) filter (where not {gone(h.key)}) as \"left\" from {n}" for n, h in HELD.items())


SQL: dict[str, str] = {
    "export_users": _export(),
    "erase_users": _erase(),
    "rederive_archives": f"""with e as (select event_id, event_id // {LINES} as archive, row_number() over (partition by event_id // {LINES} order by event_id) as line,
            event_id % 73 = 0 as blank, event_id % 83 = 0 as broken, event_id % 79 = 0 as bare, event_id % 97 = 0 as moved, event_id % 89 = 0 as noted, event_id % 71 <> 0 as stored from events),
        a as (select archive, case when archive % 5 = 3 then 'MISSING_ARCHIVE' when archive % 5 = 1 and bool_or(blank or broken or bare or moved or noted) then 'ARCHIVE_HASH_MISMATCH' end as issue,
            count(*) filter (where not blank) <> count(*) filter (where stored) as uneven from e group by archive),
        w as (select e.* from e join a on a.archive = e.archive and a.issue is null),
        l as (select archive, line, unnest(case when blank then case when stored then ['MISSING_LINE'] else [] end when not stored then ['UNUSED_LINE'] when broken then ['NOT_JSON'] when bare then ['NO_RAW_RECORD']
            else list_filter([case when moved then 'ENVELOPE_MISMATCH' end, case when noted then 'PAYLOAD_HASH_MISMATCH' end, case when moved then 'IDENTITY_MISMATCH' end, case when noted then 'RAW_JSON_MISMATCH' end], lambda x: x is not null) end) as issue from w)
        select * from l union all select archive, null, issue from a where issue is not null union all select archive, null, 'COUNT_MISMATCH' from a where issue is null and uneven""",
    "rebuild_check": f"""with {_BASE}, n as (select count(*) as whole, count(*) filter (where day(local_date) <> 12) as kept,
            count(*) filter (where day(local_date) <> 12 and metric = 'click') as moved from daily)
        select 'facts' as stage, (select count(*) from facts) as rows, 0::bigint as only_current, 0::bigint as only_rebuilt, 'PASS' as status
        union all select 'daily', kept, moved, whole - kept + moved, 'FAIL' from n
        union all select 'baselines', (select count(*) from baselines), 0, 0, 'PASS'""",
}
