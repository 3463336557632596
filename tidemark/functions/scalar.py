"""Scalar rules of the data model as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import GENERATED, GENERATED_PREFIX, NUMERIC


def source_class(sid: Column) -> Column:
    return F.when(sid.startswith(GENERATED_PREFIX), GENERATED).otherwise(NUMERIC)


def local_date(ts: Column, offset_seconds: Column, zone: Column | None = None, zones: list[str] | None = None) -> Column:
    """The date of an instant: by the offset if there is one, else by a zone among the known ones,
    else in UTC. from_utc_timestamp() fails on unknown zones, hence the list."""
    shifted = F.to_date(F.timestamp_add("SECOND", offset_seconds, ts))
    out = F.when(offset_seconds.isNotNull(), shifted)
    if zone is not None and zones:
        out = out.when(zone.isin(zones), F.to_date(F.from_utc_timestamp(ts, zone)))
    return out.otherwise(F.to_date(ts))


def metric_of(feature: Column) -> Column:
    head = F.substring_index(feature, ".", 1)
    return F.when(head == "sleep_source_episode", "sleep").otherwise(head)


def contains_any(text: Column, words: list[str]) -> Column:
    low = F.lower(text)
    found = F.lit(False)
    for w in words:
        found = found | low.contains(w.lower())
    return found


def in_quiet_hours(minute: Column, start: int, end: int) -> Column:
    """Whether a minute of the day lies in a window that may cross midnight."""
    if start <= end:
        return (minute >= start) & (minute < end)
    return (minute >= start) | (minute < end)


def json_path(body: Column, path: str) -> Column:
    """The member of a JSON object at a dotted path, as text; null where it is missing or lies in a
    value that is no object."""
    return F.get_json_object(body, "$." + path)


def scalar_members(body: Column) -> Column:
    """map<string, string> of the members of a JSON object that are neither objects nor arrays."""
    members = F.from_json(body, "map<string, variant>")
    plain = F.map_filter(members, lambda k, v: ~F.coalesce(F.schema_of_variant(v), F.lit("VOID")).rlike("^(OBJECT|ARRAY)"))
    return F.transform_values(plain, lambda k, v: v.cast("string"))


def first_timestamp(*candidates: Column) -> Column:
    """The first candidate that is a whole number."""
    return F.coalesce(*(c.try_cast("bigint") for c in candidates))


def utc_date(epoch_seconds: Column) -> Column:
    """The UTC day of an instant given in seconds, whatever the session's zone."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(epoch_seconds / 86400).cast("int"))
