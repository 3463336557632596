"""A build in stages, each a table made from others: run in the order of what needs what, made anew only where
something changed, and checked against a full build.

A stage's version carries the fingerprint of what it was made from. A run that stops leaves whole stages
behind, which the next run finds and goes on from.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.reconcile import same_content, semantic_compare
from . import store


@dataclass(frozen=True)
class Stage:
    name: str
    inputs: tuple[str, ...]
    #: Makes the table from those of the inputs, in their order.
    build: Callable[..., DataFrame]
    #: Changes with what build does.
    version: str = "1"
    #: A table that says the same as before, though its inputs changed, leaves later stages as they are. It
    #: costs a comparison of both tables.
    settles: bool = False


@dataclass(frozen=True)
class Source:
    table: DataFrame
    fingerprint: str


def files_source(spark: SparkSession, path: str) -> Source:
    """A Parquet table that is known by its files: their names, lengths and times (contents are not read).
    The files are hashed in 256 parts."""
    files = spark.read.format("binaryFile").load(path).select(F.sha2(F.concat_ws("|", "path", "length", "modificationTime"), 256).alias("h"))
    parts = files.groupBy(F.substring("h", 1, 2).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256).alias("h"))
    whole = parts.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ","), 256)).first()[0]
    return Source(spark.read.parquet(path), whole)


def in_order(stages: list[Stage], sources: Mapping[str, Source]) -> list[Stage]:
    """Stages after all that they need; a name that is missing or twice, or a circle, is an error."""
    named = {s.name: s for s in stages}
    if len(named) < len(stages) or named.keys() & sources.keys():
        raise ValueError("two tables of one name")
    missing = sorted({i for s in stages for i in s.inputs} - named.keys() - sources.keys())
    if missing:
        raise ValueError(f"no stage makes {', '.join(missing)}")
    return [named[n] for n in TopologicalSorter({s.name: s.inputs for s in stages}).static_order() if n in named]


def _digest(*parts: str) -> str:
    return hashlib.sha256(json.dumps(parts).encode()).hexdigest()


def run(spark: SparkSession, root: str, stages: list[Stage], sources: Mapping[str, Source]) -> dict[str, str]:
    """Brings every stage under root up to date; what was done for each: BUILT, SAME (built, and says the
    same as before) or SKIPPED."""
    tables, said, done = {n: s.table for n, s in sources.items()}, {n: s.fingerprint for n, s in sources.items()}, {}
    for stage in in_order(stages, sources):
        path, made_of = f"{root}/{stage.name}", _digest(stage.name, stage.version, *(said[i] for i in stage.inputs))
        known = store.current_version(spark, path)
        note = json.loads(store.note(spark, path, known)) if known >= 0 else {}
        if note.get("made_of") != made_of:
            table = stage.build(*(tables[i] for i in stage.inputs))
            content, done[stage.name] = made_of, "BUILT"
            if stage.settles and known >= 0:
                # What is compared is what is committed: written first, so that it is worked out once.
                written = store.write(table, path)
                if same_content(store.read_current(spark, path), spark.read.parquet(f"{path}/{written}")):
                    content, done[stage.name] = note["content"], "SAME"
                store.name(spark, path, known + 1, json.dumps({"made_of": made_of, "content": content}), written)
            else:
                store.commit(table, path, json.dumps({"made_of": made_of, "content": content}), after=known)
            said[stage.name] = content
        else:
            said[stage.name], done[stage.name] = note["content"], "SKIPPED"
        tables[stage.name] = store.read_current(spark, path)
    return done


def full_rebuild(spark: SparkSession, root: str, stages: list[Stage], sources: Mapping[str, Source]) -> DataFrame:
    """Builds all stages anew in an empty folder under root and compares each with its current version:
    stage, rows (of the current version), only_current, only_rebuilt, status (PASS, FAIL, or MOVED: the
    current version changed meanwhile). Nothing that is current is written."""
    ordered = in_order(stages, sources)
    before = {s.name: store.current_version(spark, f"{root}/{s.name}") for s in ordered}
    fresh = f"{root}/rebuilt-{uuid.uuid4().hex}"
    run(spark, fresh, stages, sources)
    out = []
    for s in ordered:
        made = store.read_current(spark, f"{fresh}/{s.name}")
        current = store.read_version(spark, f"{root}/{s.name}", before[s.name]) if before[s.name] >= 0 else made.limit(0)
        differ = {r.side: r["count"] for r in semantic_compare(current, made, made.columns).groupBy("side").count().collect()}
        first, second = differ.get("only_first", 0), differ.get("only_second", 0)
        moved = store.current_version(spark, f"{root}/{s.name}") != before[s.name]
        out.append((s.name, current.count(), first, second, "MOVED" if moved else "FAIL" if first or second or before[s.name] < 0 else "PASS"))
    return spark.createDataFrame(out, "stage string, rows long, only_current long, only_rebuilt long, status string")
