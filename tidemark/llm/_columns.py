"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What every operator calls a word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: int, *parts: Column) -> Column:
    """A reproducible pseudo-random integer of 60 bits, the same in any engine that has MD5."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("null")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null and keeps null apart from every string."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def row_key(doc_id: Column, text: Column, *more: Column) -> Column:
    """Tells rows apart by id and text (and more); rows with all equal are one. Null is as no text."""
    return F.xxhash64(doc_id, F.md5(F.coalesce(text, F.lit(""))), *more)
