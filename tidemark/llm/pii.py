"""Personal data by bootstrapped contextual extraction.

Base patterns find e-mail addresses, IP addresses, card and phone numbers in every text. These are
the seeds. The words around a seed make lexical patterns (the two words before it; the word before
and the word after); where no word is, there is no pattern. Identifier-like strings that no base pattern takes are candidates. Patterns and
the values that stand in them make a graph, which Spark scores in rounds: a pattern by its trusted
values against its doubtful ones, a value by the trusted patterns that hold it. Values found in one
round count for the patterns of the next, so contexts without any seed are reached too. What stands
in a pattern of high confidence is reported beside the base spans.

A candidate is doubtful if it has the form of its kind and fails the check (check digits, parts of an
address); any other is unknown, and speaks neither for nor against a pattern, but a pattern in which
too few values are known is not used.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import slices
from ._store import stash

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# The possessive loops match what greedy ones would: nothing that follows could take back a character.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9](?:[\x20().-]{0,2}[0-9])++")
# A mailbox name has 64 characters at most and a label of a host name 63; so no more are looked for.
_DOT = r"(?:\x20?[(\[](?i:dot|\.)[)\]]\x20?|\x20(?i:dot|\.)\x20)"
_AT = re.compile(r"\x20?[(\[](?i:at)[)\]]\x20?|\x20(?i:at)\x20")
_HOST = re.compile(rf"[A-Za-z0-9-]{{1,63}}+(?:(?:\.|{_DOT})[A-Za-z0-9-]{{1,63}}+)++")
_SPELLED_IP = re.compile(rf"[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{3}}")
_WORD = re.compile(r"\S+")
_AREA = re.compile(r"[0-9]{1,5}\)")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_TRIM = "\"'.,;:!?()[]{}<>|*#$%&"


def _luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum((0, 2, 4, 6, 8, 1, 3, 5, 7, 9)[int(d)] for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    free, at = 0, text.find("@")
    while at >= 0:
        start, domain = at, _DOMAIN.match(text, at + 1)
        if domain:
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, domain.end()
                free = domain.end()
        at = text.find("@", max(at + 1, free))


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    for run in _DOTTED.finditer(text):
        if run[0].count(".") < 3:
            continue
        at, parts = run.start(), run[0].split(".")
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, at + size
            at += size + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of what the base patterns take, in order."""
    spans = [(a, 0, b) for a, b in _emails(text)] + [(a, 1, b) for a, b in _addresses(text)]
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(digits) <= 19 and _luhn(digits):
                spans.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def _spelled(text: str) -> Iterator[tuple[int, int]]:
    """E-mail addresses with words for their signs."""
    free = 0
    for m in _AT.finditer(text):
        host, start = _HOST.match(text, m.end()), m.start()
        if host:
            while start > max(free, m.start() - 64) and text[start - 1] in _LOCAL:
                start -= 1
            if start < m.start():
                yield start, host.end()
                free = host.end()


def _candidates(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """Identifier-like strings apart from the spans: numbers as phone or card, spelled-out addresses."""
    # A bracket before an area code belongs to the number.
    start = lambda m: m.start() - (m.start() > 0 and text[m.start() - 1] == "(" and _AREA.match(text, m.start()) is not None)
    found = [(start(m), k, m.end()) for m in _NUMBER.finditer(text) if m.end() - m.start() >= 7
             for n in [len(_NOT_DIGIT.sub("", m[0]))] for k, ok in ((2, 12 <= n <= 19), (3, 7 <= n <= 15)) if ok]
    low = text.lower()
    if any(x in low for x in ("at)", "at]", " at ")):
        found += [(a, 0, b) for a, b in _spelled(text)]
    if any(x in low for x in ("[.]", "(.)", "dot]", "dot)", " . ", " dot ")):
        found += [(m.start(), 1, m.end()) for m in _SPELLED_IP.finditer(text)]
    taken: list[list[int]] = []  # the spans, those that overlap as one
    for a, b in sorted((a, b) for a, _, b in spans):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    at = 0
    for a, k, b in sorted(found):
        while at < len(taken) and taken[at][1] <= a:
            at += 1
        if at == len(taken) or taken[at][0] >= b:
            yield a, k, b


def _told(*words: str) -> bool:
    """Whether any of the words has a letter or digit: punctuation and the ends of a text are no context."""
    return any(c.isalnum() for w in words for c in w)


def _context(text: str, words: list[tuple[int, int]], start: int, end: int) -> tuple[str | None, str | None]:
    """The two words before a span, and the word before with the word after; None for either in which no
    word is. words: those of the text."""
    first = bisect_left(words, (start, 0))
    before = [text[a : min(b, start)].strip(_TRIM).lower() for a, b in words[max(0, first - 2) : first]]
    before = ["^"] * (2 - len(before)) + before
    next_ = bisect_right(words, end, key=lambda w: w[1])
    after = text[max(words[next_][0], end) : words[next_][1]].strip(_TRIM).lower() if next_ < len(words) else "$"
    return " ".join(before) if _told(*before) else None, f"{before[1]} _ {after}" if _told(before[1], after) else None


def _value(text: str, start: int, kind: int, end: int) -> str:
    """What tells values apart, however they are written."""
    raw = text[start:end]
    if kind > 1:
        return _NOT_DIGIT.sub("", raw)
    return re.sub(_DOT, ".", re.sub(r"\x20?[(\[]at[)\]]\x20?|\x20at\x20", "@", raw.lower()))


def _refuted(value: str, kind: int) -> bool:
    """Whether a candidate has the form of its kind but fails the check of it."""
    return kind == 2 and 14 <= len(value) <= 19 and not _luhn(value) or kind == 1 and any(int(p) > 255 for p in value.split("."))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_MENTION = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("seed", pa.bool_()), ("refuted", pa.bool_()), ("two", pa.string()), ("around", pa.string())])


def _mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        counts: list[list[int]] = [[], [], [], []]
        sums, texts, mentions = [], [], []
        for text in batch.column(1).to_pylist():
            spans = base_spans(text) if text else []
            for k in range(4):
                counts[k].append(sum(s[1] == k for s in spans))
            texts.append(joined(spans))
            sums.append(hashlib.sha256(texts[-1].encode()).hexdigest())
            rows, words = [], None
            for seed, some in ((True, spans), (False, _candidates(text, spans) if text else ())):
                for a, k, b in some:
                    if words is None:
                        words = [m.span() for m in _WORD.finditer(text)]
                    two, around = _context(text, words, a, b)
                    value = _value(text, a, k, b)
                    rows.append({"kind": k, "start": a, "end": b, "value": value, "seed": seed, "refuted": not seed and _refuted(value, k), "two": two, "around": around})
            mentions.append(rows)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sums, pa.string()), pa.array(texts, pa.string()), pa.array(mentions, pa.list_(_MENTION))],
            ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "base", "mentions"],
        )


def score_patterns(
    edges: DataFrame, rounds: int = 3, least_seeds: int = 3, confidence: float = 0.8, least_share: float = 0.3
) -> DataFrame:
    """pattern, score for the patterns of high confidence in edges(pattern, value, seed, refuted).

    A value that is a seed anywhere has trust 1. In each round a pattern counts its known values
    (trust of a half or more) and its doubtful ones (refuted and not known). It is accepted with least_seeds known values
    that are `confidence` of the known and doubtful ones and least_share of all its values; its score
    is known / (known + doubtful + 1). A value's trust is then 1 - product(1 - score) over its
    accepted patterns, and a refuted value's half of that.
    """
    edges = stash(edges.groupBy("pattern", "value").agg(F.max("seed").alias("seed"), F.max("refuted").alias("refuted")), "pii-edges")
    facts = edges.groupBy("value").agg(F.max("seed").alias("sure"), F.max("refuted").alias("refuted"))
    graph = edges.select("pattern", "value").join(facts, "value")
    trust = None
    for _ in range(rounds):
        known = F.col("sure") if trust is None else F.col("sure") | (F.coalesce("trust", F.lit(0.0)) >= 0.5)
        told = graph if trust is None else graph.join(trust, "value", "left")
        doubt = ~known & F.col("refuted")
        share = F.col("k") / (F.col("k") + F.col("d"))
        patterns = stash(
            told.groupBy("pattern").agg(F.count("*").alias("n"), F.count_if(known).alias("k"), F.count_if(doubt).alias("d"))
            .where((F.col("k") >= least_seeds) & (share >= confidence) & (F.col("k") >= F.col("n") * least_share))
            .select("pattern", (F.col("k") / (F.col("k") + F.col("d") + 1)).alias("score")),
            "pii-patterns",
        )
        trust = (
            graph.where("not sure").join(patterns, "pattern").groupBy("value", "refuted")
            .agg((1 - F.exp(F.sum(F.log(1 - F.col("score"))))).alias("trust"))
            .select("value", F.when(F.col("refuted"), F.col("trust") / 2).otherwise(F.col("trust")).alias("trust"))
        )
    return patterns


def find_personal_data(docs: DataFrame, rounds: int = 3, least_seeds: int = 3, confidence: float = 0.8) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_found (spans that
    the method added) for every row of docs(doc_id, text, ...).

    Spans are kind:start:end in code points, end exclusive, ordered by start and then kind. A null
    text has none. An added span never overlaps a base span; of two kinds for one place the better
    scored stands, then the first kind. Ids may be null or repeat: rows are judged one by one. Other
    columns are not looked at. An empty table gives an empty one.
    """
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base string, mentions array<struct<kind: int, start: long, end: long, value: string, seed: boolean, refuted: boolean, two: string, around: string>>"
    marked = stash(docs.select("doc_id", "text").mapInArrow(_mentions, schema).withColumn("row", F.monotonically_increasing_id()), "pii")
    mention = marked.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    kind = F.col("kind").cast("string")
    slots = mention.select(
        "row", "kind", "start", "end", "seed", "refuted", F.concat_ws("|", kind, "value").alias("value"),
        F.explode(F.array(F.concat(kind, F.lit("|two|"), "two"), F.concat(kind, F.lit("|around|"), "around"))).alias("pattern"),
    ).where("pattern is not null")
    patterns = score_patterns(slots.select("pattern", "value", "seed", "refuted"), rounds, least_seeds, confidence)
    places = (
        slots.where("not seed").join(patterns, "pattern").groupBy("row", "start", "end")
        .agg(F.max_by("kind", F.struct("score", -F.col("kind"))).alias("kind"))
    )
    added = places.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("more"))
    names = F.array(*(F.lit(k) for k in KINDS))
    place = F.transform(
        F.split("base", ","),
        lambda s: F.struct(
            F.split(s, ":")[1].cast("long").alias("start"),
            (F.array_position(names, F.split(s, ":")[0]) - 1).cast("int").alias("kind"),
            F.split(s, ":")[2].cast("long").alias("end"),
        ),
    )
    everything = F.array_sort(F.concat(F.when(F.col("base") == "", F.array()).otherwise(place), F.col("more")))
    text = F.array_join(F.transform(everything, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return marked.join(added, "row", "left").select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256",
        F.when(F.col("more").isNull(), F.col("base")).otherwise(text).alias("spans"),
        F.coalesce(F.size("more"), F.lit(0)).alias("n_found"),
    )
