import gzip
import hashlib

import pytest

from tidemark.llm._store import clear, new_path, stash
from tidemark.llm.warc import Archive, archive_pages, read_archives, read_warc, records, resolve_revisits, write_archives

PAGES = "page_id long, url string, html string, payload string, record_type string"
LONG = "<p>é</p>\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n" * 5


def rows():
    out = [(1, "u", LONG), (5, "u\r\nX: y", LONG), (3, "u", LONG), (2, "v", None), (4, "v", ""), (6, None, "x" * 99), (7, None, "x" * 99)]
    out += [(8, "w", "é" * 50), (9, "w", "é" * 50), (None, "n", LONG), (10, "big", "z\n" * 400_000), (11, "big", "z\n" * 400_000), (3, "u", LONG)]
    out += [(12, "q", "\n" * 150), (13, "q", "\n" * 150), (14, "q", "\r\n\r\n" * 40), (15, "q", " " * 120)]
    return [(*r, "p", "t") for r in out]


def brute(data):
    first = {}
    for i, _, html, *_ in data:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    out = []
    for i, _, html, *_ in data:
        raw = (html or "").encode()
        original = first.get(html or "")
        revisit = len(raw) >= 100 and original is not None and original != i
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if revisit else "response", original if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    got = archive_pages(spark.createDataFrame(rows(), PAGES).repartition(3)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == brute(rows())
    texts = sorted((repr(r.page_id), r.payload) for r in got if r.record_type == "response")
    first = {b[0] for b in brute(rows()) if b[3] == "response"}
    assert [t for _, t in texts] == [t for _, t in sorted((repr(i), h or "") for i, _, h, *_ in rows() if i in first)]
    assert {r.url for r in got if r.page_id == 5} == {"u%0D%0AX: y"}


def test_records_split_anywhere(spark, tmp_path):
    df = spark.createDataFrame(rows() * 3, PAGES)
    archive = write_archives(resolve_revisits(records(df)).coalesce(1), str(tmp_path / "a"), compression="none")
    text = b"".join(p.read_bytes() for p in (tmp_path / "a").glob("part-*"))
    assert text.count(b"\r\nWARC-Type: ") >= len(rows()) * 3 and text.startswith(b"WARC/1.1\r\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("1009", "70001"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = read_archives(spark, Archive(archive.path, archive.name)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
            assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(rows()) * 3, key=repr)
            if len(text) > 1e7:
                break
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_empty(spark):
    assert archive_pages(spark.createDataFrame([], PAGES)).count() == 0


def record(kind, block, **fields):
    names = {"WARC-Type": kind, **{k.replace("_", "-"): v for k, v in fields.items()}, "content-length": len(block)}
    head = "".join(f"{k}: {v}\r\n" for k, v in names.items())
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def foreign():
    """Records as another writer makes them, and what is to be read of each."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: image/png\r\n\r\n"
    bodies = [b"\x00\xff\xfe\r\n\r\nWARC/1.0\r\nContent-Length: 2\r\n\r\nWWARC/1.WARC/1.", b"", "é".encode() * 70_000, b"WARC/1." * 3000]
    made = [(record("warcinfo", b"software: x\r\n", WARC_Record_ID="<urn:a>"), ("<urn:a>", "warcinfo", None, b"software: x\r\n"))]
    for i, body in enumerate(bodies):
        fields = {"WARC_Record_ID": f"<urn:{i}>", "WARC_Target_URI": f"http://h/{i}:8", "Content_Type": "application/http; msgtype=response"}
        made.append((record("response", http + body, **fields), (f"<urn:{i}>", "response", f"http://h/{i}:8", body)))
    made.append((record("revisit", http[:-2], WARC_Record_ID="<urn:r>", Content_Type="application/http"), ("<urn:r>", "revisit", None, b"")))
    return made


def test_reads_archives_of_other_writers(spark, tmp_path):
    made = foreign()
    (tmp_path / "members.warc.gz").write_bytes(b"".join(gzip.compress(r) for r, _ in made))
    (tmp_path / "whole.warc.gz").write_bytes(gzip.compress(b"".join(r for r, _ in made)))
    (tmp_path / "plain.warc").write_bytes(b"".join(r for r, _ in made))
    (tmp_path / "empty.warc").write_bytes(b"")
    got = read_warc(spark, str(tmp_path)).collect()
    assert sorted(((r.record_id, r.record_type, r.url, bytes(r.payload)) for r in got), key=repr) == sorted([w for _, w in made] * 3, key=repr)
    assert all(r.payload_digest == hashlib.sha256(r.payload).hexdigest() and r.payload_bytes == len(r.payload) for r in got)


def test_short_and_split_files_are_refused(spark, tmp_path):
    (tmp_path / "cut.warc.gz").write_bytes(gzip.compress(record("response", b"x" * 500)[:-40]))
    with pytest.raises(Exception, match="shorter than it states"):
        read_warc(spark, str(tmp_path / "cut.warc.gz")).collect()
    (tmp_path / "big.warc").write_bytes(record("response", b"x" * 5000))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        with pytest.raises(Exception, match="split among tasks"):
            read_warc(spark, str(tmp_path / "big.warc")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_own_archives_are_ordinary_ones(spark, tmp_path):
    archive = write_archives(resolve_revisits(records(spark.createDataFrame(rows(), PAGES))), str(tmp_path / "own"))
    own = [(r.record_type, (r.payload or "").encode()) for r in read_archives(spark, archive).collect()]
    got = [(r.record_type, bytes(r.payload)) for r in read_warc(spark, archive.path).collect()]
    assert sorted(got) == sorted(own)


def test_stashed_tables_can_be_cleared(spark):
    path = new_path(spark, "x")
    held = stash(spark.range(3), "cleared")
    assert held.count() == 3
    clear(spark)
    with pytest.raises(Exception, match="(?i)not.exist|not.found"):
        held.collect()
    assert "tidemark-" in path
