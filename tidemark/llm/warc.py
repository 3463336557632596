"""WARC archives with revisit records for payloads that another record already holds.

Only headers are shuffled by payload digest to find the original response of each payload; revisit
records are joined to it and the archives are written afresh, the payload of a revisit left out.
Records are UTF-8, so Spark's text writer and reader do the input and output: a record ends with the
two line ends that the format asks for, and begins with a version line and a field that names its
archive, which is the separator when the archive is read. Files can be split at any record. The
reader checks lengths and digests, so a record that was cut wrongly cannot pass unnoticed.

Archives of other writers are read by read_warc(): Spark's text reader cuts them at the version mark,
and pieces are joined again until a record has the length that it states.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import new_path, stash

#: Payloads below this are kept in every record.
LEAST_BYTES = 100

_END = "\r\n\r\n"
#: What the records of any archive begin with.
_MARK = "WARC/1."
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    """A folder of WARC files; name: what its records carry in their second line."""

    path: str
    name: str

    @property
    def opening(self) -> str:
        return f"WARC/1.1\r\nWARC-Archive: {self.name}\r\n"


def records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest for pages(page_id, url, html)."""
    html = F.coalesce("html", F.lit(""))
    return pages.select(
        "page_id", "url", html.alias("payload"), F.octet_length(html).cast("long").alias("payload_bytes"), F.sha2(html, 256).alias("payload_digest")
    )


def resolve_revisits(recs: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Adds record_type and refers_to: of equal payloads of least_bytes or more, the record with the
    smallest page_id is the response and the others revisit it.

    Rows that share that smallest id are all responses; a null id is larger than any other, and
    where no id is known all are responses.
    """
    # Payloads that several records hold are few beside all: the table is written, so that its size is
    # known and the payloads need not be shuffled where it is small.
    shared = stash(
        recs.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest")
        .agg(F.min("page_id").alias("original"), F.count("*").alias("_n")).where("_n > 1").drop("_n"),
        "warc-shared",
    )
    revisit = F.col("original").isNotNull() & (F.col("payload_bytes") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("original"))
    return recs.join(shared, "payload_digest", "left").select(
        *recs.columns,
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("original")).alias("refers_to"),
    )


def _urn(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), page_id.cast("string")))
    parts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def write_archives(resolved: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z", compression: str = "gzip") -> Archive:
    """Writes a record for each row and says where; compression: as of Spark's text writer. Only
    uncompressed files are split among readers; with compression a file is read by one task, as it
    was written by one."""
    archive = Archive(path, uuid.uuid4().hex)
    revisit = F.col("record_type") == "revisit"
    block = F.concat(F.lit(_HTTP), F.when(revisit, F.lit("")).otherwise(F.col("payload")))

    def field(name: str, value: Column) -> Column:
        """A header line, or nothing for null."""
        safe = F.regexp_replace(F.regexp_replace(value.cast("string"), "\r", "%0D"), "\n", "%0A")
        return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit("\r\n")), F.lit(""))

    head = F.concat(
        F.lit(archive.opening),
        field("WARC-Type", F.col("record_type")),
        field("WARC-Record-ID", _urn(F.col("page_id"))),
        field("WARC-Date", F.lit(date)),
        field("WARC-Target-URI", F.col("url")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
        field("WARC-Profile", F.when(revisit, _PROFILE)),
        field("WARC-Refers-To", F.when(revisit, _urn(F.col("refers_to")))),
        field("Page-ID", F.col("page_id")),
        field("Refers-To-Page-ID", F.col("refers_to")),
        field("Payload-Length", F.col("payload_bytes")),
        field("Content-Type", F.lit("application/http;msgtype=response")),
        F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(_END),
    )
    resolved.select(F.concat(head, block).alias("value")).write.options(lineSep=_END, compression=compression).text(path)
    return archive


def read_archives(spark: SparkSession, archive: Archive) -> DataFrame:
    """page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload of each record;
    payload is null for a revisit. A record whose length or digest is wrong stops the read."""
    piece = F.col("value")
    ends = F.locate(_END, piece)
    head = F.substring(piece, F.lit(1), ends + 1)
    block = F.substring(piece, ends + len(_END), F.length(piece))

    def field(name: str) -> Column:
        found = F.regexp_extract(F.col("_head"), rf"(?m)^{name}: ([^\r\n]*)", 1)
        return F.when(F.col("_head").contains(f"\n{name}: ") | F.col("_head").startswith(f"{name}: "), found)

    raw = spark.read.option("lineSep", archive.opening).text(archive.path).where(F.length("value") > 0)
    cut = (
        raw.select(head.alias("_head"), block.alias("_rest"))
        .withColumn("_block", F.expr(f"left(_rest, length(_rest) - {len(_END)})"))
        .withColumn("record_type", field("WARC-Type"))
        .withColumn("payload_digest", F.substring(field("WARC-Payload-Digest"), 8, 64))
        .withColumn("payload", F.when(F.col("record_type") == "response", F.expr(f"substring(_block, {len(_HTTP) + 1})")))
    )
    whole = (F.octet_length("_block") == field("Content-Length").cast("int")) & (
        F.col("payload").isNull() | (F.sha2("payload", 256) == F.col("payload_digest"))
    )
    checked = F.when(F.coalesce(whole, F.lit(False)), F.col("payload_digest")).otherwise(
        F.raise_error(F.concat(F.lit("damaged WARC record: "), F.col("_head"))).cast("string")
    )
    return cut.select(
        field("Page-ID").cast("long").alias("page_id"),
        field("WARC-Target-URI").alias("url"),
        "record_type",
        field("Refers-To-Page-ID").cast("long").alias("refers_to"),
        field("Payload-Length").cast("long").alias("payload_bytes"),
        checked.alias("payload_digest"),
        "payload",
    )


def _records_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records (fields, block) of rows (file, piece), which are in the order of their files. One record
    is held at a time; a mark inside of it has cut it into several pieces."""
    parts, size, need, of = [], 0, None, None
    for batch in batches:
        heads, blocks = [], []
        for file, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if parts and file != of:
                raise ValueError(f"a WARC record of {of} is shorter than it states")
            if not parts and not piece:  # what is before the first mark of a file
                continue
            of = file
            parts.append(_MARK.encode() + piece if parts else piece)
            size += len(parts[-1])
            if need is None:
                parts = [b"".join(parts)]
                at = parts[0].find(_END.encode())
                if at < 0:
                    continue
                lines = parts[0][:at].decode("utf-8", "replace").replace("\r\n ", " ").replace("\r\n\t", " ").split("\r\n")[1:]
                fields = [(name.strip().lower(), value.strip()) for name, _, value in (x.partition(":") for x in lines)]
                length = dict(fields).get("content-length", "")
                if not length.isdigit():
                    raise ValueError(f"a WARC record of {of} states no length")
                need = at + len(_END) + int(length)
            if size >= need:
                heads.append(dict(fields))
                blocks.append(b"".join(parts)[at + len(_END) : need])
                parts, size, need = [], 0, None
        column = lambda name: pa.array([h.get(name) for h in heads], pa.string())
        names = ["warc-record-id", "warc-type", "warc-target-uri", "warc-date", "warc-payload-digest", "warc-refers-to", "content-type"]
        yield pa.RecordBatch.from_arrays([*map(column, names), pa.array(blocks, pa.binary())], ["record_id", "record_type", "url", "date", "stated_digest", "refers_to", "content_type", "block"])
    if parts:
        raise ValueError(f"a WARC record of {of} is shorter than it states")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """record_id, record_type, url, date, stated_digest, refers_to, content_type, payload (binary),
    payload_bytes, payload_digest (SHA-256) of each record of WARC files of any writer, plain or gzip
    of one or many members.

    The payload of an HTTP message is what follows its head, of other records the whole block; transfer
    and content encodings are left as they are. Fields that a record lacks are null, repeated ones count
    once (the last). An empty file has no records. A file is read by one task, a record at a time: plain
    files above spark.sql.files.maxPartitionBytes are refused, as are records cut short.
    """
    whole = F.col("_metadata.file_block_length") == F.col("_metadata.file_size")
    compressed = F.col("_metadata.file_path").endswith(".gz")
    file = F.when(whole | compressed, F.col("_metadata.file_path")).otherwise(
        F.raise_error(F.concat(F.lit("a plain WARC file is split among tasks; compress it: "), F.col("_metadata.file_path"))).cast("string")
    )
    pieces = spark.read.option("lineSep", _MARK).text(path).select(file.alias("file"), F.col("value").cast("binary").alias("piece"))
    fields = "record_id string, record_type string, url string, date string, stated_digest string, refers_to string, content_type string"
    found = pieces.mapInArrow(_records_of, f"{fields}, block binary")
    ends = F.locate(_END.encode().hex().upper(), F.hex("block"))
    head = F.when(F.col("content_type").startswith("application/http"), F.when(ends > 0, (ends - 1).cast("int") / 2 + len(_END)).otherwise(F.octet_length("block"))).otherwise(0)
    payload = F.substring(F.col("block"), (head + 1).cast("int"), F.octet_length("block"))
    return found.select("*", payload.alias("payload")).select(
        *found.columns[:-1], "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest")
    )


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes pages(page_id, url, html) to deduplicated archives in the shared folder and reads them
    back: a row as from read_archives for each page.

    A null html is an empty payload; ids and urls may be null. Repeated rows are separate records.
    An empty table gives archives without records. Other columns are not looked at.
    """
    spark = pages.sparkSession
    archive = write_archives(resolve_revisits(records(pages)), new_path(spark, "warc"))
    return read_archives(spark, archive)
