"""Finding equal keys across documents with a compact shuffle.

A document has items (numbered places), each with a hash key. The task that reads documents sorts
the keys of some million items at once, settles what it can see by itself and sends one entry for
what others must judge, so a key that a third of all documents share reaches the other side once a
million items, not once a document. Entries travel as byte columns, a row for each target partition;
there they are sorted again, and the answers go back in the same form, dealt by document, to become
one row a document. Rows shuffled grow with tasks and partitions, bytes with the items.

Modes: "shared" finds items whose key is in two or more documents; "first" those whose key is also in
a document with a smaller id; "before" those whose key stands earlier in the order of id, tag and
place; "distinct" those whose key comes with two or more different rests (of the items with an equal
key and rest only the earliest).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import mix
from ._store import partitions

#: Items that a task settles at a time.
UNIT = 1 << 20

_PARTS = ["ids", "tags", "owners", "items", "keys", "more", "sure"]
_SENT = "pid int, settled boolean, " + ", ".join(f"{p} binary" for p in _PARTS)
ANSWERS = "doc_id long, tag long, found binary"

#: ids and tags of documents; then for each item the number of its document, its place, its key and
#: the rest of its key (or None): 32 bits more of the key, in mode "distinct" 64 bits beside it.
Items = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]


def _pack(a: np.ndarray, width: int) -> bytes:
    """The first `width` bytes of each number, lowest first, all first bytes before all second ones."""
    return a.view(np.uint8).reshape(len(a), a.itemsize)[:, :width].T.tobytes()


def _unpack(data: bytes, width: int, dtype: type) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], np.dtype(dtype).itemsize), np.uint8)
    out[:, :width] = planes.T
    return out.reshape(-1).view(dtype)


def _groups(keys: np.ndarray, more: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal keys are together, and where each group begins."""
    order = np.argsort(keys)
    k = keys[order]
    fresh = np.concatenate([np.ones(min(1, len(k)), bool), k[1:] != k[:-1]])
    if more is not None and len(k):
        m = more[order]
        if np.any(~fresh[1:] & (m[1:] != m[:-1])):  # equal 64 bits of different keys
            order = np.lexsort((more, keys))
            k, m = keys[order], more[order]
        fresh = np.concatenate([[True], (k[1:] != k[:-1]) | (m[1:] != m[:-1])])
    return order, np.flatnonzero(fresh)


def _verdict(mode: str, place: tuple[np.ndarray, np.ndarray, np.ndarray], keys: np.ndarray, more: np.ndarray | None, sure: np.ndarray | None):
    """An order of (some of) the items by key, where each key's group begins in it, and which items
    are found; place: ids, tags and numbers."""
    ids, tags, items = place
    if mode in ("first", "shared"):
        order, cuts = _groups(keys, more)
        who, sizes = ids[order], np.diff(np.append(cuts, len(order)))
        low = np.minimum.reduceat(who, cuts) if len(cuts) else who
        if mode == "first":
            return order, cuts, who > np.repeat(low, sizes)
        crowd = np.maximum.reduceat(who, cuts) != low if len(cuts) else np.zeros(0, bool)
    else:
        order = np.lexsort((items, tags, ids, more, keys))
        k, m = keys[order], more[order]
        head = np.ones(len(order), bool)
        head[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
        if mode == "before":
            cuts = np.flatnonzero(head)
            first = order[np.repeat(cuts, np.diff(np.append(cuts, len(order))))]
            same = (ids[order] == ids[first]) & (tags[order] == tags[first]) & (items[order] == items[first])
            return order, cuts, ~same
        fresh = np.ones(len(order), bool)
        fresh[1:] = k[1:] != k[:-1]
        told = np.logical_or.reduceat(sure[order], np.flatnonzero(fresh)) if sure is not None and len(order) else False
        order, fresh = order[head], fresh[head]
        cuts = np.flatnonzero(fresh)
        sizes = np.diff(np.append(cuts, len(order)))
        return order, cuts, np.repeat((sizes > 1) | told, sizes)
    if sure is not None and len(cuts):
        crowd = crowd | np.logical_or.reduceat(sure[order], cuts)
    return order, cuts, np.repeat(crowd, sizes)


def _rows(pid: int, settled: bool, docs: tuple[np.ndarray, np.ndarray], entries: tuple, width: int) -> tuple:
    ids, tags = docs
    owners, items, keys, more, sure = entries
    used, owners = np.unique(owners, return_inverse=True)
    steps = np.diff(ids[used], prepend=0)
    return (
        pid, settled, _pack(steps, 8), _pack(tags[used].astype(np.uint32), 4), _pack(owners.astype(np.uint32), 4),
        _pack(items.astype(np.uint32), 4), b"" if keys is None else _pack(keys >> np.uint64(8 * (8 - width)), width),
        b"" if more is None else _pack(more, more.itemsize), b"" if sure is None else np.packbits(sure).tobytes(),
    )


def _send(find: Callable[[Iterator[pa.RecordBatch]], Iterator[Items]], parts: int, mode: str, width: int):
    def settle(unit: list[Items]) -> Iterator[pa.RecordBatch]:
        bases = np.cumsum([0, *(len(u[0]) for u in unit)])
        ids = np.concatenate([u[0] for u in unit])
        tags = np.concatenate([u[1] for u in unit])
        order = np.argsort(ids, kind="stable")  # ids in order are sent as small steps
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        ids, tags = ids[order], tags[order]
        owners = rank[np.concatenate([u[2] + b for u, b in zip(unit, bases, strict=False)])]
        items = np.concatenate([u[3] for u in unit])
        keys = np.concatenate([u[4] for u in unit])
        more = np.concatenate([u[5] for u in unit]) if unit[0][5] is not None else None
        order, cuts, hit = _verdict(mode, (ids[owners], tags[owners], items), keys, more, None)
        owners, items, keys = owners[order], items[order], keys[order]
        more = None if more is None else more[order]
        send, sure = ~hit, None
        if mode in ("shared", "distinct"):
            send[cuts] = True
            sure = hit[send]
        out = []
        at = np.flatnonzero(send)
        pid = _part_of(keys[at], parts)  # in order, as the keys are
        edges = np.searchsorted(pid, np.arange(parts + 1))
        for p in range(parts):
            s = slice(edges[p], edges[p + 1])
            if s.start < s.stop:
                i = at[s]
                out.append(_rows(p, False, (ids, tags), (owners[i], items[i], keys[i], None if more is None else more[i], None if sure is None else sure[s]), width))
        out += _answers(parts, (ids, tags), owners[hit], items[hit])
        if out:
            yield _batch(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = [], 0
        for found in find(batches):
            unit.append(found)
            held += len(found[4])
            if held >= UNIT:
                yield from settle(unit)
                unit, held = [], 0
        if held:
            yield from settle(unit)

    return run


def _answers(parts: int, docs: tuple[np.ndarray, np.ndarray], owners: np.ndarray, items: np.ndarray) -> list[tuple]:
    """Rows that carry items of documents to the partitions of the documents."""
    pid = _part_of(mix(docs[0][owners].astype(np.uint64)), parts)
    order = np.lexsort((items, owners, pid))
    edges = np.searchsorted(pid[order], np.arange(parts + 1))
    return [_rows(p, True, docs, (owners[i], items[i], None, None, None), 8) for p in range(parts) if len(i := order[edges[p] : edges[p + 1]])]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.bool_()), *(pa.array(c, pa.binary()) for c in columns[2:])], ["pid", "settled", *_PARTS]
    )


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _places(parts: dict[str, bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """id, tag and item of each entry of a row."""
    ids = np.cumsum(_unpack(parts["ids"], 8, np.int64))
    owners = _unpack(parts["owners"], 4, np.uint32)
    return ids[owners], _unpack(parts["tags"], 4, np.uint32)[owners], _unpack(parts["items"], 4, np.uint32)


def _judge(mode: str, width: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, hits = [], []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                settled, sent = row[1], dict(zip(_PARTS, row[2:], strict=True))
                got = _places(sent)
                rest = 8 if mode == "distinct" else 4
                if settled:
                    hits.append(got)
                    continue
                more = _unpack(sent["more"], rest, np.dtype(f"u{rest}")) if sent["more"] else None
                sure = np.unpackbits(np.frombuffer(sent["sure"], np.uint8), count=len(got[0])).astype(bool) if sent["sure"] else None
                open_.append((*got, _unpack(sent["keys"], width, np.uint64), more, sure))
        if open_:
            ids, tags, items, keys, more, sure = (None if x[0] is None else np.concatenate(x) for x in zip(*open_, strict=True))
            open_.clear()
            order, cuts, hit = _verdict(mode, (ids, tags, items), keys, more, sure)
            if sure is not None:
                hit = hit & ~sure[order]
            order = order[hit]
            hits.append((ids[order], tags[order], items[order]))
        if hits:
            ids, tags, items = (np.concatenate(x) for x in zip(*hits, strict=True))
            if len(ids):
                order = np.lexsort((tags, ids))
                fresh = np.ones(len(ids), bool)
                fresh[1:] = (np.diff(ids[order]) != 0) | (np.diff(tags[order].astype(np.int64)) != 0)
                owners = np.empty(len(ids), np.int64)
                owners[order] = np.cumsum(fresh) - 1
                docs = order[fresh]
                yield _batch(_answers(parts, (ids[docs], tags[docs]), owners, items))

    return run


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document of a partition."""
    got = [_places(dict(zip(_PARTS, row[2:], strict=True))) for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
    if not got:
        return
    ids, tags, items = (np.concatenate(x) for x in zip(*got, strict=True))
    got.clear()
    order = np.lexsort((items, tags, ids))
    ids, tags, items = ids[order], tags[order].astype(np.int64), items[order]
    cuts = np.flatnonzero(np.concatenate([[True], (np.diff(ids) != 0) | (np.diff(tags) != 0)]))
    ends = np.append(cuts[1:], len(ids))
    for at in range(0, len(cuts), 10_000):
        some = cuts[at : at + 10_000]
        blobs = [items[a:b].tobytes() for a, b in zip(some, ends[at : at + 10_000], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(tags[some]), pa.array(blobs, pa.binary())], ["doc_id", "tag", "found"])


def matching_items(docs: DataFrame, find: Callable[[Iterator[pa.RecordBatch]], Iterator[Items]], mode: str, width: int = 8) -> DataFrame:
    """doc_id, tag, found (32-bit numbers in a binary): one row for each document with such items.

    find turns batches of docs into Items. width: bytes of a key that are compared (with `more`, all).
    A partition holds the entries of its share of the keys, so spark.sql.shuffle.partitions has to
    grow with the input, as for any shuffle.
    """
    parts = partitions(docs.sparkSession)
    sent = docs.mapInArrow(_send(find, parts, mode, width), _SENT)
    judged = sent.repartitionById(parts, F.col("pid")).mapInArrow(_judge(mode, width, parts), _SENT)
    return judged.repartitionById(parts, F.col("pid")).mapInArrow(_gather, ANSWERS)


def items_of(found: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For a column of such binaries: the number of the row, and the item, of each item."""
    items = [np.frombuffer(blob, np.uint32) if blob else np.zeros(0, np.uint32) for blob in found.to_pylist()]
    rows = np.repeat(np.arange(len(items)), [len(x) for x in items])
    return rows, np.concatenate([np.zeros(0, np.int64), *items]).astype(np.int64)
