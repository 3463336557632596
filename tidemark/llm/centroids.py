"""Centroid clustering by delta Lloyd rounds on integer vectors.

The assignment of every vector (its owner and the distance to it) is a table in the shared folder, and
so is what each task adds to the global sums. A round compares a vector whose owner has not moved with
the centroids that have, and one whose owner has moved with all; only vectors that change their owner
count in the sums, as integers that one owner loses and another gains. What comes to the driver is one
vector of sums for each centroid.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import stash

#: Components are held within these bounds, so that a squared distance of 64 of them is below 2**62.
LIMIT = 1 << 27
#: Products and sums of integers below this are exact in doubles, for which there is a fast product.
_EXACT = 1 << 20

_STATE = "vec_id {id}, v array<int>, owner int, dist long, moved array<long>, n long"


@dataclass(frozen=True)
class Clustering:
    """rows(vec_id, cluster, distance), and the centroids in their order."""

    rows: DataFrame
    centroids: list[list[int]]


def integer_vectors(vectors: DataFrame, dims: int = 64, scale: int = 64) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component of the vectors with exactly `dims` components of
    which none is null or not finite. Components beyond LIMIT count as LIMIT."""
    x = F.col("embedding")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    held = F.transform(x, lambda c: F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), F.floor(c.cast("double") * F.lit(float(scale))).cast("double"))).cast("int"))
    return vectors.where(x.isNotNull() & (F.size(x) == dims) & F.coalesce(fine, F.lit(False))).select("vec_id", held.alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of `seed:vec_id` (null as `null`), in that order; equal
    ids by their components. A bounded number of rows comes to the driver."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))
    return [list(r.v) for r in vectors.select("v", F.sha2(named, 256).alias("h")).orderBy("h", "v").limit(k).collect()]


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, exact."""
    most = max(int(np.abs(v).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    a, b = (v.astype(np.float64), centroids.astype(np.float64)) if most < _EXACT and v.shape[1] <= 1024 else (v, centroids)
    return ((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)).astype(np.int64)


def reassign(v: np.ndarray, owner: np.ndarray, dist: np.ndarray, centroids: np.ndarray, changed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Owners and distances after the `changed` centroids have moved; owner -1: none yet. Of equally
    near centroids the first owns."""
    owner, dist = owner.copy(), dist.copy()
    lost = (owner < 0) | changed[owner]
    if lost.any():
        d = distances(v[lost], centroids)
        owner[lost] = d.argmin(axis=1)
        dist[lost] = d.min(axis=1)
    moved, kept = np.flatnonzero(changed), np.flatnonzero(~lost)
    if len(moved) and len(kept):
        d = distances(v[kept], centroids[moved])
        best, near = moved[d.argmin(axis=1)], d.min(axis=1)
        better = (near < dist[kept]) | ((near == dist[kept]) & (best < owner[kept]))
        owner[kept[better]], dist[kept[better]] = best[better], near[better]
    return owner, dist


def _pass(state: DataFrame, centroids: list[list[int]], changed: list[bool], label: str) -> DataFrame:
    """The next state: rows with their owners, and for each task and centroid a row with what its sum
    and number gain or lose (`moved`, `n`)."""
    dims, k = len(centroids[0]), len(centroids)
    schema = _STATE.format(id=state.schema["vec_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, moved = np.array(centroids, np.int64), np.array(changed, bool)
        sums, counts = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        names, kind = ["vec_id", "v", "owner", "dist", "moved", "n"], None
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.schema
            ids, vs = batch.column(0), batch.column(1)
            v = vs.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.int64)
            was = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            owner, dist = reassign(v, was, batch.column(3).to_numpy(zero_copy_only=False).astype(np.int64), c, moved)
            left = owner != was
            for i in range(k):
                gain, loss = left & (owner == i), left & (was == i)
                sums[i] += v[gain].sum(axis=0) - v[loss].sum(axis=0)
                counts[i] += int(gain.sum()) - int(loss.sum())
            none = pa.nulls(len(owner), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, vs, pa.array(owner, pa.int32()), pa.array(dist), none, pa.nulls(len(owner), pa.int64())], names)
        some = np.flatnonzero(counts.astype(bool) | sums.any(axis=1))
        if kind is not None and len(some):
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(some), kind.field(0).type), pa.nulls(len(some), kind.field(1).type), pa.array(some, pa.int32()), pa.nulls(len(some), pa.int64()),
                 pa.array(sums[some].tolist(), pa.list_(pa.int64())), pa.array(counts[some], pa.int64())],
                names,
            )

    return stash(state.mapInArrow(run, schema), label)


def _transfers(state: DataFrame, dims: int) -> dict[int, tuple[int, list[int]]]:
    """What a pass has moved: centroid -> (number, sums)."""
    parts = state.where("moved is not null").groupBy("owner").agg(F.sum("n").alias("n"), *(F.sum(F.get("moved", F.lit(i))).alias(f"s{i}") for i in range(dims)))
    return {r.owner: (r.n, [r[f"s{i}"] for i in range(dims)]) for r in parts.collect()}


def delta_lloyd(vectors: DataFrame, centroids: list[list[int]], rounds: int) -> Clustering:
    """Clusters vectors(vec_id, v array<int>): `rounds` times every vector goes to its nearest centroid
    (squared distance; the first of equal ones) and each centroid with vectors becomes the floor of
    their mean; then vectors are assigned once more. Without centroids there are no rows."""
    if not centroids:
        none = vectors.where("false").select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"))
        return Clustering(none, [])
    state = vectors.select("vec_id", "v", F.lit(-1).alias("owner"), F.lit(0).cast("long").alias("dist"))
    dims, centroids, changed = len(centroids[0]), [list(c) for c in centroids], [True] * len(centroids)
    sums, counts = [[0] * dims for _ in centroids], [0] * len(centroids)
    for i in range(rounds + 1):
        whole = _pass(state, centroids, changed, f"centroids-{i}")
        state = whole.where("moved is null").select("vec_id", "v", "owner", "dist")
        if i == rounds:
            break
        for c, (n, gained) in _transfers(whole, dims).items():
            counts[c] += n
            sums[c] = [a + b for a, b in zip(sums[c], gained, strict=True)]
        fresh = [[s // n for s in total] if n else old for total, n, old in zip(sums, counts, centroids, strict=True)]
        changed = [a != b for a, b in zip(fresh, centroids, strict=True)]
        centroids = fresh
    return Clustering(state.select("vec_id", F.col("owner").alias("cluster"), F.col("dist").alias("distance")), centroids)


def centroid_clusters(embeddings: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, dims: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for every vector of
    embeddings(vec_id, embedding) that integer_vectors keeps; other columns are left out.

    Repeated rows and ids are rows of their own, a null id is an ordinary one. With fewer than k vectors
    there are fewer centroids. A table without vectors gives no rows. An inertia beyond a long is null.
    """
    spark = embeddings.sparkSession
    vectors = stash(integer_vectors(embeddings, dims), "vectors")
    found = delta_lloyd(vectors, first_centroids(vectors, k, seed), rounds)
    named = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(found.centroids)]
    # k rows at most.
    of = found.rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("own")).collect()
    own, total = {r.cluster: int(r.own) for r in of}, sum(int(r.own) for r in of)
    long = lambda x: x if x < 1 << 63 else None
    told = spark.createDataFrame(
        [(i, long(own.get(i, 0)), long(total), h) for i, h in named], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    )
    return found.rows.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
