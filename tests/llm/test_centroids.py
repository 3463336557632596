import hashlib
import math

import numpy as np
import pytest

from tidemark.llm.centroids import LIMIT, centroid_clusters, delta_lloyd, distances, reassign

VECTORS = "vec_id long, embedding array<float>, cluster string, v string, owner string, n long"


def plain(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    name = lambda i: hashlib.sha256(f"1:{'null' if i is None else i}".encode()).hexdigest()
    cs = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in cs]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        owners = assign()
        for c in range(len(cs)):
            own = [v for (_, v), (o, _) in zip(kept, owners, strict=True) if o == c]
            if own:
                cs[c] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = assign()
    sums = [sum(d for o, d in last if o == c) for c in range(len(cs))]
    sha = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    return sorted(((i, o, d, sums[o], sum(sums), sha(cs[o])) for (i, _), (o, d) in zip(kept, last, strict=True)), key=repr)


def rows():
    rng = np.random.default_rng(3)
    centers = rng.normal(0, 1, (9, 64))
    out = [(i, [float(x) for x in centers[i % 9] + rng.normal(0, 0.6, 64)]) for i in range(300)]
    out += [(1000 + i, out[5][1]) for i in range(120)]  # a third are copies of one vector
    out += [(None, out[7][1]), (3, out[8][1]), out[9], out[9]]
    out += [(2000, None), (2001, []), (2002, [0.5] * 63), (2003, [0.5] * 65), (2004, [0.5] * 63 + [None]), (2005, [0.5] * 63 + [float("nan")]), (2006, [0.5] * 63 + [float("inf")])]
    return out


def frame(spark, data):
    return spark.createDataFrame([(i, v, "a", "b", "c", 1) for i, v in data], VECTORS)


def test_equals_plain_lloyd(spark):
    data = rows()
    got = centroid_clusters(frame(spark, data).repartition(5))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(data)


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_vectors(spark, n):
    data = [r for r in rows() if r[0] is None or r[0] >= 2000 or r[0] < n]
    data = [r for r in data if r[0] is not None]
    assert sorted((tuple(r) for r in centroid_clusters(frame(spark, data)).collect()), key=repr) == plain(data)


def test_more_rounds_and_empty_centroids(spark):
    """Rounds in which no centroid moves, and a centroid that loses all its vectors, which stays."""
    points = [(i, [x, 0]) for i, x in enumerate([0, 1, 2, 50, 51, 52, 100])]
    df = spark.createDataFrame(points, "vec_id long, v array<int>")
    got = delta_lloyd(df, [[0, 0], [1, 0], [1000, 1000], [60, 0]], 12)
    owners = {r.vec_id: (r.cluster, r.distance) for r in got.rows.collect()}
    cs = [[0, 0], [1, 0], [1000, 1000], [60, 0]]
    for _ in range(12):
        own = [min(range(4), key=lambda c: ((v[0] - cs[c][0]) ** 2 + cs[c][1] ** 2, c)) for _, v in points]
        for c in range(4):
            some = [v for (_, v), o in zip(points, own, strict=True) if o == c]
            cs[c] = [sum(x) // len(some) for x in zip(*some, strict=True)] if some else cs[c]
    assert got.centroids == cs and cs[2] == [1000, 1000]
    for i, v in points:
        d = [(v[0] - c[0]) ** 2 + c[1] ** 2 for c in cs]
        assert owners[i] == (d.index(min(d)), min(d))


def test_delta_pass_equals_whole_pass():
    rng = np.random.default_rng(5)
    v, c = rng.integers(-3, 4, (500, 4)), rng.integers(-3, 4, (6, 4))  # many ties
    owner, dist = reassign(v, np.full(500, -1), np.zeros(500, np.int64), c, np.ones(6, bool))
    for _ in range(20):
        changed = rng.random(6) < 0.4
        c = np.where(changed[:, None], rng.integers(-3, 4, (6, 4)), c)
        owner, dist = reassign(v, owner, dist, c, changed)
        d = ((v[:, None, :] - c[None]) ** 2).sum(axis=2)
        assert (owner == d.argmin(axis=1)).all() and (dist == d.min(axis=1)).all()


def test_large_components_are_exact_and_held(spark):
    v = np.array([[LIMIT, -LIMIT] * 32])
    assert distances(v, -v)[0, 0] == sum((2 * LIMIT) ** 2 for _ in range(64))
    got = centroid_clusters(frame(spark, [(1, [3e38] * 64), (2, [-3e38] * 64)]), k=1, rounds=0).collect()
    assert sorted(r.distance for r in got) == [0, 64 * (2 * LIMIT) ** 2]
