"""K-means with Ptolemaic pivots against a plain version with whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from fitledger.llm import centroids as C

VECTORS = "vec_id long, embedding array<double>, cluster string, v int, label int, distance int"


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, e, "x", 1, 2, 3) for i, e in rows], VECTORS).repartition(parts)


def plain(rows, k=C.CENTROIDS, rounds=C.ROUNDS, seed=2):
    kept = [(i, e) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    kept = [(i, e, [math.floor(256 * x) for x in e]) for i, e in kept if max(abs(math.floor(256 * x)) for x in e) <= C.LARGEST]
    kept.sort(key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centers = [v for *_, v in kept[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers))

    for _ in range(rounds):
        groups = {}
        for *_, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, members in groups.items():
            centers[j] = [sum(x) // len(members) for x in zip(*members)]
    found = [(i, *nearest(v)) for i, _, v in kept]
    inertia = {}
    for _, d, j in found:
        inertia[j] = inertia.get(j, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return [(i, j, d, inertia[j], sum(inertia.values()), sha[j]) for i, d, j in found]


def check(spark, rows):
    got = C.cluster_digest(table(spark, rows)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain(rows)))


def test_random_and_odd_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=64).round(2).tolist()) for i in range(300)]
    odd = [(1000, None), (1001, []), (1002, [0.5] * 63), (1003, [0.5] * 65), (1004, [0.5] * 63 + [None]), (1005, [0.5] * 63 + [float("nan")]),
           (1006, [0.5] * 63 + [float("inf")]), (1007, [-float("inf")] + [0.5] * 63), (None, [0.25] * 64), (None, [0.125] * 64), (7, rows[7][1]), (8, rows[9][1]),
           (-3, [-0.0] * 64), (-4, [-1 / 256] * 64), (-5, [-1e-12] * 64)]
    check(spark, rows + odd)


def test_ties_and_copies(spark):
    """A third of all rows are one vector, and many others have several nearest centroids."""
    rng = np.random.default_rng(5)
    rows = [(i, [1.0] * 64) for i in range(120)] + [(i, (rng.integers(0, 2, 64) * 0.5).tolist()) for i in range(120, 260)]
    rows += [(i, [0.0] * 32 + [float(i % 3)] * 32) for i in range(260, 360)]
    check(spark, rows)


@pytest.mark.parametrize("n", [1, 2, 39, 41])
def test_few_vectors(spark, n):
    check(spark, [(i, [float(i % 5), *([0.5 * i] * 63)]) for i in range(n)])


def test_equal_vectors_only(spark):
    check(spark, [(i, [2.0] * 64) for i in range(50)])


def test_empty_tables(spark):
    for rows in ([], [(1, None), (2, [1.0])]):
        got = C.cluster_digest(table(spark, rows))
        assert got.collect() == [] and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_vectors_too_large_for_distances(spark):
    rows = [(i, [float(i)] * 64) for i in range(5)]
    got = {r.vec_id: r for r in C.cluster_digest(table(spark, [*rows, (9, [1e30] * 64), (10, [-(2.0**18) - 1] + [0.0] * 63)])).collect()}
    assert len(got) == 7 and got[9].cluster is None and got[10].distance is None and got[9].inertia is None
    assert sorted(tuple(r) for i, r in got.items() if i < 9) == sorted(plain(rows))
    # the largest that take part
    edge = [(i, [(-1) ** i * 2.0**18] * 64) for i in range(4)] + [(8, [0.0] * 64)]
    check(spark, edge)


def test_pivots_leave_out_far_centroids(spark):
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(20, 64)) * 4
    rows = [(i, (centers[i % 20] + rng.normal(size=64) * 0.02).tolist()) for i in range(1500)]
    assigned, *_ = C.cluster(table(spark, rows), rounds=1)
    found = assigned.collect()
    assert {r.vec_id: (r.cluster, r.distance) for r in found} == {i: (j, d) for i, j, d, *_ in plain(rows, rounds=1)}
    assert sum(r.checked for r in found) / len(found) < 10


def test_bounds_never_exceed_distances():
    rng = np.random.default_rng(7)
    for scale in (1, 30, 10_000, C.LARGEST):
        v = rng.integers(-scale, scale + 1, (200, 64))
        c = np.concatenate([v[:20], v[:20] + 1, rng.integers(-scale, scale + 1, (20, 64))]).clip(-scale, scale)
        pivots, pairs = C.choose_pivots(c, 8)
        n = C.Nearest(c, pivots, pairs)
        near = np.sqrt(C.squared(v, pivots).astype(float))
        exact = C.squared(v, c)
        bounds = C.lower_bounds(near, n.centroid_pivots, n.apart, pairs)
        assert (bounds <= exact * (1 + C.SLACK)).all() and bounds.max() > 0
        cluster, distance, _ = n.find(v, near)
        assert (distance == exact.min(1)).all() and (cluster == exact.argmin(1)).all()


def test_pivots_are_distinct():
    points = np.repeat(np.arange(3), 5)[:, None] * np.ones((1, 64), np.int64)
    pivots, pairs = C.choose_pivots(points, 8)
    assert len(pivots) == 3 and set(pairs) == {(0, 1), (0, 2), (1, 2)}
    assert C.choose_pivots(points[:0], 8)[1] == [] and C.choose_pivots(points[:5], 8)[1] == []
