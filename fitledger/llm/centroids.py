"""Exact k-means on integer vectors, with Ptolemaic pivots to leave out centroids.

Ptolemy's inequality holds between any four points of a Euclidean space: for a vector x, a centroid
c and two pivots p and s, |x c| * |p s| >= | |x p| * |c s| - |x s| * |c p| |. So the distances of a
vector to a few fixed pivots, computed once and kept beside it, bound its distance to any
centroid from below, with the centroid's own few pivot distances. Each round

1. bounds all centroids by all pivot pairs and takes the one with the least bound as a first guess,
2. checks the guess exactly, and
3. checks exactly every other centroid whose bound does not exceed the guess's distance.

Bounds are computed in doubles and lowered by ``SLACK``, far more than rounding can add, and a centroid
goes only where its bound is strictly greater; so ties and near ties are always settled by the exact
squared distances, which are 64-bit integers.

Each round reads the vectors once and sends k rows of sums per task to the next aggregate; the driver
gets k sums of 64 numbers. Nothing depends on how many vectors a cluster has.

Defined results
* Kept are vectors of exactly ``DIMENSIONS`` components, none null, NaN or infinite. Others have no row.
* A component x becomes floor(256 * x). Vectors with an integer beyond ``LARGEST`` in size have no
  64-bit squared distances: they take no part, and come back with null in all columns but vec_id.
* Repeated rows are vectors of their own. The first centroids are the first k rows by hash of vec_id, then by
  content (a null vec_id hashes as an empty one); with fewer rows there are fewer centroids.
* Ties go to the smaller centroid number. A centroid without vectors stays where it is.
* An empty table, or none kept, gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, stored

DIMENSIONS = 64
SCALE = 256
LARGEST = 2**26
CENTROIDS = 40
ROUNDS = 5
# Pivots, all taken from the first centroids, and how many of their pairs are used.
PIVOTS = 12
PAIRS = 12
# Part of a product of distances by which a bound is lowered. A double's relative error is 2**-53 an operation.
SLACK = 1e-12
# Rows worked on at once.
ROWS = 2_000

PREPARED = "vec_id long, v binary, pivots binary"
ASSIGNED = "vec_id long, cluster int, distance long, checked int"


def usable(embedding: Column) -> Column:
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(embedding) == DIMENSIONS) & ~bad, F.lit(False))


def kept_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and ``x``, the components as doubles, of the vectors that are kept."""
    return embeddings.filter(usable(F.col("embedding"))).select(
        F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("x"))


def _fits() -> Column:
    return F.forall("x", lambda x: F.abs(F.floor(x * SCALE)) <= LARGEST)


def integers(x: pa.Array) -> np.ndarray:
    """floor(256 * x) of a batch's vectors, one row each."""
    flat = x.flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat * SCALE).astype(np.int64).reshape(-1, DIMENSIONS)


def first_centroids(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    rows = vectors.select(key.alias("key"), "x").orderBy("key", "x").limit(k).collect()
    return np.floor(np.array([r.x for r in rows], np.float64).reshape(len(rows), DIMENSIONS) * SCALE).astype(np.int64)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances between all rows of a and all rows of b."""
    return np.stack([((a - row) ** 2).sum(1) for row in b], axis=1) if len(b) else np.zeros((len(a), 0), np.int64)


def choose_pivots(points: np.ndarray, n: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """(at most ``n`` distinct points, each the farthest from those before it; the pairs used, farthest first,
    such that every pivot gets a turn)."""
    if not len(points):
        return points, []
    chosen, nearest = [0], squared(points, points[:1])[:, 0]
    while len(chosen) < n and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, squared(points, points[chosen[-1:]])[:, 0])
    pivots = points[chosen]
    apart = squared(pivots, pivots)
    # in a circle, so that each pivot is in two pairs; then the farthest of the others
    circle = [tuple(sorted((i, (i + 1) % len(pivots)))) for i in range(len(pivots))] if len(pivots) > 1 else []
    others = sorted(set(combinations(range(len(pivots)), 2)) - set(circle), key=lambda p: (-apart[p], p))
    return pivots, list(dict.fromkeys([*circle, *others]))[:PAIRS]


def lower_bounds(to_pivots: np.ndarray, centroid_pivots: np.ndarray, apart: np.ndarray, pairs: list[tuple[int, int]]) -> np.ndarray:
    """Squared lower bounds (vectors x centroids) from distances to pivots; never above the true value."""
    best = np.zeros((len(to_pivots), len(centroid_pivots)))
    for p, s in pairs:
        one = to_pivots[:, p, None] * centroid_pivots[None, :, s]
        two = to_pivots[:, s, None] * centroid_pivots[None, :, p]
        np.maximum(best, (np.abs(one - two) - SLACK * (one + two)) / apart[p, s], out=best)
    return best * best * (1 - SLACK)


class Nearest:
    """Nearest centroid of vectors with cached pivot distances."""

    def __init__(self, centroids: np.ndarray, pivots: np.ndarray, pairs: list[tuple[int, int]]):
        self.centroids, self.pairs = centroids, pairs
        self.centroid_pivots = np.sqrt(squared(centroids, pivots).astype(np.float64))
        self.apart = np.sqrt(squared(pivots, pivots).astype(np.float64))

    def find(self, v: np.ndarray, to_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(cluster, squared distance, number of exact checks) of each vector."""
        bounds = lower_bounds(to_pivots, self.centroid_pivots, self.apart, self.pairs)
        guess = bounds.argmin(1)
        distance = ((v - self.centroids[guess]) ** 2).sum(1)
        # a whole number up to 2**60 as a double is off by less than SLACK
        left = bounds <= distance[:, None] * (1 + SLACK)
        left[np.arange(len(v)), guess] = False
        best, checked = guess.copy(), left.sum(1) + 1
        for j in np.flatnonzero(left.any(0)).tolist():
            # the distance found so far may have come down below the bound
            rows = np.flatnonzero(left[:, j] & (bounds[:, j] <= distance * (1 + SLACK)))
            d = ((v[rows] - self.centroids[j]) ** 2).sum(1)
            better = (d < distance[rows]) | ((d == distance[rows]) & (j < best[rows]))
            best[rows[better]], distance[rows[better]] = j, d[better]
        return best, distance, checked


def _prepare(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, ROWS):
            v = integers(b.column("x"))
            near = np.sqrt(squared(v, pivots).astype(np.float64))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([r.tobytes() for r in v.astype(np.int32)], pa.binary()),
                                              pa.array([r.tobytes() for r in near], pa.binary())], names=["vec_id", "v", "pivots"])
    return run


def _rows(b: pa.RecordBatch, n_pivots: int) -> tuple[np.ndarray, np.ndarray]:
    v = np.frombuffer(b"".join(b.column("v").to_pylist()), np.int32).reshape(-1, DIMENSIONS).astype(np.int64)
    return v, np.frombuffer(b"".join(b.column("pivots").to_pylist()), np.float64).reshape(-1, n_pivots)


def _sums(nearest: Nearest, n_pivots: int):
    """One row per centroid and task: vectors and their componentwise sum."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(nearest.centroids)
        counts, sums = np.zeros(k, np.int64), np.zeros((k, DIMENSIONS), np.int64)
        for b in chunks(batches, ROWS):
            v, near = _rows(b, n_pivots)
            cluster = nearest.find(v, near)[0]
            counts += np.bincount(cluster, minlength=k)
            order = np.argsort(cluster, kind="stable")
            some, starts = np.unique(cluster[order], return_index=True)
            sums[some] += np.add.reduceat(v[order], starts, axis=0)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))],
                                         names=["cluster", "n", "sums"])
    return run


def _assign(nearest: Nearest, n_pivots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, ROWS):
            cluster, distance, checked = nearest.find(*_rows(b, n_pivots))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(checked.astype(np.int32))],
                                             names=["vec_id", "cluster", "distance", "checked"])
    return run


def moved(prepared: DataFrame, nearest: Nearest, n_pivots: int) -> np.ndarray:
    """The centroids after one round. Sums are exact decimals, of any number of vectors."""
    parts = prepared.mapInArrow(_sums(nearest, n_pivots), "cluster int, n long, sums array<long>")
    totals = parts.select("cluster", "n", F.posexplode("sums").alias("place", "part")).groupBy("cluster", "place").agg(
        F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    centroids = nearest.centroids.copy()
    # k times 64 rows, however many vectors there are
    for r in totals.collect():
        centroids[r.cluster, r.place] = int(r.total) // int(r.n)
    return centroids


def cluster(embeddings: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 2, n_pivots: int = PIVOTS) -> tuple[DataFrame, np.ndarray, DataFrame]:
    """(vec_id, cluster, distance and ``checked``, the exact distances computed, of every vector; the final
    centroids; vec_ids of vectors too large for 64-bit distances)."""
    kept = kept_vectors(embeddings)
    vectors = kept.filter(_fits())
    centroids = first_centroids(vectors, k, seed)
    pivots, pairs = choose_pivots(centroids, n_pivots)
    # cached for all rounds; a lost executor reads it again
    prepared = stored(vectors.mapInArrow(_prepare(pivots), PREPARED), "pivot-distances")
    for _ in range(rounds):
        centroids = moved(prepared, Nearest(centroids, pivots, pairs), len(pivots))
    assigned = prepared.mapInArrow(_assign(Nearest(centroids, pivots, pairs), len(pivots)), ASSIGNED)
    return assigned, centroids, kept.filter(~_fits()).select("vec_id")


def centroid_hash(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()


def cluster_digest(embeddings: DataFrame) -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = embeddings.sparkSession
    assigned, centroids, large = cluster(embeddings)
    assigned = stored(assigned, "assigned")
    inertia = assigned.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    # one row per centroid
    sums = {r.cluster: r.cluster_inertia for r in inertia.collect()}
    rows = [(j, sums.get(j, 0), sum(sums.values()), centroid_hash(c)) for j, c in enumerate(centroids)]
    about = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return assigned.join(F.broadcast(about), "cluster").select(*columns).unionByName(large, allowMissingColumns=True)


def cluster_sql(k: int = CENTROIDS, rounds: int = ROUNDS) -> str:
    """SQL of the same by comparing every vector with every centroid."""
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (
  SELECT row_id, cluster, distance FROM (
    SELECT v.row_id, c.cluster, sum((v.x - c.x) * (v.x - c.x))::BIGINT AS distance
    FROM parts v JOIN c{i} c ON c.place = v.place GROUP BY 1, 2)
  QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY distance, cluster) = 1)""")
        if i < rounds:
            steps.append(f"""
c{i + 1} AS MATERIALIZED (
  SELECT c.cluster, c.place, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN (
    SELECT a.cluster, v.place, (sum(v.x) - ((sum(v.x) % count(*)) + count(*)) % count(*))::BIGINT // count(*) AS x
    FROM parts v JOIN a{i} a USING (row_id) GROUP BY 1, 2) m ON m.cluster = c.cluster AND m.place = c.place)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, embedding, row_number() OVER (ORDER BY sha256('2:' || vec_id::VARCHAR), embedding) - 1 AS row_id
  FROM embeddings
  WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT row_id, place, floor({SCALE} * embedding[place]::DOUBLE)::BIGINT AS x FROM kept, range(1, {DIMENSIONS + 1}) t(place)),
c0 AS MATERIALIZED (SELECT row_id::INTEGER AS cluster, place, x FROM parts WHERE row_id < {k}),{','.join(steps)},
h AS (SELECT cluster, sha256(string_agg(x::VARCHAR, ',' ORDER BY place)) AS centroid_sha256 FROM c{rounds} GROUP BY 1)
SELECT vec_id, a.cluster, distance, (sum(distance) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, centroid_sha256
FROM kept JOIN a{rounds} a USING (row_id) JOIN h ON h.cluster = a.cluster
"""
