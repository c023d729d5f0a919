"""Centroid clustering of whole-number vectors with Ptolemaic pivots (operator 13).

Every vector is assigned to its nearest centroid, exactly; the centroids then move to the floor of their
vectors' mean; a few rounds of this, and a last assignment. The start centroids stay as fixed pivots: each
vector's distances to them are computed once and kept beside it in a written table. For two pivots p, s
Ptolemy's inequality bounds the distance of a vector o and a centroid c from below,

    d(o, c) >= |d(c, p) d(o, s) - d(c, s) d(o, p)| / d(p, s),

and the greatest bound over the fixed pairs counts. Bounds are rounded down by far more than the doubles they
are computed in can be off (``ROUND``). A vector takes centroids by ascending bound, checks each survivor with
whole numbers, and ends where a bound is above the best distance found; equal bounds are checked, so ties
go to the smaller number. A round moves sums of vectors only: each task adds up what it assigned, 64 sums
per centroid, and Spark adds up the tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.tables import arrow_map, written

#: Relative error granted to bounds computed in doubles, whose own is below 2^-50.
ROUND = 2.0 ** -46
#: Components below this have squared distances and sums inside 64 bits; larger ones are computed in Python's integers.
SMALL = 1 << 26
MOST = (1 << 63) - 1
CHUNK = 8192  # vectors whose bounds are held at once


def whole_rows(vectors: DataFrame, dims: int, scale: int, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<bigint>): floor(scale * x) of the vectors that take part."""
    v = F.col(vector_col)
    fits = v.isNotNull() & (F.size(v) == dims) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (vectors.where(fits)
            .select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")))


def start_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors of least sha256 of ``seed:vec_id``; rows without id come last, ties by the vector."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return np.array([r["v"] for r in rows.select("v", h.alias("h")).orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()], object)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), dims)


def exact_kind(*arrays: np.ndarray):
    """int64 where squared distances fit in it, else Python's integers."""
    return np.int64 if all((abs(a) < SMALL).all() for a in arrays if a.size) else object


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    kind = exact_kind(x.astype(object) if x.dtype == object else x, y)
    d = x.astype(kind) - y.astype(kind)
    return (d * d).sum(axis=-1)


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """(vectors, points), in doubles."""
    return np.stack([np.sqrt(squared(x, p[None, :]).astype(float)) for p in points], axis=1) if len(points) else np.zeros((len(x), 0))


def pivot_pairs(pivots: np.ndarray) -> list[tuple[int, int, float]]:
    """Each pivot with its farthest and its nearest other, where these are not the same point: (p, s, d(p, s))."""
    apart = distances(pivots, pivots)
    pairs = set()
    for p in range(len(pivots)):
        others = [s for s in range(len(pivots)) if apart[p, s] > 0]
        if others:
            pairs |= {tuple(sorted((p, pick(others, key=lambda s: apart[p, s])))) for pick in (min, max)}
    return [(p, s, float(apart[p, s])) for p, s in sorted(pairs)]


def lower_bounds(to_pivots: np.ndarray, centroid_to_pivots: np.ndarray, pairs) -> np.ndarray:
    """(vectors, centroids): distances are at least this."""
    least = np.zeros((len(to_pivots), len(centroid_to_pivots)))
    for p, s, apart in pairs:
        a = to_pivots[:, s, None] * centroid_to_pivots[None, :, p]
        b = to_pivots[:, p, None] * centroid_to_pivots[None, :, s]
        np.maximum(least, (np.abs(a - b) - ROUND * (a + b)) / apart, out=least)
    return least * (1 - ROUND)


def nearest(x: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, centroid_to_pivots: np.ndarray, pairs):
    """(number, squared distance, centroids checked) of each vector's nearest centroid, ties to the smaller number."""
    kind = exact_kind(x, centroids)
    x, centroids = x.astype(kind), centroids.astype(kind)
    bound = lower_bounds(to_pivots, centroid_to_pivots, pairs) ** 2 * (1 - ROUND)
    order = np.argsort(bound, axis=1, kind="stable")
    best, found, checked = np.zeros(len(x), kind), np.full(len(x), len(centroids)), np.zeros(len(x), np.int32)
    alive = np.arange(len(x))
    for turn in range(len(centroids)):
        c = order[alive, turn]
        if turn:
            alive = alive[bound[alive, c] <= best[alive].astype(float) * (1 + ROUND)]
            c = order[alive, turn]
        if not len(alive):
            break
        gap = x[alive] - centroids[c]
        d = (gap * gap).sum(axis=1)
        checked[alive] += 1
        better = (found[alive] == len(centroids)) | (d < best[alive]) | ((d == best[alive]) & (c < found[alive]))
        best[alive[better]], found[alive[better]] = d[better], c[better]
    return found, best, checked


class Rounds:
    """What the tasks of one assignment need: the centroids, the pivots' pairs and their distances."""

    def __init__(self, centroids: np.ndarray, pivots: np.ndarray, pairs):
        self.centroids, self.pairs, self.to_pivots = centroids, pairs, distances(centroids, pivots)

    def of(self, batch: pa.RecordBatch):
        """(ids, vectors, number, squared distance, checked) of slices of a batch."""
        dims = self.centroids.shape[1]
        x, to_pivots = matrix(batch.column("v"), dims), matrix(batch.column("to_pivots"), len(self.to_pivots[0]))
        for a in range(0, len(x), CHUNK):
            some = slice(a, a + CHUNK)
            yield batch.column("vec_id").slice(a, CHUNK), x[some], *nearest(x[some], to_pivots[some], self.centroids, self.to_pivots, self.pairs)


def moved(rows: DataFrame, now: Rounds) -> np.ndarray:
    """The centroids after one round."""
    k, dims = now.centroids.shape

    def run(batches):
        count, sums = np.zeros(k, np.int64), np.zeros((k, dims), object)
        for b in batches:
            for _, x, found, _, _ in now.of(b):
                kind = exact_kind(x)
                for c in np.unique(found):
                    mine = x[found == c].astype(kind)
                    count[c] += len(mine)
                    sums[c] += mine.sum(axis=0).astype(object)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]),
                                          pa.array([[int(s) for s in sums[c]] for c in some], pa.list_(pa.decimal128(38, 0)))], ["cluster", "n", "sums"])

    parts = arrow_map(rows, run, "cluster int, n bigint, sums array<decimal(38,0)>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dims)])
    centroids = now.centroids.copy()
    for r in total.collect():  # k rows
        centroids[r["cluster"]] = [int(r[f"s{i}"]) // r["n"] for i in range(dims)]
    return centroids


def assigned(rows: DataFrame, now: Rounds) -> DataFrame:
    """(vec_id, cluster, distance, checked)."""
    def run(batches):
        for b in batches:
            for ids, _, found, best, checked in now.of(b):
                yield pa.RecordBatch.from_arrays([ids, pa.array(found.astype(np.int32)), pa.array([min(int(d), MOST) for d in best], pa.int64()), pa.array(checked)],
                                                 ["vec_id", "cluster", "distance", "checked"])

    return arrow_map(rows, run, "vec_id bigint, cluster int, distance bigint, checked int")


def cluster_vectors(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, seed: int = 1,
                    id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid, checked): the exact result of
    ``rounds`` rounds and a last assignment; ``checked``: centroids the last assignment compared the vector with.

    Vectors that are null, not ``dims`` long, or hold a null or non-finite component take no part. Rows
    without id are clustered like others and start a centroid only where ids are too few. Rows that repeat an
    id are separate vectors; of equal hashes the smaller vector starts first. Fewer vectors than ``k``
    give as many centroids. Ties go to the smaller number; a centroid without vectors stays. Components whose
    whole number is beyond 64 bits are held at its limits, and so are distances and inertias. Other columns are not
    read. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = written(whole_rows(vectors, dims, scale, id_col, vector_col), "centroid-vectors")
    pivots = start_centroids(rows, k, seed)
    if not len(pivots):
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, "
                                         "centroid_sha256 string, centroid array<bigint>, checked int")

    def with_distances(batches):
        for b in batches:
            to = distances(matrix(b.column("v"), dims), pivots)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("v"), pa.ListArray.from_arrays(
                pa.array(np.arange(len(to) + 1, dtype=np.int32) * len(pivots)), pa.array(to.ravel()))], ["vec_id", "v", "to_pivots"])

    cached = written(arrow_map(rows, with_distances, "vec_id bigint, v array<bigint>, to_pivots array<double>"), "centroid-pivots")
    pairs, centroids = pivot_pairs(pivots), pivots
    for _ in range(rounds):
        centroids = moved(cached, Rounds(centroids, pivots, pairs))
    result = written(assigned(cached, Rounds(centroids, pivots, pairs)), "centroid-result")
    inertia = {r["cluster"]: int(r["s"]) for r in result.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    numbers = [(c, min(s, MOST), min(sum(inertia.values()), MOST), hashlib.sha256(",".join(str(int(x)) for x in centroids[c]).encode()).hexdigest(),
                [int(x) for x in centroids[c]]) for c, s in inertia.items()]  # k rows
    about = spark.createDataFrame(numbers, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string, centroid array<bigint>")
    return result.join(F.broadcast(about), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "centroid", "checked")
