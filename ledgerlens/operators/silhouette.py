"""M3: the mean Euclidean silhouette from a sample of points measured against all rows.

The silhouette of one point needs its distances to every row, so all points would need n^2 of them. Here ``sample``
points, those of least hash, are sent to the tasks (a bounded number); every row adds its distance to each of
them into a sum per (point, cluster). What leaves a task is points x clusters sums, never a pair. The mean over the
points estimates the mean over all rows, with a standard error; a table of at most ``sample`` rows is measured whole.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import ship_package

SAMPLE = 1000
CHUNK = 4096  # rows whose distances to all points are held at once


def distance_sums(x: np.ndarray, label: np.ndarray, points: np.ndarray, clusters: int, sums: np.ndarray) -> None:
    """Adds the Euclidean distances of rows to points into ``sums`` (points, clusters)."""
    for a in range(0, len(x), CHUNK):
        some, mine = x[a:a + CHUNK], label[a:a + CHUNK]
        apart = np.sqrt(((points[:, None, :] - some[None, :, :]) ** 2).sum(axis=2))
        for c in np.unique(mine):
            sums[:, c] += apart[:, mine == c].sum(axis=1)


def sampled_silhouette(df: DataFrame, features: Sequence[str], cluster: str, key: str, sample: int = SAMPLE) -> DataFrame:
    """One row: silhouette, standard_error, sampled, n.

    Rows with a null or NaN feature or a null cluster take no part. A point alone in its cluster has silhouette 0. Fewer
    than two clusters, or no rows, give a null silhouette. Points are those of least MD5 of ``key`` (ties by features).
    """
    spark = df.sparkSession
    features = list(features)
    x = F.array(*[F.col(f).cast("double") for f in features])
    rows = df.select(F.md5(F.col(key).cast("string").cast("binary")).alias("_h"), F.col(cluster).cast("string").alias("_c"), x.alias("_x")).where(
        F.col("_c").isNotNull() & F.forall("_x", lambda v: v.isNotNull() & ~F.isnan(v)))
    sizes = {r["_c"]: r["n"] for r in rows.groupBy("_c").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per cluster
    schema, n = "silhouette double, standard_error double, sampled long, n long", sum(sizes.values())
    if len(sizes) < 2:
        return spark.createDataFrame([(None, None, 0, n)], schema)
    number = {c: i for i, c in enumerate(sorted(sizes))}
    chosen = rows.orderBy(F.col("_h").asc_nulls_last(), "_c", "_x").limit(sample).collect()  # ``sample`` rows
    points = np.array([r["_x"] for r in chosen])
    own = np.array([number[r["_c"]] for r in chosen])
    sent = spark.sparkContext.broadcast(points)

    def run(batches):
        sums = np.zeros((len(sent.value), len(number)))
        for b in batches:
            distance_sums(np.asarray(b.column("_x").flatten()).reshape(b.num_rows, -1), np.array([number[c] for c in b.column("_c").to_pylist()], int), sent.value, len(number), sums)
        point, at = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(point.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(sums[point, at])], ["point", "cluster", "total"])

    ship_package(spark)
    total = np.zeros((len(points), len(number)))
    for r in rows.select("_c", "_x").mapInArrow(run, "point int, cluster int, total double").groupBy("point", "cluster").agg(F.sum("total").alias("t")).toLocalIterator():
        total[r["point"], r["cluster"]] = r["t"]
    size = np.array([sizes[c] for c in sorted(sizes)], float)
    me = np.arange(len(points))
    with np.errstate(divide="ignore", invalid="ignore"):
        inside = total[me, own] / (size[own] - 1)
        others = total / size
        others[me, own] = np.inf
        outside = others.min(axis=1)
        value = np.where(size[own] > 1, np.nan_to_num((outside - inside) / np.maximum(inside, outside)), 0.0)
    error = 0.0 if len(points) == n else float(value.std(ddof=1) / np.sqrt(len(points)) * np.sqrt(1 - len(points) / n)) if len(points) > 1 else None
    return spark.createDataFrame([(float(value.mean()), error, len(points), n)], schema)
