"""M2/M4: Lloyd's iterations of many k-means models at once, one pass over the rows for all of them.

Selecting k takes a fit per k and restart. Each fit by itself pays a Spark job per iteration, hundreds of them. Here a
job moves the centres of every model that has not settled: each task assigns its rows to the nearest centre of each
model, and what leaves it are sums per (model, cluster). A model settles as Spark's own fit does, when none of its
centres moves by more than ``tol``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import ship_package

CHUNK = 1 << 14   # rows whose distances are held at once
STEP = 1 << 13  # rows whose distances to a model's centres stay in a processor's cache
TASK_ROWS = 1 << 14  # tasks hold at least so many rows: smaller ones only add tasks to every iteration
AT_ONCE = 64  # tasks whose sums the driver adds up; those of more meet in a tree


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the nearest centre of each row (ties: the smaller)."""
    return ((centres ** 2).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)


class Centres:
    """A fitted model: its centres, and the assignment of rows to them."""

    def __init__(self, centres: np.ndarray, features_col: str = "features"):
        self.centres, self.features_col = centres, features_col

    def clusterCenters(self) -> list[np.ndarray]:  # noqa: N802 - as Spark's model names it
        return list(self.centres)

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``."""
        centres = self.centres

        def number(x: pa.Array) -> pa.Array:
            return pa.array(nearest(np.asarray(x.flatten()).reshape(len(x), centres.shape[1]), centres).astype(np.int32))

        ship_package(df.sparkSession)
        return df.withColumn("prediction", F.arrow_udf(number, "int")(vector_to_array(F.col(self.features_col))))


def moments(x: np.ndarray, models: Sequence[np.ndarray], sums: Sequence[np.ndarray]) -> None:
    """Adds to ``sums[m]`` (clusters, 1 + features) of each model: rows and feature sums by nearest centre.

    Both are products of matrices: distances of centres to rows, and the 0/1 table of nearest centres with the rows."""
    for a in range(0, len(x), STEP):
        some = x[a:a + STEP]
        columns, ones = np.ascontiguousarray(some.T), np.hstack([np.ones((len(some), 1)), some])
        for centres, into in zip(models, sums):
            apart = (-2 * centres) @ columns
            apart += (centres ** 2).sum(axis=1)[:, None]
            found = (apart == apart.min(axis=0)).astype(float) @ ones
            if found[:, 0].sum() == len(some) and np.isfinite(found).all():
                into += found
                continue
            at = apart.argmin(axis=0)  # a row as near to two centres, or one that is not finite: the smaller number
            into[:, 0] += np.bincount(at, minlength=len(centres))
            for j, column in enumerate(columns):
                into[:, 1 + j] += np.bincount(at, column, len(centres))


def distances(x: np.ndarray, models: Sequence[np.ndarray], sums: Sequence[np.ndarray]) -> None:
    """Adds to ``sums[m]`` (clusters) of each model: squared distances to the nearest centre."""
    for a in range(0, len(x), CHUNK):
        some = x[a:a + CHUNK]
        for centres, into in zip(models, sums):
            at = nearest(some, centres)
            into += np.bincount(at, ((some - centres[at]) ** 2).sum(axis=1), len(centres))


def lloyd(df: DataFrame, starts: Sequence[np.ndarray], features_col: str = "features", max_iter: int = 300,
          tol: float = 1e-9) -> list[tuple[np.ndarray, float]]:
    """(centres, sum of squared distances to them) of every model, iterated from ``starts`` until its centres settle. A
    cluster without rows keeps its centre. Rows with a null vector take no part. Distances are summed once, at the end,
    to the centres that a model's last pass assigned by."""
    models = [np.asarray(s, float) for s in starts]
    before, active = list(models), list(range(len(models)))
    if not models:
        return []
    width = models[0].shape[1]
    blocks = blocks_of(df, features_col, width).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        for _ in range(max_iter):
            if not active:
                break
            found = _summed(blocks, moments, [models[m] for m in active], (1 + width,))
            still = []
            for m, sums in zip(active, found):
                some = sums[:, 0] > 0
                moved = np.where(some[:, None], sums[:, 1:] / np.maximum(sums[:, :1], 1), models[m])
                if ((moved - models[m]) ** 2).sum(axis=1).max() > tol * tol:
                    still.append(m)
                before[m], models[m] = models[m], moved
            active = still
        costs = [float(s.sum()) for s in _summed(blocks, distances, before, ())]
    finally:
        blocks.unpersist()
    return list(zip(models, costs))


def _summed(blocks: RDD, add, sent: list[np.ndarray], shape: tuple[int, ...]) -> list[np.ndarray]:
    """What ``add`` sums over all blocks, an array (clusters, *shape) per model."""
    def run(some):
        sums = [np.zeros((len(c), *shape)) for c in sent]
        for x in some:
            add(x, sent, sums)
        yield sums

    parts = blocks.mapPartitions(run)  # a few sums per cluster
    return parts.reduce(_added) if parts.getNumPartitions() <= AT_ONCE else parts.treeReduce(_added)


def _added(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    return [x + y for x, y in zip(a, b)]


def blocks_of(df: DataFrame, features_col: str, width: int) -> RDD:
    """The rows as arrays of ``CHUNK`` rows at most, dealt to at least ``TASK_ROWS`` rows a task."""
    def run(batches):
        for b in batches:
            flat = np.asarray(b.column(0).flatten(), float)
            yield pa.RecordBatch.from_arrays([pa.array([flat[a:a + CHUNK * width].tobytes() for a in range(0, len(flat), CHUNK * width)], pa.binary())], ["block"])

    spark = df.sparkSession
    ship_package(spark)
    x = df.where(F.col(features_col).isNotNull()).select(vector_to_array(F.col(features_col)).alias("x"))
    tasks = x.count() // TASK_ROWS + 1
    if tasks < spark.sparkContext.defaultParallelism:
        x = x.coalesce(tasks)
    return x.mapInArrow(run, "block binary").rdd.map(lambda r: np.frombuffer(r[0]).reshape(-1, width))
