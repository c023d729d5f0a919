"""Rows of vectors for the two searches: which take part, and blocks of them in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str, vector_col: str, zero_ok: bool) -> DataFrame:
    """(vec_id, v array<double>) of rows that take part: id and vector not null, no null or non-finite
    component, as long as most vectors (the longer of equally frequent lengths); not all zero unless ``zero_ok``."""
    v = F.col("v")
    rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
            .where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size("v") > 0)
                   & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))))
    if not zero_ok:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    sizes = rows.groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return rows.where(F.size("v") == F.lit(sizes["size"] if sizes else 0))


def queries_of(rows: DataFrame, every: int) -> DataFrame:
    """One row per id divisible by ``every``; of rows that repeat an id the least vector asks."""
    return rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy("vec_id").agg(F.min("v").alias("v"))


def block(pack: pa.Array, id_field: str = "vec_id") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, matrix, order) of a list of (id, v) structs, by ascending id; ``order`` are their places in the list."""
    ids = np.asarray(pack.field(id_field)).astype(np.int64)
    v = pack.field("v")
    matrix = np.asarray(v.flatten()).astype(float).reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    return ids[order], matrix[order], order


def merge_best(found: DataFrame, k: int, score_type: str) -> DataFrame:
    """(query_id, rank, vec_id, score) from (query_id, ids array, scores array): per query the k best, ties to
    the smaller id. A query's lists are a few per block it met."""
    kind = {"double": pa.float64(), "bigint": pa.int64()}[score_type]

    def run(table: pa.Table) -> pa.Table:
        ids = np.concatenate([np.asarray(x.flatten()) for x in table.column("ids").chunks]).astype(np.int64)
        scores = np.concatenate([np.asarray(x.flatten()) for x in table.column("scores").chunks])
        order = np.lexsort((ids, -scores))[:k]
        return pa.table({"query_id": pa.array([table.column("query_id")[0].as_py()] * len(order), pa.int64()),
                         "rank": pa.array(np.arange(1, len(order) + 1), pa.int32()), "vec_id": pa.array(ids[order]), "score": pa.array(scores[order], kind)})

    return found.groupBy("query_id").applyInArrow(run, f"query_id bigint, rank int, vec_id bigint, score {score_type}")
