"""Exact top-k search by inner product with KD-trees per shard (operator 6).

Rows are dealt to shards of about ``SHARD`` rows by a hash of their id. Each shard is a KD-tree: median
splits on the widest dimension, tight bounding boxes. A box bounds the score of any vector inside it
(per dimension the better of the two faces), so a query takes its best leaf first and leaves out those
whose bound cannot reach its kth score. What queries of a block ask of a leaf is one product of matrices.

The kth score is propagated: a query first searches its home shard, and goes to the other shards
with the kth score found there as its starting bound. Queries travel in blocks; what comes back
from a block and shard are at most k rows per query. Equal bounds are followed, so ties are exact.

Whole numbers compress well, so the files of shards and queries may be small enough for Spark to broadcast what is
many times as large in memory: shards meet their blocks in a shuffle, so no vectors reach the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.tables import arrow_map, written
from ledgerlens.llm.vectors import block, merge_best, queries_of, usable

SHARD = 8192
LEAF = 128
QUERY_BLOCK = 256


class Tree:
    """KD-tree of one shard: nodes in one list, boxes in two matrices, leaves as slices of the rows."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, leaf: int = LEAF):
        order, nodes, low, high = np.arange(len(ids)), [], [], []
        todo = [(0, len(ids), None)]
        while todo:
            a, z, parent = todo.pop()
            rows = x[order[a:z]]
            low.append(rows.min(axis=0))
            high.append(rows.max(axis=0))
            me = len(nodes)
            nodes.append([a, z, -1, -1])
            if parent is not None:
                nodes[parent[0]][parent[1]] = me
            wide = int((high[-1] - low[-1]).argmax())
            if z - a > leaf and high[-1][wide] > low[-1][wide]:
                middle = (z - a) // 2
                order[a:z] = order[a:z][np.argpartition(rows[:, wide], middle)]
                todo += [(a, a + middle, (me, 2)), (a + middle, z, (me, 3))]
        self.nodes, self.low, self.high = nodes, np.array(low), np.array(high)
        self.ids, self.x = ids[order], x[order]
        self.size = np.abs(x).max(initial=0)

    def bounds(self, q: np.ndarray) -> np.ndarray:
        """(queries, nodes): the greatest score that a vector inside each box can have, exact or above."""
        if q.shape[1] * self.size * np.abs(q).max(initial=0) < 2.0 ** 53:
            return np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T
        return np.full((len(q), len(self.nodes)), np.inf)

    def search(self, q_ids: np.ndarray, q: np.ndarray, kth: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the block, id, score) of the k best rows of this shard for each query of a block that reach its ``kth``, ties
        to the smaller id. Each query takes its best leaf first; the others are taken leaf by leaf by all queries that it can serve."""
        leaves = np.array([n for n, node in enumerate(self.nodes) if node[2] < 0])
        bounds, kth = self.bounds(q)[:, leaves], np.array(kth, float)
        first = bounds.argmax(axis=1)
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))

        def visit(leaf: int, some: np.ndarray) -> None:
            nonlocal held
            some = some[bounds[some, leaf] >= kth[some]]
            if not len(some):
                return
            a, z = self.nodes[leaves[leaf]][:2]
            scores = self.scores(a, z, q[some])
            at, row = np.nonzero(scores >= kth[some, None])
            other = self.ids[a + row] != q_ids[some[at]]
            at, row = at[other], row[other]
            if len(at):
                held = best_of_each(*(np.concatenate(x) for x in zip(held, (some[at], self.ids[a + row], scores[at, row].astype(np.int64)))), k)
                place, number = np.unique(held[0], return_counts=True)
                full = place[number == k]
                kth[full] = np.maximum(kth[full], held[2][np.searchsorted(held[0], full, "right") - 1])

        for leaf in np.unique(first).tolist():
            visit(leaf, np.flatnonzero(first == leaf))
        for leaf in np.argsort(-bounds.max(axis=0, initial=-np.inf), kind="stable").tolist():
            visit(leaf, np.flatnonzero(first != leaf))
        return held

    def scores(self, a: int, z: int, q: np.ndarray) -> np.ndarray:
        """(queries, rows): integer inner products; in doubles where every sum is exact in them."""
        if q.shape[1] * self.size * np.abs(q).max(initial=0) < 2.0 ** 53:
            return q @ self.x[a:z].T
        return q.astype(np.int64) @ self.x[a:z].astype(np.int64).T


def best_of_each(at: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each ``at``, which ascends: highest score, ties to the smaller id."""
    order = np.lexsort((ids, -scores, at))
    at = at[order]
    kept = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[kept], ids[order][kept], scores[order][kept]


def integer_rows(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): components floor(256 * x), as doubles that hold whole numbers."""
    rows = usable(vectors, id_col, vector_col, zero_ok=True)
    return rows.select("vec_id", F.transform("v", lambda x: F.floor(x * 256).cast("double")).alias("v"))


def _search_shards(asked: DataFrame, entries: DataFrame, k: int) -> DataFrame:
    """(query_id, ids, scores): every block of (shard, asked) in the tree of (shard, entries). Both go to the shard's task, where
    its entries come first: they are read once for all blocks, and nothing is broadcast, however small the files."""
    kind = lambda df, c: df.schema[c].dataType
    both = (entries.select("shard", F.lit(None).cast(kind(asked, "asked")).alias("asked"), "entries")
            .unionByName(asked.select("shard", "asked", F.lit(None).cast(kind(entries, "entries")).alias("entries")))
            .repartition("shard").sortWithinPartitions("shard", F.col("entries").isNull()))

    def run(batches):
        shard, tree = None, None
        for b in batches:
            for r in range(b.num_rows):
                if b.column(2)[r].is_valid:
                    shard, tree = b.column(0)[r].as_py(), Tree(*block(b.column(2)[r].values)[:2])
                if not b.column(1)[r].is_valid or b.column(0)[r].as_py() != shard:
                    continue  # a shard may be without entries
                pack = b.column(1)[r].values
                names = np.asarray(pack.field("query_id")).astype(np.int64)
                q = np.asarray(pack.field("v").flatten()).reshape(len(names), -1)
                at, ids, scores = tree.search(names, q, np.asarray(pack.field("kth").fill_null(-np.inf)), k)
                ends = pa.array(np.searchsorted(at, np.arange(len(names) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.ListArray.from_arrays(ends, pa.array(ids)), pa.ListArray.from_arrays(ends, pa.array(scores))],
                                                 ["query_id", "ids", "scores"])

    return arrow_map(both, run, "query_id bigint, ids array<bigint>, scores array<bigint>")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` the ``k`` highest integer
    inner products over all other rows, exact, ties to the smaller id.

    Null and empty vectors, vectors with a null or non-finite component, of another length than most, or
    without id take no part; zero vectors do. Rows with the query's id are its own and no candidates;
    other rows that repeat an id are separate candidates, and a repeated query id asks once. Scores
    beyond 64 bits are not defined. Other columns are not read. An empty table gives an empty result.
    """
    rows = written(integer_rows(vectors, id_col, vector_col), "kd-rows")
    shards = max(1, -(-rows.count() // SHARD))
    home = lambda c: F.pmod(F.xxhash64(c), F.lit(shards)).cast("int")
    entries = written(rows.groupBy(home("vec_id").alias("shard")).agg(F.collect_list(F.struct("vec_id", "v")).alias("entries")), "kd-shards")
    queries = written(queries_of(rows, every).select(F.col("vec_id").alias("query_id"), "v"), "kd-queries")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    packed = lambda q, shard: (q.groupBy(shard, "block").agg(F.collect_list(F.struct("query_id", "v", "kth")).alias("asked")))

    asked = queries.withColumn("kth", F.lit(None).cast("double")).withColumn("shard", home("query_id")).withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(blocks)))
    first = written(_search_shards(packed(asked, "shard"), entries, k), "kd-home")
    bound = first.select("query_id", F.when(F.size("scores") == k, F.array_min("scores")).cast("double").alias("kth"))
    others = (asked.drop("kth").join(bound.hint("merge"), "query_id").withColumn("home", F.col("shard"))
              .groupBy("block").agg(F.collect_list(F.struct("query_id", "v", "kth", "home")).alias("asked"))
              .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
              .withColumn("asked", F.filter("asked", lambda q: q["home"] != F.col("shard"))).where(F.size("asked") > 0))
    rest = _search_shards(others, entries, k)
    return merge_best(first.unionByName(rest).where(F.size("ids") > 0), k, "bigint")
