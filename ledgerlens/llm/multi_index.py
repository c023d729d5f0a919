"""Approximate nearest neighbours by an inverted multi-index (operator 5).

Vectors are cut into two halves, each quantised by a codebook of its own; a pair of centroids is a
cell. A query orders the centroids of each half by distance (minus the inner product) and walks
the grid of pairs by summed distance with a heap, cell after cell, until the cells hold enough entries.
The entries of those cells are reranked by the exact inner product of the original vectors.

What is enough is measured on the table at hand: ``MEASURED`` queries of least hash are answered by brute
force, and the walk is made as long as finding ``RECALL`` of their true neighbours takes. A cell counts with at
most ``HOT`` times the mean, so one that holds a third of all rows is read whole and does not end the walk.

Fitting: k-means on a sample that grows with the codebooks. Indexing: every row is assigned to a cell. Entries are stored by
grid row (first centroid) in blocks of about ``BLOCK``, so a cell that holds a third of all rows is many
blocks; queries are packed per grid row in blocks too, each with the cells it walked there, and entry
blocks meet query blocks in a join. What one pair of blocks returns are the ``k`` best per query, so
nothing grows with a cell.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.tables import arrow_map, shuffle_partitions, written
from ledgerlens.llm.vectors import block, merge_best, queries_of, usable

#: The codebooks are fitted on rows of least hash: so many, or ``PER_CENTROID`` for each centroid of a half if that is more.
SAMPLE, PER_CENTROID = 20_000, 64
MAX_CENTROIDS = 1024  # a half; the cell sizes (at most the square of it) go to every worker
CELL = 5  # entries of a cell aimed at
BLOCK = 512  # entries, and queries, of a block
#: A query walks on until its cells hold this many times the root of the number of entries at least.
PROBE = 96
#: Queries (of least hash) whose neighbours are found by brute force, and the share of these neighbours that
#: the walk has to reach: 0.9 with a margin of about three standard errors of a mean over so many queries.
MEASURED, RECALL = 256, 0.93
#: A cell counts towards what a walk holds with so many times the mean of the cells in use at most.
HOT = 4
TILE = 8  # pairs of a tile, each way, that the walk takes at once


def fit_codebooks(rows: DataFrame, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Two codebooks by Lloyd's k-means on a sample of the rows, those of least hash."""
    h = F.xxhash64("vec_id")
    k = int(np.clip(np.sqrt(n / CELL), 4, MAX_CENTROIDS))
    sample = max(SAMPLE, PER_CENTROID * k)
    share = min(1.0, 2.0 * sample / max(n, 1))
    some = rows.where(F.pmod(h, F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(h, "vec_id").limit(sample)
    v = some.select("v").toArrow().column("v").combine_chunks()
    x = np.asarray(v.flatten()).reshape(len(v), -1) if len(v) else np.zeros((0, 0))
    cut = x.shape[1] // 2 if len(x) else 0
    return tuple(_kmeans(half, k, seed) for half in (x[:, :cut], x[:, cut:])) if len(x) else (np.zeros((1, 0)), np.zeros((1, 0)))


def _kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    centres = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(rounds):
        near = nearest_centre(x, centres)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    norms, step = (centres ** 2).sum(axis=1)[None, :], 1 << 13
    return np.concatenate([(norms - 2 * x[i:i + step] @ centres.T).argmin(axis=1) for i in range(0, max(len(x), 1), step)])


def walk(a: np.ndarray, b: np.ndarray, sizes: np.ndarray, enough: int) -> list[int]:
    """Cells (i * len(b) + j) by ascending a[i] + b[j] until they hold ``enough`` entries, empty ones left out.

    The heap holds tiles of ``TILE`` x ``TILE`` pairs of the sorted grid, keyed by their least sum: a tile enters when the one
    before it in its row (or column, at the left edge) has been taken. Pairs of taken tiles whose sum is not
    above the heap's least key have their final place, so the walk ends when these hold enough."""
    x, y = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    rows, cols = a[x], b[y]
    heap, sums, cells, held = [(rows[0] + cols[0], 0, 0)], [], [], 0
    while heap:
        if held >= enough:
            final = np.concatenate(sums) <= heap[0][0]
            if sizes[np.concatenate(cells)[final]].sum() >= enough:
                break
        _, i, j = heapq.heappop(heap)
        sums.append((rows[i:i + TILE, None] + cols[None, j:j + TILE]).ravel())
        cells.append((x[i:i + TILE, None] * len(b) + y[None, j:j + TILE]).ravel())
        held += int(sizes[cells[-1]].sum())
        if j + TILE < len(y):
            heapq.heappush(heap, (rows[i] + cols[j + TILE], i, j + TILE))
        if j == 0 and i + TILE < len(x):
            heapq.heappush(heap, (rows[i + TILE] + cols[0], i + TILE, 0))
    cells = np.concatenate(cells)[np.argsort(np.concatenate(sums), kind="stable")]
    cells = cells[:int(np.searchsorted(np.cumsum(sizes[cells]), enough)) + 1]
    return cells[sizes[cells] > 0].tolist()


class MultiIndex:
    """Codebooks, cell sizes and the table of entries (grid_row, grid_col, vec_id, v)."""

    def __init__(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding"):
        rows = usable(vectors, id_col, vector_col, zero_ok=False)
        self.n = rows.count()
        books = self.books = fit_codebooks(rows, self.n)

        def assign(batches):
            for b in batches:
                if b.num_rows:
                    x = np.asarray(b.column(1).flatten()).reshape(b.num_rows, -1)
                    cut = books[0].shape[1]
                    i, j = nearest_centre(x[:, :cut], books[0]), nearest_centre(x[:, cut:], books[1])
                    yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), b.column(0), b.column(1)],
                                                     ["grid_row", "grid_col", "vec_id", "v"])

        self.entries = written(arrow_map(rows, assign, "grid_row int, grid_col int, vec_id bigint, v array<double>"), "multi-index")
        self.sizes = np.zeros(len(books[0]) * len(books[1]), np.int64)
        for r in self.entries.groupBy("grid_row", "grid_col").count().collect():
            self.sizes[r["grid_row"] * len(books[1]) + r["grid_col"]] = r["count"]
        self.counted = np.minimum(self.sizes, HOT * -(-self.n // max(1, np.count_nonzero(self.sizes))))

    def true_cells(self, queries: pa.Table, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query (vec_id, v) its vector and the cells of its ``k`` nearest entries, by brute force in blocks."""
        columns = len(self.books[1])
        q_ids = np.asarray(queries.column("vec_id").combine_chunks())
        q = np.asarray(queries.column("v").combine_chunks().flatten()).reshape(len(q_ids), -1)

        def run(batches):
            scores, cells = np.full((len(q_ids), 0), 0.0), np.full((len(q_ids), 0), 0)
            for b in batches:
                for part in (b.slice(i, 4096) for i in range(0, b.num_rows, 4096)):
                    row, col, ids = (np.asarray(part.column(c)).astype(np.int64) for c in range(3))
                    x = np.asarray(part.column(3).flatten()).reshape(len(ids), -1)
                    new = np.where(q_ids[:, None] == ids[None, :], -np.inf, q @ x.T)
                    scores = np.concatenate([scores, new], axis=1)
                    cells = np.concatenate([cells, np.broadcast_to(row * columns + col, new.shape)], axis=1)
                    best = np.argpartition(-scores, min(k, scores.shape[1]) - 1, axis=1)[:, :k]
                    scores, cells = np.take_along_axis(scores, best, 1), np.take_along_axis(cells, best, 1)
            if scores.shape[1]:
                real = [s > -np.inf for s in scores]
                yield pa.RecordBatch.from_arrays([pa.array(q_ids), pa.array([c[r] for c, r in zip(cells, real)], pa.list_(pa.int64())),
                                                  pa.array([s[r] for s, r in zip(scores, real)], pa.list_(pa.float64()))], ["query_id", "ids", "scores"])

        found: dict[int, list[int]] = {}
        for r in merge_best(arrow_map(self.entries.select("grid_row", "grid_col", "vec_id", "v"), run, "query_id bigint, ids array<bigint>, scores array<double>"),
                            k, "double").collect():
            found.setdefault(r["query_id"], []).append(r["vec_id"])  # here a cell
        return [(v, np.array(found.get(i, []), np.int64)) for i, v in zip(q_ids.tolist(), q)]

    def enough(self, queries: DataFrame, k: int, least: int) -> int:
        """Entries, as counted, that walks have to hold for a recall of ``RECALL`` at ``k``, ``least`` at least: of all
        neighbours, and of those outside hot cells, which the many alike queries of a hot cell would hide."""
        if least >= self.counted.sum():
            return least  # every cell is walked
        h = F.xxhash64("vec_id")
        before, cold = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for v, cells in self.true_cells(queries.select("vec_id", "v").orderBy(h, "vec_id").limit(MEASURED).toArrow(), k):
            cut = self.books[0].shape[1]
            order = np.argsort(-((self.books[0] @ v[:cut])[:, None] + (self.books[1] @ v[cut:])[None, :]).ravel(), kind="stable")
            held = np.zeros(len(order), np.int64)
            held[order] = np.cumsum(self.counted[order]) - self.counted[order]
            before.append(held[cells])
            cold.append(held[cells[self.counted[cells] == self.sizes[cells]]])
        return max(least, *(_quantile(np.concatenate(x)) + 1 for x in (before, cold)))

    def search(self, queries: DataFrame, k: int = 20, probe: int = PROBE) -> DataFrame:
        """(query_id, rank, vec_id, score): per query (vec_id, v) the ``k`` nearest entries found, own id apart."""
        books, sizes = self.books, self.counted
        columns = len(books[1])
        enough = self.enough(queries, k, max(2 * k, int(probe * np.sqrt(self.n))))

        def visits(batches):
            for b in batches:
                out = {"grid_row": [], "row": [], "cols": []}
                for i, v in enumerate(b.column(1)):
                    q = np.asarray(v.values)
                    cells = np.sort(np.array(walk(-(books[0] @ q[:books[0].shape[1]]), -(books[1] @ q[books[0].shape[1]:]), sizes, enough), np.int64))
                    rows, first = np.unique(cells // columns, return_index=True)
                    out["grid_row"] += rows.tolist()
                    out["row"] += [i] * len(rows)
                    out["cols"] += np.split((cells % columns).astype(np.int32), first[1:]) if len(rows) else []
                at = pa.array(out["row"], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(out["grid_row"], pa.int32()), b.column(0).take(at), b.column(1).take(at),
                                                  pa.array(out["cols"], pa.list_(pa.int32()))], ["grid_row", "query_id", "v", "cols"])

        # few bytes but long walks: dealt by another expression than the queries are grouped by, so that Spark keeps this
        # shuffle, whose number of partitions is fixed and not merged by size
        dealt = queries.select("vec_id", "v").repartition(shuffle_partitions(queries.sparkSession), F.xxhash64("vec_id", F.lit(1)))
        met = written(arrow_map(dealt, visits, "grid_row int, query_id bigint, v array<double>, cols array<int>"), "multi-index-visits")

        def packed(rows: DataFrame, key: str, *fields: str) -> DataFrame:
            # one count per grid row, and grid rows are bounded by the codebook
            counts = F.broadcast(rows.groupBy("grid_row").agg(F.count(F.lit(1)).alias("n")))
            return (rows.join(counts, "grid_row").withColumn("part", F.pmod(F.xxhash64(key), F.ceil(F.col("n") / BLOCK)))
                    .groupBy("grid_row", "part").agg(F.collect_list(F.struct(key, *fields)).alias("pack")))

        both = (packed(met, "query_id", "v", "cols").select("grid_row", F.col("pack").alias("asked"))
                .join(packed(self.entries, "vec_id", "v", "grid_col").select("grid_row", F.col("pack").alias("entries")), "grid_row")
                .select("asked", "entries"))

        def rerank(batches):
            for b in batches:
                for r in range(b.num_rows):
                    asked, entries = b.column(0)[r].values, b.column(1)[r].values
                    ids, x, order = block(entries)
                    q_ids, q, q_order = block(asked, "query_id")
                    walked = np.zeros((len(q_ids), columns), bool)
                    cols = asked.field("cols")
                    at = np.repeat(np.arange(len(q_ids)), np.asarray(pa.compute.list_value_length(cols)))
                    walked[at, np.asarray(cols.flatten())] = True
                    seen = walked[q_order][:, np.asarray(entries.field("grid_col"))[order]]
                    yield _best(q_ids, ids, np.where(seen, inner_products(q, x), -np.inf), k)

        return merge_best(arrow_map(both, rerank, "query_id bigint, ids array<bigint>, scores array<double>"), k, "double")


def _quantile(before: np.ndarray) -> int:
    """The least entry of ``before`` that a share of ``RECALL`` does not exceed; -1 if it is empty."""
    return int(np.sort(before)[max(0, int(np.ceil(RECALL * len(before))) - 1)]) if len(before) else -1


def inner_products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """(queries, entries) in double precision, summed component by component: equal vectors get equal scores."""
    out = np.zeros((len(q), len(x)))
    for d in range(q.shape[1]):
        out += q[:, d, None] * x[None, :, d]
    return out


def _best(q_ids: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> pa.RecordBatch:
    """Per query its k best of a block; ``ids`` ascend, so a stable sort leaves ties to the smaller id."""
    scores = np.where(q_ids[:, None] == ids[None, :], -np.inf, scores)
    order = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    out_ids, out_scores = [], []
    for i in range(len(q_ids)):
        mine = order[i][scores[i, order[i]] > -np.inf]
        out_ids.append(ids[mine])
        out_scores.append(scores[i, mine])
    return pa.RecordBatch.from_arrays([pa.array(q_ids), pa.array(out_ids, pa.list_(pa.int64())), pa.array(out_scores, pa.list_(pa.float64()))],
                                      ["query_id", "ids", "scores"])


def nearest_neighbours(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by ``every`` its ``k`` nearest rows found.

    Nearness is the inner product in double precision, ties go to the smaller id. Null, empty and zero
    vectors, vectors with a null or non-finite component, of another length than most, or without id
    take no part. Rows with the query's id are its own and no candidates; other rows that repeat an id
    are separate candidates, and a repeated query id asks once. Other columns are not read. An empty
    table gives an empty result.
    """
    index = MultiIndex(vectors, id_col, vector_col)
    return index.search(queries_of(index.entries, every), k)
