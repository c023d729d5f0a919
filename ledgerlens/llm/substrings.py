"""Substring dedup by De Bruijn compaction (operator 8).

Token k-mers (windows of ``k`` words) are the edges of a De Bruijn graph. A window's anchor is its least
inner ``ANCHOR``-word hash, so equal windows have equal anchors, and the consecutive windows of a document
that share one anchor position form a run (a compacted stretch of the graph). Instead of every window, only
runs are shuffled, by anchor:

1. A run whose whole word sequence already starts in a document with a smaller id is repeated as one
   piece. Of each distinct run only the first document goes on.
2. Where different runs meet at one anchor with the same words before or after it (a shared window
   has at least ``side`` of them on one side), the windows inside their first occurrences are compared window
   by window. Each window then knows its source: first document and position.
3. In each document, consecutive repeated windows whose sources are consecutive too are one path; a
   path ends where the graph branches. Paths are joined to their source documents, and a span
   counts only if the words at its source coordinates are the words of the span.

Text is shuffled once; documents that take part in a repeat are then kept in buckets by id, so that
later joins move only runs, windows and paths. Rows of a passage that
many documents share spread over its anchors; a document sends each distinct run once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.tables import arrow_map, id_type, written, written_by_key
from ledgerlens.llm.text import Words, mix, powers, text_chunks, window_hashes

ANCHOR = 4


class Runs:
    """Runs of windows of one slice of texts: ``row``, ``first`` window (word number in the slice), number
    of windows, ``anchor`` and ``hash`` of all the words the run covers."""

    def __init__(self, words: Words, k: int):
        anchor_words = min(ANCHOR, k)
        grams = window_hashes(words.hashes, anchor_words)
        n = max(0, len(words.hashes) - k + 1)
        width = k - anchor_words + 1
        row = np.repeat(np.arange(words.rows), np.diff(words.offsets))
        self.inside = row[:n] == row[k - 1:] if n else np.zeros(0, bool)
        least, at = grams, np.arange(len(grams))
        span = 1
        while span < width:  # leftmost least of ``width`` grams by doubling
            step = min(span, width - span)
            m = len(least) - step
            take = least[step:] < least[:m]
            least, at = np.where(take, least[step:], least[:m]), np.where(take, at[step:], at[:m])
            span += step
        windows = np.flatnonzero(self.inside)
        new = np.ones(len(windows), bool)
        new[1:] = (at[windows[1:]] != at[windows[:-1]]) | (windows[1:] != windows[:-1] + 1) | (row[windows[1:]] != row[windows[:-1]])
        self.first = windows[new]
        self.count = np.diff(np.append(np.flatnonzero(new), len(windows)))
        self.row = row[self.first]
        self.anchor = least[self.first]
        self.hash = _sequence_hashes(words.hashes, self.first, self.count + k - 1)
        self.position = self.first - words.offsets[self.row]
        side = -(-(k - anchor_words) // 2)
        low, high = words.offsets[self.row], words.offsets[self.row + 1]
        before, after = at[self.first] - side, at[self.first] + anchor_words
        #: Hash of the ``side`` words before and after the anchor; null where the document has fewer.
        self.sides = [pa.array(_sequence_hashes(words.hashes, np.where(known, start, 0), np.where(known, side, 0)).astype(np.uint32).view(np.int32), mask=~known)
                      for start, known in ((before, before >= low), (after, after + side <= high))]


def _sequence_hashes(hashes: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    up, down = powers(len(hashes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[:-1], dtype=np.uint64)])
    return mix((sums[first + length] - sums[first]) * down[first] + length.astype(np.uint64))


def document_runs(rows: DataFrame, k: int) -> DataFrame:
    """(anchor, run, doc_id, pos, before, after): each distinct run of each document, at its first position
    there, with hashes of the words beside its anchor."""
    def run(batches):
        for b in batches:
            for first, end, data, offsets in text_chunks(b.column(1)):
                r = Runs(Words(data, offsets), k)
                order = np.lexsort((r.position, r.hash, r.row))
                same = (r.row[order][1:] == r.row[order][:-1]) & (r.hash[order][1:] == r.hash[order][:-1])
                keep = np.sort(order[np.concatenate([[True], ~same])]) if len(order) else order
                ids = b.column(0).slice(first, end - first).take(pa.array(r.row[keep]))
                yield pa.RecordBatch.from_arrays([pa.array(r.anchor[keep].view(np.int64)), pa.array(r.hash[keep].view(np.int64)), ids,
                                                  pa.array(r.position[keep].astype(np.int32)), *(s.take(pa.array(keep)) for s in r.sides)],
                                                 ["anchor", "run", "doc_id", "pos", "before", "after"])

    return arrow_map(rows, run, f"anchor bigint, run bigint, doc_id {id_type(rows)}, pos int, before int, after int")


def repeated_runs(runs: DataFrame) -> DataFrame:
    """(doc_id, found): per document that takes part in a repeat, its repeated runs with their sources
    (src_doc, src_pos), and with a null source the runs that must be compared window by window."""
    by_run = Window.partitionBy("anchor", "run")
    seen = (runs.repartition("anchor").withColumn("src", F.min(F.struct("doc_id", "pos")).over(by_run))
            .withColumn("last", F.max("doc_id").over(by_run)))
    meets = F.lit(False)
    for side in ("before", "after"):
        beside = Window.partitionBy("anchor", side)
        bounds = [f(c).over(beside) for c in ("run", "doc_id") for f in (F.min, F.max)]
        seen = seen.withColumns({f"{side}_{i}": b for i, b in enumerate(bounds)})
        met = F.col(side).isNotNull() & (F.col(f"{side}_0") < F.col(f"{side}_1")) & (F.col(f"{side}_2") < F.col(f"{side}_3"))
        meets = meets | met
    repeat = F.col("doc_id") > F.col("src.doc_id")
    compare = ~repeat & meets
    source = ~repeat & (F.col("last") > F.col("doc_id"))
    found = F.when(repeat, F.struct("run", F.col("src.doc_id").alias("src_doc"), F.col("src.pos").alias("src_pos"))).when(
        compare, F.struct("run", F.lit(None).cast(runs.schema["doc_id"].dataType).alias("src_doc"), F.lit(None).cast("int").alias("src_pos")))
    return seen.where(repeat | compare | source).groupBy("doc_id").agg(F.collect_set(found).alias("found"))


def _entries(column, first: int, end: int):
    """Per row of a list<struct> column slice the tuples of its fields."""
    lists = column.slice(first, end - first)
    counts = pa.compute.list_value_length(lists).fill_null(0).to_pylist()
    flat = lists.flatten()
    fields = list(zip(*[flat.field(i).to_pylist() for i in range(flat.type.num_fields)]))
    at = 0
    for n in counts:
        yield fields[at:at + n]
        at += n


def _runs_by_row(r: Runs, rows: int):
    """Per row: its runs' hashes (signed, as Spark has them), first windows and counts."""
    cuts = np.searchsorted(r.row, np.arange(rows + 1)).tolist()
    hashes, first, count = r.hash.view(np.int64).tolist(), r.first.tolist(), r.count.tolist()
    for a, z in zip(cuts[:-1], cuts[1:]):
        yield list(zip(hashes[a:z], first[a:z], count[a:z]))


def compared_windows(taking_part: DataFrame, k: int) -> DataFrame:
    """(doc_id, windows): windows of compared runs that start in a document with a smaller id, with their sources."""
    def run(batches):
        for b in batches:
            for first, end, data, offsets in text_chunks(b.column(1)):
                words = Words(data, offsets)
                edges = words.windows(k).view(np.int64).tolist()
                edge, row, pos = [], [], []
                for i, (mine, found) in enumerate(zip(_runs_by_row(Runs(words, k), end - first), _entries(b.column(2), first, end))):
                    compare = {h for h, doc, _ in found if doc is None}
                    at_first, low = {}, int(words.offsets[i])
                    for h, start, n in mine:
                        if h in compare:
                            for w in range(start, start + n):
                                at_first.setdefault(edges[w], w - low)
                    edge += at_first.keys()
                    pos += at_first.values()
                    row += [first + i] * len(at_first)
                yield pa.RecordBatch.from_arrays([pa.array(edge, pa.int64()), b.column(0).take(pa.array(row, pa.int64())), pa.array(pos, pa.int32())],
                                                 ["edge", "doc_id", "pos"])

    edges = arrow_map(taking_part.select("doc_id", "text", "found"), run, f"edge bigint, doc_id {id_type(taking_part)}, pos int")
    src = F.min(F.struct("doc_id", "pos")).over(Window.partitionBy("edge"))
    return (edges.withColumn("src", src).where(F.col("doc_id") > F.col("src.doc_id"))
            .groupBy("doc_id").agg(F.collect_set(F.struct("edge", F.col("src.doc_id").alias("src_doc"), F.col("src.pos").alias("src_pos"))).alias("windows")))


def document_paths(taking_part: DataFrame, windows: DataFrame, k: int) -> DataFrame:
    """(doc_id, text_key, src_doc, src_pos, n_words, starts): each document's paths, by source, and where
    (word numbers) they start in the document."""
    rows = taking_part.join(windows, "doc_id", "left").select("doc_id", "text", "text_key", "found", "windows")
    kind = id_type(taking_part)

    def run(batches):
        for b in batches:
            for first, end, data, offsets in text_chunks(b.column(1)):
                words = Words(data, offsets)
                edges = words.windows(k).view(np.int64).tolist()
                out = {"row": [], "src_doc": [], "src_pos": [], "n_words": [], "starts": []}
                for i, (mine, found, known) in enumerate(zip(_runs_by_row(Runs(words, k), end - first),
                                                             _entries(b.column(3), first, end), _entries(b.column(4), first, end))):
                    paths = _paths(mine, {h: (doc, pos) for h, doc, pos in found}, {e: (doc, pos) for e, doc, pos in known}, edges, int(words.offsets[i]))
                    for (doc, pos, n), starts in paths.items():
                        for column, value in zip(out.values(), (first + i, doc, pos, n + k - 1, starts)):
                            column.append(value)
                at = pa.array(out["row"], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(at), b.column(2).take(at), pa.array(out["src_doc"], b.column(0).type), pa.array(out["src_pos"], pa.int32()),
                     pa.array(out["n_words"], pa.int32()), pa.array(out["starts"], pa.list_(pa.int32()))],
                    ["doc_id", "text_key", "src_doc", "src_pos", "n_words", "starts"])

    return arrow_map(rows, run, f"doc_id {kind}, text_key bigint, src_doc {kind}, src_pos int, n_words int, starts array<int>")


def _paths(mine, runs: dict, windows: dict, edges: list, low: int) -> dict:
    """(source document, source position, windows) -> starts, from the repeated windows of one document."""
    pieces = []
    for h, start, n in mine:
        if h not in runs:
            continue
        doc, pos = runs[h]
        if doc is not None:
            pieces.append([start, n, doc, pos])
        else:
            pieces += [[w, 1, *windows[edges[w]]] for w in range(start, start + n) if edges[w] in windows]
    paths: dict = {}
    now = None
    for start, n, doc, pos in pieces:
        if now and now[0] + now[1] == start and now[2] == doc and now[3] + now[1] == pos:
            now[1] += n
            continue
        if now:
            paths.setdefault((now[2], now[3], now[1]), []).append(now[0] - low)
        now = [start, n, doc, pos]
    if now:
        paths.setdefault((now[2], now[3], now[1]), []).append(now[0] - low)
    return paths


def _digest(data: np.ndarray, words: Words, first: int, n: int) -> bytes:
    """Of n words from word ``first`` on, joined by one space."""
    return hashlib.blake2b(b" ".join(data[a:z].tobytes() for a, z in zip(words.starts[first:first + n], words.ends[first:first + n])), digest_size=16).digest()


def source_digests(taking_part: DataFrame, paths: DataFrame) -> DataFrame:
    """(src_doc, src_pos, n_words, digest): the words at each path's source coordinates."""
    wanted = (paths.select("src_doc", "src_pos", "n_words").distinct().groupBy(F.col("src_doc").alias("doc_id"))
              .agg(F.collect_list(F.struct("src_pos", "n_words")).alias("wanted")))
    rows = taking_part.select("doc_id", "text").join(wanted, "doc_id").select("doc_id", "text", "wanted")

    def run(batches):
        for b in batches:
            for first, end, data, offsets in text_chunks(b.column(1)):
                words = Words(data, offsets)
                row, pos, length, digest = [], [], [], []
                for i, wanted_here in enumerate(_entries(b.column(2), first, end)):
                    low, top = int(words.offsets[i]), int(words.offsets[i + 1])
                    for p, n in wanted_here:
                        if low + p + n <= top:
                            row.append(first + i)
                            pos.append(p)
                            length.append(n)
                            digest.append(_digest(data, words, low + p, n))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row, pa.int64())), pa.array(pos, pa.int32()), pa.array(length, pa.int32()),
                                                  pa.array(digest, pa.binary())], ["src_doc", "src_pos", "n_words", "digest"])

    return arrow_map(rows, run, f"src_doc {id_type(taking_part)}, src_pos int, n_words int, digest binary").distinct()


def without_spans(taking_part: DataFrame, spans: DataFrame, texts: bool) -> DataFrame:
    """(doc_id, text_key, n_removed, kept): documents less the words of their confirmed spans; ``kept`` is
    the text, or its SHA-256 in hex if ``texts`` is false."""
    # joined on the bucket's key alone; the text's key is compared afterwards
    rows = (taking_part.select("doc_id", "text", "text_key").join(spans.withColumnRenamed("text_key", "of_text"), "doc_id")
            .where("text_key = of_text").select("doc_id", "text", "text_key", "spans"))

    def run(batches):
        for b in batches:
            for first, end, data, offsets in text_chunks(b.column(1)):
                words = Words(data, offsets)
                removed, kept = [], []
                for i, here in enumerate(_entries(b.column(3), first, end)):
                    low, top = int(words.offsets[i]), int(words.offsets[i + 1])
                    cover = np.zeros(top - low + 1, np.int64)
                    for n, digest, starts in here:
                        for s in starts:
                            if _digest(data, words, low + s, n) == digest:
                                cover[s] += 1
                                cover[s + n] -= 1
                    gone = np.cumsum(cover[:-1]) > 0
                    removed.append(int(gone.sum()))
                    kept.append(_kept(data, words, np.arange(low, top)[~gone], texts))
                at = slice(first, end)
                yield pa.RecordBatch.from_arrays([b.column(0)[at], b.column(2)[at], pa.array(removed, pa.int64()), pa.array(kept, pa.string())],
                                                 ["doc_id", "text_key", "n_removed", "kept"])

    return arrow_map(rows, run, f"doc_id {id_type(taking_part)}, text_key bigint, n_removed bigint, kept string")


def _kept(data: np.ndarray, words: Words, which: np.ndarray, texts: bool) -> str:
    joined = b" ".join(data[a:z].tobytes() for a, z in zip(words.starts[which].tolist(), words.ends[which].tolist()))
    return joined.decode() if texts else hashlib.sha256(joined).hexdigest()


def whole_documents(rows: DataFrame, texts: bool) -> DataFrame:
    """(doc_id, text_key, n_words, whole): every row as it is if nothing is removed."""
    def run(batches):
        for b in batches:
            for first, end, data, offsets in text_chunks(b.column(1)):
                words = Words(data, offsets)
                cuts = words.offsets.tolist()
                at = slice(first, end)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[at], b.column(2)[at], pa.array(np.diff(words.offsets), pa.int64()),
                     pa.array([_kept(data, words, np.arange(a, z), texts) for a, z in zip(cuts[:-1], cuts[1:])], pa.string())],
                    ["doc_id", "text_key", "n_words", "whole"])

    return arrow_map(rows, run, f"doc_id {id_type(rows)}, text_key bigint, n_words bigint, whole string")


def repeated_spans(docs: DataFrame, k: int = 13, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents that take part in a repeat, their confirmed-source paths with ``digest``)."""
    rows = _rows(docs, id_col, text_col).where("doc_id is not null")
    found = repeated_runs(document_runs(rows.select("doc_id", "text"), k))
    taking_part = written_by_key(rows.join(found, "doc_id").dropDuplicates(["doc_id", "text_key"]), "repeats_documents", "doc_id")
    paths = written(document_paths(taking_part, compared_windows(taking_part, k), k), "repeats-paths")
    return taking_part, paths.join(source_digests(taking_part, paths), ["src_doc", "src_pos", "n_words"])


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))


def remove_repeats(docs: DataFrame, k: int = 13, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) per row of ``docs``.

    A window is ``k`` consecutive words ``[^\\x20\\x09-\\x0D]+`` of one document. Each word covered by a window whose
    word sequence also starts in a document with a smaller doc_id is removed; windows are judged on the
    input, not on what is left. ``kept``: the remaining words joined by one space, or (``texts`` false) the
    SHA-256 of that in hex.

    Null and empty texts have no words. Rows that repeat a doc_id are documents of the same rank: they
    remove nothing from each other. Rows with a null doc_id have no rank: they are returned whole and
    remove nothing. Other columns are not read. An empty table gives an empty result.
    """
    taking_part, paths = repeated_spans(docs, k, id_col, text_col)
    spans = paths.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("n_words", "digest", "starts")).alias("spans"))
    changed = without_spans(taking_part, spans, texts).select(F.col("doc_id").alias("d2"), F.col("text_key").alias("k2"), "n_removed", "kept")
    whole = whole_documents(_rows(docs, id_col, text_col), texts)
    return (whole.join(changed, (F.col("doc_id") == F.col("d2")) & (F.col("text_key") == F.col("k2")), "left")
            .select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("kept", "whole").alias("kept")))
