"""Ranked lexical search with the Best Position Algorithm (operator 11).

Items (the stated queries) are ranked over all documents by a sum of whole-number impacts, one per term they share. Tasks
read whole texts once and keep, per document, its length and the counts of the items' terms in a written
table. From it come the statistics of the corpus, and its files are the shards of the search: a task turns its
documents into impact lists (per term, highest impact first) with direct access (per term and document, the
position in the list), ``SHARD_POSTINGS`` entries at a time, so postings are never shuffled.

In a shard each item reads its lists from the top in growing blocks. Every document met is scored at once by direct
access to all lists, which marks its position in each of them as seen. A list's best position is where its
unbroken run of seen positions ends; no document yet unscored can have more from a list than the entry after it, and
the sum of these is the threshold. Reading stops when the threshold is strictly below the kth score, so equal
scores are all found. The kth score travels on to a task's next shard. What a task returns is at most ``k`` documents an item.

The items' terms go to the workers by broadcast. Items are taken in groups of about ``GROUP_TERMS`` terms, so what
is sent does not grow with their number; each group is one pass over the texts.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.tables import arrow_map, written

GROUP_TERMS = 1 << 20  # terms of the items of one pass, counted per item
SHARD_POSTINGS = 1 << 20
SHARD_DOCS = 1 << 14  # of a shard, so that a position fits in 16 bits
DENSE = 32  # a list with at least one of so many documents of its shard has its positions in an array by document
FIRST_BLOCK = 32
CHUNK_BYTES = 1 << 22  # of a text that are cut into terms at once
#: From bytes to terms: letters lower-cased, all that separates terms a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))


def terms_of(raw: bytes):
    """Lists of the terms of one text, a bounded piece at a time."""
    folded, start = raw.translate(FOLD), 0
    while start < len(folded):
        end = start + CHUNK_BYTES
        if end < len(folded):
            cut = folded.rfind(b" ", start + 1, end)
            cut = folded.find(b" ", end) if cut < 0 else cut
            end = cut if cut >= 0 else len(folded)
        yield folded[start:end].split()
        start = end


def item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item_id, term binary), distinct."""
    def run(batches):
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.large_binary()).to_pylist()):
                terms = list(set().union(*terms_of(raw)))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(terms), pa.int64()), pa.array(terms, pa.binary())], ["item_id", "term"])

    rows = items.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null and text is not null")
    return arrow_map(rows, run, "item_id bigint, term binary").distinct()


class Items:
    """The items of one group: ``terms`` in order, and of each item the numbers of its terms."""

    def __init__(self, table: pa.Table):
        self.terms = sorted(set(table.column("term").to_pylist()))
        number = {t: i for i, t in enumerate(self.terms)}
        lists: dict[int, list[int]] = {}
        for name, term in zip(table.column("item_id").to_pylist(), table.column("term").to_pylist()):
            lists.setdefault(name, []).append(number[term])
        self.lists = {name: np.array(sorted(x), np.int64) for name, x in sorted(lists.items())}


def counted_documents(docs: DataFrame, sent, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, counts): of documents with at least one term, all their terms and which of the items' they hold how often."""
    def run(batches):
        number = {t: i for i, t in enumerate(sent.value.terms)}
        for b in batches:
            keep, n, terms, counts = [], [], [], []
            for i, raw in enumerate(b.column(1).cast(pa.large_binary()).fill_null(b"").to_pylist()):
                length, found = 0, Counter()
                for piece in terms_of(raw):
                    length += len(piece)
                    found.update(map(number.get, piece))
                if length:
                    found.pop(None, None)
                    keep.append(i)
                    n.append(length)
                    terms.append(list(found))
                    counts.append(list(found.values()))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())),
                                              pa.array(counts, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "counts"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return arrow_map(rows, run, "doc_id bigint, n bigint, terms array<int>, counts array<bigint>")


class Shard:
    """Impact lists of some documents, by descending impact, with direct access."""

    def __init__(self, docs: int, doc: np.ndarray, term: np.ndarray, impact: np.ndarray):
        some = impact > 0
        doc, term, impact = doc[some], term[some], impact[some]
        order = np.lexsort((doc, -impact, term))
        self.docs, self.doc, self.impact, term = docs, doc[order], impact[order], term[order]
        self.terms, self.starts, sizes = np.unique(term, return_index=True, return_counts=True)
        self.ends = self.starts + sizes
        position = np.arange(len(term)) - np.repeat(self.starts, sizes)
        by_doc = np.lexsort((self.doc, term))
        self.sorted_doc, self.sorted_position = self.doc[by_doc], position[by_doc]
        self.row = np.full(len(self.terms), -1)
        often = np.flatnonzero(sizes * DENSE >= docs)
        self.row[often] = np.arange(len(often))
        self.dense = np.full((len(often), docs), -1, np.int16)
        for r, t in enumerate(often):
            here = slice(self.starts[t], self.ends[t])
            self.dense[r, self.doc[here]] = position[here]

    def search(self, terms: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, scores, positions read or accessed): all documents that can be among the ``k`` best and reach ``floor``."""
        at = np.searchsorted(self.terms, terms)
        at = at[(at < len(self.terms)) & (self.terms[np.minimum(at, len(self.terms) - 1)] == terms)] if len(self.terms) else at[:0]
        at = np.concatenate([at[self.row[at] >= 0], at[self.row[at] < 0]])
        frequent, starts, ends = int((self.row[at] >= 0).sum()), self.starts[at], self.ends[at]
        sizes = ends - starts
        base = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        seen, scored, best = np.zeros(base[-1], bool), np.zeros(self.docs, bool), np.zeros(len(at), np.int64)
        found, scores, kth, reads = [], [], floor, 0
        depth, block = 0, FIRST_BLOCK
        while True:
            met = [self.doc[s + depth:min(s + depth + block, e)] for s, e in zip(starts, ends) if s + depth < e]
            if not met:
                break
            met = np.concatenate(met)
            new = np.unique(met[~scored[met]])
            scored[new] = True
            reads += len(met) + len(new) * len(at)
            score = np.zeros(len(new), np.int64)
            if frequent and len(new):
                place = self.dense[np.ix_(self.row[at[:frequent]], new)].astype(np.int64)
                held = place >= 0
                score += np.where(held, self.impact[np.where(held, place, 0) + starts[:frequent, None]], 0).sum(axis=0)
                seen[(place + base[:frequent, None])[held]] = True
            for j in range(frequent, len(at)):
                mine = self.sorted_doc[starts[j]:ends[j]]
                place = np.minimum(np.searchsorted(mine, new), len(mine) - 1)
                held = mine[place] == new
                place = self.sorted_position[starts[j] + place[held]]
                score[held] += self.impact[starts[j] + place]
                seen[base[j] + place] = True
            found.append(new)
            scores.append(score)
            for j in range(len(at)):
                rest = seen[base[j] + best[j]:base[j + 1]]
                best[j] = sizes[j] if rest.all() else best[j] + int(rest.argmin())
            left = best < sizes
            threshold = int(self.impact[(starts + best)[left]].sum())
            scores = [np.concatenate(scores)]
            if len(scores[0]) >= k:
                kth = max(kth, int(np.partition(scores[0], len(scores[0]) - k)[len(scores[0]) - k]))
            if threshold < kth or not left.any():
                break
            depth, block = depth + block, block * 2
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), reads
        found, scores = np.concatenate(found), scores[0]
        reach = scores >= max(kth, 1)
        return found[reach], scores[reach], reads


def impacts(n: list[int], doc: np.ndarray, term: np.ndarray, count: np.ndarray, weights: np.ndarray, total_docs: int, total_terms: int) -> np.ndarray:
    """The whole-number impact of each (document, term)."""
    m = np.array([100 - 50 + 50 * x * total_docs // total_terms for x in n], np.int64)
    return weights[term] * ((1_000_000_000 * count) // (1000 * count + 20 * m[doc]))


def best_documents(counted: DataFrame, sent, weights: np.ndarray, total_docs: int, total_terms: int, k: int, shard_postings: int) -> DataFrame:
    """(item_id, doc_id, score): per task and item the ``k`` best of its documents."""
    weights_sent = counted.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        items, weights = sent.value, weights_sent.value
        best = {name: (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for name in items.lists}
        held: list = []

        def search():
            ids, nameless = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            n = [x for h in held for x in h[2]]
            firsts = np.cumsum([0] + [len(h[0]) for h in held[:-1]])
            doc = np.concatenate([h[3] + f for h, f in zip(held, firsts)])
            term, count = np.concatenate([h[4] for h in held]), np.concatenate([h[5] for h in held])
            shard = Shard(len(ids), doc, term, impacts(n, doc, term, count, weights, total_docs, total_terms))
            for name, terms in items.lists.items():
                old = best[name]
                docs, scores, _ = shard.search(terms, k, int(old[2].min()) if len(old[2]) == k else 0)
                if len(docs):
                    new = np.concatenate([old[0], ids[docs]]), np.concatenate([old[1], nameless[docs]]), np.concatenate([old[2], scores])
                    order = np.lexsort((new[0], new[1], -new[2]))[:k]
                    best[name] = tuple(x[order] for x in new)
            held.clear()

        postings = documents = 0
        for b in batches:
            sizes = np.diff(np.asarray(b.column("terms").offsets))
            first = 0
            while first < b.num_rows:  # as many rows as the shard at hand has room for, one at least
                room = np.searchsorted(np.cumsum(sizes[first:]), shard_postings - postings, side="right")
                end = first + max(1, min(int(room), SHARD_DOCS - documents, b.num_rows - first))
                some = b.slice(first, end - first)
                ids = some.column("doc_id")
                held.append((np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()), some.column("n").to_pylist(), np.repeat(np.arange(end - first), sizes[first:end]),
                             np.asarray(some.column("terms").flatten()).astype(np.int64), np.asarray(some.column("counts").flatten())))
                postings, documents, first = postings + int(sizes[first:end].sum()), documents + end - first, end
                if postings >= shard_postings or documents >= SHARD_DOCS or first < b.num_rows:
                    search()
                    postings = documents = 0
        if held:
            search()
        for name, (ids, nameless, scores) in best.items():
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(ids), pa.int64()), pa.array(ids, pa.int64(), mask=nameless), pa.array(scores)], ["item_id", "doc_id", "score"])

    return arrow_map(counted, run, "item_id bigint, doc_id bigint, score bigint")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50, item_col: str = "item_id", id_col: str = "doc_id", text_col: str = "text",
                   group_terms: int = GROUP_TERMS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """(item_id, rank, doc_id, score): per item the ``k`` documents of highest score above 0, exact, ties to the smaller id.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, only A-Z lower-cased. The
    score adds, over the item's distinct terms, w * ((1000000000 * tf) div (1000 * tf + 20 * m)) with
    w = floor(1000 * ln((2N + 2) / (2 df + 1))) and m = 50 + (50 n N) div L, over all documents with a term.

    Null and empty texts have no terms. Rows without doc_id count in the statistics and are ranked like others, last
    among equals, under a null id; rows that repeat an id are documents of their own. Items without id or terms
    give no rows; rows that repeat an item id are one item with the terms of all. Other columns are not read.
    Empty tables give an empty result.
    """
    spark = docs.sparkSession
    asked = written(item_terms(items, item_col, text_col), "search-items")
    groups = max(1, -(-asked.count() // group_terms))
    out = spark.createDataFrame([], "item_id bigint, doc_id bigint, score bigint")
    for g in range(groups):
        group = Items(asked.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g).toArrow())
        if not group.terms:
            continue
        sent = spark.sparkContext.broadcast(group)
        counted = written(counted_documents(docs, sent, id_col, text_col), "search-counts")
        total = counted.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
        if not total["docs"]:
            continue
        df = np.zeros(len(group.terms), np.int64)
        held = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toArrow()  # one row per term of the group
        df[np.asarray(held.column("term"))] = np.asarray(held.column("df"))
        weights = np.array([math.floor(1000 * math.log((2 * total["docs"] + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        out = out.unionByName(best_documents(counted, sent, weights, total["docs"], total["terms"], k, shard_postings))
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
