"""MinHash near-dedup with sequential Bayesian verification (operator 1).

1. Each document's distinct word shingles give a MinHash signature and a digest of the set; documents
   with equal sets are one class from here on (exact copies never meet in a bucket).
2. Signatures are cut into bands; classes that agree on a band share a bucket. A bucket first yields
   a star: its least class against every other, so a bucket costs its size and not its square.
3. Candidate pairs are compared in batches of signature values. After n values with m matches the
   similarity has the posterior Beta(m + 1, n - m + 1); a pair goes as soon as the probability that
   it reaches the threshold is below ``miss``. Survivors are verified on their full shingle sets.
4. Links join classes into components. Buckets whose classes beside the star's centre still lie in
   several components are searched on, class against class of another component, in blocks; links
   found there close the components.

A link can only be missed by banding ((1 - s^rows)^bands at similarity s: under 1e-4 at 0.8 and
1e-6 at 0.85 with the defaults) or by a pruned pair (``miss`` each). Nothing is capped.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.components import connected_components
from ledgerlens.llm.tables import arrow_map, id_type, written
from ledgerlens.llm.text import Words, text_chunks, window_hashes
from ledgerlens.session import remove_path

BANDS, ROWS = 24, 5
BATCH = 24  # signature values compared between two looks at the posterior
MISS = 1e-4
BLOCK = 128  # classes of a bucket that are compared at a time once its star has left it in pieces
SEED = 20


@lru_cache(maxsize=4)
def _hash_family(size: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return (rng.integers(0, 1 << 32, size, dtype=np.uint32) | np.uint32(1))[:, None], rng.integers(0, 1 << 32, size, dtype=np.uint32)[:, None]


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """The least of ``size`` hashes over a set, in slices that stay in the CPU's cache."""
    a, b = _hash_family(size)
    x = shingles.astype(np.uint32)
    best = (a * x[:2048] + b).min(axis=1)
    for i in range(2048, len(x), 2048):
        np.minimum(best, (a * x[i:i + 2048] + b).min(axis=1), out=best)
    return best


def shingle_sets(words: Words, k: int):
    """Per row the sorted distinct hashes of its k-word shingles; fewer than k words are one shingle."""
    windows = words.windows(k)
    for a, z in zip(words.offsets[:-1].tolist(), words.offsets[1:].tolist()):
        yield np.unique(windows[a:z - k + 1] if z - a >= k else window_hashes(words.hashes[a:z], max(1, z - a)))


@lru_cache(maxsize=8)
def least_matches(size: int, batch: int, threshold: float, miss: float) -> list[tuple[int, int]]:
    """(n, m): after n values a pair with fewer than m matches is given up.

    P(similarity >= t | m of n) under a uniform prior is the chance that a binomial with n + 1 trials
    of probability t stays at m or below.
    """
    bounds = []
    for n in [*range(batch, size, batch), size]:
        total, m = 0.0, 0
        while m <= n:
            total += comb(n + 1, m) * threshold ** m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        bounds.append((n, m))
    return bounds


def surviving(a: np.ndarray, b: np.ndarray, bounds: list[tuple[int, int]]) -> np.ndarray:
    """Indices of the row pairs of two signature matrices that no batch gave up."""
    alive, matches, done = np.arange(len(a)), np.zeros(len(a), np.int64), 0
    for n, m in bounds:
        matches[alive] += (a[alive, done:n] == b[alive, done:n]).sum(axis=1)
        alive, done = alive[matches[alive] >= m], n
    return alive


def set_signatures(docs: DataFrame, k: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, n_shingles, cls, sig) per row; ``cls``, a 128-bit digest of the set, is null for an empty set."""
    def run(batches):
        for b in batches:
            for first, end, data, offsets in text_chunks(b.column(2)):
                n, cls, sig = [], [], []
                for s in shingle_sets(Words(data, offsets, lower=True), k):
                    n.append(len(s))
                    cls.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    sig.append(signature(s, size).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([b.column(0)[first:end], b.column(1)[first:end], pa.array(n, pa.int64()), pa.array(cls, pa.binary()),
                                                  pa.array(sig, pa.binary())], ["doc_id", "text_key", "n_shingles", "cls", "sig"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return arrow_map(rows, run, f"doc_id {id_type(rows)}, text_key bigint, n_shingles bigint, cls binary, sig binary")


def class_sets(docs: DataFrame, needed: DataFrame, unnamed: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(v, shingles): the full sets of the needed classes, read from one document of each; ``unnamed``: (v, rep_key),
    the key of a text for the classes without an id."""
    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    wanted = needed.select("v", F.col("v.rep").alias("doc_id"))
    # repeated rows go while the join's partitioning by doc_id still holds
    texts = rows.join(wanted, "doc_id").dropDuplicates(["doc_id", "text_key", "v"]).select("v", "text")
    keyed = needed.join(unnamed, "v").select("v", F.col("rep_key").alias("text_key"))
    texts = texts.unionByName(rows.where("doc_id is null").join(keyed, "text_key").dropDuplicates(["text_key", "v"]).select("v", "text"))

    def run(batches):
        for b in batches:
            for first, end, data, offsets in text_chunks(b.column(1)):
                v = b.column(0).slice(first, end - first)
                sets = [s.tobytes() for s in shingle_sets(Words(data, offsets, lower=True), k)]
                keep = [hashlib.blake2b(s, digest_size=16).digest() == c for s, c in zip(sets, pa.compute.struct_field(v, "cls").to_pylist())]
                batch = pa.RecordBatch.from_arrays([v, pa.array(sets, pa.binary())], ["v", "shingles"])
                yield batch.filter(pa.array(keep, pa.bool_()))

    return arrow_map(texts, run, f"v {wanted.schema['v'].dataType.simpleString()}, shingles binary")


def pruned(pairs: DataFrame, sigs: DataFrame, bounds) -> DataFrame:
    """Pairs (u, v) of classes that survive the sequential comparison of their signatures."""
    with_a = pairs.join(sigs.select(F.col("v").alias("u"), F.col("sig").alias("sig_u")), "u")
    both = with_a.join(sigs.select("v", F.col("sig").alias("sig_v")), "v").select("u", "v", "sig_u", "sig_v")

    def run(batches):
        for b in batches:
            if b.num_rows:
                x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint32).reshape(b.num_rows, -1) for i in (2, 3))
                yield b.select([0, 1]).take(pa.array(surviving(x, y, bounds)))

    kind = pairs.schema["u"].dataType.simpleString()
    return arrow_map(both, run, f"u {kind}, v {kind}")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets have 100 * intersection >= ``percent`` * union."""
    # a star's centre is a hot u: where it is joined first, only rows are split over tasks, not the Python step
    both = (pairs.join(sets.select(F.col("v").alias("u"), F.col("shingles").alias("set_u")), "u")
            .join(sets.select("v", F.col("shingles").alias("set_v")), "v").select("u", "v", "set_u", "set_v"))

    def run(batches):
        for b in batches:
            keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)
                    for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["u"].dataType.simpleString()
    return arrow_map(both, run, f"u {kind}, v {kind}")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= percent * (len(x) + len(y) - common)


def bucket_members(classes: DataFrame, bands: int, rows: int) -> DataFrame:
    """(key, band, v, leader): the classes of every bucket that holds two or more, with the bucket's least class."""
    width = 4 * rows
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("sig", i * width + 1, width)) for i in range(bands)])
    members = classes.select("v", F.posexplode(keys).alias("band", "key"))
    leaders = members.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("leader")).where("n > 1").drop("n")
    return members.join(leaders, "key")


def cross_links(mixed: DataFrame, rows: int, percent: int, bounds) -> DataFrame:
    """Links (u, v) between classes of different components within buckets.

    ``mixed``: (key, band, n, v, c, sig, shingles), n the bucket's size. A bucket is packed into blocks
    of about ``BLOCK`` classes; block meets block in a join on the bucket, and both comparisons run
    inside the task, so pairs are never rows. A pair that shares several buckets is compared in its
    first band only. One link per pair of components and pair of blocks is enough to connect them.
    """
    block = F.pmod(F.xxhash64("v"), F.ceil(F.col("n") / BLOCK))
    packs = (mixed.withColumn("block", block).groupBy("key", "band", "block")
             .agg(F.collect_list(F.struct("v", "c", "sig", "shingles")).alias("pack")))
    left = packs.select("key", "band", F.col("block").alias("i"), F.col("pack").alias("pack_i"))
    right = packs.select("key", F.col("block").alias("j"), F.col("pack").alias("pack_j"))
    # every pack finds itself, so the outer join has the inner one's rows; but of a large bucket the planner splits
    # the left side alone, where it made a task of every piece of one side with every piece of the other
    both = left.join(right, "key", "left").where("j is null or i <= j").select("band", "i", "j", "pack_i", "pack_j")

    def run(batches):
        for b in batches:
            u, v = _links_of_rows(b, rows, percent, bounds)
            kind = b.schema.field(3).type.value_type.field("v").type
            yield pa.RecordBatch.from_arrays([pa.array(u, kind), pa.array(v, kind)], ["u", "v"])

    kind = mixed.schema["v"].dataType.simpleString()
    return arrow_map(both, run, f"u {kind}, v {kind}")


def _links_of_rows(b: pa.RecordBatch, rows: int, percent: int, bounds):
    """Links of a batch of (band, i, j, pack_i, pack_j). A block meets itself by its left pack alone: the right one
    is collected on its own, and its rows need not be in the same order."""
    u, v = [], []
    for row in range(b.num_rows):
        same = b.column(1)[row] == b.column(2)[row]
        x = _unpack(b.column(3)[row].values)
        y = x if same else _unpack(b.column(4)[row].values)
        for a, z in _links_of_blocks(x, y, b.column(0)[row].as_py(), same, rows, percent, bounds):
            u.append(x[0][a])
            v.append(y[0][z])
    return u, v


def _unpack(pack: pa.StructArray):
    """(classes, components as small numbers by value, signatures, sets) of a block."""
    v, c, sig, sets = (pack.field(k) for k in ("v", "c", "sig", "shingles"))
    names = [tuple(x.values()) for x in c.to_pylist()]
    return v.to_pylist(), names, np.frombuffer(b"".join(sig.to_pylist()), np.uint32).reshape(len(v), -1), [np.frombuffer(x, np.uint64) for x in sets.to_pylist()]


def _links_of_blocks(x, y, band: int, same: bool, rows: int, percent: int, bounds):
    """Index pairs (into x, into y) of links between different components; one per pair of components."""
    apart = np.array([[a != b for b in y[1]] for a in x[1]])
    if same:
        apart = np.triu(apart, 1)
    for earlier in range(band):
        cut = slice(earlier * rows, (earlier + 1) * rows)
        apart &= ~(x[2][:, None, cut] == y[2][None, :, cut]).all(axis=2)
    i, j = np.nonzero(apart)
    kept = surviving(x[2][i], y[2][j], bounds)
    if not len(kept):
        return
    i, j = i[kept], j[kept]
    sizes_x, sizes_y = np.array([len(s) for s in x[3]]), np.array([len(s) for s in y[3]])
    near = 100 * np.minimum(sizes_x[i], sizes_y[j]) >= percent * np.maximum(sizes_x[i], sizes_y[j])
    i, j = i[near], j[near]
    if not len(i):
        return
    common = _intersections([x[3][k] for k in np.unique(i)], [y[3][k] for k in np.unique(j)])[
        np.searchsorted(np.unique(i), i), np.searchsorted(np.unique(j), j)]
    linked = 100 * common >= percent * (sizes_x[i] + sizes_y[j] - common)
    seen = set()
    for a, z in zip(i[linked].tolist(), j[linked].tolist()):
        if (x[1][a], y[1][z]) not in seen:
            seen.add((x[1][a], y[1][z]))
            yield a, z


def _intersections(xs: list[np.ndarray], ys: list[np.ndarray], columns: int = 8192) -> np.ndarray:
    """Sizes of all intersections of two lists of sets: incidence matrices times each other, in column slices."""
    both = np.concatenate([*xs, *ys])
    _, column = np.unique(both, return_inverse=True)
    row = np.repeat(np.arange(len(xs) + len(ys)), [len(s) for s in [*xs, *ys]])
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((len(xs), len(ys)))
    top = int(column[-1]) + 1 if len(column) else 0
    for lo in range(0, top, columns):
        a, z = np.searchsorted(column, [lo, lo + columns])
        table = np.zeros((len(xs) + len(ys), min(columns, top - lo)), np.float32)
        table[row[a:z], column[a:z] - lo] = 1
        out += table[:len(xs)] @ table[len(xs):].T
    return out.astype(np.int64)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text",
                    bands: int = BANDS, rows: int = ROWS, miss: float = MISS, scratch: list[str] | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, text_key, representative) per row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text with A-Z lower-cased; a set holds the distinct k-word
    shingles, or the whole sequence if it has fewer words. Documents with 100 * intersection >=
    ``percent`` * union are linked; ``component_id`` is the least doc_id that links reach, ``kept`` says
    whether it is the row's own. ``text_key`` is the XXH64 of the text; ``representative`` marks the rows of one
    text per component (all rows without shingles). Null and empty texts have no shingles and no links: they are kept.
    Rows that repeat a doc_id are each returned; with different texts they are linked only through
    their texts. A null doc_id names no component: such a row links like any other and takes the least id
    that links reach, else null; of a component without any id one text is the representative. Other columns are not read. An empty table gives an empty result.
    ``scratch`` collects the paths of the larger intermediate tables that the result still reads.
    """
    size = bands * rows
    bounds = least_matches(size, BATCH, percent / 100, miss)
    signed = written(set_signatures(docs, k, size, id_col, text_col), "dedup-signatures", scratch)
    # a class that only rows without id have is found again by a text's key
    classes = written(signed.where("cls is not null").groupBy("cls")
                      .agg(F.min("doc_id").alias("rep"), F.min("text_key").alias("text_key"), F.first("sig").alias("sig"))
                      .select(F.struct("rep", "cls").alias("v"), F.when(F.col("rep").isNull(), F.col("text_key")).alias("rep_key"), "sig"), "dedup-classes", scratch)
    members = written(bucket_members(classes, bands, rows), "dedup-members", scratch)
    unnamed = classes.where("v.rep is null").select("v", "rep_key")
    sets = written(class_sets(docs, members.select("v").distinct(), unnamed, k, id_col, text_col), "dedup-sets", scratch)
    stars = pruned(members.where("v <> leader").select(F.col("leader").alias("u"), "v").distinct(), classes, bounds)
    links = written(verified(stars, sets, percent), "dedup-links")
    # the star's centre has been compared with all others; what is left are the others among each other
    centred = connected_components(links, "dedup-stars")
    joined = members.where("v <> leader").join(centred, "v", "left").select("key", "band", "v", F.coalesce("component", "v").alias("c"))
    open_keys = joined.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("key", "n")
    mixed = joined.join(open_keys, "key").join(classes.drop("rep_key"), "v").join(sets, "v")
    more = written(cross_links(mixed.select("key", "band", "n", "v", "c", "sig", "shingles"), rows, percent, bounds), "dedup-more-links")
    # the components so far, as stars, connect what the links did
    found = connected_components(centred.select(F.col("v").alias("u"), F.col("component").alias("v")).unionByName(more), "dedup-components")
    # nulls sort first, so a class without id is the least of its component: the least one with an id takes its place
    better = (found.where("component.rep is null and v.rep is not null").groupBy(F.col("component").alias("first"))
              .agg(F.min("v").alias("with_id")))
    named = (classes.join(found, "v", "left").select("v", "rep_key", F.coalesce("component", "v").alias("first"))
             .join(better, "first", "left").select(F.col("v.cls").alias("cls"), "rep_key", F.coalesce("with_id", "first").alias("least"))
             .select("cls", "rep_key", F.col("least.rep").alias("component_id"), (F.col("least.cls") == F.col("cls")).alias("least")))
    return (signed.drop("sig").join(named, "cls", "left")
            .withColumn("component_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
            .select("doc_id", "n_shingles", "component_id", "kept", "text_key",
                    (F.col("kept") & F.coalesce("least", F.lit(True)) & F.coalesce(F.col("text_key") == F.col("rep_key"), F.lit(True))).alias("representative")))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` less near duplicates: one row of each component, all its columns; rows without
    shingles stay. Repeated rows of a representative become one."""
    scratch: list[str] = []
    found = near_duplicates(docs, k, percent, id_col, text_col, scratch=scratch).where("representative")
    marked = written(found.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")), "dedup-staying")
    for path in scratch:  # nothing reads them any more: make room before the texts move
        remove_path(docs.sparkSession, path)
    keyed = docs.withColumn("_key", F.xxhash64(F.col(text_col).cast("string")))
    staying = keyed.alias("d").join(marked.alias("m"), F.col(f"d.{id_col}").eqNullSafe(F.col("m._id")) & (F.col("d._key") == F.col("m._key")), "left_semi")
    return staying.dropDuplicates([id_col, "_key"]).drop("_key")
