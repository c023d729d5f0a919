"""Line dedup with two Bloom filters (operator 12).

A line's key is the line stripped and lower-cased; keys that several documents hold keep their lines in the first
of them only. What moves between machines is small until a key is suspected:

1. The documents of a task are cut into slices of bounded size. A slice is one row of a written table: per document
   the 128-bit digests of its distinct keys. Texts are read, not moved.
2. Each slice sends every distinct key once, as a 32-bit address in one of the filter's segments (leading bits of
   the digest), with a mark if several documents of the slice hold it. The number of segments follows the
   number of keys, so what meets in one segment does not grow.
3. A segment fills two Bloom filters with the addresses, pack after pack: an address whose bits are all set in
   the filter of once-seen ones goes into the filter of twice-seen ones. It then answers each slice with those
   of its addresses that are in the second filter. No key that two documents hold is missed.
4. Only those suspected repeats are shuffled, by their whole digests: the least and greatest id per digest confirm or
   reject the suspicion and name the first occurrence. Documents then learn which of their keys to drop. A digest
   that so many rows hold that at most ``HOT`` such digests can exist is looked up by broadcast, all others by a join.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.tables import arrow_map, id_type, written
from ledgerlens.llm.text import mix

SPACES = b" \t\n\x0b\x0c\r"
FOLLOWING = bytes(range(0x80, 0xC0))  # bytes that do not begin a code point
DIGEST = 16
SLICE_KEYS = 1 << 16  # keys of a slice; a document with more is a slice of its own
SEGMENT_KEYS = 1 << 19  # keys of a segment aimed at
BITS_PER_KEY, PROBES = 16, 4
#: A digest found in more than one of ``HOT`` of the suspected rows is looked up by broadcast: there are fewer than ``HOT`` of these.
HOT = 4096
STEPS = [np.uint64(0xD1B54A32D192ED03 * (i + 1) % (1 << 64)) for i in range(PROBES)]


def line_key(line: bytes) -> bytes:
    return line.strip(SPACES).lower()


def long_enough(key: bytes, least: int) -> bool:
    """At least ``least`` code points."""
    return len(key) >= least and (len(key) >= 4 * least or key.isascii() or len(key.translate(None, FOLLOWING)) >= least)


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=DIGEST).digest()


def as_bytes(texts: pa.Array) -> list[bytes]:
    """Nulls are empty."""
    return texts.cast(pa.large_binary()).fill_null(b"").to_pylist()


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def key_slices(rows: DataFrame, least: int) -> DataFrame:
    """(slice, doc_ids, text_keys, counts, digests): the distinct keys of each document, a bounded number of documents in a row."""
    kind = id_type(rows)

    def run(batches):
        number, schema = TaskContext.get().partitionId() << 32, None
        ids, names, counts, held = [], [], [], bytearray()

        def slice_row():
            return pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int64()), pa.array([ids], pa.list_(schema)), pa.array([names], pa.list_(pa.int64())),
                 pa.array([counts], pa.list_(pa.int32())), pa.array([bytes(held)], pa.binary())], ["slice", "doc_ids", "text_keys", "counts", "digests"])

        for b in batches:
            schema = b.schema.field(0).type
            for doc, name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2))):
                keys = {key for key in map(line_key, text.split(b"\n")) if long_enough(key, least)}
                if not keys:
                    continue
                ids.append(doc)
                names.append(name)
                counts.append(len(keys))
                held += b"".join(map(digest, keys))
                if len(held) >= SLICE_KEYS * DIGEST:
                    yield slice_row()
                    number, ids, names, counts, held = number + 1, [], [], [], bytearray()
        if ids:
            yield slice_row()

    return arrow_map(rows, run, f"slice bigint, doc_ids array<{kind}>, text_keys array<bigint>, counts array<int>, digests binary")


def places(digests: bytes, segments: int) -> np.ndarray:
    """Segment and 32-bit address of each digest, in one number: its leading ``segments`` + 32 bits."""
    return np.frombuffer(digests, ">u8").astype(np.uint64)[::DIGEST // 8] >> np.uint64(32 - segments)


def packed_places(slices: DataFrame, segments: int) -> DataFrame:
    """(segment, slice, once, again): a slice's distinct addresses in a segment, and those that several of its documents hold."""
    def run(batches):
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                place, times = np.unique(places(raw, segments), return_counts=True)
                segment, address = (place >> np.uint64(32)).astype(np.int64), place.astype(np.uint32)
                cuts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]])) if len(place) else np.zeros(0, np.int64)
                ends = np.append(cuts[1:], len(place))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(segment[cuts]), pa.array(np.full(len(cuts), name)), pa.array([address[a:z].tobytes() for a, z in zip(cuts, ends)], pa.binary()),
                     pa.array([address[a:z][times[a:z] > 1].tobytes() for a, z in zip(cuts, ends)], pa.binary())], ["segment", "slice", "once", "again"])

    return arrow_map(slices.select("slice", "digests"), run, "segment bigint, slice bigint, once binary, again binary")


class Bloom:
    """A Bloom filter of 32-bit addresses, a byte per bit while its segment is at work."""

    def __init__(self, keys: int):
        self.bits = max(10, (keys * BITS_PER_KEY - 1).bit_length())
        self.data = np.zeros(1 << self.bits, np.uint8)

    def at(self, addresses: np.ndarray) -> list[np.ndarray]:
        wide = addresses.astype(np.uint64)
        return [mix(wide + step) >> np.uint64(64 - self.bits) for step in STEPS]

    def add(self, addresses: np.ndarray) -> None:
        for at in self.at(addresses):
            self.data[at] = 1

    def holds(self, addresses: np.ndarray) -> np.ndarray:
        found = np.ones(len(addresses), bool)
        for at in self.at(addresses):
            found &= self.data[at] == 1
        return found


def suspected_places(packs: DataFrame) -> DataFrame:
    """(slice, hits): the addresses of each slice, with their segment, that the twice-seen filter holds."""
    def run(table: pa.Table) -> pa.Table:
        once = [np.frombuffer(x, np.uint32) for x in table.column("once").to_pylist()]
        again = [np.frombuffer(x, np.uint32) for x in table.column("again").to_pylist()]
        keys = sum(map(len, once))
        seen, twice = Bloom(keys), Bloom(keys)
        for pack, repeated in zip(once, again):
            twice.add(pack[seen.holds(pack)])
            twice.add(repeated)
            seen.add(pack)
        segment = np.uint64(table.column("segment")[0].as_py()) << np.uint64(32)
        hits = [pack[twice.holds(pack)] for pack in once]
        some = [i for i, h in enumerate(hits) if len(h)]
        return pa.table({"slice": table.column("slice").take(pa.array(some, pa.int64())),
                         "hits": pa.array([(hits[i].astype(np.uint64) | segment).tobytes() for i in some], pa.binary())})

    return packs.groupBy("segment").applyInArrow(run, "slice bigint, hits binary")


def suspected_keys(slices: DataFrame, hits: DataFrame, segments: int, kind: str) -> DataFrame:
    """(doc_id, text_key, digest): the suspected keys of each document."""
    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                raw = b.column("digests")[r].as_py()
                wanted = np.sort(np.concatenate([np.frombuffer(x, np.uint64) for x in b.column("hits")[r].as_py()]))
                place = places(raw, segments)
                some = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, place), len(wanted) - 1)] == place)
                row = pa.array(np.repeat(np.arange(len(b.column("counts")[r])), np.asarray(b.column("counts")[r].values))[some])
                yield pa.RecordBatch.from_arrays([b.column("doc_ids")[r].values.take(row), b.column("text_keys")[r].values.take(row),
                                                  pa.array([raw[i * DIGEST:(i + 1) * DIGEST] for i in some.tolist()], pa.binary())], ["doc_id", "text_key", "digest"])

    answers = hits.groupBy("slice").agg(F.collect_list("hits").alias("hits"))
    return arrow_map(slices.join(answers, "slice"), run, f"doc_id {kind}, text_key bigint, digest binary")


def dropped_keys(suspects: DataFrame) -> DataFrame:
    """(doc_id, text_key, drop array<binary>): the digests of keys whose lines a document loses."""
    total = suspects.count()
    seen = suspects.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"),
                                          F.count_if(F.col("doc_id").isNull()).alias("nameless"), F.count(F.lit(1)).alias("n"))
    repeated = written(seen.where((F.col("first") != F.col("last")) | (F.col("first").isNotNull() & (F.col("nameless") > 0)))
                       .select("digest", "first", (F.col("n") * HOT > total).alias("hot")), "line-repeats")
    loses = F.col("doc_id").isNull() | (F.col("doc_id") != F.col("first"))
    hot = F.broadcast(repeated.where("hot").select("digest", "first"))
    lost = (suspects.join(hot, "digest").where(loses).select("doc_id", "text_key", "digest")
            .unionByName(suspects.join(hot, "digest", "left_anti").join(repeated.where(~F.col("hot")), "digest").where(loses).select("doc_id", "text_key", "digest")))
    return lost.groupBy("doc_id", "text_key").agg(F.collect_set("digest").alias("drop"))


def repeated_keys(docs: DataFrame, least: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, drop) of the documents that lose lines; ``text_key`` is ``xxhash64`` of the text."""
    rows = _rows(docs, id_col, text_col)
    slices = written(key_slices(rows, least), "line-slices", options={"parquet.block.size": 16 << 20})
    keys = slices.agg(F.sum(F.octet_length("digests"))).first()[0] or 0
    segments = min(32, (int(keys) // DIGEST // SEGMENT_KEYS).bit_length())
    hits = suspected_places(packed_places(slices, segments))
    return dropped_keys(written(suspected_keys(slices, hits, segments, id_type(rows)), "line-suspects"))


def dedup_lines(docs: DataFrame, least: int = 10, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept) per row of ``docs``.

    A text is split at ``\\n``; a line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends, A-Z lower-cased. Keys of
    at least ``least`` code points found in at least two documents lose all their lines except in the smallest
    doc_id holding them. ``kept``: the other lines, unchanged, joined by ``\\n``, or (``texts`` false) the SHA-256 of that in hex.

    A null or empty text is one empty line. Rows that repeat a doc_id are one document here: a key they share
    is no repeat, and both keep it or lose it. A row without doc_id is a document of its own after all others: it
    loses keys that a document with an id holds, and keys held only by rows without id stay everywhere.
    Equality of keys is that of their 128-bit digests. Other columns are not read. An empty table gives an empty result.
    """
    rows = _rows(docs, id_col, text_col)
    lost = repeated_keys(docs, least, id_col, text_col).select(F.col("doc_id").alias("d2"), F.col("text_key").alias("k2"), "drop")
    both = rows.join(lost, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("text_key") == F.col("k2")), "left").select("doc_id", "text", "drop")

    def run(batches):
        for b in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, drop in zip(as_bytes(b.column(1)), b.column(2)):
                if drop.is_valid:
                    gone, lines = set(drop.as_py()), text.split(b"\n")
                    stay = [line for line in lines if not (long_enough(key := line_key(line), least) and digest(key) in gone)]
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(stay))
                    text = b"\n".join(stay)
                else:
                    n_lines.append(text.count(b"\n") + 1)
                    n_dropped.append(0)
                kept.append(text.decode() if texts else hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())],
                                             ["doc_id", "n_lines", "n_dropped", "kept"])

    return arrow_map(both, run, f"doc_id {id_type(rows)}, n_lines bigint, n_dropped bigint, kept string")
