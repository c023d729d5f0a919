"""LM scoring with a log-frequency Bloom filter (operator 10).

Training texts are counted as unigrams and bigrams over words and one end token per text (which is
also the context of a text's first word). A count is quantised to a level: counts of a level are
within a factor of ``LOG_BASE``, small counts have a level each. A gram of level q is put into the
filter once with each of 1..q. A probe asks for 1, 2, ... until the first miss, which gives the level
back; levels are read as the middle of their counts. The score of a text is the sum of log10 P(w | v) with

    P(w | v) = (c(v w) + PRIOR * P(w)) / (c(v) + PRIOR),   P(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)),

all counts from the filter, N and V exact. The plain unigram score beside it uses exact counts.

Building: each task counts whole slices and sends the counts packed by segment (leading bits of a
gram's hash); the number of segments follows the input, so what one segment gathers does not. A
segment sums its counts, sets its bits of the filter and keeps its exact unigram counts as a table.

The filter has between one and two bits per training byte at every size. One of at most 2^``MAX_BITS`` bits is
broadcast. A larger one stays the table of its segments: the texts are cut into slices, a slice's distinct
grams are packed by groups of segments, packs of many slices (salted, so a pack is bounded) meet the bits of
their group, and the levels, written once, go back to the slices. Both ways give the same levels. Keys that are
shuffled ascend, so they go as the steps between them, and a step's shuffle files go when its result is written. Of the words the most frequent,
``TOP_WORDS`` at most, are broadcast with their exact counts, all others are joined with the table of counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.tables import arrow_map, id_type, shuffles_removed, written
from ledgerlens.llm.text import Words, mix, text_chunks

END = np.uint64(0x5A17E4D0E4D05A17)  # hash of the end token
LOG_BASE = 1.2
PROBES = 3
PRIOR = 20.0
MIN_BITS = 16  # of a bit's number in the filter
MAX_BITS = 26  # of a filter that is broadcast (8 MB a worker, and in the driver); larger ones are joined
SEGMENT_BYTES = 1 << 20  # of training text per segment
TOP_WORDS = 1 << 18
FLUSH_TOKENS = 1 << 22
SCORE_BYTES = 1 << 20
SLICE_TOKENS = 1 << 20  # of a slice whose grams are joined with the filter; a longer text is one slice
GROUP_BITS = 24  # segments of so many bits (2 MB) together are one group that a pack of grams meets
PACK_BYTES = 1 << 24  # of grams that meet one copy of a group's bits
SLICE_FILE = {"parquet.block.size": 8 << 20}  # slices are long rows, and readers take a row group at once
#: The least count of each level, up to 10^18.
LEVEL_EDGES = np.unique(np.ceil(LOG_BASE ** np.arange(0, 228) - 1e-9).astype(np.int64))
# Odd multipliers that tell grams, levels and probes apart (fixed values of public hash functions).
UNI, BI, STEP = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB), 0x8EBC6AF09C88C6E3


def tokens_of(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes with an end token after each row's words, offsets of the rows)."""
    return np.insert(words.hashes, words.offsets[1:], END), words.offsets + np.arange(words.rows + 1)


def unigram_keys(tokens: np.ndarray) -> np.ndarray:
    return mix(tokens * UNI)


def bigram_keys(tokens: np.ndarray) -> np.ndarray:
    """Of each token after the one before it; the first follows an end token."""
    before = np.concatenate([[END], tokens[:-1]])
    return mix(mix(before * BI) + tokens)


def levels_of(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVEL_EDGES, counts, side="right")


def counts_of_levels() -> np.ndarray:
    """The middle of the counts of each level; level 0 is 0."""
    return np.concatenate([[0.0], (LEVEL_EDGES[:-1] + LEVEL_EDGES[1:] - 1) / 2, [float(LEVEL_EDGES[-1])]])


class Filter:
    """Places of grams in a filter of 2^``bits`` bits whose leading ``segments`` bits are a key's leading bits."""

    def __init__(self, bits: int, segments: int, data: np.ndarray | None = None):
        self.bits, self.segments, self.data = bits, segments, data

    def segment(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - self.segments)).astype(np.int64) if self.segments else np.zeros(len(keys), np.int64)

    def place(self, keys: np.ndarray, level: int, probe: int) -> np.ndarray:
        """Inside the key's segment."""
        return (mix(keys + np.uint64((level * PROBES + probe) * STEP % (1 << 64))) & np.uint64((1 << (self.bits - self.segments)) - 1)).astype(np.int64)

    def built_segment(self, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        table = np.zeros(max(8, 1 << (self.bits - self.segments)), np.uint8)
        level = levels_of(counts)
        for j in range(1, int(level.max(initial=0)) + 1):
            some = keys[level >= j]
            for i in range(PROBES):
                table[self.place(some, j, i)] = 1
        return np.packbits(table, bitorder="little")

    def levels(self, keys: np.ndarray, first: int = 0) -> np.ndarray:
        """``first``: the segment that ``data`` begins with."""
        out = np.zeros(len(keys), np.int64)
        alive = np.arange(len(keys))
        base = (self.segment(keys) - first) << (self.bits - self.segments)
        for j in range(1, len(LEVEL_EDGES) + 1):
            for i in range(PROBES):
                at = base[alive] + self.place(keys[alive], j, i)
                alive = alive[(self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1]
            if not len(alive):
                break
            out[alive] = j
        return out


def _sums(keys: list[np.ndarray], counts: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts (ones if not given)."""
    keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    if counts is None:
        return np.unique(keys, return_counts=True)
    counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], np.add.reduceat(counts, new) if len(new) else counts


def packed_counts(training: DataFrame, shape: Filter) -> DataFrame:
    """(segment, kind, keys, counts): counts of a slice of the training texts, packed by segment. Kind 0: words
    by their own hash (their segment is that of the unigram's key), 1: bigrams."""
    def pack(kind, keys, counts):
        segment = shape.segment(unigram_keys(keys) if kind == 0 else keys)
        order = np.argsort(segment, kind="stable")
        keys, counts, segment = keys[order], counts[order], segment[order]
        cuts = np.flatnonzero(np.concatenate([[True], segment[1:] != segment[:-1]])) if len(keys) else np.zeros(0, np.int64)
        ends = np.append(cuts[1:], len(keys))
        return pa.RecordBatch.from_arrays(
            [pa.array(segment[cuts], pa.int64()), pa.array(np.full(len(cuts), kind), pa.int32()),
             pa.array([_steps(keys[a:z]) for a, z in zip(cuts, ends)], pa.binary()),
             pa.array([_narrow(counts[a:z]) for a, z in zip(cuts, ends)], pa.binary())], ["segment", "kind", "keys", "counts"])

    def run(batches):
        words, pairs, held = [], [], 0
        for b in batches:
            for _, _, data, offsets in text_chunks(b.column(0)):
                tokens, _ = tokens_of(Words(data, offsets, lower=True))
                words.append(tokens)
                pairs.append(bigram_keys(tokens))
                held += len(tokens)
                if held >= FLUSH_TOKENS:
                    yield pack(0, *_sums(words))
                    yield pack(1, *_sums(pairs))
                    words, pairs, held = [], [], 0
        if held:
            yield pack(0, *_sums(words))
            yield pack(1, *_sums(pairs))

    return arrow_map(training.select("text"), run, "segment bigint, kind int, keys binary, counts binary")


def _narrow(values: np.ndarray) -> bytes:
    """A leading byte for the width, then so many bytes of each value: most are small."""
    values = np.ascontiguousarray(values, "<u8")
    width = max(1, -(-int(values.max(initial=0)).bit_length() // 8))
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _widen(raw: bytes) -> np.ndarray:
    out = np.zeros(((len(raw) - 1) // raw[0], 8), np.uint8)
    out[:, :raw[0]] = np.frombuffer(raw, np.uint8, offset=1).reshape(-1, raw[0])
    return out.reshape(-1).view("<i8")


def _steps(keys: np.ndarray) -> bytes:
    """Ascending keys as the first one and the steps between them: the closer they lie, the fewer bytes each."""
    return keys[:1].tobytes() + _narrow(np.diff(keys))


def _keys(raw: bytes) -> np.ndarray:
    return np.cumsum(np.concatenate([np.frombuffer(raw, np.uint64, 1), _widen(raw[8:]).view(np.uint64)]), dtype=np.uint64)


def built_segments(packed: DataFrame, shape: Filter) -> DataFrame:
    """(segment, bits, words, counts, n_words, n_tokens): a segment's part of the filter and its exact word counts."""
    def run(table: pa.Table) -> pa.Table:
        kind = np.asarray(table.column("kind"))
        keys, counts = table.column("keys").to_pylist(), table.column("counts").to_pylist()
        part = lambda k: _sums([_keys(x) for x, y in zip(keys, kind) if y == k], [_widen(x) for x, y in zip(counts, kind) if y == k])
        (words, word_counts), (pairs, pair_counts) = part(0), part(1)
        bits = shape.built_segment(np.concatenate([unigram_keys(words), pairs]), np.concatenate([word_counts, pair_counts]))
        return pa.table({"segment": table.column("segment").slice(0, 1), "bits": pa.array([bits.tobytes()], pa.binary()),
                         "words": pa.array([words.tobytes()], pa.binary()), "counts": pa.array([_narrow(word_counts)], pa.binary()),
                         "n_words": pa.array([len(words)], pa.int64()), "n_tokens": pa.array([int(word_counts.sum())], pa.int64())})

    return packed.groupBy("segment").applyInArrow(run, "segment bigint, bits binary, words binary, counts binary, n_words bigint, n_tokens bigint")


def word_counts(segments: DataFrame) -> DataFrame:
    """(word, count): exact counts by word hash."""
    def run(batches):
        for b in batches:
            for words, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(words, np.int64)), pa.array(_widen(counts))], ["word", "count"])

    return arrow_map(segments.select("words", "counts"), run, "word bigint, count bigint")


def frequent_words(counts: DataFrame, most: int) -> DataFrame:
    """The words of the highest counts, ``most`` at most: a histogram of count classes (sixteenths of a
    power of two, so a few hundred rows) gives the least count whose words fit."""
    kind = F.floor(F.log2("count") * 16).cast("int")
    fit, least = 0, None
    for r in sorted(counts.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n")).collect(), key=lambda r: -r["kind"]):
        fit += r["n"]
        if fit > most:
            break
        least = r["kind"]
    return counts.where(kind >= least) if least is not None else counts.limit(0)


class Model:
    """What scoring needs: N, V and the most frequent words (of bounded size), the table of all counts, and the filter,
    ``whole`` (broadcast) if it has at most 2^``max_bits`` bits, else as the table of its segments."""

    def __init__(self, training: DataFrame, max_bits: int = MAX_BITS, top_words: int = TOP_WORDS, segment_bytes: int = SEGMENT_BYTES):
        size = int(training.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
        bits = max(MIN_BITS, size.bit_length())
        shape = self.shape = Filter(bits, min(bits - 3, (size // segment_bytes).bit_length()))
        with shuffles_removed(training.sparkSession):
            segments = self.segments = written(built_segments(packed_counts(training, shape), shape), "lm-segments")
        totals = segments.agg(F.sum("n_tokens").alias("n"), F.sum("n_words").alias("v")).first()
        self.tokens, self.words = int(totals["n"] or 0), int(totals["v"] or 0)
        self.counts = word_counts(segments)
        self.whole = bits <= max_bits
        width = 1 << max(0, bits - shape.segments - 3)
        data = np.zeros(max(1, 1 << (bits - 3)) if self.whole else 0, np.uint8)
        for r in segments.select("segment", "bits").toLocalIterator() if self.whole else ():
            data[r["segment"] * width:(r["segment"] + 1) * width] = np.frombuffer(r["bits"], np.uint8)[:width]
        top = frequent_words(self.counts, top_words).toPandas()
        order = np.argsort(top["word"].to_numpy(np.int64).view(np.uint64))
        self.sent = training.sparkSession.sparkContext.broadcast(
            (bits, shape.segments, data, top["word"].to_numpy(np.int64).view(np.uint64)[order], top["count"].to_numpy(np.int64)[order]))

    @property
    def denominator(self) -> float:
        return self.tokens + 0.5 * (self.words + 1)


def rare_tokens(rows: DataFrame, model: Model) -> DataFrame:
    """(row_key, word, times): each row's tokens that are not among the most frequent words."""
    sent = model.sent

    def run(batches):
        top = sent.value[3]
        for b in batches:
            for first, end, data, offsets in text_chunks(b.column(1)):
                tokens, cuts = tokens_of(Words(data, offsets, lower=True))
                at = np.minimum(np.searchsorted(top, tokens), max(0, len(top) - 1))
                rare = np.flatnonzero(top[at] != tokens) if len(top) else np.arange(len(tokens))
                row = np.searchsorted(cuts, rare, side="right") - 1
                order = np.lexsort((tokens[rare], row))
                row, word = row[order], tokens[rare][order]
                new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (word[1:] != word[:-1])])) if len(row) else row
                times = np.diff(np.append(new, len(row)))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(first + row[new])), pa.array(word[new].view(np.int64)), pa.array(times.astype(np.int32))],
                                                 ["row_key", "word", "times"])

    return arrow_map(rows.select("row_key", "text"), run, "row_key bigint, word bigint, times int")


def slice_scores(tokens: np.ndarray, cuts: np.ndarray, level_of, top: np.ndarray, top_counts: np.ndarray, denominator: float) -> list[pa.Array]:
    """n_tokens, top_known, top_score and score of a slice's rows; ``level_of``: from gram keys to their levels."""
    value, starts = counts_of_levels(), cuts[:-1]
    distinct, back = np.unique(tokens, return_inverse=True)
    at = np.minimum(np.searchsorted(top, distinct), max(0, len(top) - 1))
    known = top[at] == distinct if len(top) else np.zeros(len(distinct), bool)
    exact = np.where(known, np.log10(((top_counts[at] if len(top) else 0) + 0.5) / denominator), 0.0)
    single = value[level_of(unigram_keys(distinct))]
    pairs, pair_back = np.unique(bigram_keys(tokens), return_inverse=True)
    pair = value[level_of(pairs)][pair_back]
    context = np.concatenate([single[np.searchsorted(distinct, END)][None], single[back[:-1]]])
    plain = (single[back] + 0.5) / denominator
    bits_of = np.log10((np.minimum(pair, context) + PRIOR * plain) / (context + PRIOR))
    return [pa.array(np.diff(cuts), pa.int64()), pa.array(np.add.reduceat(known[back].astype(np.int64), starts)),
            pa.array(np.add.reduceat(exact[back], starts)), pa.array(np.add.reduceat(bits_of, starts))]


SCORED = ["doc_id", "row_key", "n_tokens", "top_known", "top_score", "score"]


def scored_rows(rows: DataFrame, model: Model) -> DataFrame:
    """(doc_id, row_key, n_tokens, top_known, top_score, score): the model's score, and the exact unigram part
    of the most frequent words."""
    sent, denominator = model.sent, model.denominator
    schema = f"doc_id {id_type(rows)}, row_key bigint, n_tokens bigint, top_known bigint, top_score double, score double"
    if not model.whole:
        return rows_scored_by_join(rows, model, schema)

    def run(batches):
        bits, segments, data, top, top_counts = sent.value
        held = Filter(bits, segments, data)
        for b in batches:
            for first, end, raw, offsets in text_chunks(b.column(2), SCORE_BYTES):
                tokens, cuts = tokens_of(Words(raw, offsets, lower=True))
                yield pa.RecordBatch.from_arrays([b.column(0)[first:end], b.column(1)[first:end],
                                                  *slice_scores(tokens, cuts, held.levels, top, top_counts, denominator)], SCORED)

    return arrow_map(rows.select("doc_id", "row_key", "text"), run, schema)


def slice_keys(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Distinct keys of a slice's unigrams and bigrams, ascending: so by segment."""
    return np.unique(np.concatenate([unigram_keys(words), bigram_keys(words[places])]))


def token_slices(rows: DataFrame) -> DataFrame:
    """(slice, tokens, ids, row_keys, lengths, words, places): rows of about ``SLICE_TOKENS`` tokens together; ``places`` of
    the tokens among the distinct ``words``."""
    kind = id_type(rows)

    def run(batches):
        part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

        def packed():
            ids, keys = (pa.concat_arrays([h[c] for h in held]) for c in (0, 1))
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
            words, places = np.unique(np.concatenate([h[3] for h in held]), return_inverse=True)
            binary = [pa.array([x], pa.binary()) for x in (_narrow(np.concatenate([h[2] for h in held])), _steps(words), _narrow(places))]
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + made], pa.int64()), pa.array([len(places)], pa.int64()), one(ids), one(keys), *binary],
                                              ["slice", "tokens", "ids", "row_keys", "lengths", "words", "places"])

        for b in batches:
            for first, end, raw, offsets in text_chunks(b.column(2), SLICE_TOKENS):
                tokens, cuts = tokens_of(Words(raw, offsets, lower=True))
                held.append((b.column(0)[first:end], b.column(1)[first:end], np.diff(cuts), tokens))
                size += len(tokens)
                if size >= SLICE_TOKENS:
                    yield packed()
                    made, held, size = made + 1, [], 0
        if held:
            yield packed()

    return arrow_map(rows.select("doc_id", "row_key", "text"), run,
                     f"slice bigint, tokens bigint, ids array<{kind}>, row_keys array<bigint>, lengths binary, words binary, places binary")


def slice_probes(slices: DataFrame, groups: Filter) -> DataFrame:
    """(slice, group, keys): the distinct grams of each slice by group of segments, ascending."""
    def run(batches):
        for b in batches:
            for at, words, places in zip(*(b.column(c).to_pylist() for c in range(3))):
                keys = slice_keys(_keys(words), _widen(places))
                group = groups.segment(keys)
                cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
                ends = np.append(cuts[1:], len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cuts), at, np.int64)), pa.array(group[cuts]),
                                                  pa.array([_steps(keys[a:z]) for a, z in zip(cuts, ends)], pa.binary())], ["slice", "group", "keys"])

    return arrow_map(slices.select("slice", "words", "places"), run, "slice bigint, group bigint, keys binary")


def probed_levels(probes: DataFrame, segments: DataFrame, shape: Filter, groups: Filter, salts: int) -> DataFrame:
    """(slice, group, levels): a byte per gram of ``probes``, in its order. A group's bits are copied ``salts`` times."""
    each, width = shape.segments - groups.segments, 1 << (shape.bits - shape.segments - 3)

    def run(asked: pa.Table, held: pa.Table) -> pa.Table:
        keys = [_keys(k) for k in asked.column("keys").to_pylist()]
        distinct, back = np.unique(np.concatenate([*keys, np.zeros(0, np.uint64)]), return_inverse=True)
        level = np.zeros(len(distinct), np.uint8)
        if held.num_rows and len(distinct):
            first = held.column("group")[0].as_py() << each
            bits = np.zeros(width << each, np.uint8)
            for at, raw in zip(held.column("segment").to_pylist(), held.column("bits").to_pylist()):
                bits[(at - first) * width:(at - first + 1) * width] = np.frombuffer(raw, np.uint8)
            level = Filter(shape.bits, shape.segments, bits).levels(distinct, first).astype(np.uint8)
        ends = np.cumsum([len(k) for k in keys])
        parts = [x.tobytes() for x in np.split(level[back], ends[:-1])] if keys else []
        return pa.table({"slice": asked.column("slice"), "group": asked.column("group"), "levels": pa.array(parts, pa.binary())})

    asked = probes.withColumn("salt", F.pmod(F.xxhash64("slice"), F.lit(salts)))
    held = (segments.select(F.shiftright("segment", each).alias("group"), "segment", "bits")
            .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long")))))
    return (asked.groupBy("group", "salt").cogroup(held.groupBy("group", "salt"))
            .applyInArrow(run, "slice bigint, group bigint, levels binary"))


def rows_scored_by_join(rows: DataFrame, model: Model, schema: str) -> DataFrame:
    """``scored_rows`` for a filter that is too large to broadcast."""
    sent, denominator, shape = model.sent, model.denominator, model.shape
    groups = Filter(shape.bits, min(shape.segments, max(0, shape.bits - GROUP_BITS)))
    slices = written(token_slices(rows), "lm-slices", options=SLICE_FILE)  # numbered by task, so kept before anything joins them
    # eight bytes a gram, and a slice has no more bigrams than tokens
    asked = int(slices.agg(F.sum(F.col("tokens") * 8 + F.octet_length("words"))).first()[0] or 0)
    salts = max(1, -(-asked // (PACK_BYTES << groups.segments)))
    with shuffles_removed(rows.sparkSession):  # the grams have gone from the disk when the slices are shuffled
        levels = written(probed_levels(slice_probes(slices, groups), model.segments, shape, groups, salts), "lm-levels")

    def run(texts: pa.Table, found: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(found.column("group")), kind="stable")
        parts = found.column("levels").to_pylist()
        level = np.frombuffer(b"".join([parts[i] for i in order]), np.uint8)
        _, _, _, top, top_counts = sent.value
        ids, row_keys = (texts.column(c)[0].values for c in ("ids", "row_keys"))
        lengths, places = (_widen(texts.column(c)[0].as_py()) for c in ("lengths", "places"))
        words = _keys(texts.column("words")[0].as_py())
        keys = slice_keys(words, places)
        scores = slice_scores(words[places], np.concatenate([[0], np.cumsum(lengths)]), lambda k: level[np.searchsorted(keys, k)], top, top_counts, denominator)
        return pa.table([ids, row_keys, *scores], SCORED)

    return slices.groupBy("slice").cogroup(levels.groupBy("slice")).applyInArrow(run, schema)


def score_documents(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs``, learnt from ``training``
    (same columns).

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end token, counted as a token. ``base_score`` is the
    exact smoothed unigram score, ``score`` the bigram model's, both log10. Null texts are empty: one end
    token. Repeated rows count and are scored as often as they occur; null ids are kept. Without
    training texts no token is known (V = N = 0). Other columns are not read. An empty table gives an
    empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    model = Model(training.select(text.alias("text")))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("row_key"), text.alias("text"))
    unknown = F.coalesce("count", F.lit(0))
    rare = (rare_tokens(rows, model).join(model.counts, "word", "left")
            .groupBy("word", "row_key").agg(F.max("times").alias("times"), F.max(unknown).alias("c"))
            .groupBy("row_key").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"),
                                    F.sum(F.col("times") * F.log10((F.col("c") + 0.5) / F.lit(model.denominator))).alias("rare_score")))
    with shuffles_removed(docs.sparkSession):
        rare = written(rare, "lm-rare")
    return (scored_rows(rows, model).join(rare, "row_key", "left")
            .select("doc_id", "n_tokens", (F.col("top_known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
                    F.lit(model.tokens).cast("long").alias("train_tokens"),
                    (F.col("top_score") + F.coalesce("rare_score", F.lit(0.0))).alias("base_score"), "score"))
