"""Language ID by prediction by partial matching (operator 3).

Per language a byte context tree of order ``ORDER`` is counted on a bounded sample of labelled texts
and then frozen. A byte's code length follows from the longest context the language has seen: with T
occurrences and D distinct followers, a follower seen c times has probability c / (T + D), and
escaping to the next shorter context costs D / (T + D) (method C); below order 0 all 256 bytes are
equally likely. A text's code length under a language is the exact sum over all its bytes; the
shortest wins, ties go to the smaller name.

Frozen statistics make a byte's cost a function of the last ``ORDER`` + 1 bytes, so a worker scores
whole batches with numpy: paths of the trees that were seen are looked up in a hash table of costs
for all languages at once, other windows walk the escape chain once per distinct window. Scoring is
a map over documents: nothing is shuffled.
"""

from __future__ import annotations

import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.tables import arrow_map, id_type

ORDER = 3
#: The bound of the training sample: documents per language, and characters of each.
TRAIN_DOCS = 300
TRAIN_CHARS = 8_000
BITS = 21  # of a slot number in the hash table of seen paths
# Odd 64-bit multipliers of the table's levels (fixed values of public hash functions).
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)
PAD = b"\n" * ORDER  # what precedes a text
LETTER = re.compile("[A-Za-z]")


def training_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    per_lang: int = TRAIN_DOCS, chars: int = TRAIN_CHARS) -> list[tuple[str, str]]:
    """(lang, text) of at most ``per_lang`` labelled documents per language, those of least hash, with
    at most ``chars`` characters each.

    A hash threshold per language, twice what is wanted over the language's documents, leaves a
    bounded number of rows before anything is ranked or shuffled. Labels are few (each has a tree in
    every worker), so their counts come to the driver.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.xxhash64(id_col).alias("h"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    share = {r["lang"]: min(1.0, 2.0 * per_lang / r["n"]) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not share:
        return []
    kept = F.create_map(*[F.lit(x) for pair in share.items() for x in pair])[F.col("lang")]
    some = rows.where(F.pmod("h", F.lit(1 << 30)) < kept * F.lit(float(1 << 30))).select("lang", "h", "id", F.substring("text", 1, chars).alias("text"))
    ranked = some.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h", "id", "text"))).where(F.col("r") <= per_lang)
    return sorted((r["lang"], r["text"]) for r in ranked.select("lang", "text").collect())


class ContextTrees:
    """Frozen context trees of several languages and the exact code lengths they give."""

    def __init__(self, sample: list[tuple[str, str]]):
        self.key = uuid.uuid4().hex
        self.langs = sorted({lang for lang, _ in sample})
        self.trees = [self._tree([t.encode() for lang, t in sample if lang == x]) for x in self.langs]
        seen = [tree[ORDER][0] for tree in self.trees]
        self.paths = np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.uint32)
        self.costs = self.chain(self.paths)

    @staticmethod
    def _tree(texts: list[bytes]):
        """Per order k: sorted paths (k context bytes and the follower), their counts; sorted contexts, T and D."""
        codes = np.concatenate([_codes(np.frombuffer(PAD + t, np.uint8))[len(PAD):] for t in texts])
        tree = []
        for k in range(ORDER + 1):
            paths, counts = np.unique(codes & np.uint32((1 << 8 * (k + 1)) - 1), return_counts=True)
            contexts, first, followers = np.unique(paths >> np.uint32(8), return_index=True, return_counts=True)
            totals = np.add.reduceat(counts, first) if len(counts) else counts
            tree.append((paths, counts.astype(float), contexts, totals.astype(float), followers.astype(float)))
        return tree

    def chain(self, codes: np.ndarray) -> np.ndarray:
        """(windows, languages): bits of each window's last byte after its first ``ORDER`` bytes, by the escape chain."""
        out = np.zeros((len(codes), len(self.langs)))
        for column, tree in enumerate(self.trees):
            open_ = np.ones(len(codes), bool)
            bits = np.zeros(len(codes))
            for k in range(ORDER, -1, -1):
                paths, counts, contexts, totals, followers = tree[k]
                if not len(paths):
                    continue
                path = codes & np.uint32((1 << 8 * (k + 1)) - 1)
                c_at, c_known = _find(contexts, path >> np.uint32(8))
                p_at, p_known = _find(paths, path)
                whole = totals[c_at] + followers[c_at]
                bits += np.where(open_ & p_known, np.log2(whole / counts[p_at]), 0)
                bits += np.where(open_ & c_known & ~p_known, np.log2(whole / followers[c_at]), 0)
                open_ &= ~p_known
            out[:, column] = bits + 8 * open_
        return out

    def tables(self) -> list[np.ndarray]:
        """Slot to row number + 1, level by level; a path that finds its slot taken goes to the next level."""
        left, levels = np.arange(len(self.paths)), []
        for m in MULTIPLIERS:
            if not len(left):
                break
            table = np.zeros(1 << BITS, np.int32)
            slots = _slots(self.paths[left], m)
            table[slots[::-1]] = left[::-1] + 1
            left = left[table[slots] != left + 1]
            levels.append(table)
        return levels

    def window_costs(self, codes: np.ndarray) -> np.ndarray:
        """``chain`` for long arrays: seen paths by table, the others by the chain, once per distinct window."""
        if not hasattr(self, "levels"):
            self.levels = self.tables()
        row = np.full(len(codes), -1, np.int64)
        todo = slice(None)
        for table, m in zip(self.levels, MULTIPLIERS):
            got = table[_slots(codes[todo], m)].astype(np.int64) - 1
            hit = (got >= 0) & (self.paths[got] == codes[todo])
            if isinstance(todo, slice):
                row = np.where(hit, got, -1)
                todo = np.flatnonzero(~hit)
            else:
                row[todo[hit]] = got[hit]
                todo = todo[~hit]
            if not len(todo):
                break
        costs = self.costs[row] if len(self.costs) else np.zeros((len(codes), len(self.langs)))
        miss = np.flatnonzero(row < 0)
        if len(miss):
            distinct, back = np.unique(codes[miss], return_inverse=True)
            costs[miss] = self.chain(distinct)[back]
        return costs

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages): bits of each whole text."""
        out = np.zeros((len(texts), len(self.langs)))
        bounds = np.cumsum([len(PAD) + len(t) for t in texts])
        costs = self.window_costs(_codes(np.frombuffer(b"".join(PAD + t for t in texts), np.uint8)))
        ends = bounds
        starts = ends - np.array([len(t) for t in texts])
        full = np.flatnonzero(ends > starts)
        if len(full):
            cuts = np.stack([starts[full], ends[full]], 1).ravel()
            padded = np.concatenate([costs, np.zeros((1, costs.shape[1]))])
            out[full] = np.add.reduceat(padded, cuts, axis=0)[::2]
        return out


def _codes(b: np.ndarray) -> np.ndarray:
    """The last four bytes at each position as one number; ``ORDER`` is 3."""
    x = b.astype(np.uint32)
    out = x.copy()
    for k in range(1, ORDER + 1):
        out[k:] |= x[:-k] << np.uint32(8 * k)
    return out


def _slots(codes: np.ndarray, multiplier: int) -> np.ndarray:
    return (codes.astype(np.uint64) * np.uint64(multiplier)) >> np.uint64(64 - BITS)


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def has_letter(text: str) -> bool:
    return bool(LETTER.search(text)) or any(map(str.isalpha, text))


_MODELS: dict = {}


def predict_languages(docs: DataFrame, model: ContextTrees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte) for every row of ``docs``, each text scored whole.

    ``score`` is the winner's share if all languages are equally likely beforehand: 2 to the minus
    code length, over the sum of all languages'. Null texts, texts without a letter and a model
    without languages give ``und``, 0 and null. Repeated rows and null ids are kept; other columns
    are not read. An empty table gives an empty result. The model's size is bounded by its sample.
    """
    def run(batches):
        m = _MODELS.setdefault(model.key, model)
        step = max(1 << 16, (1 << 22) // max(1, len(m.langs)))
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            start = size = 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size >= step or i == len(texts) - 1:
                    yield _scored(m, ids.slice(start, i + 1 - start), texts[start:i + 1])
                    start, size = i + 1, 0

    rows = docs.selectExpr(f"`{id_col}` as doc_id", f"cast(`{text_col}` as string) as text")
    return arrow_map(rows, run, f"doc_id {id_type(rows)}, lang_pred string, score double, bits_per_byte double")


#: Texts of fewer bytes are not judged by their code length, which says little of them; the others by class of length.
JUDGED = (400, 1600)
#: A text is in no learnt language if it needs this many times the bits per byte of the worst held-out labelled text.
SLACK = 1.5
FEWEST = 30  # held-out labelled texts of a class, for a bound to be learnt


def rate_bounds(held_out: DataFrame, model: ContextTrees, text_col: str = "text") -> list[float]:
    """Per class of ``JUDGED`` the bits per byte that a text in a learnt language stays under: ``SLACK`` times the greatest
    of all ``held_out`` rows (labelled, not learnt from); infinite for a class with fewer than ``FEWEST`` of them."""
    size = F.octet_length(F.col(text_col).cast("string"))
    scored = predict_languages(held_out.select(size.alias("doc_id"), F.col(text_col).alias("text")).where(F.col("doc_id") >= JUDGED[0]), model)
    kind = sum((F.col("doc_id") >= least).cast("int") for least in JUDGED) - 1
    found = scored.groupBy(kind.alias("kind")).agg(F.count("bits_per_byte").alias("n"), F.max("bits_per_byte").alias("most")).collect()  # one row a class
    known = {r["kind"]: r["most"] * SLACK for r in found if r["n"] >= FEWEST}
    return [known.get(k, float("inf")) for k in range(len(JUDGED))]


def in_known_language(docs: DataFrame, model: ContextTrees, bounds: list[float] | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, whose text is in a language the model has learnt; all rows if it has learnt none.

    Texts without a letter go, and texts of at least ``JUDGED[0]`` bytes whose best language needs more bits per byte than
    ``bounds`` (of ``rate_bounds``) allows for their length. A null ``lang_col`` becomes the predicted language.
    """
    if not model.langs:
        return docs
    place = docs.columns.index(text_col)
    named = docs.columns.index(lang_col) if lang_col in docs.columns else None
    limits = np.array([float("inf"), *(bounds or [float("inf")] * len(JUDGED))])

    def run(batches):
        m = _MODELS.setdefault(model.key, model)
        step = max(1 << 16, (1 << 22) // max(1, len(m.langs)))
        for b in batches:
            texts, start, size = b.column(place).to_pylist(), 0, 0
            for i, t in enumerate(texts):
                size += len(t or "")
                if size >= step or i == len(texts) - 1:
                    part = b.slice(start, i + 1 - start)
                    scored = _scored(m, pa.nulls(len(part)), texts[start:i + 1])
                    lengths = [len(x.encode()) if x else 0 for x in texts[start:i + 1]]
                    limit = limits[np.searchsorted(JUDGED, lengths, side="right")]
                    rate = np.array([x or 0.0 for x in scored.column(3).to_pylist()])
                    keep = [p != "und" and r <= most for p, r, most in zip(scored.column(1).to_pylist(), rate, limit)]
                    if named is not None and part.column(named).null_count:
                        filled = pa.compute.coalesce(part.column(named), scored.column(1).cast(part.column(named).type))
                        part = part.set_column(named, part.schema.field(named), filled)
                    yield part.filter(pa.array(keep, pa.bool_()))
                    start, size = i + 1, 0

    return arrow_map(docs, run, docs.schema)


def _scored(m: ContextTrees, ids, texts: list) -> pa.RecordBatch:
    known = [i for i, t in enumerate(texts) if m.langs and t and has_letter(t)]
    pred, score, rate = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
    if known:
        raw = [texts[i].encode() for i in known]
        bits = m.code_lengths(raw)
        best = bits.argmin(axis=1)
        least = bits[np.arange(len(best)), best]
        share = 1.0 / np.exp2(np.maximum(least[:, None] - bits, -1000.0)).sum(axis=1)
        for i, r, k, s, x in zip(known, raw, best.tolist(), share.tolist(), least.tolist()):
            pred[i], score[i], rate[i] = m.langs[k], s, x / len(r)
    return pa.RecordBatch.from_arrays([ids, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rate, pa.float64())],
                                      ["doc_id", "lang_pred", "score", "bits_per_byte"])
