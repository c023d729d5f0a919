"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks (operator 2).

A piece (what the pre-tokenizer's pattern cuts off) starts as its bytes. The leaves of a segment
tree hold, per adjacent pair of symbols, its merge rank and position; inner nodes hold the least of
their children, so the root is the leftmost pair of lowest rank. A merge changes three leaves (the
merged pair vanishes, its two neighbours get new ranks) and updates their paths: logarithmic work a
merge, until the root holds no mergeable pair.

Two forms of the same tree: ``merge_piece`` for one piece of any length, and ``merge_many``, which
runs the trees of many short pieces side by side in numpy arrays, one merge of each per step. A
worker keeps the symbols of pieces it has met in a cache of bounded size. Documents are dealt to
tasks by Spark, each is encoded whole in its task, and nothing is shuffled.
"""

from __future__ import annotations

import gc
import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerlens.llm.tables import arrow_map, id_type

# Fixed value: the published pre-tokenizer pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of a generation of the cache; two generations and as many pieces are kept at most.
GENERATION = 1 << 19
#: The same where the ids themselves are wanted, beside whose arrays a worker has less room.
IDS_GENERATION = 1 << 16
SHORT = 32  # symbols of pieces that share the numpy trees
NONE = np.int64(1) << 40


def byte_alphabet() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 characters
    stand for themselves, the others for code points from 256 on, in order."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class Vocabulary:
    """Ranks, symbols and special strings of a ``tokenizers`` JSON file of byte-level BPE."""

    def __init__(self, spec: str):
        import regex
        model = json.loads(spec)
        alphabet = byte_alphabet()
        to_byte = {c: b for b, c in alphabet.items()}
        vocab = model["model"]["vocab"]
        as_bytes = lambda s: bytes(to_byte[c] for c in s)
        special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
        size = max([*vocab.values(), *special.values()]) + 1
        self.bytes_of = [b""] * size
        for s, i in vocab.items():
            if s not in special:
                self.bytes_of[i] = as_bytes(s)
        for s, i in special.items():
            self.bytes_of[i] = s.encode()
        self.byte_ids = np.array([vocab[alphabet[b]] for b in range(256)], np.int64)
        pairs = [m.split(" ", 1) if isinstance(m, str) else m for m in model["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        merged = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.ranks = {}
        for r, (a, b, m) in enumerate(zip(left.tolist(), right.tolist(), merged.tolist())):
            self.ranks.setdefault((a, b), (r, m))
        keys = left << 20 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.key_ranks, self.key_merged = keys[order], order.astype(np.int64), merged[order]
        self.pieces = regex.compile(PATTERN)
        self.long_run = regex.compile(r"\s[ \n](?:\s|\Z)")
        self.special = special
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None

    def rank(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (``NONE`` if the pair has none) and merged symbol of the pairs."""
        want = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        known = self.keys[at] == want
        return np.where(known, self.key_ranks[at], NONE), self.key_merged[at]


@lru_cache(maxsize=2)
def vocabulary(spec: str) -> Vocabulary:
    return Vocabulary(spec)


def merge_piece(v: Vocabulary, piece: bytes) -> list[int]:
    """Symbols of one piece; the tree is a flat list with its root at 1."""
    symbols = [int(v.byte_ids[b]) for b in piece]
    n = len(symbols)
    if n < 2:
        return symbols
    none = (1 << 60, 0)
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [none] * (2 * size)
    rank = v.ranks
    for i in range(n - 1):
        got = rank.get((symbols[i], symbols[i + 1]))
        if got:
            tree[size + i] = (got[0], i)
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))

    def put(i: int, leaf: tuple[int, int]) -> None:
        i += size
        tree[i] = leaf
        while i > 1:
            i >>= 1
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

    while tree[1] is not none and tree[1][0] < none[0]:
        i = tree[1][1]
        j = after[i]
        symbols[i] = rank[symbols[i], symbols[j]][1]
        symbols[j] = -1
        k = after[i] = after[j]
        if j < n - 1:
            put(j, none)
        if k < n:
            before[k] = i
            got = rank.get((symbols[i], symbols[k]))
            put(i, (got[0], i) if got else none)
        else:
            put(i, none)
        h = before[i]
        if h >= 0:
            got = rank.get((symbols[h], symbols[i]))
            put(h, (got[0], h) if got else none)
    return [s for s in symbols if s >= 0]


def merge_many(v: Vocabulary, pieces: list[bytes]) -> list[list[int]]:
    """``merge_piece`` for many pieces of at most ``SHORT`` bytes: one tree a row, one merge a row
    and step. Leaf values are rank * width + position, so the least is the leftmost lowest rank."""
    if not pieces:
        return []
    lengths = np.array([len(p) for p in pieces], np.int64)
    n, width = len(pieces), max(2, 1 << int(max(lengths.max() - 1, 1)).bit_length())
    flat = v.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
    symbols = np.full((n, width + 1), -1, np.int64)
    symbols[:, :width][np.arange(width) < lengths[:, None]] = flat
    place = np.arange(width, dtype=np.int64)
    tree = np.full((n, 2 * width), NONE * width, np.int64)
    paired = place[None, :] + 1 < lengths[:, None]
    ranks, _ = v.rank(symbols[:, :width][paired], symbols[:, 1:][paired])
    leaves = tree[:, width:]
    leaves[paired] = ranks * width + np.broadcast_to(place, (n, width))[paired]
    for level in range(width.bit_length() - 2, -1, -1):
        lo = 1 << level
        tree[:, lo:2 * lo] = np.minimum(tree[:, 2 * lo:4 * lo:2], tree[:, 2 * lo + 1:4 * lo:2])
    after = np.tile(np.arange(1, width + 2, dtype=np.int64), (n, 1))
    before = np.tile(np.arange(-1, width, dtype=np.int64), (n, 1))
    top = NONE * width

    def put(rows: np.ndarray, at: np.ndarray, leaf: np.ndarray) -> None:
        node = at + width
        tree[rows, node] = leaf
        while node.size and node[0] > 1:
            node = node >> 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

    rows = np.flatnonzero(tree[:, 1] < top)
    while rows.size:
        i = tree[rows, 1] % width
        j = after[rows, i]
        _, merged = v.rank(symbols[rows, i], symbols[rows, j])
        symbols[rows, i] = merged
        symbols[rows, j] = -1
        k = after[rows, j]
        after[rows, i] = k
        put(rows, np.minimum(j, width - 1), np.full(len(rows), top, np.int64))
        right = k < lengths[rows]
        leaf = np.full(len(rows), top, np.int64)
        if right.any():
            r, a, b = rows[right], i[right], k[right]
            before[r, b] = a
            got, _ = v.rank(symbols[r, a], symbols[r, b])
            leaf[right] = np.minimum(got * width + a, top)
        put(rows, i, leaf)
        h = before[rows, i]
        left = h >= 0
        if left.any():
            r, a = rows[left], h[left]
            got, _ = v.rank(symbols[r, a], symbols[r, i[left]])
            put(r, a, np.minimum(got * width + a, top))
        rows = rows[tree[rows, 1] < top]
    kept = symbols[:, :width] >= 0
    ids, ends = symbols[:, :width][kept].tolist(), np.cumsum(kept.sum(axis=1)).tolist()
    return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends)]


class Encoder:
    """Encodes whole texts. ``forms`` maps a unit to what ``form`` makes of its ids, ``pieces`` a piece to its ids.

    Where no white-space run reaches three characters (or two at the end), pieces never cross a cut
    before a space or line feed: such texts are cut there into units and the pattern runs once per
    distinct unit. Other texts go through the pattern whole.
    """

    def __init__(self, spec: str, form, generation: int | None = None):
        self.v = vocabulary(spec)
        self.form = form
        self.generation = generation or GENERATION
        self.forms: dict = {}
        self.old: dict = {}
        self.pieces: dict = {}

    def units(self, text: str) -> list:
        """Keys of ``forms``: a string is a unit that follows a cut (its space left out), a tuple any other."""
        v = self.v
        if v.special_split is not None and any(s in text for s in v.special):
            return [(part, part in v.special) for part in v.special_split.split(text)]
        if v.long_run.search(text):
            return [(text, False)]
        parts = text.replace("\n", " \n").split(" ")
        parts[0] = (parts[0], False)
        return parts

    def learn(self, units: set) -> None:
        """Puts the units that the cache lacks into it. A full generation becomes the old one, from
        which units that are met again are taken over: the bound holds and frequent units stay."""
        lacking = units.difference(self.forms)
        if len(self.forms) + len(lacking) > self.generation:
            self.forms, self.old, lacking = {}, self.forms, units
        v, new, wanted = self.v, [], []
        findall, forms, old = v.pieces.findall, self.forms, self.old
        for u in lacking:
            known = old.get(u)
            if known is not None:
                forms[u] = known
            elif type(u) is tuple:
                new.append((u, None if u[1] else findall(u[0])))
            else:
                new.append((u, findall(u if u[:1] == "\n" else " " + u)))
        for _, ps in new:
            wanted += ps or ()
        if len(self.pieces) + len(new) > self.generation:
            self.pieces.clear()
        self.merge(list(set(wanted).difference(self.pieces)))
        pieces = self.pieces
        for u, ps in new:
            forms[u] = self.form([v.special[u[0]]] if ps is None else pieces[ps[0]] if len(ps) == 1 else [i for p in ps for i in pieces[p]])

    def merge(self, new: list[str]) -> None:
        raw = [p.encode() for p in new]
        short = sorted((i for i, b in enumerate(raw) if len(b) <= SHORT), key=lambda i: len(raw[i]))
        for a in range(0, len(short), 20_000):
            some = short[a:a + 20_000]
            for i, ids in zip(some, merge_many(self.v, [raw[i] for i in some])):
                self.pieces[new[i]] = ids
        for i, b in enumerate(raw):
            if len(b) > SHORT:
                self.pieces[new[i]] = merge_piece(self.v, b)

    def encode(self, texts: list[str]) -> list[list]:
        """Per text the forms of its units, in order."""
        split = [self.units(t) for t in texts]
        self.learn(set().union(*split))
        found = self.forms.__getitem__
        out = [list(map(found, us)) for us in split]
        for us in split:  # whole texts and first words are of little use again
            for u in us if type(us[-1]) is tuple else us[:1]:
                self.forms.pop(u, None)
        return out


def decode_bytes(v: Vocabulary, ids: list[int]) -> bytes:
    return b"".join(map(v.bytes_of.__getitem__, ids))


def chunks(texts: list, chars: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Slices of a list of texts with about ``chars`` characters each; a longer text is one slice."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


_ENCODERS: dict = {}


def worker_encoder(kind: str, spec: str, form, generation: int | None = None) -> Encoder:
    """One encoder a worker and use, so its cache serves all batches of the worker."""
    key = (kind, hash(spec))
    if key not in _ENCODERS:
        gc.disable()  # encoding makes no cycles, and collections over a full cache cost a third of the time
        _ENCODERS[key] = Encoder(spec, form(vocabulary(spec)), generation)
    return _ENCODERS[key]


def encode_documents(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for every row of ``docs``, each text encoded whole.

    Null and empty texts have no ids. Repeated rows and null ids are kept. Other columns are not
    read. The vocabulary file (``vocab_path``, a ``tokenizers`` JSON) is read by the driver and sent
    with the function; its size does not depend on the data. An empty table gives an empty result.
    """
    spec = _spec(vocab_path)

    def run(batches):
        enc = worker_encoder("ids", spec, lambda v: lambda ids: np.array(ids, np.int32).tobytes(), IDS_GENERATION)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for a, z in chunks(texts):
                raw = [b"".join(forms) for forms in enc.encode(texts[a:z])]
                cuts = np.cumsum([0, *(len(x) // 4 for x in raw)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.frombuffer(b"".join(raw), np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), ids], ["doc_id", "ids"])

    rows = docs.selectExpr(f"`{id_col}` as doc_id", f"cast(`{text_col}` as string) as text")
    return arrow_map(rows, run, f"doc_id {id_type(rows)}, ids array<int>")


def decode_documents(encoded: DataFrame, vocab_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids): the bytes of the ids in order, read as UTF-8; special ids give
    their strings. Null ids give an empty text."""
    spec = _spec(vocab_path)

    def run(batches):
        v = vocabulary(spec)
        for b in batches:
            texts = [decode_bytes(v, ids or []).decode("utf-8", "replace") for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return arrow_map(encoded.select("doc_id", "ids"), run, f"doc_id {id_type(encoded)}, text string")


def round_trip_digests(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) without building the id lists of whole corpora.

    Per piece the cache keeps the decimal ids and the bytes they decode to. The digests are those of
    ``encode_documents`` (decimal ids joined by commas) and ``decode_documents`` (UTF-8).
    """
    spec = _spec(vocab_path)

    def form(v):
        decimal = [b"%d," % i for i in range(len(v.bytes_of))]
        return lambda ids: (b"".join(map(decimal.__getitem__, ids)), decode_bytes(v, ids))

    def run(batches):
        enc = worker_encoder("digest", spec, form)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            ids, texts = b.column(0), [t or "" for t in b.column(1).to_pylist()]
            for a, z in chunks(texts):
                n, one, two = [], [], []
                for forms in enc.encode(texts[a:z]):
                    decimal = b"".join([f[0] for f in forms])
                    n.append(decimal.count(b","))
                    one.append(sha(decimal[:-1]))
                    raw = b"".join([f[1] for f in forms])
                    two.append(sha(raw if raw.isascii() else raw.decode("utf-8", "replace").encode()))
                yield pa.RecordBatch.from_arrays([ids.slice(a, z - a), pa.array(n, pa.int64()), pa.array(one, pa.string()), pa.array(two, pa.string())],
                                                 ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.selectExpr(f"`{id_col}` as doc_id", f"cast(`{text_col}` as string) as text")
    return arrow_map(rows, run, f"doc_id {id_type(rows)}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()
