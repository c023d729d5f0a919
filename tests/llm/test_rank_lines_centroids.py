"""Lexical search, line dedup and centroid clustering against brute force."""
import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import centroids, lexical_search, line_dedup

DOC = "doc_id bigint, text string"


def frame(spark, rows, schema, clash=()):
    df = spark.createDataFrame(rows, schema).repartition(3)
    return df.withColumns({c: F.lit(7) for c in clash})


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


# ---- 11: lexical search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def brute_ranks(docs, items, k):
    counts = [(i, Counter(TERM.findall(lower(t or "")))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    asked = defaultdict(set)
    for i, t in items:
        if i is not None:
            asked[i] |= set(TERM.findall(lower(t or "")))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, c in counts:
            m = 100 - 50 + 50 * sum(c.values()) * n_docs // n_terms
            s = 0
            for t in terms & set(c):
                df = sum(t in d for _, d in counts)
                s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m))
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out)


def corpus(rng, n):
    words = ["Alpha", "beta2", "ñandú", "Ärger", "delta", "e"] + [f"w{i}" for i in range(60)]
    text = lambda m: " ".join(words[int(len(words) * rng.random() ** 2)] + rng.choice(["", ",", ".x", " y", "-"]) for _ in range(m))
    return [(i, text(rng.choice([0, 1, 3, 20, 60]))) for i in range(n)], [(i, text(12)) for i in range(8)]


def ranks(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("size", [{}, {"shard_postings": 40}, {"group_terms": 20}])
def test_ranks_equal_brute_force(spark, size):
    docs, items = corpus(random.Random(5), 150)
    docs += [(None, docs[7][1]), (None, None), (7, docs[7][1]), (900, None), (901, ""), (902, "!?"), (903, "alpha " * 3000)]
    items += [(20, None), (21, "zzz unheard"), (None, "alpha"), (3, "Delta"), (22, "")]
    got = lexical_search.rank_documents(frame(spark, docs, DOC, ("n", "terms", "counts", "term", "score")),
                                        frame(spark, items, "item_id bigint, text string", ("score", "rank", "doc_id")), k=10, **size)
    assert ranks(got) == brute_ranks(docs, items, 10)


def test_equal_scores_go_to_the_smaller_id(spark):
    docs = [(i, "same words here") for i in range(60)] + [(100 + i, "other things") for i in range(60)]
    got = lexical_search.rank_documents(frame(spark, docs, DOC), frame(spark, [(1, "words")], "item_id bigint, text string"), k=5)
    assert [(r["rank"], r["doc_id"]) for r in got.orderBy("rank").collect()] == [(i + 1, i) for i in range(5)]


def test_search_of_empty_tables(spark):
    items, docs = frame(spark, [(1, "a b")], "item_id bigint, text string"), frame(spark, [(1, "a b")], DOC)
    assert lexical_search.rank_documents(docs.limit(0), items).count() == 0
    assert lexical_search.rank_documents(docs, items.limit(0)).count() == 0
    assert lexical_search.rank_documents(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_long_texts_are_cut_between_terms():
    size = lexical_search.CHUNK_BYTES
    raw = b"ab " * (size // 3 + 5) + b"x" * (size + 9) + b" Yz"
    assert [t for piece in lexical_search.terms_of(raw) for t in piece] == raw.lower().split()


def shard_of(rng, docs, terms):
    doc, term = np.nonzero(rng.random((docs, terms)) < np.linspace(0.9, 0.002, terms)[None, :])
    return lexical_search.Shard(docs, doc, term, rng.integers(0, 1000, len(doc)) // (1 + term % 7)), doc, term


def test_a_shard_finds_the_best_and_stops_before_the_end():
    rng = np.random.default_rng(3)
    shard, _, _ = shard_of(rng, 3000, 60)
    dense = np.zeros((3000, 60), np.int64)
    dense[shard.doc, np.repeat(shard.terms, shard.ends - shard.starts)] = shard.impact
    for size in (1, 2, 5, 40):
        terms = np.sort(rng.choice(70, size, replace=False))
        total = dense[:, terms[terms < 60]].sum(axis=1)
        for floor in (0, int(np.sort(total)[-3])):
            found, scores, reads = shard.search(terms, 20, floor)
            kth = max(np.sort(total)[-20], 1, floor)
            assert sorted(np.flatnonzero(total >= kth).tolist()) == sorted(found[scores >= kth].tolist())
            assert (total[found] == scores).all()
    entries = int((shard.ends - shard.starts)[np.isin(shard.terms, [0, 7])].sum())
    _, _, reads = shard.search(np.array([0, 7]), 5, 0)
    assert reads < entries / 2


# ---- 12: line dedup

SPACES = " \t\n\x0b\x0c\r"


def brute_lines(rows, least=10):
    holders = defaultdict(set)
    for n, (i, t) in enumerate(rows):
        for line in (t or "").split("\n"):
            key = lower(line.strip(SPACES))
            if len(key) >= least:
                holders[key].add((0, i) if i is not None else (1, n))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = []
        for line in lines:
            held = holders.get(lower(line.strip(SPACES)), ())
            gone = len(held) > 1 and min(held)[0] == 0 and min(held) != (0, i)
            keep += [] if gone else [line]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


def line_rows(rng, n):
    lines = [f"A Line that Repeats {i}" for i in range(30)] + ["short", "", "nine char", "ten chars!", "ñññññññññ", "ññññññññññ", "ñandú cigüeña é", "x" * 5000]
    pad = lambda t: rng.choice(["", " ", "\t", "\x0b\r"]) + (t.upper() if rng.random() < 0.2 and t.isascii() else t) + rng.choice(["", " ", "\r", "\x0c"])
    return [(i, "\n".join(pad(rng.choice(lines)) if rng.random() < 0.4 else f"own {i} {rng.random()}" for _ in range(rng.randrange(12)))) for i in rng.sample(range(10 * n), n)]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


def test_lines_equal_brute_force(spark):
    rng = random.Random(8)
    rows = line_rows(rng, 120)
    rows += [(None, rows[3][1]), (None, rows[3][1]), (None, "only without id line\nA Line that Repeats 3"), (None, "only without id line"), (rows[5][0], rows[6][1]),
             rows[9], rows[9], (5001, None), (5002, ""), (5003, "\n\n"), (5004, " not stripped line "), (5005, "not stripped line"), (5006, "\n".join(rows[3][1] for _ in range(900)))]
    df = frame(spark, rows, DOC, ("digest", "drop", "first", "slice", "text_key", "hits", "kept", "d2", "_id"))
    got = ordered(tuple(r) for r in line_dedup.dedup_lines(df).collect())
    assert got == ordered(brute_lines(rows))
    hashed = ordered(tuple(r) for r in line_dedup.dedup_lines(df, texts=False).collect())
    assert hashed == ordered((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute_lines(rows))


def test_a_line_in_a_third_of_all_documents_and_empty_tables(spark):
    rows = [(i, f"own line number {i}\n" + ("Confidential - do not copy" if i % 3 == 0 else "other")) for i in range(3000)]
    got = line_dedup.dedup_lines(frame(spark, rows, DOC))
    assert {r["doc_id"] for r in got.where("n_dropped = 1").collect()} == set(range(3, 3000, 3))
    assert line_dedup.dedup_lines(frame(spark, rows[:1], DOC).limit(0)).count() == 0


def test_filters_miss_no_repeat():
    rng = np.random.default_rng(1)
    bloom = line_dedup.Bloom(5000)
    keys = rng.integers(0, 1 << 32, 5000, dtype=np.uint64).astype(np.uint32)
    bloom.add(keys)
    assert bloom.holds(keys).all()
    others = rng.integers(0, 1 << 32, 100_000, dtype=np.uint64).astype(np.uint32)
    assert bloom.holds(np.setdiff1d(others, keys)).mean() < 0.02


def test_only_suspected_lines_are_shuffled_whole(spark):
    rows = [(i, "\n".join(f"line {i} of its own, {j}" for j in range(20)) + ("\nthe one repeated line" if i < 9 else "")) for i in range(500)]
    slices = line_dedup.key_slices(line_dedup._rows(frame(spark, rows, DOC), "doc_id", "text"), 10).cache()
    hits = line_dedup.suspected_places(line_dedup.packed_places(slices, 1))
    suspects = line_dedup.suspected_keys(slices, hits, 1, "bigint")
    found = Counter(r["doc_id"] for r in suspects.collect())
    slices.unpersist()
    assert set(range(9)) <= set(found) and sum(found.values()) < 9 + 500 * 20 * 0.02


# ---- 13: centroid clustering


def brute_clusters(rows, k, rounds, dims):
    kept = [(i, tuple(math.floor(64 * x) for x in v)) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centres = [v for _, v in sorted(kept, key=key)[:k]]
    apart = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    for turn in range(rounds + 1):
        near = [min((apart(v, c), n) for n, c in enumerate(centres)) for _, v in kept]
        if turn < rounds:
            for n in range(len(centres)):
                mine = [v for (_, v), (_, m) in zip(kept, near) if m == n]
                centres[n] = tuple(sum(x) // len(mine) for x in zip(*mine)) if mine else centres[n]
    inertia = Counter()
    for d, n in near:
        inertia[n] += d
    return sorted([(i is None, i or 0, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest())
                   for (i, _), (d, n) in zip(kept, near)])


def clusters(df):
    return sorted((r["vec_id"] is None, r["vec_id"] or 0, r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect())


VEC = "vec_id bigint, embedding array<double>"


@pytest.mark.parametrize("spread,k", [(0.02, 5), (0.5, 7)])
def test_clusters_equal_brute_force(spark, spread, k):
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(6, 8))
    rows = [(i, (middles[i % 6] + spread * rng.normal(size=8)).tolist()) for i in range(300)]
    rows += [rows[3], (3, rows[4][1]), (None, rows[5][1]), (400, None), (401, []), (402, [1.0] * 7), (403, [None] + [1.0] * 7), (404, [math.nan] + [1.0] * 7),
             (405, [math.inf] + [1.0] * 7), (406, [0.0] * 8), (407, [0.0] * 8)]
    rows += [(500 + i, middles[0].tolist()) for i in range(150)]  # a third in one place
    df = frame(spark, rows, VEC, ("v", "cluster", "distance", "n", "sums", "to_pivots", "inertia"))
    got = centroids.cluster_vectors(df, k=k, rounds=3, dims=8)
    assert clusters(got) == brute_clusters(rows, k, 3, 8)
    if spread < 0.1:  # well-separated places: the bounds spare most comparisons
        assert got.agg(F.avg("checked")).first()[0] < k / 2


def test_fewer_vectors_than_centroids_ties_empty_and_large_values(spark):
    same = [(i, [1.0, 2.0]) for i in range(5)]
    assert clusters(centroids.cluster_vectors(frame(spark, same, VEC), k=3, dims=2)) == brute_clusters(same, 3, 3, 2)
    few = [(1, [0.5, 1.0]), (2, [3.0, 4.0])]
    assert clusters(centroids.cluster_vectors(frame(spark, few, VEC), k=16, dims=2)) == brute_clusters(few, 16, 3, 2)
    assert centroids.cluster_vectors(frame(spark, few, VEC).limit(0), dims=2).count() == 0
    assert centroids.cluster_vectors(frame(spark, few, VEC), dims=64).count() == 0
    large = [(i, [float(i) * 1e7, -1e7]) for i in range(12)]
    assert clusters(centroids.cluster_vectors(frame(spark, large, VEC), k=3, dims=2)) == brute_clusters(large, 3, 3, 2)
    beyond = centroids.cluster_vectors(frame(spark, [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [1.0, 1.0])], VEC), k=2, dims=2).collect()
    assert len(beyond) == 3


def test_bounds_are_never_above_the_distance():
    rng = np.random.default_rng(6)
    x, pivots, centres = (rng.integers(-40, 40, (n, 16)) for n in (500, 6, 9))
    pivots[3] = pivots[2]
    pairs = centroids.pivot_pairs(pivots)
    assert pairs and all(d > 0 for _, _, d in pairs)
    low = centroids.lower_bounds(centroids.distances(x, pivots), centroids.distances(centres, pivots), pairs)
    exact = np.array([[((a - c) ** 2).sum() for c in centres] for a in x])
    assert (low ** 2 <= exact).all() and (low > 0).mean() > 0.9
