"""Vector searches and URL filters against brute force."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import kd_search, multi_index, url_filter, vectors
from ledgerlens.llm.queries import URL_RULES

ODD = [(9001, None), (9002, []), (9003, [1.0] * 7), (9004, [float("nan")] + [0.0] * 7), (9005, [float("inf")] + [0.0] * 7), (9006, [None] + [1.0] * 7), (None, [1.0] * 8)]


def table(spark, rows):
    df = spark.createDataFrame([(i, v) for i, v in rows], "vec_id bigint, embedding array<float>").repartition(3)
    return df.withColumns({c: F.lit(1) for c in ("v", "shard", "pack", "n", "cell", "score")})


def some_vectors(n, seed, dims=8):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dims)).astype(np.float32)
    x[n // 3:2 * n // 3] = x[n // 3]
    x[5] = 0
    return [(int(i), r.tolist()) for i, r in zip(rng.permutation(n), x)]


def brute(rows, every, k, score):
    out = {}
    for q, v in rows:
        if q % every == 0:
            best = sorted(((-score(v, w), i) for i, w in rows if i != q))[:k]
            out[q] = [(i, -s) for s, i in best]
    return out


def listed(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_kd_search_is_exact(spark, monkeypatch):
    monkeypatch.setattr(kd_search, "SHARD", 60)
    monkeypatch.setattr(kd_search, "QUERY_BLOCK", 5)
    rows = some_vectors(400, 1)
    whole = lambda v: [int(np.floor(256 * float(np.float32(x)))) for x in v]
    ints = [(i, whole(v)) for i, v in rows]
    got = listed(kd_search.top_k(table(spark, rows + ODD), 5, 10))
    assert got == brute(ints, 10, 5, lambda v, w: sum(a * b for a, b in zip(v, w)))
    assert kd_search.top_k(table(spark, []), 5, 10).count() == 0
    few = listed(kd_search.top_k(table(spark, [(0, [1.0, 2.0]), (1, [0.5, -1.0])]), 5, 10))
    assert few == {0: [(1, 256 * 128 - 512 * 256)]}
    assert kd_search.top_k(table(spark, [(0, [1.0, 2.0])]), 5, 10).count() == 0


def test_trees_bound_their_boxes():
    rng = np.random.default_rng(2)
    x = np.floor(256 * rng.normal(size=(300, 6)))
    tree = kd_search.Tree(np.arange(300), x, leaf=8)
    q = np.floor(256 * rng.normal(size=(4, 6)))
    bounds = tree.bounds(q)
    for n, (a, z, left, _) in enumerate(tree.nodes):
        assert (bounds[:, n] >= (q @ tree.x[a:z].T).max(axis=1)).all()
        assert left >= 0 or z - a <= 8
    assert sorted(tree.ids.tolist()) == list(range(300))


def test_shards_are_not_broadcast_however_small_their_files(spark, monkeypatch):
    """Files of alike vectors are many times smaller than their rows, which do not fit the driver: nothing of the search is broadcast."""
    plans, arrow_map = [], kd_search.arrow_map
    monkeypatch.setattr(kd_search, "arrow_map", lambda df, *rest: (plans.append(df._jdf.queryExecution().executedPlan().toString()), arrow_map(df, *rest))[1])
    monkeypatch.setattr(kd_search, "SHARD", 60)
    alike = [(i, [float(i % 3), 1.0, -2.0]) for i in range(400)]
    got = listed(kd_search.top_k(table(spark, alike), 5, 10))
    assert got == brute([(i, [256 * int(x) for x in v]) for i, v in alike], 10, 5, lambda v, w: sum(a * b for a, b in zip(v, w)))
    assert len(plans) == 2 and not any("Broadcast" in p for p in plans)


def test_a_block_is_searched_as_each_of_its_queries(spark):
    rng = np.random.default_rng(3)
    x = np.floor(40 * rng.normal(size=(500, 3)))
    x[100:300] = x[100]
    ids = rng.permutation(500) // 2  # ids come twice
    tree = kd_search.Tree(ids, x, leaf=16)
    q_ids, q = np.arange(40), np.floor(40 * rng.normal(size=(40, 3)))
    for kth in (np.full(40, -np.inf), rng.normal(scale=3000, size=40).round()):
        at, found, scores = tree.search(q_ids, q, kth, 7)
        for i in range(40):
            want = sorted((-int(s), int(n)) for s, n in zip(x @ q[i], ids) if n != q_ids[i] and s >= kth[i])[:7]
            assert [(-s, n) for s, n in zip(scores[at == i].tolist(), found[at == i].tolist())] == want


def test_multi_index_finds_the_nearest(spark, monkeypatch):
    rows = [(i, v) for i, v in some_vectors(600, 3)]
    usable = [(i, [float(np.float32(x)) for x in v]) for i, v in rows if any(v)]
    monkeypatch.setattr(multi_index, "BLOCK", 50)
    want = brute(usable, 20, 20, lambda v, w: float(sum(np.float64(a) * np.float64(b) for a, b in zip(v, w))))
    got = listed(multi_index.nearest_neighbours(table(spark, rows + ODD), 20, 20))
    assert set(got) == set(want)
    recall = np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9
    scores = {(q, i): s for q in want for i, s in [(i, float(sum(a * b for a, b in zip(dict(usable)[q], w)))) for i, w in usable]}
    assert all(s == pytest.approx(scores[q, i], abs=1e-12) for q in got for i, s in got[q])
    assert all(r == sorted(r, key=lambda x: (-x[1], x[0])) for r in got.values())
    assert multi_index.nearest_neighbours(table(spark, []), 20, 20).count() == 0
    few = listed(multi_index.nearest_neighbours(table(spark, [(0, [1.0, 2.0]), (1, [0.5, -1.0]), (2, [0.5, -1.0]), (3, [0.0, 0.0])]), 20, 20))
    assert few == {0: [(1, -1.5), (2, -1.5)]}


def recall_of(got, want, queries=None):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / len(want[q]) for q in queries or want])


def brute_ids(x, every, k):
    """Per query the (id, None) of its ``k`` nearest rows of ``x``, whose ids are their places."""
    scores = x.astype(float) @ x.astype(float).T
    np.fill_diagonal(scores, -np.inf)
    return {q: [(int(i), None) for i in np.argsort(-scores[q], kind="stable")[:k]] for q in range(0, len(x), every)}


def test_the_walk_is_as_long_as_the_measured_recall_asks(spark, monkeypatch):
    x = np.random.default_rng(6).normal(size=(4000, 8)).astype(np.float32)
    monkeypatch.setattr(multi_index.MultiIndex.search, "__defaults__", (20, 2))  # 126 entries a walk, 3 % of all
    rows, want = table(spark, [(i, v.tolist()) for i, v in enumerate(x)]), brute_ids(x, 20, 20)
    assert recall_of(listed(multi_index.nearest_neighbours(rows, 20, 20)), want) >= 0.9
    index = multi_index.MultiIndex(rows)
    enough = index.enough(vectors.queries_of(index.entries, 20), 20, 126)
    assert 126 < enough < 0.6 * len(x)
    assert index.enough(vectors.queries_of(index.entries, 20), 20, len(x)) == len(x)


def test_a_hot_cell_does_not_end_the_walk(spark, monkeypatch):
    x = np.random.default_rng(7).normal(size=(4000, 8)).astype(np.float32)
    x[::3] = x[0] + np.random.default_rng(8).normal(scale=1e-4, size=x[::3].shape)  # a third are near copies
    monkeypatch.setattr(multi_index.MultiIndex.search, "__defaults__", (20, 2))
    rows, want = table(spark, [(i, v.tolist()) for i, v in enumerate(x)]), brute_ids(x, 20, 20)
    others = [q for q in want if q % 3]
    index = multi_index.MultiIndex(rows)
    assert index.sizes.max() > 300 and 0 < index.counted.max() <= multi_index.HOT * (1 + 4000 / np.count_nonzero(index.sizes))
    assert index.enough(vectors.queries_of(index.entries, 20), 20, 126) < 0.6 * index.counted.sum()
    assert recall_of(listed(multi_index.nearest_neighbours(rows, 20, 20)), want, others) >= 0.9


def test_walk_takes_cells_by_summed_distance():
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=9), rng.normal(size=7)
    sizes = rng.integers(0, 4, 63)
    order = [c for c in np.argsort((a[:, None] + b[None, :]).ravel(), kind="stable") if sizes[c]]
    assert multi_index.walk(a, b, sizes, 10 ** 9) == order
    cut = multi_index.walk(a, b, sizes, 20)
    assert cut == order[:len(cut)] and sum(sizes[cut]) >= 20 > sum(sizes[cut[:-1]])


def test_usable_vectors(spark):
    rows = some_vectors(30, 5) + ODD
    assert vectors.usable(table(spark, rows), "vec_id", "embedding", zero_ok=True).count() == 30
    assert vectors.usable(table(spark, rows), "vec_id", "embedding", zero_ok=False).count() == 29


URLS = ["http://www.example.com/en/1", "http://example.com/en/", "https://EXAMPLE.com/EN/", "http://a.b.example.com/en", "http://com/x", "http://com", "ftp://x.net/es/1?q#f", "http://net/fr/?x",
        "http://xnet/fr/", "http://planet.net/de/", "", None, "no scheme", "://", "http://", "http:///en/", "http://x.www.example.com/en/q", "http://x.com://y/z", "http://com./a", "http://.com/a",
        "http://example.com?x=/en/", "http://example.com#/en/", "http://a..net/es/", "http://net/es", "HTTP://NET/es/é", "http://user@x.com:80/p", "http://x.org/" + "p" * 5000, "http://com-x.com/a", "x\ny://q.com/en\n/z"]


def brute_verdict(url):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    host = path = ""
    if rest is not None:
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), len(h), a, h + p) for a, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


@pytest.mark.parametrize("parts", [1, 7])
def test_url_verdicts_equal_brute_force(spark, parts):
    rows = [(i if i % 9 else None, u) for i, u in enumerate(URLS * 3)]
    df = spark.createDataFrame(rows, "page_id bigint, url string").withColumns({c: F.lit(1) for c in ("host", "path", "key", "rule", "id")})
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = url_filter.url_filter(df, url_filter.rule_table(spark, URL_RULES)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, ((i, *brute_verdict(u)) for i, u in rows)))


def test_url_filter_without_urls_or_rules(spark):
    none = spark.createDataFrame([], "page_id bigint, url string")
    assert url_filter.url_filter(none, url_filter.rule_table(spark, URL_RULES)).count() == 0
    one = spark.createDataFrame([(1, "http://a.com/x")], "page_id bigint, url string")
    assert tuple(url_filter.url_filter(one, url_filter.rule_table(spark, URL_RULES).limit(0), default="block").first()) == (1, "a.com", "/x", None, "block")
    both = [("allow", "a.com", "/"), ("block", "a.com", "/"), ("allow", "a.com", "/x/y")]
    assert url_filter.url_filter(one, url_filter.rule_table(spark, both)).first()["verdict"] == "block"
