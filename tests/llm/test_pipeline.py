"""The pipeline against a plain version of its five stages, and the registry of corpus queries."""
import hashlib
import itertools
import os
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerlens.llm.queries import MIX_SEED, QUERIES, SQL, vocabulary_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shingles(t, k=5):
    w = re.findall(rb"[^\x20\x09-\x0d]+", t.encode().lower())
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def copies_of(i, rate):
    u = (int(hashlib.md5(f"{MIX_SEED}:{i}:1".encode()).hexdigest()[:13], 16) + 0.5) / 16.0 ** 13
    k, p = 0, 2.718281828459045 ** -rate
    cdf = p
    while cdf <= u:
        k += 1
        p *= rate / k
        cdf += p
    return k


def test_pipeline_equals_its_plain_version(spark, tmp_path):
    from tokenizers import Tokenizer
    rng = random.Random(12)
    sounds = {"xx": "ka ti mo ru sel", "yy": "str pfl ung eit och"}
    say = lambda lang, n: " ".join("".join(rng.choice(sounds[lang].split()) for _ in range(3)) for _ in range(n))
    rows = []
    for i in range(120):
        lang = "xx" if i % 3 else "yy"
        text = say(lang, rng.randrange(20, 60))
        if i % 10 == 4:
            w = rows[-1][1].split()
            w[0] = "changed"
            text = " ".join(w)
        if i % 10 == 7:
            text += f" password=secret{i}abcdefgh and {say(lang, 5)}"
        rows.append((i, text, lang, "big" if i % 4 else "small", 0))
    rows += [(200, None, None, "big", 0), (201, "", "xx", "big", 0), (202, "12 34 --", "yy", "small", 0)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["doc_id"], r["n_tokens"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    kept = [r for r in rows if r[1] and re.search("[a-z]", r[1])]
    root = {r[0]: r[0] for r in kept}
    sets = {r[0]: shingles(r[1]) for r in kept}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in itertools.combinations(sets, 2):
        if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    kept = [r for r in kept if find(r[0]) == r[0]]
    assert len(kept) < 120
    secret = re.compile(r"password=[A-Za-z0-9+/_.=-]{12,}")
    kept = [(r[0], secret.sub("[SECRET]", r[1]), r[3]) for r in kept]
    n = {s: sum(r[2] == s for r in kept) for s in ("big", "small")}
    lib = Tokenizer.from_file(vocabulary_path())
    want = []
    for i, text, source in kept:
        ids = lib.encode(text, add_special_tokens=False).ids
        want += [(i, len(ids), tuple(ids))] * copies_of(i, 0.5 * len(kept) / n[source])
    assert got == sorted(want)


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.createDataFrame([(1, "one two three", "en", "a", 3), (2, None, None, None, None)], SCHEMA)
    empty = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for d in (docs, empty):
            out = stage(spark, d, "")
            assert out.columns == docs.columns and out.schema["n_chars"].dataType == docs.schema["n_chars"].dataType, name
            out.count()
    assert corpus_pipeline.STAGES[-1][1](spark, empty, "").count() == 0


def test_every_operator_has_one_query():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))
    assert {"op4_mixing", "op6_kd_search", "op7_url_filter", "op11_lexical_search", "op12_line_dedup", "op13_centroids"} <= set(SQL) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
@pytest.mark.parametrize("name", ["op4_mixing", "op6_kd_search", "op7_url_filter", "op11_lexical_search", "op12_line_dedup", "op13_centroids"])
def test_queries_equal_their_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    a, b = QUERIES[name](spark, SF).toPandas(), con.execute(SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    rows = lambda d: sorted(map(tuple, d[cols].astype(object).where(d[cols].notna(), None).map(lambda v: round(v, 6) if isinstance(v, float) else v).astype(str).values.tolist()))
    assert rows(a) == rows(b)


def test_the_language_stage_uses_its_model(spark):
    """Long text in no learnt language goes, a missing label is filled in, and without the model neither happens."""
    rng = random.Random(3)
    sounds = {"xx": "ka ti mo ru sel", "yy": "str pfl ung eit och"}
    say = lambda lang, n: " ".join("".join(rng.choice(sounds[lang].split()) for _ in range(3)) for _ in range(n))
    rows = [(i, say("xx" if i % 2 else "yy", 60 + i % 50), "xx" if i % 2 else "yy", "s", 0) for i in range(400)]
    noise = "".join(chr(rng.randrange(0x400, 0x480)) for _ in range(600))
    rows += [(1000, say("xx", 80), None, "s", 0), (1001, noise, None, "s", 0), (1002, "short \u0436\u0449", "xx", "s", 0), (1003, say("xx", 70) + ' key = "9f8e7d6c5b4a39281706f5e4d3c2b1a0"', "xx", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    stage = dict(corpus_pipeline.STAGES)["language_id"]
    out = {r["doc_id"]: r["lang"] for r in stage(spark, docs, "").collect()}
    assert 1001 not in out and len(out) == len(rows) - 1 and out[1000] == "xx" and {1002, 1003} <= set(out)
    bare = {r["doc_id"]: r["lang"] for r in stage(spark, docs.withColumn("lang", F.lit(None).cast("string")), "").collect()}
    assert 1001 in bare and bare[1000] is None  # nothing learnt: nothing is rejected or filled in
