"""The registered queries of this subpackage: each applies one operator, with production parameters,
to its whole table. ``SQL`` holds the DuckDB statement where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import (bpe, centroids, kd_search, language, lexical_search, line_dedup, lm_score, mixing, multi_index, near_dedup, secrets,
                            substrings, url_filter)
from ledgerlens.llm.tables import read_table

# The rules that op7 judges by.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
             ("block", "net", "/es/"), ("block", "net", "/fr/")]
MIX_SEED = 17

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def crc_class(doc_id, classes: int):
    """crc32 of the id as text, modulo ``classes``; null for a null id."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(classes))


@query("op1_near_dedup")
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document under 3-word shingles and similarity 0.85."""
    return near_dedup.near_duplicates(read_table(spark, sf_dir, "documents"), k=3, percent=85)


@query("op2_bpe")
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of encoded and decoded text per document."""
    return bpe.round_trip_digests(read_table(spark, sf_dir, "documents"), vocabulary_path())


def language_model(docs: DataFrame) -> language.ContextTrees:
    """Learns from labelled documents whose class of 4 is not 2; rows with a null id teach nothing."""
    return language.ContextTrees(language.training_sample(docs.where(crc_class(F.col("doc_id"), 4) != 2)))


@query("op3_language_id")
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; a null id counts as held out."""
    docs = read_table(spark, sf_dir, "documents")
    return language.predict_languages(docs, language_model(docs)).select(
        "doc_id", F.coalesce(crc_class(F.col("doc_id"), 4) == 2, F.lit(True)).alias("held_out"), "lang_pred", "score", "bits_per_byte")


_U = "(CAST(('0x' || substr(md5('%d:' || COALESCE(doc_id::VARCHAR, 'null') || ':1'), 1, 13)) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0" % MIX_SEED


@query("op4_mixing", f"""
WITH RECURSIVE n AS (SELECT source, count(*) AS n_docs FROM documents GROUP BY source),
r AS (SELECT source, 1.0::DOUBLE / (SELECT count(*)::DOUBLE FROM n) * (SELECT sum(n_docs)::DOUBLE FROM n) / n_docs::DOUBLE AS rate FROM n),
c AS (SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS cdf FROM r
      UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), cdf + p * rate / (k + 1) FROM c WHERE k < 100),
d AS (SELECT doc_id, text, lang, source, n_chars, {_U} AS u FROM documents),
m AS (SELECT d.*, r.rate, (SELECT count(*) FROM c WHERE c.source IS NOT DISTINCT FROM d.source AND c.cdf <= d.u AND c.k < 100) AS copies
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, text, lang, source, n_chars, i::INTEGER AS copy_no, rate,
       md5('order{MIX_SEED}:' || doc_id::VARCHAR || ':' || i::VARCHAR) AS mix_order
FROM m, unnest(range(1, copies + 1)) AS t(i)""")
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus with all sources at equal weight and its present expected size."""
    return mixing.mix_sources(read_table(spark, sf_dir, "documents"), seed=MIX_SEED)


@query("op5_multi_index")
def op5_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every 20th vector."""
    return multi_index.nearest_neighbours(read_table(spark, sf_dir, "embeddings"), k=20, every=20)


@query("op6_kd_search", """
WITH r AS (SELECT vec_id, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS x FROM embeddings WHERE vec_id IS NOT NULL),
c AS (SELECT vec_id, d, floor(256 * x)::BIGINT AS x FROM r WHERE vec_id NOT IN (SELECT vec_id FROM r WHERE x IS NULL OR NOT isfinite(x))),
p AS (SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
      FROM c AS q JOIN c ON q.d = c.d WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id GROUP BY ALL)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM p
QUALIFY rank <= 5""")
def op6_kd_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of every 50th vector."""
    return kd_search.top_k(read_table(spark, sf_dir, "embeddings"), k=5, every=50)


@query("op7_url_filter", """
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT page_id, COALESCE(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             COALESCE(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
r(action, rhost, rpath) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                                   ('block', 'net', '/es/'), ('block', 'net', '/fr/'))
SELECT page_id, host, path,
  (SELECT arg_max(rhost || rpath, length(rhost) + length(rpath)) FROM r WHERE (h.host = rhost OR h.host LIKE '%.' || rhost) AND starts_with(h.path, rpath)) AS rule,
  COALESCE((SELECT arg_max(action, length(rhost) + length(rpath)) FROM r WHERE (h.host = rhost OR h.host LIKE '%.' || rhost) AND starts_with(h.path, rpath)), 'allow') AS verdict
FROM h""")
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url; urls that no rule fits are allowed."""
    return url_filter.url_filter(read_table(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES))


@query("op8_substrings")
def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document less the 13-word windows that a smaller document holds."""
    return (substrings.remove_repeats(read_table(spark, sf_dir, "documents"), k=13, texts=False)
            .withColumnRenamed("kept", "kept_sha256"))


@query("op9_secrets")
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest of the strong spans and all spans per document."""
    s = secrets.scan_secrets(read_table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["ord"] == secrets.KINDS.index(k))).cast("long").alias(f"n_{k}")
    return s.select("doc_id", count("assign"), count("access"), count("hex"),
                    F.sha2(secrets.span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                    secrets.span_text(F.concat("base", "added")).alias("spans"))


@query("op10_lm_score")
def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and bigram scores of every document; rows with a null id teach nothing and count as held out."""
    docs = read_table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_class(F.col("doc_id"), 5) == 1, F.lit(True))
    return (lm_score.score_documents(docs, docs.where(~held_out))
            .select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"))


_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_TERMS = f"regexp_extract_all(translate(text, {_LOWER}), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"


@query("op11_lexical_search", f"""
WITH b AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark WHERE item_id IS NOT NULL),
d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS terms FROM documents),
n AS (SELECT rid, doc_id, len(terms)::BIGINT AS n FROM d WHERE len(terms) > 0),
t AS (SELECT count(*)::BIGINT AS total_docs, sum(n)::BIGINT AS total_terms FROM n),
p AS (SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(terms) AS term FROM d) AS u WHERE term IN (SELECT term FROM b) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * total_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
      FROM (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term) AS f, t),
i AS (SELECT p.rid, p.term, w.w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n.n * total_docs) // total_terms))) AS impact
      FROM p JOIN w USING (term) JOIN n USING (rid), t),
s AS (SELECT b.item_id, i.rid, sum(i.impact)::BIGINT AS score FROM b JOIN i USING (term) GROUP BY ALL HAVING sum(i.impact) > 0)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
FROM s JOIN n USING (rid) QUALIFY rank <= 50""")
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 documents of highest score for every benchmark item."""
    return lexical_search.rank_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=50)


@query("op12_line_dedup", f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(COALESCE(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT rid, doc_id, generate_subscripts(lines, 1) AS i, unnest(lines) AS line FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_LOWER}) AS key FROM l),
f AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10
      GROUP BY key HAVING count(DISTINCT doc_id) + count(DISTINCT CASE WHEN doc_id IS NULL THEN rid END) >= 2),
r AS (SELECT rid, doc_id, i, line, f.first IS NOT NULL AND f.first IS DISTINCT FROM k.doc_id AS dropped FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(COALESCE(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM r GROUP BY rid, doc_id""")
def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document less those that a smaller document holds."""
    return (line_dedup.dedup_lines(read_table(spark, sf_dir, "documents"), least=10, texts=False)
            .withColumnRenamed("kept", "kept_sha256"))


def _lloyd_sql(k: int = 16, rounds: int = 3) -> str:
    """Plain rounds of assigning and moving, one group of common table expressions each."""
    near = """a{r} AS (SELECT vec_id, rid, cluster, distance FROM (
  SELECT x.vec_id, x.rid, c.cluster, sum((x.v - c.v) * (x.v - c.v))::BIGINT AS distance FROM x JOIN c{r} AS c ON x.d = c.d GROUP BY ALL) AS s
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, cluster) = 1)"""
    move = """c{s} AS (SELECT c.cluster, c.d, COALESCE(m.v, c.v) AS v FROM c{r} AS c LEFT JOIN (
  SELECT a.cluster, x.d, floor(sum(x.v)::DOUBLE / count(*)::DOUBLE)::BIGINT AS v FROM a{r} AS a JOIN x ON a.rid = x.rid GROUP BY ALL) AS m
  ON m.cluster = c.cluster AND m.d = c.d)"""
    steps = [near.format(r=0)]
    for r in range(rounds):
        steps += [move.format(r=r, s=r + 1), near.format(r=r + 1)]
    return f"""
WITH e AS (SELECT row_number() OVER () AS rid, vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) = 64),
u AS (SELECT rid, vec_id, generate_subscripts(embedding, 1) AS d, unnest(embedding)::DOUBLE AS f FROM e),
x AS (SELECT rid, vec_id, d, floor(64 * f)::BIGINT AS v FROM u WHERE rid NOT IN (SELECT rid FROM u WHERE f IS NULL OR NOT isfinite(f))),
g AS (SELECT rid, row_number() OVER (ORDER BY sha256('1:' || vec_id::VARCHAR) NULLS LAST, l)::INTEGER - 1 AS cluster
      FROM (SELECT rid, vec_id, list(v ORDER BY d) AS l FROM x GROUP BY ALL) AS o QUALIFY cluster < {k}),
c0 AS (SELECT g.cluster, x.d, x.v FROM g JOIN x USING (rid)),
{", ".join(steps)},
h AS (SELECT cluster, sha256(string_agg(v::VARCHAR, ',' ORDER BY d)) AS centroid_sha256 FROM c{rounds} GROUP BY cluster)
SELECT vec_id, cluster, distance, sum(distance) OVER (PARTITION BY cluster)::BIGINT AS cluster_inertia,
       sum(distance) OVER ()::BIGINT AS inertia, centroid_sha256 FROM a{rounds} JOIN h USING (cluster)"""


@query("op13_centroids", _lloyd_sql())
def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster of every vector after three rounds with 16 centroids."""
    return centroids.cluster_vectors(read_table(spark, sf_dir, "embeddings"), k=16, rounds=3).drop("centroid", "checked")
