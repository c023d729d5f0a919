"""Registered queries: evaluation on a deterministic score.

score = 1 - train-only seller on-time rate (the model's strongest single feature), so the
metrics are exactly reproducible in SQL; fitted-model scores are covered by the rows-only
model keys.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import evaluate as E
from ledgerlens.plans.oracle_views import DRIFT, SPLIT
from ledgerlens.plans.queries_drift import encoded
from ledgerlens.plans.registry import R, query

_EXTRA = SPLIT + "," + DRIFT
THRESHOLDS = [0.3, 0.4, 0.5, 0.6, 0.7, 0.8]  # fixed candidate thresholds
PRED_THRESHOLD = 0.25


def scored(spark, sf_dir):
    return encoded(spark, sf_dir).select(
        "order_id", "split", "is_late", F.col("is_late").cast("int").alias("label"),
        (1 - F.col("seller_on_time_rate")).alias("score"), "is_new_or_thin_history_seller")


def _auc_sql(where: str = "", by: str | None = None) -> str:
    b = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    g = f" GROUP BY {by}" if by else ""
    return f"""
SELECT {b}CAST(sum(pos + neg) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS n_pos,
       sum(pos * (neg_below + 0.5 * neg)) / nullif(CAST(sum(pos) * sum(neg) AS DOUBLE), 0) AS auc
FROM (SELECT *, coalesce(sum(neg) OVER ({part}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below
      FROM (SELECT {b}score, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg
            FROM c_scored {where} GROUP BY {b}score)){g}"""


@query("auc", _auc_sql("WHERE split = 'test'"), mart=True, extra=_EXTRA, rnd=R("auc"), ids="E1")
def q_auc(spark, sf_dir):
    return E.auc(scored(spark, sf_dir).where(F.col("split") == "test"), "label", "score")


@query("auc_by_slice", _auc_sql("WHERE split = 'test'", "is_new_or_thin_history_seller"), mart=True, extra=_EXTRA,
       rnd=R("auc"), ids="E6")
def q_auc_by_slice(spark, sf_dir):
    return E.auc(scored(spark, sf_dir).where(F.col("split") == "test"), "label", "score",
                 by=["is_new_or_thin_history_seller"])


@query("train_test_gap", _auc_sql("", "split"), mart=True, extra=_EXTRA, rnd=R("auc"), ids="E7")
def q_train_test_gap(spark, sf_dir):
    return E.auc(scored(spark, sf_dir), "label", "score", by=["split"])


@query("confusion", f"""
SELECT a.actual, p.predicted, count(s.order_id) AS n FROM (SELECT unnest([0, 1]) AS actual) a
CROSS JOIN (SELECT unnest([0, 1]) AS predicted) p
LEFT JOIN (SELECT order_id, label, CAST(score >= {PRED_THRESHOLD} AS INTEGER) AS pred FROM c_scored WHERE split = 'test') s
  ON s.label = a.actual AND s.pred = p.predicted
GROUP BY a.actual, p.predicted
""", mart=True, extra=_EXTRA, ids="E3")
def q_confusion(spark, sf_dir):
    s = scored(spark, sf_dir).where(F.col("split") == "test").withColumn("pred", (F.col("score") >= PRED_THRESHOLD).cast("int"))
    return E.confusion(s, "label", "pred")


_CR_CTES = f"""
c_c AS (SELECT count(*) FILTER (WHERE label = 0 AND pred = 0) AS c00, count(*) FILTER (WHERE label = 0 AND pred = 1) AS c01,
               count(*) FILTER (WHERE label = 1 AND pred = 0) AS c10, count(*) FILTER (WHERE label = 1 AND pred = 1) AS c11
        FROM (SELECT label, CAST(score >= {PRED_THRESHOLD} AS INTEGER) AS pred FROM c_scored WHERE split = 'test')),
c_per AS (SELECT '0' AS class_label, coalesce(c00 / nullif(CAST(c00 + c10 AS DOUBLE), 0), 0) AS precision,
                 coalesce(c00 / nullif(CAST(c00 + c01 AS DOUBLE), 0), 0) AS recall, c00 + c01 AS support FROM c_c
          UNION ALL
          SELECT '1', coalesce(c11 / nullif(CAST(c11 + c01 AS DOUBLE), 0), 0), coalesce(c11 / nullif(CAST(c11 + c10 AS DOUBLE), 0), 0), c11 + c10 FROM c_c),
c_perf AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM c_per)"""


@query("class_report", """
SELECT class_label, precision, recall, f1, CAST(support AS BIGINT) AS support FROM c_perf
UNION ALL SELECT 'accuracy', NULL, NULL, coalesce((c00 + c11) / nullif(CAST(c00 + c01 + c10 + c11 AS DOUBLE), 0), 0), c00 + c01 + c10 + c11 FROM c_c
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM c_perf
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                 sum(f1 * support) / sum(support), CAST(sum(support) AS BIGINT) FROM c_perf
""", mart=True, extra=_EXTRA + "," + _CR_CTES, rnd=R("precision", "recall", "f1"), ids="E2")
def q_class_report(spark, sf_dir):
    s = scored(spark, sf_dir).where(F.col("split") == "test").withColumn("pred", (F.col("score") >= PRED_THRESHOLD).cast("int"))
    return E.class_report(s, "label", "pred").withColumn("support", F.col("support").cast("long"))


@query("threshold_table", " UNION ALL ".join(
    f"""SELECT CAST({t} AS DOUBLE) AS threshold, count(*) FILTER (WHERE score >= {t} AND label = 1) AS tp,
       count(*) FILTER (WHERE score >= {t} AND label = 0) AS fp, count(*) FILTER (WHERE score < {t} AND label = 1) AS fn,
       coalesce(count(*) FILTER (WHERE score >= {t} AND label = 1) / nullif(CAST(count(*) FILTER (WHERE score >= {t}) AS DOUBLE), 0), 0) AS precision,
       coalesce(count(*) FILTER (WHERE score >= {t} AND label = 1) / nullif(CAST(count(*) FILTER (WHERE label = 1) AS DOUBLE), 0), 0) AS recall,
       count(*) FILTER (WHERE score >= {t}) AS flagged FROM c_scored WHERE split = 'test'""" for t in [0.1, 0.2, 0.25, 0.3, 0.5, 0.8]),
       mart=True, extra=_EXTRA, rnd=R("precision", "recall"), ids="E4")
def q_threshold_table(spark, sf_dir):
    s = scored(spark, sf_dir).where(F.col("split") == "test")
    return E.threshold_table(s, "label", "score", [0.1, 0.2, 0.25, 0.3, 0.5, 0.8])


@query("pr_curve", """
SELECT score AS threshold, tp, fp, tp / CAST(tp + fp AS DOUBLE) AS precision, tp / nullif(CAST(P AS DOUBLE), 0) AS recall FROM (
  SELECT score, CAST(sum(pos) OVER (ORDER BY score DESC) AS BIGINT) AS tp, CAST(sum(neg) OVER (ORDER BY score DESC) AS BIGINT) AS fp, sum(pos) OVER () AS P
  FROM (SELECT score, CAST(sum(label) AS BIGINT) AS pos, CAST(sum(1 - label) AS BIGINT) AS neg FROM c_scored WHERE split = 'test' GROUP BY score))
""", mart=True, extra=_EXTRA, rnd=R("threshold", "precision", "recall"), ids="E5")
def q_pr_curve(spark, sf_dir):
    return E.pr_curve(scored(spark, sf_dir).where(F.col("split") == "test"), "label", "score")
