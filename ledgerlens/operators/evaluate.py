"""Exact ranking and threshold metrics as distributed aggregates.

AUC and the PR curve are computed on *distinct score groups*: rows collapse to
(score, positives, negatives) in a partial aggregate (ties share a group, T: ties = 1/2),
then a range-partitioned prefix sum (``ordering.running_totals``) gives the negatives
below / positives above each score. No single-partition sort, exact result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.ordering import running_totals


def _lab(label: str) -> Column:
    return F.col(label).cast("long")


def score_groups(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    return (df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
            .groupBy(*by, F.col(score).alias("score"))
            .agg(F.sum(_lab(label)).alias("pos"), F.sum(1 - _lab(label)).alias("neg")))


def auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """ROC-AUC = P(score_pos > score_neg) + 1/2 P(tie); null when a class is absent."""
    by = list(by)
    g = running_totals(score_groups(df, label, score, by), ["score"], ["neg"], by, prefix="below_")
    out = g.groupBy(*by).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n"), F.sum("pos").alias("n_pos"),
        F.sum(F.col("pos") * (F.col("below_neg") + 0.5 * F.col("neg"))).alias("_num"),
        F.sum("neg").alias("_nn"))
    return out.select(*by, "n", "n_pos",
                      F.try_divide(F.col("_num"), (F.col("n_pos") * F.col("_nn")).cast("double")).alias("auc"))


def pr_curve(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """E5: for each distinct score taken as threshold (predict positive when score >=
    threshold): tp, fp, precision, recall."""
    by = list(by)
    g = score_groups(df, label, score, by).withColumn("_desc", -F.col("score"))
    c = running_totals(g, ["_desc"], ["pos", "neg"], by, prefix="above_", totals="all_")
    c = c.withColumn("_P", F.col("all_pos"))
    tp = F.col("above_pos") + F.col("pos")
    fp = F.col("above_neg") + F.col("neg")
    return c.select(*by, F.col("score").alias("threshold"), tp.alias("tp"), fp.alias("fp"),
                    (tp / (tp + fp)).alias("precision"), F.try_divide(tp.cast("double"), F.col("_P").cast("double")).alias("recall"))


def threshold_table(df: DataFrame, label: str, score: str, thresholds: Sequence[float]) -> DataFrame:
    """Precision / recall / flagged at each threshold (0 when undefined), one pass."""
    y = F.col(label).cast("boolean")
    s = F.col(score)
    aggs = []
    for i, t in enumerate(thresholds):
        p = s >= F.lit(t)
        aggs += [F.count_if(p & y).alias(f"tp{i}"), F.count_if(p & ~y).alias(f"fp{i}"),
                 F.count_if(~p & y).alias(f"fn{i}")]
    wide = df.agg(*aggs)
    stack = ", ".join(f"CAST({t} AS DOUBLE), tp{i}, fp{i}, fn{i}" for i, t in enumerate(thresholds))
    long = wide.selectExpr(f"stack({len(thresholds)}, {stack}) AS (threshold, tp, fp, fn)")
    return long.select("threshold", "tp", "fp", "fn",
                       F.coalesce(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")), F.lit(0.0)).alias("precision"),
                       F.coalesce(F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double")), F.lit(0.0)).alias("recall"),
                       (F.col("tp") + F.col("fp")).alias("flagged"))


def confusion(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Zero-filled 2x2 confusion counts (actual, predicted, n)."""
    y, p = F.col(label).cast("int"), F.col(pred).cast("int")
    wide = df.agg(*[F.count_if((y == a) & (p == b)).alias(f"c{a}{b}") for a in (0, 1) for b in (0, 1)])
    return wide.selectExpr("stack(4, 0, 0, c00, 0, 1, c01, 1, 0, c10, 1, 1, c11) AS (actual, predicted, n)")


def class_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Per class precision / recall / f1 / support, plus accuracy, macro and
    weighted averages (sklearn layout; undefined ratios are 0)."""
    cm = confusion(df, label, pred)
    wide = cm.agg(*[F.sum(F.when((F.col("actual") == a) & (F.col("predicted") == b), F.col("n"))).alias(f"c{a}{b}")
                    for a in (0, 1) for b in (0, 1)])

    def safe(n, d):
        return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))

    c00, c01, c10, c11 = (F.col(x) for x in ("c00", "c01", "c10", "c11"))
    rows = []
    for cls, tp, fp, fn in (("0", c00, c10, c01), ("1", c11, c01, c10)):
        prec, rec = safe(tp, tp + fp), safe(tp, tp + fn)
        f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
        rows.append(wide.select(F.lit(cls).alias("class_label"), prec.alias("precision"), rec.alias("recall"),
                                f1.alias("f1"), (tp + fn).alias("support")))
    per = rows[0].unionByName(rows[1])
    n = per.agg(F.sum("support").alias("n"))
    macro = per.agg(F.lit("macro avg").alias("class_label"), F.avg("precision").alias("precision"),
                    F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.sum("support").alias("support"))
    weighted = per.agg(F.lit("weighted avg").alias("class_label"),
                       (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("precision"),
                       (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("recall"),
                       (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("f1"),
                       F.sum("support").alias("support"))
    acc = wide.select(F.lit("accuracy").alias("class_label"), F.lit(None).cast("double").alias("precision"),
                      F.lit(None).cast("double").alias("recall"), safe(c00 + c11, c00 + c01 + c10 + c11).alias("f1"),
                      (c00 + c01 + c10 + c11).alias("support"))
    del n
    return per.unionByName(acc).unionByName(macro).unionByName(weighted)


def result_summary(results: DataFrame, metric: str = "auc", by: Sequence[str] = ()) -> DataFrame:
    """Mean and sample std (ddof 1) of a per-fold metric, per model."""
    return results.groupBy(*by).agg(F.count(metric).alias("folds"), F.avg(metric).alias(f"mean_{metric}"),
                                    F.stddev_samp(metric).alias(f"std_{metric}"))
