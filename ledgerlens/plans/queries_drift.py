"""Registered queries: drift diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import drift as DR
from ledgerlens.operators.features import rate_encode
from ledgerlens.plans import delivery as D
from ledgerlens.plans.oracle_views import DRIFT, SPLIT
from ledgerlens.plans.queries_split import trimmed
from ledgerlens.plans.registry import R, query
from ledgerlens.plans.sqlgen import corr_rows_sql, corr_sql, n_sql

COMPARISON_FEATURES = [f for f in D.BASELINE_FEATURES if f != "is_new_or_thin_history_seller"]
_EXTRA = SPLIT + "," + DRIFT


def encoded(spark, sf_dir):
    df, _ = D.split_frame(trimmed(spark, sf_dir))
    return D.materialise(rate_encode(df.where(F.col("split") == "train"), df, "primary_seller_id", "is_late", 5))


def windows(spark, sf_dir):
    """Trimmed mart with window labels, train-only seller rate and delivery stages."""
    enc = encoded(spark, sf_dir)
    return D.with_stages(D.comparison_windows(enc))


@query("feature_correlations", corr_rows_sql("c_encoded WHERE split = 'train'", "CAST(is_late AS INTEGER)",
                                             COMPARISON_FEATURES).replace("FROM c_encoded WHERE split = 'train'",
                                                                          "FROM (SELECT * FROM c_encoded WHERE split = 'train')"),
       mart=True, extra=SPLIT, rnd=R("r", "t", "p", d=5), ids="D1 T12")
def q_feature_correlations(spark, sf_dir):
    enc = encoded(spark, sf_dir)
    return DR.corr_table(enc.where(F.col("split") == "train"), "is_late", COMPARISON_FEATURES).select(
        "feature", "r", "n", "t", "p")


def _wcorr_sql():
    parts = " UNION ALL ".join(
        f"SELECT window_label, '{f}' AS feature, {corr_sql(f, 'CAST(is_late AS INTEGER)')} AS r FROM c_wfull "
        f"WHERE window_label IS NOT NULL GROUP BY window_label" for f in COMPARISON_FEATURES)
    return f"""
SELECT feature, max(r) FILTER (WHERE window_label = 'A') AS r_A, max(r) FILTER (WHERE window_label = 'B') AS r_B,
       sign(max(r) FILTER (WHERE window_label = 'A')) * sign(max(r) FILTER (WHERE window_label = 'B')) < 0 AS sign_flip
FROM ({parts}) GROUP BY feature"""


@query("window_correlations", _wcorr_sql(), mart=True, extra=_EXTRA, rnd=R("r_A", "r_B", d=5), ids="D2 W4 D3")
def q_window_correlations(spark, sf_dir):
    w = windows(spark, sf_dir).where(F.col("window_label").isNotNull())
    c = DR.corr_table(w, "is_late", COMPARISON_FEATURES, by=["window_label"])
    return DR.window_compare(c, "window_label", "A", "B")


@query("same_entity_corr", f"""
SELECT window_label, {corr_sql('seller_customer_distance_km', 'CAST(is_late AS INTEGER)')} AS r,
       {n_sql('seller_customer_distance_km', 'is_late')} AS n
FROM c_wfull WHERE window_label IS NOT NULL AND primary_seller_id IN (
  SELECT primary_seller_id FROM c_wfull WHERE window_label = 'A' INTERSECT SELECT primary_seller_id FROM c_wfull WHERE window_label = 'B')
GROUP BY window_label
""", mart=True, extra=_EXTRA, rnd=R("r", d=5), ids="D5 U3 J5")
def q_same_entity_corr(spark, sf_dir):
    w = windows(spark, sf_dir).where(F.col("window_label").isNotNull())
    a = w.where(F.col("window_label") == "A").select("primary_seller_id").distinct()
    b = w.where(F.col("window_label") == "B").select("primary_seller_id").distinct()
    common = w.join(a.intersect(b), "primary_seller_id", "left_semi")
    return DR.corr_table(common, "is_late", ["seller_customer_distance_km"], by=["window_label"]).select(
        "window_label", "r", "n")


def _bootstrap_sql(reps: int = 20, frac: float = 0.7, seed: int = 42) -> str:
    u = DR.replicate_uniform_sql("d.order_id", "g.rep", seed)
    w = DR.bootstrap_weights_sql("u", frac)
    return f"""
SELECT avg(r) AS mean_r, stddev_pop(r) AS std_r, min(r) AS min_r, max(r) AS max_r, count(r) AS reps FROM (
  SELECT rep, CASE WHEN vx * vy > 0 THEN cv / sqrt(vx * vy) END AS r FROM (
    SELECT rep, sxy / sw - (sx / sw) * (sy / sw) AS cv, sxx / sw - pow(sx / sw, 2) AS vx,
           syy / sw - pow(sy / sw, 2) AS vy FROM (
      SELECT rep, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx,
             sum(w * y * y) AS syy, sum(w * x * y) AS sxy FROM (
        SELECT rep, x, y, CAST(CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN {w} ELSE 0 END AS DOUBLE) AS w FROM (
          SELECT g.rep, d.x, d.y, {u} AS u
          FROM (SELECT order_id, CAST(seller_customer_distance_km AS DOUBLE) AS x,
                       CAST(CAST(is_late AS INTEGER) AS DOUBLE) AS y
                FROM c_wfull WHERE window_label = 'B') d,
               (SELECT range AS rep FROM range({reps})) g))
      GROUP BY rep)))"""


@query("bootstrap_corr", _bootstrap_sql(), mart=True, extra=_EXTRA, rnd=R("mean_r", "std_r", "min_r", "max_r", d=6),
       ids="D4")
def q_bootstrap_corr(spark, sf_dir):
    """Replicate weights from an integer hash that the oracle restates in SQL."""
    w = windows(spark, sf_dir).where(F.col("window_label") == "B")
    reps = DR.bootstrap_corr(w, "order_id", "seller_customer_distance_km", "is_late", 20, 0.7, 42)
    return DR.bootstrap_summary(reps)


@query("category_share_by_window", """
SELECT window_label, primary_category, n, share, CAST(rnk AS INTEGER) AS rank FROM (
  SELECT window_label, primary_category, n, n / sum(n) OVER (PARTITION BY window_label) AS share,
         row_number() OVER (PARTITION BY window_label ORDER BY n DESC, primary_category) AS rnk
  FROM (SELECT window_label, primary_category, count(*) AS n FROM c_wfull
        WHERE window_label IS NOT NULL AND primary_category IS NOT NULL GROUP BY 1, 2))
WHERE rnk <= 10
""", mart=True, extra=_EXTRA, rnd=R("share"), ids="D6 V4")
def q_category_share_by_window(spark, sf_dir):
    return DR.top_shares(windows(spark, sf_dir), "primary_category", "window_label", 10).withColumn(
        "rank", F.col("rank").cast("int"))


_STAGES = ["stage1_purchase_to_approval_hrs", "stage2_approval_to_carrier_hrs", "stage3_carrier_to_customer_hrs"]


@query("stage_decomposition", "SELECT window_label, count(*) AS n, " + ", ".join(
    f"avg({s}) AS mean_{s}" for s in _STAGES) + " FROM c_wfull WHERE window_label IS NOT NULL GROUP BY window_label",
       mart=True, extra=_EXTRA, rnd=R(*[f"mean_{s}" for s in _STAGES], d=5), ids="D7 X2")
def q_stage_decomposition(spark, sf_dir):
    w = windows(spark, sf_dir).where(F.col("window_label").isNotNull())
    return w.groupBy("window_label").agg(F.count(F.lit(1)).alias("n"), *[F.avg(s).alias(f"mean_{s}") for s in _STAGES])


@query("slack_analysis", f"""
SELECT window_label, avg(estimated_delivery_window_days) AS mean_estimated_days, avg(slack_days) AS mean_slack_days,
       {corr_sql('estimated_delivery_window_days', 'seller_customer_distance_km')} AS r_estimate_distance,
       {corr_sql('slack_days', 'seller_customer_distance_km')} AS r_slack_distance,
       {corr_sql('stage3_carrier_to_customer_hrs', 'seller_customer_distance_km')} AS r_transit_distance,
       {n_sql('slack_days', 'seller_customer_distance_km')} AS n_slack
FROM c_wfull WHERE window_label IS NOT NULL GROUP BY window_label
""", mart=True, extra=_EXTRA,
       rnd=R("mean_estimated_days", "mean_slack_days", "r_estimate_distance", "r_slack_distance", "r_transit_distance", d=5),
       ids="D8 D3 X10 T18")
def q_slack_analysis(spark, sf_dir):
    from ledgerlens.functions.numeric import guarded_corr, pair_count
    w = windows(spark, sf_dir).where(F.col("window_label").isNotNull())
    d = F.col("seller_customer_distance_km")
    return w.groupBy("window_label").agg(
        F.avg("estimated_delivery_window_days").alias("mean_estimated_days"),
        F.avg("slack_days").alias("mean_slack_days"),
        guarded_corr(F.col("estimated_delivery_window_days"), d).alias("r_estimate_distance"),
        guarded_corr(F.col("slack_days"), d).alias("r_slack_distance"),
        guarded_corr(F.col("stage3_carrier_to_customer_hrs"), d).alias("r_transit_distance"),
        pair_count(F.col("slack_days"), d).alias("n_slack"))


@query("window_summary", """
SELECT window_label, count(*) AS n, count(DISTINCT primary_seller_id) AS sellers, avg(CAST(is_late AS DOUBLE)) AS late_rate,
       avg(CASE WHEN is_new_or_thin_history_seller THEN 0.0 ELSE 1.0 END) * 100 AS pct_with_history
FROM c_wfull WHERE window_label IS NOT NULL GROUP BY window_label
""", mart=True, extra=_EXTRA, rnd=R("late_rate", "pct_with_history"), ids="D10 V8 T13 A21 T11")
def q_window_summary(spark, sf_dir):
    w = windows(spark, sf_dir).where(F.col("window_label").isNotNull())
    return w.groupBy("window_label").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("primary_seller_id").alias("sellers"),
        F.avg(F.col("is_late").cast("double")).alias("late_rate"),
        (F.avg(F.when(F.col("is_new_or_thin_history_seller"), 0.0).otherwise(1.0)) * 100).alias("pct_with_history"))


@query("describe_by_window", """
SELECT window_label, 'seller_customer_distance_km' AS column_name, count(seller_customer_distance_km) AS n,
       avg(seller_customer_distance_km) AS mean, stddev_samp(seller_customer_distance_km) AS std,
       min(seller_customer_distance_km) AS min, quantile_cont(seller_customer_distance_km, 0.25) AS q25,
       quantile_cont(seller_customer_distance_km, 0.5) AS q50, quantile_cont(seller_customer_distance_km, 0.75) AS q75,
       max(seller_customer_distance_km) AS max
FROM c_wfull WHERE window_label IS NOT NULL GROUP BY window_label
""", mart=True, extra=_EXTRA, rnd=R("mean", "std", "min", "q25", "q50", "q75", "max", d=4), ids="D9 V6")
def q_describe_by_window(spark, sf_dir):
    from ledgerlens.operators.profile import describe
    w = windows(spark, sf_dir).where(F.col("window_label").isNotNull())
    return describe(w, ["seller_customer_distance_km"], by=["window_label"])
