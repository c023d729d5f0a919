"""Registered queries: nearest join and causal effect."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import causal as C
from ledgerlens.operators.ordering import quantile_bins
from ledgerlens.plans import causal as CP
from ledgerlens.plans import delivery as D
from ledgerlens.plans.oracle_views import CAUSAL, SPLIT
from ledgerlens.plans.queries_base import T
from ledgerlens.plans.registry import R, query

_EXTRA = SPLIT + "," + CAUSAL
_OUT = ["review_score"] + CP.BALANCE_COVARIATES


def cdata(spark, sf_dir):
    t = T(spark, sf_dir)
    trimmed, _ = D.trimmed_mart(t)
    return D.materialise(CP.causal_data(t, trimmed))  # read by treated, control, pair and balance sides


def pairs_values(spark, sf_dir):
    cd = cdata(spark, sf_dir)
    pairs = C.match_pairs(cd, "order_id", "is_late", "propensity")
    return C.pair_values(pairs, cd, "order_id", _OUT), cd


@query("attach_outcome", """
SELECT count(*) AS "rows", count(r.review_score) AS with_outcome, count(*) - count(r.review_score) AS missing
FROM c_trim t LEFT JOIN (SELECT order_id, avg(review_score) AS review_score FROM c_reviews GROUP BY order_id) r ON t.order_id = r.order_id
""", mart=True, extra=_EXTRA, ids="C1 A3 J1 F4")
def q_attach_outcome(spark, sf_dir):
    t = T(spark, sf_dir)
    _, rep = C.attach_outcome(D.trimmed_mart(t)[0], t.reviews, "order_id", "review_score")
    return rep


@query("naive_effect", """
SELECT avg(review_score) FILTER (WHERE is_late) AS mean_treated, avg(review_score) FILTER (WHERE NOT is_late) AS mean_control,
       stddev_samp(review_score) FILTER (WHERE is_late) AS std_treated, stddev_samp(review_score) FILTER (WHERE NOT is_late) AS std_control,
       count(review_score) FILTER (WHERE is_late) AS n_treated, count(review_score) FILTER (WHERE NOT is_late) AS n_control,
       avg(review_score) FILTER (WHERE is_late) - avg(review_score) FILTER (WHERE NOT is_late) AS naive_effect
FROM c_cd
""", mart=True, extra=_EXTRA, rnd=R("mean_treated", "mean_control", "std_treated", "std_control", "naive_effect"), ids="C2 A17")
def q_naive_effect(spark, sf_dir):
    return C.naive_effect(cdata(spark, sf_dir), "is_late", "review_score")


@query("entity_rate_full", "SELECT primary_seller_id, seller_on_time_rate FROM c_rate_full", mart=True, extra=_EXTRA,
       rnd=R("seller_on_time_rate"), ids="C3")
def q_entity_rate_full(spark, sf_dir):
    return cdata(spark, sf_dir).select("primary_seller_id", "seller_on_time_rate").distinct()


@query("describe_scores", """
SELECT is_late, 'propensity' AS column_name, count(propensity) AS n, avg(propensity) AS mean, stddev_samp(propensity) AS std,
       min(propensity) AS min, quantile_cont(propensity, 0.25) AS q25, quantile_cont(propensity, 0.5) AS q50,
       quantile_cont(propensity, 0.75) AS q75, max(propensity) AS max
FROM c_cd GROUP BY is_late
""", mart=True, extra=_EXTRA, rnd=R("mean", "std", "min", "q25", "q50", "q75", "max"), ids="C5 V6")
def q_describe_scores(spark, sf_dir):
    from ledgerlens.operators.profile import describe
    return describe(cdata(spark, sf_dir), ["propensity"], by=["is_late"])


@query("overlap_histogram", """
SELECT treated, bin, lo + bin * (hi - lo) / 50 AS bin_start, count(*) AS count,
       count(*) / (n * nullif((hi - lo) / 50, 0)) AS density FROM (
  SELECT c.is_late AS treated, r.lo, r.hi, r.n,
         CASE WHEN r.hi > r.lo THEN least(CAST(floor((c.propensity - r.lo) / (r.hi - r.lo) * 50) AS INTEGER), 49) ELSE 0 END AS bin
  FROM c_cd c JOIN (SELECT is_late, min(propensity) AS lo, max(propensity) AS hi, count(*) AS n FROM c_cd
                    WHERE propensity IS NOT NULL GROUP BY is_late) r ON c.is_late = r.is_late
  WHERE c.propensity IS NOT NULL)
GROUP BY treated, bin, lo, hi, n
""", mart=True, extra=_EXTRA, rnd=R("bin_start", "density", d=4), ids="C6")
def q_overlap_histogram(spark, sf_dir):
    return C.overlap_histogram(cdata(spark, sf_dir), "is_late", "propensity", 50)


@query("common_support", """
SELECT (SELECT min(propensity) FROM c_cd WHERE NOT is_late) AS control_min, (SELECT max(propensity) FROM c_cd WHERE NOT is_late) AS control_max,
       count(*) AS n_treated,
       count(*) FILTER (WHERE propensity BETWEEN (SELECT min(propensity) FROM c_cd WHERE NOT is_late) AND (SELECT max(propensity) FROM c_cd WHERE NOT is_late)) AS in_support,
       avg(CASE WHEN propensity BETWEEN (SELECT min(propensity) FROM c_cd WHERE NOT is_late) AND (SELECT max(propensity) FROM c_cd WHERE NOT is_late) THEN 1.0 ELSE 0.0 END) * 100 AS pct_in_support
FROM c_cd WHERE is_late
""", mart=True, extra=_EXTRA, rnd=R("control_min", "control_max", "pct_in_support"), ids="C7")
def q_common_support(spark, sf_dir):
    return C.common_support(cdata(spark, sf_dir), "is_late", "propensity")


@query("nn_match", "SELECT * FROM c_pairs", mart=True, extra=_EXTRA,
       rnd=R("treated_score", "control_score", "distance", d=9), ids="J9 C8 T20")
def q_nn_match(spark, sf_dir):
    return C.match_pairs(cdata(spark, sf_dir), "order_id", "is_late", "propensity")


@query("matched_effect", """
SELECT count(control_id) AS pairs, avg(distance) AS mean_distance, max(distance) AS max_distance,
       avg(t_review_score) FILTER (WHERE control_id IS NOT NULL) AS mean_treated,
       avg(c_review_score) FILTER (WHERE control_id IS NOT NULL) AS mean_matched_control,
       avg(t_review_score) FILTER (WHERE control_id IS NOT NULL) - avg(c_review_score) FILTER (WHERE control_id IS NOT NULL) AS matched_effect
FROM c_pv
""", mart=True, extra=_EXTRA, rnd=R("mean_distance", "max_distance", "mean_treated", "mean_matched_control", "matched_effect", d=9),
       ids="C9 C10")
def q_matched_effect(spark, sf_dir):
    pv, _ = pairs_values(spark, sf_dir)
    return C.matched_effect(pv, "review_score")


@query("covariate_balance", " UNION ALL ".join(
    f"SELECT '{c}' AS covariate, avg(t_{c}) AS mean_treated, avg(c_{c}) AS mean_control, "
    f"CASE WHEN avg(t_{c}) <> 0 THEN abs(avg(t_{c}) - avg(c_{c})) / avg(t_{c}) * 100 ELSE 0.0 END AS pct_diff "
    f"FROM c_pv WHERE control_id IS NOT NULL" for c in CP.BALANCE_COVARIATES),
    mart=True, extra=_EXTRA, rnd=R("mean_treated", "mean_control", "pct_diff", d=5), ids="C11 X12 T21")
def q_covariate_balance(spark, sf_dir):
    pv, _ = pairs_values(spark, sf_dir)
    return C.covariate_balance(pv, CP.BALANCE_COVARIATES)


@query("caliper_effect", """
SELECT (SELECT 0.2 * stddev_samp(propensity) FROM c_cd) AS caliper,
       count(*) FILTER (WHERE control_id IS NOT NULL AND distance <= (SELECT 0.2 * stddev_samp(propensity) FROM c_cd)) AS kept,
       count(*) FILTER (WHERE control_id IS NOT NULL) AS pairs,
       count(*) FILTER (WHERE control_id IS NOT NULL AND distance <= (SELECT 0.2 * stddev_samp(propensity) FROM c_cd)) * 100.0
         / count(*) FILTER (WHERE control_id IS NOT NULL) AS pct_kept,
       avg(t_review_score) FILTER (WHERE control_id IS NOT NULL AND distance <= (SELECT 0.2 * stddev_samp(propensity) FROM c_cd))
       - avg(c_review_score) FILTER (WHERE control_id IS NOT NULL AND distance <= (SELECT 0.2 * stddev_samp(propensity) FROM c_cd)) AS caliper_effect
FROM c_pv
""", mart=True, extra=_EXTRA, rnd=R("caliper", "pct_kept", "caliper_effect", d=5), ids="C12")
def q_caliper_effect(spark, sf_dir):
    pv, cd = pairs_values(spark, sf_dir)
    return C.caliper_effect(pv, cd, "propensity", "review_score", 0.2).withColumn("pct_kept", F.col("pct_kept").cast("double"))


_WIN_CTES = """
c_q AS (SELECT c.*, CASE WHEN x <= q[1] THEN 'Q1' WHEN x <= q[2] THEN 'Q2' WHEN x <= q[3] THEN 'Q3' ELSE 'Q4' END AS time_window
        FROM (SELECT *, CAST(epoch_us(order_purchase_timestamp) AS DOUBLE) AS x FROM c_cd) c,
             (SELECT quantile_cont(CAST(epoch_us(order_purchase_timestamp) AS DOUBLE), [0.25, 0.5, 0.75]) AS q FROM c_cd)),
c_qw AS (SELECT q.*, r.propensity_w FROM c_q q JOIN (SELECT time_window, primary_seller_id, avg(CAST(is_late AS DOUBLE)) AS propensity_w
                                                      FROM c_q GROUP BY 1, 2) r
         ON q.time_window = r.time_window AND q.primary_seller_id = r.primary_seller_id),
c_wctrl AS (SELECT time_window, propensity_w AS score, min(order_id) AS cid FROM c_qw WHERE NOT is_late GROUP BY 1, 2),
c_wpairs AS (SELECT * FROM (
   SELECT t.time_window, t.order_id AS treated_id, c.cid AS control_id, abs(t.propensity_w - c.score) AS distance,
          row_number() OVER (PARTITION BY t.order_id ORDER BY abs(t.propensity_w - c.score), c.score, c.cid) AS rn
   FROM c_qw t JOIN c_wctrl c ON t.time_window = c.time_window WHERE t.is_late) WHERE rn = 1)"""


@query("effect_by_window", """
SELECT n.time_window, n.n_late, n.n_ontime, n.naive_diff, m.matched_diff, m.avg_match_distance FROM
 (SELECT time_window, count(*) FILTER (WHERE is_late) AS n_late, count(*) FILTER (WHERE NOT is_late) AS n_ontime,
         avg(review_score) FILTER (WHERE is_late) - avg(review_score) FILTER (WHERE NOT is_late) AS naive_diff
  FROM c_qw GROUP BY time_window) n
LEFT JOIN
 (SELECT p.time_window, avg(t.review_score) - avg(c.review_score) AS matched_diff, avg(p.distance) AS avg_match_distance
  FROM c_wpairs p JOIN c_qw t ON p.treated_id = t.order_id JOIN c_qw c ON p.control_id = c.order_id GROUP BY p.time_window) m
ON n.time_window = m.time_window
""", mart=True, extra=_EXTRA + "," + _WIN_CTES, rnd=R("naive_diff", "matched_diff", "avg_match_distance", d=6), ids="C13 W5")
def q_effect_by_window(spark, sf_dir):
    return effect_by_window(cdata(spark, sf_dir))


def effect_by_window(cd):
    q = quantile_bins(cd, "order_purchase_timestamp", ["Q1", "Q2", "Q3", "Q4"], name="time_window")
    return windowed_effect(CP.windowed_propensity(q, "time_window"), "propensity_w")


def windowed_effect(qw, score):
    from ledgerlens.operators.matching import nearest_join
    # read by the naive, treated, control and pair sides: five columns, written once
    qw = D.materialise(qw.select("order_id", "time_window", "is_late", "review_score", score))
    late = F.col("is_late")
    naive = qw.groupBy("time_window").agg(
        F.count_if(late).alias("n_late"), F.count_if(~late).alias("n_ontime"),
        (F.avg(F.when(late, F.col("review_score"))) - F.avg(F.when(~late, F.col("review_score")))).alias("naive_diff"))
    pairs = nearest_join(qw.where(late), qw.where(~late), "order_id", score, by=["time_window"])
    pv = C.pair_values(pairs.where(F.col("control_id").isNotNull()), qw, "order_id", ["review_score"])
    m = pv.groupBy("time_window").agg(
        (F.avg("t_review_score") - F.avg("c_review_score")).alias("matched_diff"),
        F.avg("distance").alias("avg_match_distance"))
    return naive.join(m, "time_window", "left").select("time_window", "n_late", "n_ontime", "naive_diff", "matched_diff",
                                                        "avg_match_distance")


@query("causal_summary", """
SELECT 'Naive' AS comparison_type, 'On-time' AS "group", avg(review_score) FILTER (WHERE NOT is_late) AS avg_review_score FROM c_cd
UNION ALL SELECT 'Naive', 'Late', avg(review_score) FILTER (WHERE is_late) FROM c_cd
UNION ALL SELECT 'Matched', 'On-time', avg(c_review_score) FROM c_pv WHERE control_id IS NOT NULL
UNION ALL SELECT 'Matched', 'Late', avg(t_review_score) FROM c_pv WHERE control_id IS NOT NULL
""", mart=True, extra=_EXTRA, rnd=R("avg_review_score", d=9), ids="C14 P5")
def q_causal_summary(spark, sf_dir):
    pv, cd = pairs_values(spark, sf_dir)
    return comparison_rows(cd, pv)


def comparison_rows(cd, pv):
    """C14: naive and matched mean scores of late and on-time orders."""
    nv = C.naive_effect(cd, "is_late", "review_score")
    me = C.matched_effect(pv, "review_score")
    a = nv.selectExpr("stack(2, 'Naive', 'On-time', mean_control, 'Naive', 'Late', mean_treated) AS (comparison_type, `group`, avg_review_score)")
    b = me.selectExpr("stack(2, 'Matched', 'On-time', mean_matched_control, 'Matched', 'Late', mean_treated) AS (comparison_type, `group`, avg_review_score)")
    return a.unionByName(b)
