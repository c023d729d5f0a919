"""Registered queries: Spark ML models (rows-only checks; planted-truth tests in tests/)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import causal as C
from ledgerlens.operators import models as M
from ledgerlens.operators import evaluate as E
from ledgerlens.operators.evaluate import auc, result_summary
from ledgerlens.operators.features import entity_rate_stats, with_entity_rates
from ledgerlens.operators.ordering import rolling_folds
from ledgerlens.plans import causal as CP
from ledgerlens.plans import delivery as D
from ledgerlens.plans import models as PM
from ledgerlens.plans import segmentation as S
from ledgerlens.plans.queries_base import T
from ledgerlens.plans.oracle_views import CAUSAL, CUSTOMER, SPLIT
from ledgerlens.plans.queries_causal import cdata, comparison_rows, windowed_effect
from ledgerlens.plans.queries_drift import encoded
from ledgerlens.plans.queries_eval import THRESHOLDS
from ledgerlens.plans.queries_split import trimmed
from ledgerlens.plans.registry import R, query


def segmented(spark, sf_dir):
    return PM.segments(S.clustering_ready(T(spark, sf_dir)))


@query("kmeans_select_k", ids="M2 M3 T22")
def q_kmeans_select_k(spark, sf_dir):
    return PM.kmeans_select_k(S.clustering_ready(T(spark, sf_dir)))


@query("kmeans_segments", ids="M4 M5 F11")
def q_kmeans_segments(spark, sf_dir):
    lab, _ = segmented(spark, sf_dir)
    return lab.select("customer_unique_id", "cluster_final", "customer_segment")


@query("segment_profile", ids="A11 M5")
def q_segment_profile(spark, sf_dir):
    _, prof = segmented(spark, sf_dir)
    return prof


@query("logit_delivery", ids="M9 M12 M1")
def q_logit_delivery(spark, sf_dir):
    _, scored = PM.logit_split(encoded(spark, sf_dir))
    return scored.select("order_id", "split", "is_late", "score")


@query("logit_coefs", ids="M10 O4")
def q_logit_coefs(spark, sf_dir):
    model, _ = PM.logit_split(encoded(spark, sf_dir))
    return M.coefficient_table(model, D.BASELINE_FEATURES, spark)


@query("logit_auc", ids="E1 E7 M9")
def q_logit_auc(spark, sf_dir):
    _, scored = PM.logit_split(encoded(spark, sf_dir))
    return auc(scored.withColumn("label", F.col("is_late").cast("int")), "label", "score", by=["split"])


def fold_rates(rows, train, most=PM.SENT_SELLERS):
    """``rows`` with the seller rate of ``train`` and the thin-history flag as a number. A fit reads its rows several times: up to
    ``most`` sellers go to the rows, more meet them in one shuffle whose result is written."""
    stats, overall = entity_rate_stats(train, "primary_seller_id", "is_late", 5)
    stats = PM.materialise(stats)
    sent = stats.count() <= most
    out = with_entity_rates(rows, stats, overall, "primary_seller_id", sent=sent)
    out = out.withColumn("is_new_or_thin_history_seller", F.col("is_new_or_thin_history_seller").cast("int"))
    return out if sent else PM.materialise(out)


@query("rolling_fold_auc", ids="W2 M7 E8")
def q_rolling_fold_auc(spark, sf_dir):
    """Five rolling-origin folds: per fold train-only seller rate, scaler and LR."""
    f = rolling_folds(trimmed(spark, sf_dir), "order_purchase_timestamp", "order_id", 5)
    own = [c for c in D.BASELINE_FEATURES if c in f.columns]
    f = PM.materialise(f.select("chunk", "order_purchase_timestamp", "primary_seller_id", "is_late", *own))
    def one_fold(i):
        tr = f.where(F.col("chunk") < i)
        te = f.where(F.col("chunk") == i)
        rows = fold_rates(f.where(F.col("chunk") <= i), tr)
        a, b, _ = M.scaled_vectors(rows.where(F.col("chunk") < i), rows.where(F.col("chunk") == i), D.BASELINE_FEATURES)
        model = M.fit_logit(a, D.BASELINE_FEATURES, "is_late")
        sc = M.positive_probability(model.transform(b))
        r = auc(sc.withColumn("label", F.col("is_late").cast("int")), "label", "score").first()
        rng = te.agg(F.min("order_purchase_timestamp").alias("s"), F.max("order_purchase_timestamp").alias("e"),
                     F.avg(F.col("is_late").cast("double")).alias("lr")).first()
        return (i, rng["s"], rng["e"], rng["lr"], r["auc"])
    rows = M.run_parallel([lambda i=i: one_fold(i) for i in range(1, 6)])  # folds are independent jobs
    return spark.createDataFrame(rows, "fold int, test_start timestamp_ntz, test_end timestamp_ntz, test_late_rate double, auc double")


@query("walk_forward_auc", ids="W3 M7 E8 T15 T16 T17")
def q_walk_forward_auc(spark, sf_dir):
    return PM.walk_forward(trimmed(spark, sf_dir), PM.wf_features(), "logit")


@query("walk_forward_stage_auc", ids="W3 M8 A20 E8")
def q_walk_forward_stage_auc(spark, sf_dir):
    return PM.walk_forward(trimmed(spark, sf_dir), PM.wf_features(True), "logit", with_stages=True)


@query("forest_delivery", ids="M11 R1")
def q_forest_delivery(spark, sf_dir):
    """Random forest (200 trees, depth 8, balanced, category dummies) on the chronological
    split; train and test AUC."""
    enc = encoded(spark, sf_dir)
    train = enc.where(F.col("split") == "train")
    cat = M.category_vector(train, ["primary_category"])
    vec = lambda d: M.assemble(cat.transform(d), PM.wf_features(), vectors=["primary_category_vec"])
    model = M.fit_forest(vec(train), "is_late")
    sc = M.positive_probability(model.transform(vec(enc)))
    return auc(sc.withColumn("label", F.col("is_late").cast("int")), "label", "score", by=["split"])


@query("model_compare", ids="E9 E8")
def q_model_compare(spark, sf_dir):
    """Walk-forward AUC of logit, logit with stages and random forest."""
    base = trimmed(spark, sf_dir)
    # the walk-forwards are independent: their month loops run at once
    runs = {"logit": lambda: PM.walk_forward(base, PM.wf_features(), "logit"),
            "logit_stage": lambda: PM.walk_forward(base, PM.wf_features(True), "logit", with_stages=True),
            "forest": lambda: forest_months(base)}
    out = None
    for name, df in zip(runs, M.run_parallel(list(runs.values()), 3)):
        part = df.withColumn("model", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return result_summary(out, "auc", by=["model"])


def forest_months(base):
    return PM.walk_forward(base, PM.wf_features(), "forest", categories=["primary_category"])


@query("walk_forward_forest_auc", ids="M11 W3 R1 E8")
def q_walk_forward_forest_auc(spark, sf_dir):
    """Random forest (200 trees, depth 8, balanced, category indicators) refitted per month."""
    return forest_months(trimmed(spark, sf_dir))


WALK_FOLDS = """
SELECT year_month AS test_month, test_size, CAST(test_late AS DOUBLE) / test_size AS test_late_rate, true AS auc_in_range
FROM (SELECT *, dense_rank() OVER (ORDER BY year_month) - 1 AS month_idx
      FROM (SELECT CAST(date_trunc('month', order_purchase_timestamp) AS TIMESTAMP) AS year_month,
                   count(*) AS test_size, CAST(sum(CAST(is_late AS INTEGER)) AS BIGINT) AS test_late
            FROM c_trim GROUP BY 1))
WHERE month_idx >= 9 AND test_late >= 5 AND test_size >= 50"""


def checked_folds(months):
    """Fold table with what SQL can state of it: months, sizes, late rates, and that every AUC is a probability."""
    return months.select("test_month", "test_size", "test_late_rate", F.coalesce(F.col("auc").between(0, 1), F.lit(False)).alias("auc_in_range"))


@query("walk_forward_forest_folds", WALK_FOLDS, mart=True, extra=SPLIT, rnd=R("test_late_rate"), ids="M11 W3 E8")
def q_walk_forward_forest_folds(spark, sf_dir):
    return checked_folds(forest_months(trimmed(spark, sf_dir)))


@query("walk_forward_folds", WALK_FOLDS, mart=True, extra=SPLIT, rnd=R("test_late_rate"), ids="W3 M7 E8")
def q_walk_forward_folds(spark, sf_dir):
    return checked_folds(PM.walk_forward(trimmed(spark, sf_dir), PM.wf_features(), "logit"))


@query("rolling_fold_checked", """
SELECT chunk AS fold, min(order_purchase_timestamp) AS test_start, max(order_purchase_timestamp) AS test_end,
       avg(CAST(is_late AS DOUBLE)) AS test_late_rate, true AS auc_in_range
FROM c_folds WHERE chunk BETWEEN 1 AND 5 GROUP BY chunk
""", mart=True, extra=SPLIT, rnd=R("test_late_rate"), ids="W2 M7 E8")
def q_rolling_fold_checked(spark, sf_dir):
    r = q_rolling_fold_auc(spark, sf_dir)
    return r.select("fold", "test_start", "test_end", "test_late_rate", F.coalesce(F.col("auc").between(0, 1), F.lit(False)).alias("auc_in_range"))


@query("logit_optimality", """
SELECT split, count(*) AS n, CAST(sum(CAST(is_late AS INTEGER)) AS BIGINT) AS positives, true AS optimal
FROM c_encoded GROUP BY split""", mart=True, extra=SPLIT, ids="M9 M12")
def q_logit_optimality(spark, sf_dir):
    """At the optimum of a logit with a free intercept the weighted residuals of the training
    rows sum to 0: checked within the solver's tolerance, beside rows and positives per split."""
    _, sc = PM.logit_split(encoded(spark, sf_dir))
    y = F.col("is_late").cast("int")
    t = sc.where(F.col("split") == "train").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("p")).first()
    w = F.when(y == 1, F.lit(t["n"] / (2.0 * t["p"]))).otherwise(F.lit(t["n"] / (2.0 * (t["n"] - t["p"]))))
    r = sc.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum(y).cast("long").alias("positives"),
                                (F.abs(F.sum(w * (F.col("score") - y))) / F.sum(w) < 1e-3).alias("ok"))
    return r.select("split", "n", "positives", F.when(F.col("split") == "train", F.col("ok")).otherwise(True).alias("optimal"))


@query("kmeans_optimality", """
SELECT count(*) AS n, count(*) AS in_clusters, CAST(5 AS BIGINT) AS clusters, CAST(0 AS BIGINT) AS nearer_elsewhere FROM c_ready""",
       extra=CUSTOMER, ids="M4 M5")
def q_kmeans_optimality(spark, sf_dir):
    """Customers, sum of cluster sizes, clusters, and rows nearer (beyond rounding) to another
    cluster's mean of scaled features than to their own: 0 once Lloyd's iterations have settled."""
    from ledgerlens.operators.scaling import scale_apply, scale_fit
    lab, prof = segmented(spark, sf_dir)
    cols = S.FINAL_CLUSTER_FEATURES
    x = PM.materialise(scale_apply(lab, scale_fit(lab, cols)).select("cluster_final", *cols))
    means = {r["cluster_final"]: [r[c] for c in cols] for r in x.groupBy("cluster_final").agg(*[F.avg(c).alias(c) for c in cols]).collect()}
    dist = lambda m: sum((F.col(c) - F.lit(v)) * (F.col(c) - F.lit(v)) for c, v in zip(cols, m))
    own = F.coalesce(*[F.when(F.col("cluster_final") == k, dist(m)) for k, m in means.items()])
    least = F.least(*[dist(m) for m in means.values()])
    return x.agg(F.count(F.lit(1)).alias("n"), F.lit(sum(r["size"] for r in prof.select("size").collect())).cast("long").alias("in_clusters"),
                 F.lit(len(means)).cast("long").alias("clusters"), F.count_if(own > least + 1e-6).alias("nearer_elsewhere"))


@query("kmeans_segments_checked", """
SELECT count(*) AS n, count(DISTINCT customer_unique_id) AS persons, CAST(5 AS BIGINT) AS clusters, CAST(5 AS BIGINT) AS segments, count(*) AS in_profile FROM c_ready""",
       extra=CUSTOMER, ids="M5 F11 A11 P2 T14")
def q_kmeans_segments_checked(spark, sf_dir):
    """Every person once, five clusters with names of their own, and a profile whose sizes add up."""
    lab, prof = segmented(spark, sf_dir)
    sizes = prof.agg(F.sum("size")).first()[0]  # of five rows
    return lab.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("customer_unique_id").alias("persons"), F.countDistinct("cluster_final").alias("clusters"),
                   F.countDistinct("customer_segment").alias("segments"), F.lit(sizes).cast("long").alias("in_profile"))


@query("logit_score_equations", "SELECT unnest([" + ", ".join(f"'{f}'" for f in D.BASELINE_FEATURES) + "]) AS feature, true AS solved", ids="M9 M10 M1")
def q_logit_score_equations(spark, sf_dir):
    """At the optimum each coefficient equals C times the weighted sum of residual times scaled feature (C = 1): the fitted
    coefficients are held against the training rows, feature by feature."""
    from ledgerlens.operators.scaling import scale_apply, scale_fit
    model, sc = PM.logit_split(encoded(spark, sf_dir))
    train = encoded(spark, sf_dir).withColumn("is_new_or_thin_history_seller", F.col("is_new_or_thin_history_seller").cast("int")).where(F.col("split") == "train")
    y = F.col("is_late").cast("double")
    x = scale_apply(train, scale_fit(train, D.BASELINE_FEATURES))
    t = x.agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("p")).first()
    w = F.when(y == 1, F.lit(t["n"] / (2.0 * t["p"]))).otherwise(F.lit(t["n"] / (2.0 * (t["n"] - t["p"]))))
    z = sum((F.col(f).cast("double") * F.lit(float(c)) for f, c in zip(D.BASELINE_FEATURES, model.coefficients)), F.lit(float(model.intercept)))
    gap = w * (y - 1 / (1 + F.exp(-z)))
    sums = x.agg(*[F.sum(gap * F.col(f)).alias(f) for f in D.BASELINE_FEATURES]).first()
    rows = [(f, bool(abs(sums[f] - float(c)) < 1e-3 * t["n"])) for f, c in zip(D.BASELINE_FEATURES, model.coefficients)]
    return spark.createDataFrame(rows, "feature string, solved boolean")


@query("propensity_checked", """
SELECT count(*) AS n, count(*) AS inside, CAST(sum(CAST(is_late AS INTEGER)) AS BIGINT) AS treated, CAST(sum(CAST(is_late AS INTEGER)) AS BIGINT) AS pairs,
       CAST(0 AS BIGINT) AS pairs_of_a_kind FROM c_cd""", mart=True, extra=SPLIT + "," + CAUSAL, ids="C4 C8 M9")
def q_propensity_checked(spark, sf_dir):
    """Scores inside (0, 1) for every order, one pair for every treated order, and no pair of two treated or two controls."""
    p = fitted_propensity(spark, sf_dir)
    pairs = PM.materialise(C.match_pairs(p, "order_id", "is_late", "propensity_score"))
    late = p.select(F.col("order_id").alias("id"), "is_late")
    both = (pairs.join(late.withColumnRenamed("id", "treated_id").withColumnRenamed("is_late", "a"), "treated_id")
            .join(late.withColumnRenamed("id", "control_id").withColumnRenamed("is_late", "b"), "control_id"))
    n = both.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("a") == F.col("b")).alias("kind")).first()
    s = F.col("propensity_score")
    return p.agg(F.count(F.lit(1)).alias("n"), F.count_if((s > 0) & (s < 1)).alias("inside"), F.count_if("is_late").alias("treated"),
                 F.lit(n["pairs"]).cast("long").alias("pairs"), F.lit(n["kind"]).cast("long").alias("pairs_of_a_kind"))


@query("logit_class_report", ids="E2 M9")
def q_logit_class_report(spark, sf_dir):
    """Report of the fitted model on the test split at probability 0.5."""
    _, sc = PM.logit_split(encoded(spark, sf_dir))
    t = _test(sc).withColumn("pred", (F.col("score") >= 0.5).cast("int"))
    return E.class_report(t, "label", "pred").withColumn("support", F.col("support").cast("long"))


def _test(scored):
    return scored.where(F.col("split") == "test").withColumn("label", F.col("is_late").cast("int"))


@query("logit_confusion", ids="E3 M9")
def q_logit_confusion(spark, sf_dir):
    _, sc = PM.logit_split(encoded(spark, sf_dir))
    return E.confusion(_test(sc).withColumn("pred", (F.col("score") >= 0.5).cast("int")), "label", "pred")


@query("logit_threshold_table", ids="E4 M9")
def q_logit_threshold_table(spark, sf_dir):
    _, sc = PM.logit_split(encoded(spark, sf_dir))
    return E.threshold_table(_test(sc), "label", "score", THRESHOLDS)


@query("logit_pr_curve", ids="E5 M9")
def q_logit_pr_curve(spark, sf_dir):
    _, sc = PM.logit_split(encoded(spark, sf_dir))
    return E.pr_curve(_test(sc), "label", "score")


@query("logit_auc_by_slice", ids="E6 M9")
def q_logit_auc_by_slice(spark, sf_dir):
    _, sc = PM.logit_split(encoded(spark, sf_dir))
    return auc(_test(sc), "label", "score", by=["is_new_or_thin_history_seller"])


@query("propensity_scores", ids="C4 R2 M1 M9")
def q_propensity_scores(spark, sf_dir):
    p = PM.propensity_scores(cdata(spark, sf_dir), CP.CONFOUNDERS)
    return p.select("order_id", "is_late", "propensity_score")


def fitted_propensity(spark, sf_dir):
    return PM.materialise(PM.propensity_scores(cdata(spark, sf_dir), CP.CONFOUNDERS))


def fitted_pairs(spark, sf_dir):
    p = fitted_propensity(spark, sf_dir)
    pairs = PM.materialise(C.match_pairs(p, "order_id", "is_late", "propensity_score"))
    return C.pair_values(pairs, p, "order_id", ["review_score"] + CP.BALANCE_COVARIATES), p


@query("propensity_matched_effect", ids="C4 C8 C10")
def q_propensity_matched_effect(spark, sf_dir):
    return C.matched_effect(fitted_pairs(spark, sf_dir)[0], "review_score")


@query("propensity_describe", ids="C4 C5")
def q_propensity_describe(spark, sf_dir):
    from ledgerlens.operators.profile import describe
    return describe(fitted_propensity(spark, sf_dir), ["propensity_score"], by=["is_late"])


@query("propensity_overlap", ids="C4 C6")
def q_propensity_overlap(spark, sf_dir):
    return C.overlap_histogram(fitted_propensity(spark, sf_dir), "is_late", "propensity_score", 50)


@query("propensity_support", ids="C4 C7")
def q_propensity_support(spark, sf_dir):
    return C.common_support(fitted_propensity(spark, sf_dir), "is_late", "propensity_score")


@query("propensity_balance", ids="C4 C11")
def q_propensity_balance(spark, sf_dir):
    return C.covariate_balance(fitted_pairs(spark, sf_dir)[0], CP.BALANCE_COVARIATES)


@query("propensity_caliper", ids="C4 C12")
def q_propensity_caliper(spark, sf_dir):
    pv, p = fitted_pairs(spark, sf_dir)
    return C.caliper_effect(pv, p, "propensity_score", "review_score", 0.2)


@query("propensity_effect_by_window", ids="C4 C13 W5")
def q_propensity_effect_by_window(spark, sf_dir):
    """Per time quartile: the propensity model refitted inside the window, naive and matched difference."""
    from ledgerlens.operators.ordering import quantile_bins
    q = quantile_bins(PM.materialise(cdata(spark, sf_dir)), "order_purchase_timestamp", ["Q1", "Q2", "Q3", "Q4"], name="time_window")
    return windowed_effect(PM.materialise(PM.windowed_propensity(q, "time_window", CP.CONFOUNDERS)), "propensity_score")


@query("propensity_summary", ids="C4 C14 P5")
def q_propensity_summary(spark, sf_dir):
    pv, p = fitted_pairs(spark, sf_dir)
    return comparison_rows(p, pv)


@query("segment_names", ids="M5 T14 F11")
def q_segment_names(spark, sf_dir):
    """Rule-based name of each k-means cluster (from the k-row centroid profile)."""
    _, prof = segmented(spark, sf_dir)
    return prof.select("cluster", "customer_segment", "size")
