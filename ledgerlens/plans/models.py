"""Model pipelines: segmentation (M2-M5), delivery-risk LR / RF (M9-M12), walk-forward
(W3 E8 E9) and the propensity model (C4)."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators import models as M
from ledgerlens.operators.forest import LOCAL_ROWS, fold_forests
from ledgerlens.operators.evaluate import auc
from ledgerlens.operators.features import stage_stats_at_cutoff, stats_at_cutoff
from ledgerlens.plans import delivery as D
from ledgerlens.plans.segmentation import FINAL_CLUSTER_FEATURES
from ledgerlens.functions.temporal import ntz_lit
from ledgerlens.plans.walk_forward import month_plan
from ledgerlens.session import remove_path, scratch_path

KMEANS_SEEDS = tuple(range(42, 52))   # ten restarts
PROFILE_COLS = ["recency_days", "monetary", "avg_review_score", "category_diversity", "avg_installments",
                "avg_freight_ratio_log", "frequency"]


def materialise(df: DataFrame) -> DataFrame:
    """Cut lineage before a fit loop: written once in the shared folder, read column by column."""
    return D.materialise(df)


def materialise_by(df: DataFrame, key: str) -> DataFrame:
    """Like ``materialise``, as Parquet partitioned by ``key``: filters on it prune folders, and
    a reader takes only the columns it needs."""
    path = scratch_path(df.sparkSession, f"by_{key}/{uuid.uuid4().hex}")
    df.write.partitionBy(key).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def segments(ready: DataFrame, k: int = 5, seeds: Sequence[int] = KMEANS_SEEDS, features=FINAL_CLUSTER_FEATURES):
    """M4 + M5: final k-means on the scaled behavioural features and rule-based names.
    Returns (customers with cluster + customer_segment, profile table)."""
    base = materialise(ready)
    vec, _, _ = M.scaled_vectors(base, None, features)
    model, _ = M.fit_kmeans(vec, k, seeds)
    lab = model.transform(vec).withColumnRenamed("prediction", "cluster_final").drop("features")
    # restore unscaled feature values by key (scaled copies were only for the fit)
    lab = base.join(lab.select("customer_unique_id", "cluster_final"), "customer_unique_id", "inner")
    prof = lab.groupBy(F.col("cluster_final").alias("cluster")).agg(
        F.count(F.lit(1)).alias("size"), *[F.avg(c).alias(c) for c in PROFILE_COLS])
    rows = [r.asDict() for r in prof.collect()]  # k rows
    names = M.name_segments(rows)
    name_map = F.create_map(*[x for kv in names.items() for x in (F.lit(kv[0]), F.lit(kv[1]))])
    lab = lab.withColumn("customer_segment", name_map[F.col("cluster_final")])
    prof = prof.withColumn("customer_segment", name_map[F.col("cluster")])
    return lab, prof


def kmeans_select_k(ready: DataFrame, ks=range(2, 11), seeds: Sequence[int] = KMEANS_SEEDS,
                    features=FINAL_CLUSTER_FEATURES) -> DataFrame:
    base = materialise(ready)
    vec, _, _ = M.scaled_vectors(base, None, features)
    vec = materialise(vec.select("customer_unique_id", "features"))
    return M.select_k(vec, list(ks), seeds, key="customer_unique_id")


def logit_split(encoded: DataFrame, features: Sequence[str] = D.BASELINE_FEATURES):
    """M9 on the chronological split: (model, scored test+train, stats)."""
    df = encoded.withColumn("is_new_or_thin_history_seller", F.col("is_new_or_thin_history_seller").cast("int"))
    df = materialise(df)
    train = df.where(F.col("split") == "train")
    tr, ap, _ = M.scaled_vectors(train, df, features)
    model = M.fit_logit(tr, features, "is_late", balanced=True)
    scored = M.positive_probability(model.transform(ap)).drop("features", "rawPrediction", "probability")
    return model, scored


#: Sellers of a month whose statistics are broadcast to its rows (a few dozen bytes each); more are joined by shuffle.
SENT_SELLERS = 1 << 19


def with_sellers(part: DataFrame, stats: DataFrame, sellers: int) -> DataFrame:
    """``part`` with its sellers' statistics. Each month joins the whole history before it: up to ``SENT_SELLERS`` sellers
    go to the rows, as the other way shuffles the history once a month."""
    return part.join(F.broadcast(stats) if sellers <= SENT_SELLERS else stats, "primary_seller_id", "left")


def walk_forward(df: DataFrame, features: Sequence[str], fit: str = "logit", with_stages: bool = False,
                 categories: Sequence[str] = (), trees: int = 200, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """W3 + M7 (+M8) + E8: expanding-window monthly evaluation.

    Seller stats for every cutoff come from one aggregate (``stats_at_cutoff``); each
    evaluated month filters it by its cutoff, so no per-month re-aggregation of history.
    Training rows get the fold's whole-train rate (T15). Forests of months whose rows fit in a task are
    grown together (``fold_forests``), larger ones one by one as distributed fits.
    """
    spark = df.sparkSession
    df = D.with_month(df)
    if with_stages:
        df = D.with_stages(df)
    df = materialise_by(df, "year_month")  # a month's training rows are its earlier partitions
    plan = month_plan(df, "year_month", "is_late")
    evaluated = plan.where("evaluated").orderBy("year_month").collect()  # calendar-bounded
    months = [r["year_month"] for r in evaluated]
    together = [r["year_month"] for r in evaluated if r["train_size"] + r["test_size"] <= local_rows] if fit == "forest" and len(categories) <= 1 else []
    cut = plan.where("evaluated").select(F.col("year_month").alias("cutoff"))
    rates = materialise(stats_at_cutoff(df, "primary_seller_id", "is_late", "year_month", cut, 5))
    sellers = {r["cutoff"]: r["count"] for r in rates.groupBy("cutoff").count().collect()}  # one row per month
    stages = None
    stage_cols = ["stage2_approval_to_carrier_hrs", "stage3_carrier_to_customer_hrs"]
    if with_stages:
        stages = materialise(stage_stats_at_cutoff(df, "primary_seller_id", stage_cols, "year_month", cut))
    overall = {r["cutoff"]: r["overall_on_time_rate"]
               for r in rates.select("cutoff", "overall_on_time_rate").distinct().collect()}  # one row per month
    fallback = {}
    if with_stages:
        fallback = {r["cutoff"]: r for r in stages.select("cutoff", *[f"fallback_{c}" for c in stage_cols]).distinct().collect()}
    out_path = scratch_path(spark, f"walk_forward/{uuid.uuid4().hex}")

    def fit_month(i, m):
        part = df.where(F.col("year_month") <= ntz_lit(m))
        r = rates.where(F.col("cutoff") == ntz_lit(m)).select(
            "primary_seller_id", F.col("entity_on_time_rate").alias("seller_on_time_rate"))
        part = with_sellers(part, r, sellers.get(m, 0)).withColumn(
            "seller_on_time_rate", F.coalesce(F.col("seller_on_time_rate"), F.lit(overall.get(m))))
        if with_stages:
            s = stages.where(F.col("cutoff") == ntz_lit(m))
            fb = fallback.get(m)
            part = with_sellers(part, s.select("primary_seller_id", *[F.col(f"avg_{c}").alias(f"seller_avg_{c}") for c in stage_cols]), sellers.get(m, 0))
            for c in stage_cols:
                part = part.withColumn(f"seller_avg_{c}", F.coalesce(F.col(f"seller_avg_{c}"),
                                                                      F.lit(fb[f"fallback_{c}"] if fb else None)))
        train = part.where(F.col("year_month") < ntz_lit(m))
        test = part.where(F.col("year_month") == ntz_lit(m))
        if fit == "forest":
            cat = M.category_vector(train, categories) if categories else None
            vec = [f"{c}_vec" for c in categories]
            tr, te = (M.assemble(cat.transform(d) if cat else d, features, vectors=vec) for d in (train, test))
            model = M.fit_forest(tr, "is_late", trees=trees)
        else:
            tr, te, _ = M.scaled_vectors(train, test, features)
            model = M.fit_logit(tr, features, "is_late")
        # each month writes its scored test rows to its own folder of a shared scratch
        # table: the driver plan stays one month deep, finished months survive a lost
        # executor, and concurrent months never share a commit folder
        (M.positive_probability(model.transform(te))
         .select(F.col("year_month").alias("test_month"), F.col("is_late").cast("int").alias("label"), "score")
         .write.mode("overwrite").parquet(f"{out_path}/fold={i}"))

    def grow_together():
        folds = F.array(*[ntz_lit(m) for m in together])
        part = df.withColumn("test_month", F.explode(F.filter(folds, lambda c: c >= F.col("year_month"))))
        r = rates.select(F.col("cutoff").alias("test_month"), "primary_seller_id", F.col("entity_on_time_rate").alias("seller_on_time_rate"))
        whole = F.create_map(*[x for m in together for x in (ntz_lit(m), F.lit(overall.get(m)).cast("double"))])
        part = part.join(r, ["test_month", "primary_seller_id"], "left").withColumn(
            "seller_on_time_rate", F.coalesce(F.col("seller_on_time_rate"), whole[F.col("test_month")]))
        (fold_forests(part, "test_month", F.col("year_month") == F.col("test_month"), "is_late", F.xxhash64("order_id"), features,
                      categories[0] if categories else None, trees=trees, folds=len(together))
         .write.mode("overwrite").parquet(f"{out_path}/fold=together"))

    M.run_parallel([lambda i=i, m=m: fit_month(i, m) for i, m in enumerate(months) if m not in together] + ([grow_together] if together else []))
    if not months:
        return spark.createDataFrame([], "test_month timestamp_ntz, test_size long, test_late_rate double, auc double")
    res = materialise(auc(spark.read.parquet(out_path).drop("fold"), "label", "score", by=["test_month"]))  # one job for every month
    remove_path(spark, out_path)
    return res.select("test_month", F.col("n").alias("test_size"),
                      (F.col("n_pos") / F.col("n")).alias("test_late_rate"), "auc")


def wf_features(with_stages: bool = False) -> list[str]:
    base = [f for f in D.BASELINE_FEATURES if f != "is_new_or_thin_history_seller"]
    if with_stages:
        return base + ["seller_avg_stage2_approval_to_carrier_hrs", "seller_avg_stage3_carrier_to_customer_hrs"]
    return base


def propensity_scores(cd: DataFrame, confounders: Sequence[str]) -> DataFrame:
    """C4: unweighted LR on scaled confounders + category indicators (drop_first)."""
    df = materialise(cd)
    cat = M.category_vector(df, ["primary_category"], drop_first=True)
    tr, _, _ = M.scaled_vectors(cat.transform(df), None, confounders, ["primary_category_cut"])
    model = M.fit_logit(tr, confounders, "is_late", balanced=False)
    scored = M.positive_probability(model.transform(tr), "propensity_score").select("order_id", "propensity_score")
    return df.join(scored, "order_id")  # unscaled columns, for balance and effects


def windowed_propensity(cd: DataFrame, window: str, confounders: Sequence[str]) -> DataFrame:
    """The propensity model refitted inside each window (a handful of windows)."""
    df = materialise(cd.where(F.col(window).isNotNull()))
    labels = sorted(r[0] for r in df.select(window).distinct().collect())
    parts = M.run_parallel([lambda w=w: propensity_scores(df.where(F.col(window) == w), confounders) for w in labels])
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
