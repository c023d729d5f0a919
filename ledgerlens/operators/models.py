"""Spark ML wrappers. Fits iterate on the executors; only centroids,
coefficients and per-fold metric rows reach the driver."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.lloyd import Centres, lloyd
from ledgerlens.operators.scaling import scale_apply, scale_fit
from ledgerlens.operators.silhouette import SAMPLE, sampled_silhouette

# fixed segment labels of the final five-cluster solution
SEGMENT_NAMES = {
    "dissatisfied": "Dissatisfied Segment",
    "core": "Satisfied Core",
    "high_value": "High-Value Installment Payers",
    "repeat": "Repeat/Multi-Category Buyers",
    "low_spend": "Low-Spend High-Freight",
}


# Independent fits (restarts, k values, folds, walk-forward months) are submitted as
# concurrent Spark jobs from this many driver threads, as CrossValidator(parallelism=...)
# does. Each fit is still distributed; the pool only overlaps their driver-side iterations.
# A session can set its own with the conf key below.
FIT_PARALLELISM = 4
FIT_PARALLELISM_CONF = "ledgerlens.fit.parallelism"


def run_parallel(tasks: Sequence[Callable[[], object]], parallelism: int | None = None) -> list:
    """Run zero-argument callables that each launch Spark jobs; results in input order."""
    tasks = list(tasks)
    spark = SparkSession.active()
    if parallelism is None:
        parallelism = int(spark.conf.get(FIT_PARALLELISM_CONF, str(FIT_PARALLELISM)))
    if parallelism <= 1 or len(tasks) <= 1:
        return [t() for t in tasks]
    wrap = inheritable_thread_target(spark)  # threads keep the job tags / local properties
    with ThreadPool(min(parallelism, len(tasks))) as pool:
        return pool.map(lambda t: wrap(t)(), tasks)


def category_vector(train: DataFrame, cols: Sequence[str], drop_first: bool = False):
    """R1/R2 for models: per column one sparse indicator vector ``{col}_vec`` over the values of
    ``train`` (alphabetical), so a category of any size stays one column. Unseen values and nulls are
    all zeros. Returns a fitted transformer; ``drop_first`` leaves the first value out."""
    idx = [f"{c}_idx" for c in cols]
    # alphabetDesc puts the first value last, where dropLast leaves it out
    index = StringIndexer(inputCols=list(cols), outputCols=idx, handleInvalid="keep", stringOrderType="alphabetDesc" if drop_first else "alphabetAsc")
    hot = OneHotEncoder(inputCols=idx, outputCols=[f"{c}_vec" for c in cols], dropLast=True)
    if not drop_first:
        return Pipeline(stages=[index, hot]).fit(train)
    sized = index.fit(train)
    # the slot of unseen values is dropped by the encoder; the first value's slot goes with a slice
    model = Pipeline(stages=[sized, hot]).fit(train)
    slices = [VectorSlicer(inputCol=f"{c}_vec", outputCol=f"{c}_cut", indices=list(range(max(len(sized.labelsArray[i]) - 1, 0))))
              for i, c in enumerate(cols)]
    return PipelineModel([*model.stages, *slices])


def assemble(df: DataFrame, features: Sequence[str], out: str = "features", vectors: Sequence[str] = ()) -> DataFrame:
    return VectorAssembler(inputCols=[*features, *vectors], outputCol=out, handleInvalid="keep").transform(
        df.select("*", *[F.col(c).cast("double").alias(f"__f_{c}") for c in features])
        .drop(*features).select("*", *[F.col(f"__f_{c}").alias(c) for c in features])
        .drop(*[f"__f_{c}" for c in features]))


def scaled_vectors(train: DataFrame, apply: DataFrame | None, features: Sequence[str], vectors: Sequence[str] = ()):
    """M1 then vector assembly: scaler fitted on ``train`` only (population std); ``vectors`` are
    appended unscaled."""
    stats = scale_fit(train, features)
    tr = assemble(scale_apply(train, stats), features, vectors=vectors)
    ap = None if apply is None else assemble(scale_apply(apply, stats), features, vectors=vectors)
    return tr, ap, stats


def fit_kmeans(df: DataFrame, k: int, seeds: Sequence[int] = (42,), features_col: str = "features",
               max_iter: int = 300):
    """M2/M4: best-of-restarts k-means (lowest training cost, ties to the earlier seed), k-means|| init."""
    return min(_kmeans_fits(df, [(k, s) for s in seeds], features_col, max_iter), key=lambda mc: mc[1])


def _kmeans_fits(df: DataFrame, fits: Sequence[tuple[int, int]], features_col: str = "features", max_iter: int = 300):
    """(model, training cost) of each (k, seed): Spark draws the first centres (k-means||), then all iterate together."""
    starts = run_parallel([lambda k=k, s=s: _kmeans_once(df, k, s, features_col, 0)[0].clusterCenters() for k, s in fits])
    return [(Centres(c, features_col), cost) for c, cost in lloyd(df, [np.array(c) for c in starts], features_col, max_iter)]  # until no centre moves


def _kmeans_once(df: DataFrame, k: int, seed: int, features_col: str = "features", max_iter: int = 300):
    m = KMeans(k=k, seed=int(seed), featuresCol=features_col, maxIter=max_iter, tol=1e-9, initMode="k-means||").fit(df)
    return m, m.summary.trainingCost


def select_k(df: DataFrame, ks: Sequence[int], seeds: Sequence[int], features_col: str = "features", key: str | None = None,
             sample: int = SAMPLE) -> DataFrame:
    """M2 + M3 (+T22: one fit per k gives both): k, inertia, silhouette (mean Euclidean, of ``sample`` points against
    all rows) with its standard error, and silhouette_squared (squared Euclidean, the closed form of
    ``ClusteringEvaluator``). ``key`` names the rows; without it their features do."""
    ev = ClusteringEvaluator(featuresCol=features_col, predictionCol="prediction",
                             distanceMeasure="squaredEuclidean")
    ks, seeds = [int(k) for k in ks], list(seeds)
    # every (k, restart) fit iterates with the others; the best restart per k keeps the earlier seed on ties
    fits = _kmeans_fits(df, [(k, s) for k in ks for s in seeds], features_col)
    best = [min(fits[i * len(seeds):(i + 1) * len(seeds)], key=lambda mc: mc[1]) for i in range(len(ks))]
    width = len(best[0][0].clusterCenters()[0]) if best else 0
    columns = [f"_f{i}" for i in range(width)]

    def measured(model):
        out = model.transform(df)
        x = vector_to_array(F.col(features_col))
        flat = out.select(F.col("prediction"), (F.col(key).cast("string") if key else x.cast("string")).alias("_key"), *[x[i].alias(c) for i, c in enumerate(columns)])
        return ev.evaluate(out), sampled_silhouette(flat, columns, "prediction", "_key", sample).first()

    sil = run_parallel([lambda m=m: measured(m) for m, _ in best])
    rows = [(k, float(cost), e["silhouette"], e["standard_error"], float(squared)) for k, (_, cost), (squared, e) in zip(ks, best, sil)]
    return df.sparkSession.createDataFrame(rows, "k int, inertia double, silhouette double, standard_error double, silhouette_squared double")


def name_segments(profile_rows: list[dict], cluster: str = "cluster") -> dict[int, str]:
    """Rule-based names from the (k-row) centroid profile, resolved greedily,
    ties by cluster id: lowest review -> dissatisfied; highest installments -> high value;
    highest category diversity -> repeat / multi-category; highest freight ratio -> low
    spend high freight; remaining -> satisfied core."""
    left = sorted(profile_rows, key=lambda r: r[cluster])
    names = {}

    def pick(key, reverse, label):
        cands = [r for r in left if r[cluster] not in names and r.get(key) is not None]
        if not cands:
            return
        best = sorted(cands, key=lambda r: ((-r[key]) if reverse else r[key], r[cluster]))[0]
        names[best[cluster]] = SEGMENT_NAMES[label]

    pick("avg_review_score", False, "dissatisfied")
    pick("avg_installments", True, "high_value")
    pick("category_diversity", True, "repeat")
    pick("avg_freight_ratio_log", True, "low_spend")
    for r in left:
        names.setdefault(r[cluster], SEGMENT_NAMES["core"])
    return names


def balanced_weights(df: DataFrame, label: str, name: str = "w") -> tuple[DataFrame, float]:
    """sklearn 'balanced' class weights n / (2 * n_class) as a column; returns (df, sum w)."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("p")).first()
    n, p = row["n"], row["p"] or 0
    wp = n / (2.0 * p) if p else 0.0
    wn = n / (2.0 * (n - p)) if n - p else 0.0
    return df.withColumn(name, F.when(F.col(label).cast("boolean"), F.lit(wp)).otherwise(F.lit(wn))), float(n)


def fit_logit(train: DataFrame, features: Sequence[str], label: str, balanced: bool = True, c: float = 1.0,
              max_iter: int = 1000, tol: float = 1e-4):
    """M9: L2 logistic regression equivalent to sklearn's C-parameterised objective on
    pre-scaled features: regParam = 1 / (C * sum of weights), no internal standardisation,
    and sklearn's default convergence tolerance (1e-4)."""
    df = train.withColumn("label", F.col(label).cast("double"))
    if balanced:
        df, total = balanced_weights(df, label)
    else:
        df, total = df.withColumn("w", F.lit(1.0)), float(df.count())
    lr = LogisticRegression(featuresCol="features", labelCol="label", weightCol="w", maxIter=max_iter,
                            regParam=1.0 / (c * total) if total else 0.0, elasticNetParam=0.0,
                            standardization=False, fitIntercept=True, tol=tol)
    return lr.fit(df)


#: Rows of a forest's training set that one task reads: with a count and a node per tree beside each, about 3 KB a row for 200 trees.
FOREST_TASK_ROWS = 1 << 17


def fit_forest(train: DataFrame, label: str, balanced: bool = True, trees: int = 200, depth: int = 8,
               seed: int = 42, task_rows: int = FOREST_TASK_ROWS):
    """Random forest, 200 trees of depth 8, sqrt feature subsets, balanced weights. More than ``task_rows``
    rows are dealt evenly to tasks of at most about so many, as a fit reads its partitions whole at every level."""
    df = train.withColumn("label", F.col(label).cast("double"))
    df, n = balanced_weights(df, label) if balanced else (df.withColumn("w", F.lit(1.0)), float(df.count()))
    if n > task_rows:
        df = df.select("features", "label", "w").repartition(max(-int(-n // task_rows), df.sparkSession.sparkContext.defaultParallelism))
    rf = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="w", numTrees=trees,
                                maxDepth=depth, featureSubsetStrategy="sqrt", seed=seed,
                                cacheNodeIds=True, maxMemoryInMB=1024)  # fewer passes; same model
    return rf.fit(df)


def positive_probability(pred: DataFrame, name: str = "score") -> DataFrame:
    """Probability of the positive class as a double column."""
    return pred.withColumn(name, vector_to_array(F.col("probability"))[1])


def coefficient_table(model, features: Sequence[str], spark) -> DataFrame:
    """Coefficients ranked by absolute value (a k-row table)."""
    rows = [(f, float(c)) for f, c in zip(features, model.coefficients.toArray())]
    rows.sort(key=lambda r: -abs(r[1]))
    return spark.createDataFrame([(i, f, c) for i, (f, c) in enumerate(rows)], "rank int, feature string, coefficient double")
