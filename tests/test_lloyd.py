"""Joint k-means: every model as Spark's own fit from the same start, in few jobs."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import models as M
from ledgerlens.operators.lloyd import lloyd


def vectors(spark, n=400, seed=4):
    rs = np.random.RandomState(seed)
    return M.assemble(spark.createDataFrame([(i, *map(float, rs.randn(3) + (i % 4) * 2)) for i in range(n)], "id long, a double, b double, c double"), ["a", "b", "c"])


def test_joint_fits_are_those_of_spark_one_by_one(spark):
    vec = vectors(spark)
    fits = [(2, 1), (3, 1), (4, 7)]
    for (k, seed), (model, cost) in zip(fits, M._kmeans_fits(vec, fits)):
        theirs, their_cost = M._kmeans_once(vec, k, seed)
        assert np.allclose(model.clusterCenters(), theirs.clusterCenters(), atol=1e-9) and cost == pytest.approx(their_cost)
        assert (model.transform(vec).select("id", F.col("prediction").alias("p")).join(
            theirs.transform(vec).select("id", "prediction"), "id").where("p != prediction").count() == 0)


def test_iterations_of_all_models_share_their_jobs(spark):
    vec = vectors(spark).cache()
    starts = [np.array(M._kmeans_once(vec, k, s, max_iter=0)[0].clusterCenters()) for k in (2, 3, 4) for s in (1, 2, 3)]
    group = "joint-k-means"
    spark.sparkContext.setJobGroup(group, group)
    try:
        together = lloyd(vec, starts)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        spark.sparkContext.setJobGroup(group + "-alone", group)
        for s, (centres, _) in zip(starts, together):
            assert np.allclose(lloyd(vec, [s])[0][0], centres)
        alone = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group + "-alone"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs * 3 < alone


def test_a_cluster_without_rows_keeps_its_centre(spark):
    vec = vectors(spark, 20)
    (centres, _), = lloyd(vec, [np.array([[0.0, 0, 0], [1e6, 1e6, 1e6]])])
    assert centres[1].tolist() == [1e6] * 3


def test_distances_are_summed_apart_from_the_iterations():
    from ledgerlens.operators.lloyd import distances, moments
    rs = np.random.RandomState(5)
    x, centres = rs.randn(900, 3), rs.randn(4, 3)
    at = ((x[:, None] - centres) ** 2).sum(axis=2).argmin(axis=1)
    sums, far = np.zeros((4, 4)), np.zeros(4)
    moments(x, [centres], [sums])
    distances(x, [centres], [far])
    for c in range(4):
        assert np.allclose(sums[c], [(at == c).sum(), *x[at == c].sum(axis=0)]) and far[c] == pytest.approx(((x[at == c] - centres[c]) ** 2).sum())


def sums_one_by_one(x, centres):
    out = np.zeros((len(centres), 1 + x.shape[1]))
    for row in x:
        at = ((centres ** 2).sum(axis=1) - 2 * (centres @ row)).argmin()
        out[at] += [1, *row]
    return out


def test_moments_are_products_of_matrices(monkeypatch):
    from ledgerlens.operators import lloyd as L
    rng = np.random.default_rng(4)
    x, models = rng.normal(size=(700, 3)), [rng.normal(size=(k, 3)) for k in (2, 5)]
    monkeypatch.setattr(L, "STEP", 256, raising=False)
    sums, count = [np.zeros((k, 4)) for k in (2, 5)], np.bincount
    monkeypatch.setattr(np, "bincount", None)  # a count a feature and model took longer than the distances
    L.moments(x, models, sums)
    monkeypatch.setattr(np, "bincount", count)
    assert all(np.allclose(s, sums_one_by_one(x, c)) for s, c in zip(sums, models))
    x = rng.integers(0, 3, (700, 3)).astype(float)  # many rows as near to two centres, and centres that come twice
    models = [np.array([[0.0, 0, 0], [2, 2, 2], [0, 0, 0]]), np.array([[1.0, 0, 0], [0, 1, 0], [0, 0, 1]])]
    sums = [np.zeros((3, 4)) for _ in models]
    L.moments(x, models, sums)
    assert all((s == sums_one_by_one(x, c)).all() for s, c in zip(sums, models))
    odd = x[:5].copy()
    odd[2, 1] = np.nan
    sums = [np.zeros((3, 4))]
    L.moments(odd, models[:1], sums)
    assert sums[0][:, 0].sum() == 5 and np.isfinite(sums[0][1]).all()
