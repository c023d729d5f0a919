import numpy as np
from pyspark.sql import functions as F

from ledgerlens.operators import models as M


def test_kmeans_recovers_blobs(spark):
    rs = np.random.RandomState(0)
    centers = [(0, 0), (10, 10), (-10, 10)]
    rows = [(i, float(cx + rs.randn()), float(cy + rs.randn())) for i, (cx, cy) in
            enumerate([c for c in centers for _ in range(60)])]
    df = spark.createDataFrame(rows, "id long, x double, y double")
    vec, _, _ = M.scaled_vectors(df, None, ["x", "y"])
    sel = {r["k"]: r["silhouette"] for r in M.select_k(vec, [2, 3, 4], seeds=[1, 2]).collect()}
    assert max(sel, key=sel.get) == 3
    model, _ = M.fit_kmeans(vec, 3, seeds=[1])
    pred = model.transform(vec).select("id", "prediction").collect()
    groups = {}
    for r in pred:
        groups.setdefault(r["id"] // 60, set()).add(r["prediction"])
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == 3


def test_logit_recovers_coefficient_signs(spark):
    rs = np.random.RandomState(5)
    n = 3000
    x1, x2, x3 = rs.randn(n), rs.randn(n), rs.randn(n)
    logit = -2.2 + 1.5 * x1 - 0.8 * x2 + 0.0 * x3
    y = rs.rand(n) < 1 / (1 + np.exp(-logit))
    df = spark.createDataFrame([(float(a), float(b), float(c), bool(d)) for a, b, c, d in zip(x1, x2, x3, y)],
                               "x1 double, x2 double, x3 double, y boolean")
    vec, _, _ = M.scaled_vectors(df, None, ["x1", "x2", "x3"])
    model = M.fit_logit(vec, ["x1", "x2", "x3"], "y", balanced=True)
    c = model.coefficients.toArray()
    assert c[0] > 0.5 and c[1] < -0.2 and abs(c[2]) < 0.2 and abs(c[0]) > abs(c[1])


def test_name_segments_rule():
    rows = [
        {"cluster": 0, "avg_review_score": 4.5, "avg_installments": 2.0, "category_diversity": 1.0, "avg_freight_ratio_log": 0.2},
        {"cluster": 1, "avg_review_score": 1.8, "avg_installments": 2.5, "category_diversity": 1.0, "avg_freight_ratio_log": 0.2},
        {"cluster": 2, "avg_review_score": 4.4, "avg_installments": 8.0, "category_diversity": 1.1, "avg_freight_ratio_log": 0.2},
        {"cluster": 3, "avg_review_score": 4.2, "avg_installments": 3.0, "category_diversity": 2.5, "avg_freight_ratio_log": 0.2},
        {"cluster": 4, "avg_review_score": 4.4, "avg_installments": 2.0, "category_diversity": 1.0, "avg_freight_ratio_log": 0.9},
    ]
    n = M.name_segments(rows)
    assert n[1].startswith("Dissatisfied") and n[2].startswith("High-Value") and n[3].startswith("Repeat")
    assert n[4].startswith("Low-Spend") and n[0] == "Satisfied Core"


def test_parallel_fits_match_serial(spark):
    """Restarts submitted as concurrent jobs give the serial answer (order and best fit)."""
    from ledgerlens.operators import models as M
    assert M.run_parallel([lambda i=i: spark.range(i * 10).count() for i in range(6)], 3) == [0, 10, 20, 30, 40, 50]
    rows = [(float(i % 3) * 5 + (i % 7) * 0.1, float(i % 5)) for i in range(300)]
    vec = M.assemble(spark.createDataFrame(rows, "a double, b double"), ["a", "b"])
    old = M.FIT_PARALLELISM
    try:
        M.FIT_PARALLELISM = 1
        serial = M.fit_kmeans(vec, 3, seeds=[1, 2, 3, 4])
        M.FIT_PARALLELISM = 4
        par = M.fit_kmeans(vec, 3, seeds=[1, 2, 3, 4])
    finally:
        M.FIT_PARALLELISM = old
    assert abs(serial[1] - par[1]) < 1e-9
    assert sorted(map(tuple, serial[0].clusterCenters())) == sorted(map(tuple, par[0].clusterCenters()))


def test_fit_pool_size_from_session_conf(spark):
    """ledgerlens.fit.parallelism = 1 runs the fits serially on the calling thread."""
    import threading
    from ledgerlens.operators import models as M
    me = threading.current_thread().name
    try:
        spark.conf.set(M.FIT_PARALLELISM_CONF, "1")
        assert M.run_parallel([lambda: threading.current_thread().name] * 3) == [me] * 3
        spark.conf.set(M.FIT_PARALLELISM_CONF, "3")
        names = M.run_parallel([lambda: threading.current_thread().name] * 3)
        assert me not in names
    finally:
        spark.conf.unset(M.FIT_PARALLELISM_CONF)
