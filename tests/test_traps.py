"""Operators on string ids, null groups, hot keys and unbounded category domains."""
import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import drift, matching, models, ordering, profile
from ledgerlens.operators.evaluate import auc
from ledgerlens.operators.features import _as_of_cutoffs, item_enrichment


def test_nearest_join_takes_string_ids_and_null_groups(spark):
    rng = random.Random(1)
    rows = [(f"id{i:03d}", rng.choice(["a", None]), i % 3 == 0, round(rng.random(), 2)) for i in range(150)]
    df = spark.createDataFrame(rows, "id string, g string, t boolean, s double")
    got = {r["treated_id"]: r["control_id"] for r in matching.nearest_join(df.where("t"), df.where("not t"), "id", "s", by=["g"], n_parts=5).collect()}
    for i, g, t, s in rows:
        if t:
            best = min((abs(s - x), x, j) for j, h, u, x in rows if not u and h == g)
            assert got[i] == best[2]


def test_bootstrap_takes_string_ids_and_keeps_all_mass(spark):
    df = spark.createDataFrame([(f"k{i}", float(i % 7), float(i % 5)) for i in range(400)], "k string, x double, y double")
    assert drift.bootstrap_summary(drift.bootstrap_corr(df, "k", "x", "y", reps=5)).first()["reps"] == 5
    for lam in (0.7, 10.0, 60.0):
        cdf = drift.poisson_cdf(lam)
        assert cdf[-1] == pytest.approx(1.0, abs=1e-12) and all(b >= a for a, b in zip(cdf, cdf[1:]))
    u = df.select(drift.replicate_uniform("k", 0, 42).alias("u")).toPandas()["u"]
    assert 0 <= u.min() and u.max() < 1 and abs(u.mean() - 0.5) < 0.06 and u.nunique() == 400


def test_null_groups_have_quantiles_and_auc(spark):
    rows = [(None if i % 2 else "a", float(i % 10), i % 3 == 0) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, x double, y boolean")
    q = {(r["g"], r["p"]): r["q"] for r in ordering.exact_quantiles(df, "x", [0.0, 0.25, 0.5, 1.0], by=["g"], n_parts=4).collect()}
    for g in ("a", None):
        x = [r[1] for r in rows if r[0] == g]
        assert all(q[g, p] == pytest.approx(np.quantile(x, p)) for p in (0.0, 0.25, 0.5, 1.0))
    assert all(r["auc"] is not None for r in auc(df, "y", "x", by=["g"]).collect())
    d = {r["g"]: r for r in profile.describe(df, ["x"], by=["g"]).collect()}
    assert d[None]["q50"] == pytest.approx(np.median([r[1] for r in rows if r[0] is None]))


def test_cutoffs_explode_their_own_slice(spark):
    per = spark.createDataFrame([("a", 1, 10), ("a", 4, 5), ("b", 3, 7)], "e string, p int, n long")
    cuts = spark.createDataFrame([(c,) for c in (1, 2, 4, 5, 9)], "c int")
    got = {(r["cutoff"], r["e"]): r["n"] for r in _as_of_cutoffs(per, "e", "p", ["n"], cuts).collect()}
    assert got == {(2, "a"): 10, (4, "a"): 10, (5, "a"): 15, (9, "a"): 15, (4, "b"): 7, (5, "b"): 7, (9, "b"): 7}
    plan = _as_of_cutoffs(per, "e", "p", ["n"], cuts)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_facts_are_not_exchanged_on_the_category(spark):
    items = spark.createDataFrame([(i, i % 9, 1.0) for i in range(50)], "order_id int, product_id int, price double")
    products = spark.createDataFrame([(i, "hot" if i else None, 1.0, 1.0, 1.0, 1.0) for i in range(9)],
                                     "product_id int, product_category_name string, product_weight_g double, product_length_cm double, product_height_cm double, product_width_cm double")
    names = spark.createDataFrame([("hot", "warm")], "product_category_name string, product_category_name_english string")
    out = item_enrichment(items, products, names)
    assert {r["category_en"] for r in out.collect()} == {"warm", None}
    plan = out.select("order_id", "category_en")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("product_id") < plan.rindex("product_category_name_english")


def test_category_vectors_take_any_number_of_values(spark):
    df = spark.createDataFrame([(f"c{i:04d}",) for i in range(1500)] + [(None,)], "c string")
    hot = models.category_vector(df, ["c"]).transform(df)
    assert hot.first()["c_vec"].size == 1500
    small = spark.createDataFrame([("b",), ("a",), ("c",), (None,)], "c string")
    cut = {r["c"]: list(r["c_cut"].toArray()) for r in models.category_vector(small, ["c"], drop_first=True).transform(small).collect()}
    assert cut["a"] == cut[None] == [0.0, 0.0] and sorted(map(tuple, (cut["b"], cut["c"]))) == [(0.0, 1.0), (1.0, 0.0)]


@pytest.mark.parametrize("parts", [1, 3, 16])
def test_customer_features_do_not_depend_on_partitions(spark, parts):
    import os
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("driver test data not present")
    import __spark_entry__ as E
    keep = spark.conf.get("spark.sql.shuffle.partitions")

    def digest(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            d = E.queries()["customer_features"](spark, sf).toPandas().sort_values("customer_unique_id")
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", keep)
        return d.to_csv(index=False)
    assert digest(parts) == digest(8)


def test_payments_keep_every_item(spark):
    import os
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("driver test data not present")
    from ledgerlens.sources.proxy import proxy_tables
    assert proxy_tables(spark, sf).payments.count() == spark.read.parquet(f"{sf}/lineitem.parquet").count()


def test_checkpoints_need_a_shared_folder_off_local_masters(monkeypatch):
    from ledgerlens import session

    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Fake:
        sparkContext = Context()
    monkeypatch.setattr(session, "checkpoint_dir", lambda s: None)
    with pytest.raises(ValueError):
        session.ensure_checkpoint_dir(Fake())


def test_split_counts_come_from_the_value_table(spark):
    base = dt.datetime(2020, 1, 1)
    rows = [(base + dt.timedelta(hours=i // 4),) for i in range(101)] + [(None,)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    split, n = ordering.chrono_split(df, "ts", 0.8)
    assert n == 101 and split == rows[int(101 * 0.8)][0]
    assert ordering.chrono_split(df.where(F.lit(False)), "ts") == (None, 0)


def test_t15_training_rows_get_the_folds_whole_train_rate(spark):
    """A training row's rate includes its own and later rows of the fold's training set, not only earlier ones."""
    from ledgerlens.operators.features import rate_encode
    train = spark.createDataFrame([(i, "s", i >= 4) for i in range(8)], "id int, seller string, late boolean")
    got = {r["seller_on_time_rate"] for r in rate_encode(train, train, "seller", "late", 5).collect()}
    assert got == {0.5}


def test_t16_feature_list_per_pipeline():
    from ledgerlens.plans import causal, delivery, models
    assert "is_new_or_thin_history_seller" in delivery.BASELINE_FEATURES and "is_new_or_thin_history_seller" not in models.wf_features()
    assert len(models.wf_features()) == 10 and [f for f in models.wf_features(True) if f not in models.wf_features()] == [
        "seller_avg_stage2_approval_to_carrier_hrs", "seller_avg_stage3_carrier_to_customer_hrs"]
    assert len(causal.CONFOUNDERS) == 6 and "seller_on_time_rate" in causal.CONFOUNDERS


def test_t22_one_fit_per_k_and_restart_gives_inertia_and_silhouette(spark, monkeypatch):
    from ledgerlens.operators import models as M
    calls, once = [], M._kmeans_once
    monkeypatch.setattr(M, "_kmeans_once", lambda df, k, s, *a, **b: (calls.append((k, s)), once(df, k, s, *a, **b))[1])
    vec = M.assemble(spark.createDataFrame([(float(i % 3) * 5, float(i % 5)) for i in range(60)], "a double, b double"), ["a", "b"])
    out = M.select_k(vec, [2, 3], seeds=[1, 2])
    assert sorted(calls) == [(2, 1), (2, 2), (3, 1), (3, 2)] and out.count() == 2
