"""Running state, publication in increments, Euclidean silhouette, fixed-size bootstrap."""
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import drift as DR
from ledgerlens.operators import history as HI
from ledgerlens.operators import models as M
from ledgerlens.operators.features import stats_at_cutoff
from ledgerlens.operators.silhouette import sampled_silhouette
from ledgerlens.sources import publish as PB

# ---- running state


def months(spark, n=600):
    rng = random.Random(4)
    rows = [(rng.choice([None, "a", "b", "c", "d"]) if i % 3 else "hot", f"2020-{1 + i * 6 // n:02d}", rng.random() < 0.3) for i in range(n)]
    return spark.createDataFrame(rows, "seller string, month string, late boolean")


def test_extended_state_equals_full_recomputation(spark, tmp_path):
    df = months(spark)
    state = HI.RunningState(spark, str(tmp_path / "s"), "seller", {"n_late": F.col("late").cast("long")})
    assert state.before("2020-03") is None
    state.extend("2020-02", df.where("month <= '2020-02'"))
    for m in ("2020-03", "2020-04"):
        state.extend(m, df.where(F.col("month") == m))
    cut = spark.createDataFrame([("2020-03",), ("2020-05",)], "cutoff string")
    full = stats_at_cutoff(df, "seller", "late", "month", cut, 5)
    for c in ("2020-03", "2020-05"):
        mine = HI.rates_of_state(state.before(c), "seller").collect()
        whole = {r["seller"]: r for r in full.where(F.col("cutoff") == c).collect()}
        assert len(mine) == len(whole) and None in whole and "hot" in whole
        for r in mine:
            for f in ("entity_orders", "has_sufficient_history", "entity_on_time_rate", "overall_on_time_rate"):
                assert r[f] == pytest.approx(whole[r["seller"]][f]), (c, r["seller"], f)


def test_state_months_come_in_order_and_the_last_may_be_replaced(spark, tmp_path):
    df = months(spark)
    state = HI.RunningState(spark, str(tmp_path / "s"), "seller", {"n_late": F.col("late").cast("long")}, where=F.col("late").isNotNull())
    state.extend("2020-01", df.where("month = '2020-01'"))
    state.extend("2020-02", df.where("month = '2020-02'").limit(3))
    state.extend("2020-02", df.where("month = '2020-02'"))
    assert state.at("2020-02").agg(F.sum("n")).first()[0] == df.where("month <= '2020-02'").count()
    with pytest.raises(ValueError):
        state.extend("2020-01", df)
    state.extend("2020-03", df.limit(0))
    assert state.months() == ["2020-01", "2020-02", "2020-03"]
    assert state.at("2020-03").agg(F.sum("n")).first()[0] == state.at("2020-02").agg(F.sum("n")).first()[0]


# ---- publication


def table(spark, rows):
    return spark.createDataFrame(rows, "id int, state string, v double")


ROWS = [(1, "SP", 1.0), (2, "SP", 2.0), (3, "RJ/x=1", 3.0), (4, None, 4.0), (5, "MG", None)]


def test_only_changed_partitions_are_written(spark, tmp_path):
    root = str(tmp_path / "p")
    read = lambda **k: sorted(((r["id"], r["state"], r["v"]) for r in PB.read_published(spark, root, "id int, state string, v double", **k).collect()), key=lambda r: r[0])
    assert read() == []
    assert PB.publish(table(spark, ROWS), root, "state") == ["MG", "RJ/x=1", "SP", None]
    assert read() == ROWS
    folders = {r["value"]: r["folder"] for r in PB.manifest(spark, root).collect()}
    assert PB.publish(table(spark, ROWS[::-1]).repartition(3), root, "state") == []
    later = [(1, "SP", 9.0), *ROWS[1:3], *ROWS[4:]]  # SP changes, the null partition goes
    assert PB.publish(table(spark, later), root, "state") == ["SP"]
    now = {r["value"]: r["folder"] for r in PB.manifest(spark, root).collect()}
    assert set(now) == {"SP", "RJ/x=1", "MG"} and [v for v in now if now[v] != folders[v]] == ["SP"]
    assert read() == later and read(version=0) == ROWS


def test_a_run_without_manifest_is_invisible(spark, tmp_path):
    root = str(tmp_path / "p")
    PB.publish(table(spark, ROWS), root, "state")
    table(spark, [(7, "SP", 7.0)]).write.parquet(f"{root}/data/run=half/_part=0")
    (tmp_path / "p" / "manifest" / "1").mkdir()  # begun, without its mark of success
    assert PB.read_published(spark, root).count() == len(ROWS)
    assert PB.publish(table(spark, []), root, "state") == [] and PB.manifest(spark, root).count() == 0


# ---- silhouette


def brute_silhouette(x, label):
    apart = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    out = []
    for i, c in enumerate(label):
        mine = label == c
        if mine.sum() == 1:
            out.append(0.0)
            continue
        a = apart[i, mine].sum() / (mine.sum() - 1)
        b = min(apart[i, label == o].mean() for o in set(label) - {c})
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return np.array(out)


def points(spark, n=600):
    rs = np.random.RandomState(7)
    label = rs.randint(0, 4, n)
    x = rs.randn(n, 3) + 2.0 * np.eye(4, 3)[label] * 2
    label[0] = 9  # alone
    rows = [(i, *map(float, p), int(c)) for i, (p, c) in enumerate(zip(x, label))]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, g int").repartition(3), x, label


def test_whole_silhouette_is_exact_and_a_sample_is_within_its_error(spark):
    df, x, label = points(spark)
    exact = brute_silhouette(x, label).mean()
    whole = sampled_silhouette(df, ["a", "b", "c"], "g", "id", 600).first()
    assert whole["silhouette"] == pytest.approx(exact) and whole["standard_error"] == 0 and whole["sampled"] == 600
    some = sampled_silhouette(df, ["a", "b", "c"], "g", "id", 120).first()
    assert some["sampled"] == 120 and 0 < some["standard_error"] < 0.1 and abs(some["silhouette"] - exact) < 2 * some["standard_error"]


def test_silhouette_of_odd_tables(spark):
    df, _, _ = points(spark, 40)
    one = sampled_silhouette(df.withColumn("g", F.lit(1)), ["a"], "g", "id").first()
    assert one["silhouette"] is None and one["n"] == 40
    assert sampled_silhouette(df.limit(0), ["a"], "g", "id").first()["n"] == 0
    same = sampled_silhouette(df.withColumn("a", F.lit(1.0)), ["a"], "g", "id").first()
    assert same["silhouette"] == 0
    holes = df.withColumn("a", F.when(F.col("id") > 5, F.col("a"))).withColumn("g", F.when(F.col("id") != 9, F.col("g")))
    assert sampled_silhouette(holes, ["a"], "g", "id").first()["n"] == 33


def test_select_k_gives_the_euclidean_silhouette(spark):
    df, x, _ = points(spark, 200)
    vec = M.assemble(df, ["a", "b", "c"])
    got = M.select_k(vec, [3], seeds=[1], key="id").first()
    model, _ = M.fit_kmeans(vec, 3, seeds=[1])
    label = {r["id"]: r["prediction"] for r in model.transform(vec).select("id", "prediction").collect()}
    assert got["silhouette"] == pytest.approx(brute_silhouette(x, np.array([label[i] for i in range(200)])).mean()) and got["standard_error"] == 0


# ---- fixed-size bootstrap


def test_fixed_bootstrap_sizes_and_spread(spark):
    rs = np.random.RandomState(3)
    x = rs.randn(3000)
    y = 0.5 * x + rs.randn(3000)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))] + [(5000, None, 1.0)]
    df = spark.createDataFrame(rows, "id int, x double, y double").repartition(5)
    for block in (1 << 17, 500):  # one block, and seven
        out = DR.fixed_bootstrap(df, "id", "x", "y", reps=30, block=block).collect()
        assert sorted(r["rep"] for r in out) == list(range(30)) and {r["size"] for r in out} == {round(0.7 * 3001)}
        r = np.array([o["r"] for o in out])
        full = np.corrcoef(x, y)[0, 1]
        expected = (1 - full ** 2) / np.sqrt(0.7 * 3000)
        assert abs(r.mean() - full) < 4 * expected / np.sqrt(30) + 2 * expected and 0.5 * expected < r.std() < 2 * expected


def test_fixed_bootstrap_draws_with_replacement_and_ignores_row_order(spark):
    df = spark.createDataFrame([(i, float(i), float(i % 7)) for i in range(400)], "id int, x double, y double")
    a, b = (sorted((r["rep"], round(r["r"], 9)) for r in DR.fixed_bootstrap(d, "id", "x", "y", reps=5).collect()) for d in (df.coalesce(1), df.orderBy(F.desc("y")).repartition(4)))
    assert a == b
    u = DR.draw_uniform(np.arange(20_000, dtype=np.int64), 3, 1, 42)
    hits = np.bincount((u * 100).astype(int), minlength=100)
    assert 120 < hits.min() and hits.max() < 290 and len(set((u * 20_000).astype(int))) < 20_000 * 0.66
    assert DR.fixed_bootstrap(df.limit(0), "id", "x", "y").count() == 0
    constant = DR.fixed_bootstrap(df.withColumn("x", F.lit(1.0)), "id", "x", "y", reps=2).collect()
    assert [r["r"] for r in constant] == [None, None]
