"""Values at wanted ranks: equal to a full sort on skewed, tied, null and grouped data; only a narrow part is ordered."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import ordering as O
from ledgerlens.operators import selection as S


def skewed(spark, n, groups=1):
    """A third of the rows at one value, a heavy tail, ties."""
    df = spark.range(0, n, 1, 6)
    u = (F.pmod(F.xxhash64("id"), F.lit(1 << 30)) + 0.5) / (1 << 30)
    x = F.when(F.col("id") % 3 == 0, 7.0).when(F.col("id") % 3 == 1, F.round(F.exp(u * 40), 1)).otherwise(-1 / u)
    return df.select("id", F.when(F.col("id") % 11 != 5, x).alias("x"), F.when(F.col("id") % groups != 0, F.col("id") % groups).alias("g"))


PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def test_quantiles_of_a_large_skewed_column(spark):
    df = skewed(spark, 200_000)
    values = np.array([r["x"] for r in df.select("x").collect() if r["x"] is not None])
    got = {r["p"]: r["q"] for r in O.exact_quantiles(df, "x", PROBS).collect()}
    assert sorted(got) == PROBS
    for p, q in got.items():
        assert q == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_quantiles_by_group_with_null_group_and_one_hot_group(spark):
    df = skewed(spark, 240_000).withColumn("g", F.when(F.col("id") % 4 < 3, "hot").when(F.col("id") % 8 == 3, (F.col("id") % 5).cast("string")))
    rows = df.collect()
    got = {(r["g"], r["p"]): r["q"] for r in O.exact_quantiles(df, "x", [0.25, 0.9], by=["g"]).collect()}
    assert len(got) == 2 * len({r["g"] for r in rows})
    for (g, p), q in got.items():
        assert q == pytest.approx(np.quantile([r["x"] for r in rows if r["g"] == g and r["x"] is not None], p), rel=1e-12)


def test_only_a_narrow_part_is_ordered(spark, monkeypatch):
    seen = []
    whole = O.value_positions
    monkeypatch.setattr(O, "value_positions", lambda df, *a, **k: (seen.append(df.count()), whole(df, *a, **k))[1])
    df = spark.range(300_000).select((F.xxhash64("id") / 3.0).alias("x"))
    O.exact_quantiles(df, "x", [0.25, 0.5, 0.75]).collect()
    assert len(seen) == 1 and seen[0] < 300_000 * 3 * 8 / S.ACCURACY


def test_infinities_nan_nulls_and_empty(spark):
    df = spark.createDataFrame([(float("-inf"),), (None,), (1.0,), (2.0,), (float("nan"),), (float("inf"),)], "x double")
    got = {r["p"]: r["q"] for r in O.exact_quantiles(df, "x", [0.25, 0.5]).collect()}
    assert got == {0.25: 1.0, 0.5: 2.0}
    assert O.exact_quantiles(df.where("x is null"), "x", [0.5]).count() == 0
    assert O.exact_quantiles(df.limit(0), "x", [0.5], by=["x"]).count() == 0
    assert O.chrono_split(spark.createDataFrame([], "t timestamp_ntz"), "t") == (None, 0)


def test_split_of_many_ties(spark):
    df = spark.range(120_000).select(F.timestamp_micros(F.floor(F.col("id") / 50_000) * 1_000_000).cast("timestamp_ntz").alias("t"))
    at, n = O.chrono_split(df, "t", 0.8)
    assert n == 120_000 and at.second == 1
