"""Outcome attachment, naive and matched effects, balance, caliper, overlap."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.numeric import pct_diff
from ledgerlens.operators.matching import nearest_join


def attach_outcome(df: DataFrame, outcomes: DataFrame, key: str, value: str, name: str | None = None):
    """Mean outcome per key (several reviews per order possible) left-joined; returns
    (rows with an outcome, one-row report of matched / missing)."""
    name = name or value
    o = outcomes.groupBy(key).agg(F.avg(value).alias(name))
    j = df.join(o, key, "left")
    rep = j.agg(F.count(F.lit(1)).alias("rows"), F.count(name).alias("with_outcome")) \
        .withColumn("missing", F.col("rows") - F.col("with_outcome"))
    return j.where(F.col(name).isNotNull()), rep


def naive_effect(df: DataFrame, treat: str, outcome: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean outcome of treated minus untreated, with group sizes and std."""
    t = F.col(treat).cast("boolean")
    y = F.col(outcome).cast("double")
    return df.groupBy(*by).agg(
        F.avg(F.when(t, y)).alias("mean_treated"), F.avg(F.when(~t, y)).alias("mean_control"),
        F.stddev_samp(F.when(t, y)).alias("std_treated"), F.stddev_samp(F.when(~t, y)).alias("std_control"),
        F.count(F.when(t, y)).alias("n_treated"), F.count(F.when(~t, y)).alias("n_control"),
    ).withColumn("naive_effect", F.col("mean_treated") - F.col("mean_control"))


def common_support(df: DataFrame, treat: str, score: str) -> DataFrame:
    """Share of treated rows whose score lies within the control [min, max]."""
    t = F.col(treat).cast("boolean")
    row = df.where(~t).agg(F.min(score).alias("lo"), F.max(score).alias("hi")).first()
    inside = F.col(score).between(F.lit(row["lo"]), F.lit(row["hi"]))
    return df.where(t).agg(F.count(F.lit(1)).alias("n_treated"), F.count_if(inside).alias("in_support"),
                           (F.avg(F.coalesce(inside, F.lit(False)).cast("double")) * 100).alias("pct_in_support")) \
        .select(F.lit(row["lo"]).cast("double").alias("control_min"), F.lit(row["hi"]).cast("double").alias("control_max"), "*")


def overlap_histogram(df: DataFrame, treat: str, score: str, bins: int = 50) -> DataFrame:
    """Density histogram per group, numpy layout: ``bins`` equal bins between the
    group's own min and max (last bin closed), density = count / (n * width)."""
    g = F.col(treat).cast("boolean").alias("treated")
    base = df.select(g, F.col(score).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    rng = base.groupBy("treated").agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count(F.lit(1)).alias("n"))
    j = base.join(F.broadcast(rng), "treated")  # two rows: one per group
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") > F.col("lo"),
               F.least(F.floor((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins).cast("int"), F.lit(bins - 1))
               ).otherwise(F.lit(0))
    h = j.groupBy("treated", b.alias("bin"), "lo", "hi", "n").agg(F.count(F.lit(1)).alias("count"))
    w = (F.col("hi") - F.col("lo")) / bins
    return h.select("treated", "bin", (F.col("lo") + F.col("bin") * w).alias("bin_start"), "count",
                    F.try_divide(F.col("count").cast("double"), F.col("n") * F.when(w > 0, w)).alias("density"))


def match_pairs(df: DataFrame, id_col: str, treat: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """1-NN pairs (with replacement) of treated to control rows on ``score``."""
    t = F.col(treat).cast("boolean")
    return nearest_join(df.where(t), df.where(~t), id_col, score, by)


def pair_values(pairs: DataFrame, df: DataFrame, id_col: str, cols: Sequence[str]) -> DataFrame:
    """Attach ``cols`` of the treated row (``t_``) and of the matched control (``c_``).

    Many treated rows share one control (the lowest id of a score): the values of the distinct
    controls are looked up once and are the small side of the second join.
    """
    tv = df.select(F.col(id_col).alias("treated_id"), *[F.col(c).alias(f"t_{c}") for c in cols])
    used = pairs.select("control_id").where(F.col("control_id").isNotNull()).distinct()
    cv = df.select(F.col(id_col).alias("control_id"), *[F.col(c).alias(f"c_{c}") for c in cols]).join(used, "control_id")
    return pairs.join(tv, "treated_id", "left").join(cv, "control_id", "left")


def matched_effect(pv: DataFrame, outcome: str, by: Sequence[str] = ()) -> DataFrame:
    """Pairs, mean / max distance and mean(y_treated) - mean(y_control)."""
    ok = F.col("control_id").isNotNull()
    return pv.groupBy(*by).agg(
        F.count_if(ok).alias("pairs"), F.avg("distance").alias("mean_distance"), F.max("distance").alias("max_distance"),
        F.avg(F.when(ok, F.col(f"t_{outcome}"))).alias("mean_treated"),
        F.avg(F.when(ok, F.col(f"c_{outcome}"))).alias("mean_matched_control"),
    ).withColumn("matched_effect", F.col("mean_treated") - F.col("mean_matched_control"))


def covariate_balance(pv: DataFrame, covariates: Sequence[str]) -> DataFrame:
    """C11: per covariate, mean over treated and over matched controls and the % difference
    relative to the (signed) treated mean, 0 when that mean is 0 (T21)."""
    ok = F.col("control_id").isNotNull()
    aggs = []
    for i, c in enumerate(covariates):
        aggs += [F.avg(F.when(ok, F.col(f"t_{c}"))).alias(f"t{i}"), F.avg(F.when(ok, F.col(f"c_{c}"))).alias(f"c{i}")]
    wide = pv.agg(*aggs)
    stack = ", ".join(f"'{c}', t{i}, c{i}" for i, c in enumerate(covariates))
    long = wide.selectExpr(f"stack({len(covariates)}, {stack}) AS (covariate, mean_treated, mean_control)")
    return long.withColumn("pct_diff", pct_diff("mean_treated", "mean_control"))


def caliper_effect(pv: DataFrame, df: DataFrame, score: str, outcome: str, k: float = 0.2) -> DataFrame:
    """caliper = k * sample std of the score over all rows; pairs within it, their
    share and the effect on them."""
    sd = df.agg(F.stddev_samp(score).alias("sd")).first()["sd"]
    cal = None if sd is None else k * sd
    ok = F.col("control_id").isNotNull()
    inside = ok & (F.col("distance") <= F.lit(cal))
    return pv.agg(F.lit(cal).cast("double").alias("caliper"), F.count_if(inside).alias("kept"),
                  F.count_if(ok).alias("pairs"),
                  (F.count_if(inside) * 100.0 / F.count_if(ok)).alias("pct_kept"),
                  (F.avg(F.when(inside, F.col(f"t_{outcome}"))) - F.avg(F.when(inside, F.col(f"c_{outcome}")))).alias("caliper_effect"))
