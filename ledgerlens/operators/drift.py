"""Association and drift diagnostics, all single-pass grouped aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.numeric import guarded_corr, pair_count


def normal_two_sided_p(z: Column) -> Column:
    """Two-sided normal tail 2*(1 - Phi(|z|)) via the Abramowitz-Stegun 7.1.26 erf
    polynomial (|error| < 1.5e-7). Fixed coefficients of that published formula:
    p = 0.3275911, a1..a5 = 0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429.
    """
    x = F.abs(z) / F.lit(math.sqrt(2.0))
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erfc = poly * F.exp(-x * x)
    return erfc  # 2 * (1 - Phi(|z|)) == erfc(|z| / sqrt 2)


def corr_table(df: DataFrame, label: str, features: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Per feature (and group) Pearson r with ``label`` over non-null pairs,
    n, t = r*sqrt((n-2)/(1-r^2)) and a two-sided normal-tail p. r is null for a constant
    column (T12) instead of an error."""
    by = list(by)
    y = F.col(label).cast("double")
    aggs = []
    for i, f in enumerate(features):
        aggs += [guarded_corr(F.col(f), y).alias(f"r__{i}"), pair_count(F.col(f), y).alias(f"n__{i}")]
    wide = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    stack = ", ".join(f"'{f}', r__{i}, n__{i}" for i, f in enumerate(features))
    long = wide.selectExpr(*[f"`{b}`" for b in by], f"stack({len(features)}, {stack}) AS (feature, r, n)")
    t = F.col("r") * F.sqrt(F.try_divide((F.col("n") - 2).cast("double"), 1 - F.col("r") * F.col("r")))
    return long.withColumn("t", t).withColumn("p", normal_two_sided_p(F.col("t")))


def window_compare(corr: DataFrame, window: str, a: str, b: str) -> DataFrame:
    """Correlations of two windows side by side with a sign-flip flag."""
    w = corr.groupBy("feature").pivot(window, [a, b]).agg(F.first("r"))
    return w.select("feature", F.col(a).alias(f"r_{a}"), F.col(b).alias(f"r_{b}"),
                    (F.signum(F.col(a)) * F.signum(F.col(b)) < 0).alias("sign_flip"))


def poisson_cdf(lam: float) -> list[float]:
    """Cumulative P(K <= k) for k = 0, 1, ... until the rest of the mass is below a double's
    grain (2^-53): no draw is cut off, whatever the mean (below 700, where exp underflows)."""
    out, p, c, k = [], math.exp(-lam), 0.0, 0
    while k <= lam or p > 2.0 ** -53:
        c += p
        out.append(c)
        k += 1
        p = p * lam / k
    return out


# Fixed values of the replicate hash (must stay as written for oracle parity): the key's MD5
# gives two 28-bit numbers, so keys of any type work and 2^56 keys are told apart; then integer
# arithmetic mod the prime 2^31 - 1 with the MINSTD multipliers 48271 and 16807, offsets
# 1000003 (seed) and 7919 (replicate); every intermediate product stays below 2^62, so the
# same values come out of any engine with 64-bit integers.
HASH_MOD = 2147483647
HASH_SEED_MUL, HASH_REP_MUL = 1000003, 7919
HASH_STEPS = (("mul", 48271), ("square", 12345), ("mul", 16807), ("square", 54321), ("mul", 48271))


def replicate_uniform(key: str, rep: int, seed: int) -> Column:
    """u in [0, 1) from (key, rep, seed): an offset, then multiply / square-add rounds mod p;
    the key's second number enters between the rounds."""
    m = HASH_MOD
    digest = F.md5(F.col(key).cast("string").cast("binary"))
    part = lambda at: F.conv(F.substring(digest, at, 7), 16, 10).cast("long")
    x = part(1) + F.lit((seed * HASH_SEED_MUL + rep * HASH_REP_MUL) % m)
    for i, (kind, c) in enumerate(HASH_STEPS):
        x = (x * x + F.lit(c)) % m if kind == "square" else (x * F.lit(c)) % m
        x = x + part(8) if i == 1 else x
    return x.cast("double") / F.lit(float(m))


def replicate_uniform_sql(key: str, rep: str, seed: int) -> str:
    """The same hash as a SQL expression (``rep`` is a SQL integer expression)."""
    m = HASH_MOD
    part = lambda at: f"CAST('0x' || substr(md5(CAST({key} AS VARCHAR)), {at}, 7) AS BIGINT)"
    x = f"({part(1)} + ({seed * HASH_SEED_MUL % m} + ({rep}) * {HASH_REP_MUL}) % {m})"
    for i, (kind, c) in enumerate(HASH_STEPS):
        x = f"(({x} * {x} + {c}) % {m})" if kind == "square" else f"(({x} * {c}) % {m})"
        x = f"({x} + {part(8)})" if i == 1 else x
    return f"(CAST({x} AS DOUBLE) / CAST({m} AS DOUBLE))"


def bootstrap_weights(u: Column, frac: float) -> Column:
    """Resampling multiplicity of a row in one replicate: Poisson(frac) drawn by inverse
    CDF from the replicate uniform ``u`` - the standard Poisson bootstrap for sampling with
    replacement, reproducible and without shuffles or a driver loop."""
    return sum((u >= F.lit(c)).cast("int") for c in poisson_cdf(frac))


def bootstrap_weights_sql(u: str, frac: float) -> str:
    """Poisson(frac) inverse CDF of a SQL uniform column ``u``."""
    return "(" + " + ".join(f"CAST({u} >= CAST('{c!r}' AS DOUBLE) AS INTEGER)" for c in poisson_cdf(frac)) + ")"


def bootstrap_corr(df: DataFrame, key: str, x: str, y: str, reps: int = 20, frac: float = 0.7,
                   seed: int = 42) -> DataFrame:
    """Correlation of (x, y) on ``reps`` Poisson-bootstrap replicates in ONE pass
    (weighted sums per replicate), -> (rep, r)."""
    xs, ys = F.col(x).cast("double"), F.col(y).cast("double")
    both = xs.isNotNull() & ys.isNotNull()
    # hash -> uniform -> weight once per (row, replicate) in a narrow projection; the
    # aggregate then only reads plain columns
    u = df.select(xs.alias("_x"), ys.alias("_y"), both.alias("_ok"),
                  *[replicate_uniform(key, r, seed).alias(f"_u{r}") for r in range(reps)])
    wts = u.select("_x", "_y", *[F.when(F.col("_ok"), bootstrap_weights(F.col(f"_u{r}"), frac))
                                 .otherwise(0).cast("double").alias(f"_w{r}") for r in range(reps)])
    xs, ys = F.col("_x"), F.col("_y")
    aggs = []
    for r in range(reps):
        w = F.col(f"_w{r}")
        aggs += [F.sum(w).alias(f"w{r}"), F.sum(w * xs).alias(f"x{r}"), F.sum(w * ys).alias(f"y{r}"),
                 F.sum(w * xs * xs).alias(f"xx{r}"), F.sum(w * ys * ys).alias(f"yy{r}"),
                 F.sum(w * xs * ys).alias(f"xy{r}")]
    wide = wts.agg(*aggs)
    stack = ", ".join(f"{r}, w{r}, x{r}, y{r}, xx{r}, yy{r}, xy{r}" for r in range(reps))
    long = wide.selectExpr(f"stack({reps}, {stack}) AS (rep, w, sx, sy, sxx, syy, sxy)")
    cov = F.col("sxy") / F.col("w") - (F.col("sx") / F.col("w")) * (F.col("sy") / F.col("w"))
    vx = F.col("sxx") / F.col("w") - F.pow(F.col("sx") / F.col("w"), 2)
    vy = F.col("syy") / F.col("w") - F.pow(F.col("sy") / F.col("w"), 2)
    # a constant replicate (or rounding below zero) gives a null r, not an error
    return long.select("rep", F.when(vx * vy > 0, cov / F.sqrt(vx * vy)).alias("r"))


# Fixed values of the draw hash (must stay as written for oracle parity): multipliers of the draw, replicate and block
# numbers, then the same kinds of rounds as above.
DRAW_MULS = (48271, 69621, 16807)
DRAW_STEPS = (("square", 12345), ("mul", 48271), ("square", 54321), ("mul", 16807), ("square", 7919), ("mul", 48271))
RESAMPLE_BLOCK = 1 << 17  # rows that one task resamples at once


def draw_uniform(draw, rep, block, seed: int):
    """u in [0, 1) from whole numbers; for columns and numpy arrays alike (every product stays below 2^62)."""
    x = (draw % HASH_MOD * DRAW_MULS[0] + rep * DRAW_MULS[1] + block * DRAW_MULS[2] + seed * HASH_SEED_MUL % HASH_MOD) % HASH_MOD
    for kind, c in DRAW_STEPS:
        x = (x * x + c) % HASH_MOD if kind == "square" else (x * c) % HASH_MOD
    return x / float(HASH_MOD)


def draw_uniform_sql(draw: str, rep: str, block: str, seed: int) -> str:
    """The same in SQL."""
    x = f"(({draw}) % {HASH_MOD} * {DRAW_MULS[0]} + ({rep}) * {DRAW_MULS[1]} + ({block}) * {DRAW_MULS[2]} + {seed * HASH_SEED_MUL % HASH_MOD}) % {HASH_MOD}"
    for kind, c in DRAW_STEPS:
        x = f"((({x}) * {c}) % {HASH_MOD})" if kind == "mul" else f"(list_transform([{x}], lambda z: (z * z + {c}) % {HASH_MOD})[1])"
    return f"(CAST({x} AS DOUBLE) / {float(HASH_MOD)})"


def fixed_bootstrap(df: DataFrame, key: str, x: str, y: str, reps: int = 20, frac: float = 0.7, seed: int = 42,
                    block: int = RESAMPLE_BLOCK) -> DataFrame:
    """D4 as drawn by a sample with replacement: each replicate has exactly round(frac * rows) draws -> (rep, size, r).

    Rows take their place in the order of their key's hash, in blocks of ``block`` places. A draw falls on a place
    uniformly, hence on a block; draws are only counted per (replicate, block), combined before the shuffle. Each
    block then draws its counts among its own rows and returns sums per replicate, so no draw meets a row in a join.
    Rows with a null value are drawn and count in ``size``, not in ``r``; a constant replicate has a null ``r``.
    """
    from ledgerlens.operators.ordering import row_index
    from ledgerlens.session import ship_package
    spark = df.sparkSession
    narrow = df.select(F.md5(F.col(key).cast("string").cast("binary")).alias("_h"), F.col(key).alias("_k"),
                       F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    n = narrow.count()
    if not n:
        return spark.createDataFrame([], "rep int, size long, r double")
    rows = row_index(narrow, ["_h", "_k", "_x", "_y"], name="_at").select(F.floor(F.col("_at") / block).cast("long").alias("block"),
                                                                       (F.col("_at") % block).alias("_at"), "_x", "_y")
    draws = int(n * frac + 0.5)
    place = lambda r: F.floor(draw_uniform(F.col("id"), r.cast("long"), F.lit(0).cast("long"), seed) * n)
    counts = (spark.range(draws).select("id", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))).alias("rep"))
              .groupBy("rep", F.floor(place(F.col("rep")) / block).cast("long").alias("block")).agg(F.count(F.lit(1)).alias("draws")))

    def run(mine: pa.Table, asked: pa.Table) -> pa.Table:
        out = {c: [] for c in ("rep", "size", "w", "sx", "sy", "sxx", "syy", "sxy")}
        order = np.argsort(np.asarray(mine.column("_at")))
        xs, ys = (np.asarray(mine.column(c).combine_chunks().cast(pa.float64()).fill_null(float("nan")))[order] for c in ("_x", "_y"))
        good = ~np.isnan(xs) & ~np.isnan(ys)
        xs, ys = np.where(good, xs, 0.0), np.where(good, ys, 0.0)
        for rep, many, number in zip(asked.column("rep").to_pylist(), asked.column("draws").to_pylist(), asked.column("block").to_pylist()):
            at = (draw_uniform(np.arange(many, dtype=np.int64), rep, number + 1, seed) * len(xs)).astype(np.int64)
            w = np.bincount(at, minlength=len(xs)) * good
            for c, v in zip(out, (rep, many, w.sum(), (w * xs).sum(), (w * ys).sum(), (w * xs * xs).sum(), (w * ys * ys).sum(), (w * xs * ys).sum())):
                out[c].append(v)
        return pa.table({"rep": pa.array(out["rep"], pa.int32()), "size": pa.array(out["size"], pa.int64()),
                         **{c: pa.array([float(v) for v in out[c]], pa.float64()) for c in ("w", "sx", "sy", "sxx", "syy", "sxy")}})

    ship_package(spark)
    parts = rows.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(
        run, "rep int, size long, w double, sx double, sy double, sxx double, syy double, sxy double")
    s = parts.groupBy("rep").agg(*[F.sum(c).alias(c) for c in ("size", "w", "sx", "sy", "sxx", "syy", "sxy")])
    mean = lambda c: F.try_divide(F.col(c), F.col("w"))
    vx, vy = mean("sxx") - mean("sx") * mean("sx"), mean("syy") - mean("sy") * mean("sy")
    return s.select("rep", "size", F.when(vx * vy > 0, (mean("sxy") - mean("sx") * mean("sy")) / F.sqrt(vx * vy)).alias("r"))


def bootstrap_summary(reps: DataFrame) -> DataFrame:
    """D4 summary: mean, population std (ddof 0, T11), min, max of the replicate r."""
    return reps.agg(F.avg("r").alias("mean_r"), F.stddev_pop("r").alias("std_r"),
                    F.min("r").alias("min_r"), F.max("r").alias("max_r"), F.count("r").alias("reps"))


def top_shares(df: DataFrame, col: str, by: str, k: int = 10) -> DataFrame:
    """Share of each value within each ``by`` group, top ``k`` per group (report)."""
    from pyspark.sql import Window
    cnt = df.where(F.col(col).isNotNull() & F.col(by).isNotNull()).groupBy(by, col).agg(F.count(F.lit(1)).alias("n"))
    w_tot = Window.partitionBy(by)
    ranked = cnt.withColumn("share", F.col("n") / F.sum("n").over(w_tot)) \
        .withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.col("n").desc(), F.col(col))))
    return ranked.where(F.col("rank") <= k)
