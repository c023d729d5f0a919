"""Profiling: V4 V6 A10 A11 A12 A14 A17 A22 D9 C5."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.selection import kept
from ledgerlens.operators.ordering import exact_quantiles, null_safe_join


def value_counts(df: DataFrame, col: str, by: Sequence[str] = (), normalize: bool = True) -> DataFrame:
    """V4: frequency of each non-null value (optionally per group) and its share of the
    group's non-null rows. Output (by..., value, n, share)."""
    by = list(by)
    base = df.where(F.col(col).isNotNull())
    cnt = base.groupBy(*by, F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    if not normalize:
        return cnt
    if by:
        tot = cnt.groupBy(*by).agg(F.sum("n").alias("_t"))
        return cnt.join(tot, by, "inner").select(*by, "value", "n", (F.col("n") / F.col("_t")).alias("share"))
    total = cnt.agg(F.sum("n").alias("_t"))  # one row
    return cnt.join(F.broadcast(total)).select("value", "n", (F.col("n") / F.col("_t")).alias("share"))


def unpivot_columns(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (),
                    name: str = "column_name", value: str = "value") -> DataFrame:
    """Long form (by..., column_name, value) of numeric columns (cast to double)."""
    by = list(by)
    stack = ", ".join(f"'{c}', CAST(`{c}` AS DOUBLE)" for c in cols)
    return df.selectExpr(*[f"`{b}`" for b in by], f"stack({len(cols)}, {stack}) AS ({name}, {value})")


def describe(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """V6: count, mean, sample std, min, q25/q50/q75 (linear), max per column (and group).

    ``exact`` uses the distributed exact quantile (no values collected into one task);
    ``exact=False`` uses ``percentile_approx`` (one partial aggregate, fixed memory).
    """
    by = list(by)
    long = unpivot_columns(df, cols, by)
    if exact:
        long, _ = kept(long, "described")  # read by the statistics and by the rank selection: the input runs once
    keys = by + ["column_name"]
    stats = long.groupBy(*keys).agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        *([] if exact else [F.percentile_approx("value", [0.25, 0.5, 0.75], 10000).alias("_q")]))
    if not exact:
        return stats.select(*keys, "n", "mean", "std", "min", F.col("_q")[0].cast("double").alias("q25"),
                            F.col("_q")[1].cast("double").alias("q50"), F.col("_q")[2].cast("double").alias("q75"), "max")
    q = exact_quantiles(long, "value", [0.25, 0.5, 0.75], keys, narrow=True)
    qw = q.groupBy(*keys).agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(n)
                                for p, n in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))])
    return null_safe_join(stats, qw, keys).select(*keys, "n", "mean", "std", "min", "q25", "q50", "q75", "max")


def rate_by(df: DataFrame, dim: str | Sequence[str], flag: str, min_n: int = 0,
            n_name: str = "orders", rate_name: str = "late_rate") -> DataFrame:
    """Per dimension value, row count and mean of a boolean flag; null keys
    dropped (T3); optional minimum support (a HAVING)."""
    dims = [dim] if isinstance(dim, str) else list(dim)
    keep = F.lit(True)
    for d in dims:
        keep = keep & F.col(d).isNotNull()
    out = df.where(keep).groupBy(*dims).agg(F.count(flag).alias(n_name),
                                             F.avg(F.col(flag).cast("double")).alias(rate_name))
    return out.where(F.col(n_name) >= min_n) if min_n else out


def group_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Mean, sample std and count of ``value`` per ``group``."""
    return df.groupBy(group).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
                                 F.count(value).alias("n"))


def segment_profile(df: DataFrame, segment: str, cols: Sequence[str]) -> DataFrame:
    """Per segment: size, size share in percent and the mean of each column."""
    base = df.where(F.col(segment).isNotNull())
    sizes = base.groupBy(segment).agg(F.count(F.lit(1)).alias("size"), *[F.avg(c).alias(f"mean_{c}") for c in cols])
    total = sizes.agg(F.sum("size").alias("_t"))  # one row
    return sizes.join(F.broadcast(total)).withColumn("size_pct", F.col("size") * 100.0 / F.col("_t")).drop("_t")


def orders_per_entity(bridge: DataFrame, entity: str = "customer_unique_id", order: str = "order_id") -> DataFrame:
    """A10: distribution of distinct orders per entity: (orders_per_customer, customers, share)."""
    per = bridge.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.countDistinct(order).alias("k"))
    dist = per.groupBy(F.col("k").alias("orders_per_customer")).agg(F.count(F.lit(1)).alias("customers"))
    total = dist.agg(F.sum("customers").alias("_t"))  # one row
    return dist.join(F.broadcast(total)).withColumn("share", F.col("customers") / F.col("_t")).drop("_t")


def repeat_rate(bridge: DataFrame, entity: str = "customer_unique_id", order: str = "order_id") -> DataFrame:
    """A10: persons, repeat persons (> 1 distinct order) and the repeat rate."""
    per = bridge.where(F.col(entity).isNotNull()).groupBy(entity).agg(F.countDistinct(order).alias("k"))
    return per.agg(F.count(F.lit(1)).alias("customers"), F.count_if(F.col("k") > 1).alias("repeat_customers"),
                   F.avg((F.col("k") > 1).cast("double")).alias("repeat_rate"))


def window_range(df: DataFrame, window: str, ts: str) -> DataFrame:
    """Min / max timestamp and row count per window label."""
    return df.groupBy(window).agg(F.min(ts).alias("start"), F.max(ts).alias("end"), F.count(F.lit(1)).alias("n"))
