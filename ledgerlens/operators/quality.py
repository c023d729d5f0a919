"""Validation and integrity checks. Each returns a small result DataFrame.

All checks are single-pass aggregates or anti/semi joins; none collects data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: Sequence[str], name: str = "") -> DataFrame:
    """V1: rows, distinct key tuples (null is one key), duplicates = rows - distinct."""
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    return g.agg(F.lit(name).alias("table_name"), F.sum("c").cast("long").alias("rows"),
                 F.count(F.lit(1)).alias("distinct_keys"),
                 F.sum(F.col("c") - 1).cast("long").alias("duplicates"))


def orphan_keys(child: DataFrame, fk: str, parent: DataFrame, pk: str, relation: str) -> DataFrame:
    """Child rows whose foreign key has no parent row (left anti join)."""
    p = parent.select(F.col(pk).alias("_pk")).distinct()
    orphans = child.join(p, child[fk] == p["_pk"], "left_anti")
    return orphans.agg(F.lit(relation).alias("relation"), F.count(F.lit(1)).alias("orphans"))


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def null_profile(df: DataFrame, cols: Sequence[str] | None = None, name: str | None = None) -> DataFrame:
    """V3: null count and share per column, one pass, then unpivoted to long form."""
    cols = list(cols or df.columns)
    agg = df.agg(F.count(F.lit(1)).alias("_n"),
                 *[F.sum(F.col(f"`{c}`").isNull().cast("long")).alias(f"n__{i}") for i, c in enumerate(cols)])
    stack = ", ".join(f"'{c}', n__{i}" for i, c in enumerate(cols))
    out = agg.selectExpr("_n", f"stack({len(cols)}, {stack}) as (column_name, nulls)")
    out = out.select("column_name", F.coalesce("nulls", F.lit(0)).cast("long").alias("nulls"),
                     F.when(F.col("_n") > 0, F.coalesce("nulls", F.lit(0)) / F.col("_n")).alias("share"))
    if name is not None:
        out = out.select(F.lit(name).alias("table_name"), "*")
    return out


def inf_nan_guard(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """V5: count of +-inf and NaN per column, one pass."""
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c).cast("double")
        aggs += [F.count_if(F.abs(x) == F.lit(float("inf"))).alias(f"inf__{i}"),
                 F.count_if(F.isnan(x)).alias(f"nan__{i}")]
    agg = df.agg(*aggs)
    stack = ", ".join(f"'{c}', inf__{i}, nan__{i}" for i, c in enumerate(cols))
    return agg.selectExpr(f"stack({len(cols)}, {stack}) as (column_name, n_inf, n_nan)")


def rule_violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """V7: number of rows satisfying each named predicate (null predicate counts as no)."""
    names = list(rules)
    agg = df.agg(*[F.count_if(F.coalesce(rules[n], F.lit(False))).alias(f"r__{i}") for i, n in enumerate(names)])
    stack = ", ".join(f"'{n}', r__{i}" for i, n in enumerate(names))
    return agg.selectExpr(f"stack({len(names)}, {stack}) as (rule, violations)")


def key_coverage(df: DataFrame, key: str, lookup: DataFrame, lookup_key: str, name: str = "") -> DataFrame:
    """V8: share of rows in ``df`` whose key exists in ``lookup`` (a semi-join flag)."""
    keys = lookup.select(F.col(lookup_key).alias("_k")).distinct().withColumn("_hit", F.lit(1))
    j = df.select(key).join(keys, F.col(key) == F.col("_k"), "left")
    return j.agg(F.lit(name).alias("check_name"), F.count(F.lit(1)).alias("rows"),
                 F.count("_hit").alias("matched"),
                 F.avg(F.coalesce(F.col("_hit"), F.lit(0)).cast("double")).alias("coverage"))


def fanout(df: DataFrame, key: str, value: str | None = None, name: str = "") -> DataFrame:
    """V9: groups with > 1 distinct ``value`` (or > 1 row when value is None): count,
    total groups and percent."""
    per = df.groupBy(key).agg((F.countDistinct(value) if value else F.count(F.lit(1))).alias("k"))
    return per.agg(F.lit(name).alias("check_name"), F.count_if(F.col("k") > 1).alias("groups_over_one"),
                   F.count(F.lit(1)).alias("groups"),
                   (F.avg((F.col("k") > 1).cast("double")) * 100).alias("pct"))


def violator_sample(df: DataFrame, key: str, offending_keys: DataFrame, order: Sequence[str], n_keys: int = 5) -> DataFrame:
    """All rows of the first ``n_keys`` offending keys (by key order), sorted.

    The offending-key list is cut to ``n_keys`` with a TakeOrdered (a report limit),
    then applied as a semi join.
    """
    first = offending_keys.select(F.col(offending_keys.columns[0]).alias(key)).distinct().orderBy(key).limit(n_keys)
    return df.join(first, key, "left_semi").orderBy(*order)


def flag_agreement(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Share of rows (both non-null) where the two boolean expressions agree."""
    both = a.isNotNull() & b.isNotNull()
    return df.agg(F.count_if(both).alias("rows"),
                  F.avg(F.when(both, (a == b).cast("double"))).alias("agreement"))


def domain_overlap(left: DataFrame, right: DataFrame, col: str) -> DataFrame:
    """Distinct values only in right (e.g. test) / only in left (train)."""
    l = left.select(col).where(F.col(col).isNotNull()).distinct()
    r = right.select(col).where(F.col(col).isNotNull()).distinct()
    only_r = r.join(l, col, "left_anti").agg(F.count(F.lit(1)).alias("n")).withColumn("direction", F.lit("right_not_left"))
    only_l = l.join(r, col, "left_anti").agg(F.count(F.lit(1)).alias("n")).withColumn("direction", F.lit("left_not_right"))
    n_r = r.agg(F.count(F.lit(1)).alias("n")).withColumn("direction", F.lit("right_distinct"))
    return union_all([only_r, only_l, n_r]).select("direction", "n")


def impossible_sequence(df: DataFrame, stages: dict[str, Column]) -> DataFrame:
    """Per stage, rows with a negative duration; rows kept when every stage is >= 0
    (a null stage also fails, T19); rows before and after."""
    keep = F.lit(True)
    for c in stages.values():
        keep = keep & (c >= 0)
    aggs = [F.count(F.lit(1)).alias("rows_before"), F.count_if(F.coalesce(keep, F.lit(False))).alias("rows_after")]
    aggs += [F.count_if(c < 0).alias(f"negative_{n}") for n, c in stages.items()]
    return df.agg(*aggs).withColumn("rows_removed", F.col("rows_before") - F.col("rows_after"))


def missing_after_left_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of ``left`` with no partner in ``right`` (left anti join)."""
    return left.join(right.select(key).distinct(), key, "left_anti")
