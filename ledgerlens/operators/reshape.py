"""One-hot encoding and row-normalised crosstabs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_values(df: DataFrame, col: str) -> list:
    """Sorted distinct non-null values of a column whose values become columns.

    The distinct set is computed on the executors (partial aggregation). What travels is as
    large as the result's schema; models use ``models.category_vector`` instead, which keeps
    a category of any size in one sparse column.
    """
    return sorted(r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().collect())


def dummy_name(prefix: str, value) -> str:
    return f"{prefix}_{value}"


def one_hot(df: DataFrame, col: str, prefix: str, values: Sequence | None = None,
            drop_first: bool = False) -> DataFrame:
    """0/1 integer column per category value (sorted); a null value is all zeros.

    ``drop_first`` drops the alphabetically first value (pandas ``drop_first``).
    """
    vals = sorted(values) if values is not None else distinct_values(df, col)
    if drop_first:
        vals = vals[1:]
    return df.select("*", *[F.when(F.col(col) == F.lit(v), 1).otherwise(0).cast("int").alias(dummy_name(prefix, v))
                            for v in vals])


def crosstab_pct(df: DataFrame, row: str, col: str) -> DataFrame:
    """R3 (long form): per (row, col) count and share of the row total in percent.

    Null keys on either side are dropped, as pandas groupby/crosstab do (T3).
    """
    base = df.where(F.col(row).isNotNull() & F.col(col).isNotNull())
    cnt = base.groupBy(row, col).agg(F.count(F.lit(1)).alias("n"))
    tot = cnt.groupBy(row).agg(F.sum("n").alias("_row_total"))
    return (cnt.join(tot, row, "inner")
            .select(row, col, "n", (F.col("n") * 100.0 / F.col("_row_total")).alias("pct")))


def pct_column_name(value: str, prefix: str = "pct") -> str:
    """Label -> column name with blanks replaced ("Satisfied Core" -> pct_Satisfied_Core)."""
    return f"{prefix}_" + re.sub(" ", "_", str(value))


def crosstab_pct_wide(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    """Size -> unstack(fill 0) -> row percent, one ``pct_<value>`` column per value.

    ``values`` is the explicit (bounded) column domain, so the pivot needs no extra job.
    """
    long = crosstab_pct(df, row, col)
    wide = long.groupBy(row).pivot(col, list(values)).agg(F.first("pct"))
    return wide.select(row, *[F.coalesce(F.col(f"`{v}`"), F.lit(0.0)).alias(pct_column_name(v)) for v in values])
