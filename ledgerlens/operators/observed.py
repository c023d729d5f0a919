"""Reports taken while a table is written: one pass gives the table and all its counts.

``DataFrame.observe`` adds the counts to the job that writes the rows, as mergeable aggregates of its last stage. Each
report alone would scan the input, or run its joins, again.

A session that has observed a DataFrame cannot serialise the functions of Spark ML's transformers any more (they hold
their session, and with it what watches the observations), so the write runs in a session of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import scratch_path


def count_columns(nulls: Sequence[str] = (), numbers: Sequence[str] = (), rules: dict[str, Column] | None = None,
                  extra: dict[tuple[str, str], Column] | None = None) -> dict[tuple[str, str], Column]:
    """(report, item) -> count aggregate. A null predicate counts as no."""
    out = {("rows", ""): F.count(F.lit(1))}
    hits = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    for c in nulls:
        out["nulls", c] = F.count_if(F.col(f"`{c}`").isNull())
    for c in numbers:
        x = F.col(f"`{c}`").cast("double")
        out["inf", c], out["nan", c] = hits(F.abs(x) == F.lit(float("inf"))), hits(F.isnan(x))
    for name, rule in (rules or {}).items():
        out["violations", name] = hits(rule)
    for at, predicate in (extra or {}).items():
        out[at] = hits(predicate)
    return out


#: Settings of the caller's session that the writing session takes over.
SHARED_CONF = ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone", "spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")


def write_observed(spark: SparkSession, build: Callable[[SparkSession], DataFrame], name: str, path: str | None = None,
                   **reports) -> tuple[DataFrame, dict[tuple[str, str], int]]:
    """Writes the DataFrame that ``build`` makes as Parquet (to ``path``, else to shared scratch); returns the table and its
    counts by (report, item). ``build`` gets the writing session; ``reports``: as ``count_columns`` takes them.

    An empty table gives zero for every count.
    """
    path = path or scratch_path(spark, f"{name}/{uuid.uuid4().hex}")
    writer = spark.newSession()
    for key in SHARED_CONF:
        writer.conf.set(key, spark.conf.get(key))
    df = build(writer)
    counts = count_columns(**reports)
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    df.observe(seen, *[c.alias(f"m{i}") for i, c in enumerate(counts.values())]).write.parquet(path)
    found = {at: int(seen.get[f"m{i}"] or 0) for i, at in enumerate(counts)}
    spark.createDataFrame([], "n int")  # makes the caller's session the active one again
    return spark.read.schema(df.schema).parquet(path), found


def long_report(spark: SparkSession, counts: dict[tuple[str, str], int], name: str) -> DataFrame:
    """(report, item, n); the row count's item is ``name``."""
    return spark.createDataFrame([(r, i or name, n) for (r, i), n in counts.items()], "report string, item string, n long")


def null_profile_of(spark: SparkSession, counts: dict[tuple[str, str], int]) -> DataFrame:
    """V3 as ``quality.null_profile`` gives it."""
    rows = counts["rows", ""]
    return spark.createDataFrame([(c, n, n / rows if rows else None) for (r, c), n in counts.items() if r == "nulls"], "column_name string, nulls long, share double")


def inf_nan_of(spark: SparkSession, counts: dict[tuple[str, str], int]) -> DataFrame:
    """V5 as ``quality.inf_nan_guard`` gives it."""
    return spark.createDataFrame([(c, n, counts["nan", c]) for (r, c), n in counts.items() if r == "inf"], "column_name string, n_inf long, n_nan long")


def violations_of(spark: SparkSession, counts: dict[tuple[str, str], int]) -> DataFrame:
    """V7 as ``quality.rule_violations`` gives it."""
    return spark.createDataFrame([(c, n) for (r, c), n in counts.items() if r == "violations"], "rule string, violations long")
