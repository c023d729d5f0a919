"""M7, M8, A15, A16 as a running state: a new month extends last month's state instead of aggregating all history.

The state is a table of folders by month. A month's folder holds, for every entity seen so far, its sums over all rows up to
and including that month. Extending reads the folder before it and the new month's rows only; a cutoff's statistics
are one folder. Folders are written whole, so a failed extension leaves the months before it as they were.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import path_exists, remove_path


class RunningState:
    """Sums per ``entity`` by month. ``sums``: name -> column to add up (null adds nothing); ``n`` counts the rows."""

    def __init__(self, spark: SparkSession, path: str, entity: str, sums: dict[str, Column], where: Column | None = None):
        self.spark, self.path, self.entity, self.sums, self.where = spark, path.rstrip("/"), entity, sums, where

    def folder(self, month: str) -> str:
        return f"{self.path}/month={month}"

    def months(self) -> list[str]:
        """Finished months, in order."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath().getName().split("=", 1)[1] for s in fs.listStatus(p) if s.isDirectory()] if fs.exists(p) else []
        return sorted(m for m in found if path_exists(self.spark, f"{self.folder(m)}/_SUCCESS"))

    def summed(self, rows: DataFrame) -> DataFrame:
        rows = rows if self.where is None else rows.where(self.where)
        return rows.groupBy(self.entity).agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(s) for s, c in self.sums.items()])

    def at(self, month: str) -> DataFrame:
        """(entity, n, sums...) over all rows up to and including ``month``."""
        return self.spark.read.parquet(self.folder(month))

    def before(self, month: str) -> DataFrame | None:
        """The state that a cutoff at ``month`` may see: rows strictly before it."""
        known = [m for m in self.months() if m < month]
        return self.at(known[-1]) if known else None

    def extend(self, month: str, rows: DataFrame) -> None:
        """Adds ``rows``, all of ``month``. Months come in order; adding the last month again replaces it."""
        known = self.months()
        if known and month < known[-1]:
            raise ValueError(f"{month} lies before the last month {known[-1]}: rebuild from there")
        old, new = self.before(month), self.summed(rows)
        if old is not None:
            names: Sequence[str] = ["n", *self.sums]
            new = (old.select(F.col(self.entity).alias("_e"), *[F.col(c).alias(f"_{c}") for c in names])
                   .join(new, F.col("_e").eqNullSafe(F.col(self.entity)), "full")
                   .select(F.coalesce(F.col(self.entity), F.col("_e")).alias(self.entity),
                           *[(F.coalesce(F.col(f"_{c}"), F.lit(0)) + F.coalesce(F.col(c), F.lit(0))).alias(c) for c in names]))
        if path_exists(self.spark, self.folder(month)):
            remove_path(self.spark, self.folder(month))
        new.write.parquet(self.folder(month))


def rates_of_state(state: DataFrame, entity: str, late: str = "n_late", min_n: int = 5) -> DataFrame:
    """M7 from a state: (entity, entity_orders, entity_on_time_rate, has_sufficient_history, overall_on_time_rate)."""
    whole = state.agg(F.try_divide(F.sum(late).cast("double"), F.sum("n").cast("double")).alias("r")).first()["r"]
    overall = F.lit(None if whole is None else 1 - whole).cast("double")
    enough = F.col("n") >= min_n
    return state.select(entity, F.col("n").alias("entity_orders"), enough.alias("has_sufficient_history"), overall.alias("overall_on_time_rate"),
                        F.when(enough, 1 - F.col(late) / F.col("n")).otherwise(overall).alias("entity_on_time_rate"))
