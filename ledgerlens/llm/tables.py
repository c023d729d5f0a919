"""Reading the corpus tables, keeping intermediate tables in the cluster's shared folder, and running
Python functions on the executors."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.session import scratch_path, ship_package


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, paths: list[str] | None = None, options: dict | None = None) -> DataFrame:
    """``df`` written once to the shared scratch folder and read back: later steps restart from
    the files, not from the plan, so losing executors costs only unfinished tasks. ``paths``
    collects where, for a caller that removes the files when they have served; ``options`` go to the writer."""
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    if paths is not None:
        paths.append(path)
    df.write.mode("overwrite").options(compression="zstd", **(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Inside, a query's shuffle files go from the disk as it ends, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written_by_key(df: DataFrame, name: str, key: str) -> DataFrame:
    """Like ``written``, in buckets of ``key`` (an external table in the shared scratch folder): later
    joins on ``key`` shuffle only their other side. ``df`` should already be partitioned by ``key``."""
    spark = df.sparkSession
    table = f"ledgerlens_{name}_{uuid.uuid4().hex}"
    (df.write.bucketBy(shuffle_partitions(spark), key).option("compression", "zstd")
     .option("path", scratch_path(spark, table)).saveAsTable(table))
    return spark.table(table)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_map(df: DataFrame, fn, schema) -> DataFrame:
    """``mapInArrow`` with this package importable on the executors."""
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def id_type(df: DataFrame, column: str = "doc_id") -> str:
    return df.schema[column].dataType.simpleString()
