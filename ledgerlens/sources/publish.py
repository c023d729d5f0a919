"""S4, P1-P4 published in increments: only changed partitions are written, and readers see whole versions.

A publication is a folder of data runs and of numbered manifests. A run writes the partitions whose row count or checksum
changed into a folder of its own; the manifest, written last, names for each partition the folder that holds it, its
rows and its checksum. Readers follow the newest finished manifest, so a run that is under way, or failed, is
invisible, and older versions stay readable.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import path_exists

MANIFEST = "value string, folder string, rows long, checksum string"


def _versions(spark: SparkSession, root: str) -> list[int]:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(n) for n in names if n.isdigit() and path_exists(spark, f"{root}/manifest/{n}/_SUCCESS"))


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """(value, folder, rows, checksum) of the newest finished version, or of ``version``."""
    known = _versions(spark, root)
    if not known:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest/{known[-1] if version is None else version}")


def checksums(df: DataFrame, by: str) -> DataFrame:
    """(value, rows, checksum) per partition; the checksum does not depend on the order of rows."""
    fields = F.xxhash64(F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x1e")) for c in df.columns]))
    return df.groupBy(F.col(by).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("rows"), F.sum(fields.cast("decimal(38,0)")).cast("string").alias("checksum"))


def publish(df: DataFrame, root: str, by: str) -> list:
    """Publishes ``df`` by the values of ``by`` (months, states: a bounded list); returns the values written anew.

    A value that no longer occurs leaves the manifest. Without any change no version is added. A null value is a partition.
    """
    spark = df.sparkSession
    root = root.rstrip("/")
    now = {r["value"]: (r["rows"], r["checksum"]) for r in checksums(df, by).collect()}
    old = {r["value"]: r for r in manifest(spark, root).collect()}
    changed = sorted((v for v, told in now.items() if v not in old or (old[v]["rows"], old[v]["checksum"]) != told), key=lambda v: (v is None, v))
    if not changed and set(old) == set(now) and _versions(spark, root):
        return []
    number = {v: i for i, v in enumerate(changed)}
    run = f"data/run={uuid.uuid4().hex}"
    if changed:
        text = F.col(by).cast("string")
        named = F.create_map(*[F.lit(x) for v, i in number.items() if v is not None for x in (v, i)]) if any(v is not None for v in number) else None
        part = named[text] if named is not None else F.lit(None).cast("int")
        if None in number:
            part = F.when(text.isNull(), F.lit(number[None])).otherwise(part)
        df.withColumn("_part", part).where("_part is not null").write.partitionBy("_part").parquet(f"{root}/{run}")
    rows = [(v, f"{run}/_part={number[v]}" if v in number else old[v]["folder"], *now[v]) for v in now]
    version = max(_versions(spark, root), default=-1) + 1
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{root}/manifest/{version}")
    return changed


def read_published(spark: SparkSession, root: str, schema=None, version: int | None = None) -> DataFrame:
    """The table that the newest finished manifest (or ``version``) names. ``schema``: for a publication without rows."""
    folders = [f"{root.rstrip('/')}/{r['folder']}" for r in manifest(spark, root.rstrip("/"), version).collect()]
    if not folders:
        return spark.createDataFrame([], schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.option("recursiveFileLookup", "true").parquet(*folders)
