"""S1 / S3 with quarantine: rows that do not read as the declared types are set aside with a reason, never nulled in silence.

Each CSV table is read once with its declared schema and a column for the raw text of rows Spark could not parse, and
written as Parquet in two folders: good rows, and bad ones with their raw text and the reason. The reason is
found by reading the raw text again as strings and trying each declared type.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.sources.tables import COMMERCE_SCHEMAS, MULTILINE_TABLES

RAW = "_corrupt"
OTHER = "wrong number of fields"


@dataclass
class Loaded:
    good: dict[str, DataFrame]   # by table, declared schema
    bad: dict[str, DataFrame]    # by table: raw, reason

    def counts(self) -> DataFrame:
        """(table_name, reason, n); good rows have the reason ``good``."""
        parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), F.lit("good").alias("reason"), "n") for t, df in self.good.items()]
        parts += [df.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "reason", "n") for t, df in self.bad.items()]
        return reduce(DataFrame.unionByName, parts)


def reads_as(text: Column, kind: T.DataType, timestamp_format: str) -> Column:
    """Whether a field's text reads as its declared type; an absent field does."""
    if isinstance(kind, T.StringType):
        return F.lit(True)
    value = F.try_to_timestamp(text, F.lit(timestamp_format)) if isinstance(kind, T.TimestampNTZType) else text.try_cast(kind)
    return text.isNull() | value.isNotNull()


def reason_of(raw: Column, schema: T.StructType, timestamp_format: str) -> Column:
    """The first column whose text does not read as its type, else a wrong number of fields."""
    texts = F.from_csv(raw, ", ".join(f"`{f.name}` string" for f in schema), {"escape": '"', "multiLine": "true"})
    wrong = F.lit(None).cast("string")
    for f in reversed(schema.fields):
        said = F.lit(f"{f.name}: not a {f.dataType.simpleString()}")
        wrong = F.when(~reads_as(texts[f.name], f.dataType, timestamp_format), said).otherwise(wrong)
    return F.coalesce(wrong, F.lit(OTHER))


def load_quarantined(spark: SparkSession, paths: dict[str, str], out: str, timestamp_format: str = "yyyy-MM-dd HH:mm:ss",
                     schemas: dict[str, T.StructType] | None = None) -> Loaded:
    """Loads the CSV files of ``paths`` (by table) into ``out``: ``out/<table>/bad=false`` and ``bad=true``.

    A row is bad if a field does not read as its type or if it has too few or too many fields. A blank line is
    no row; a table without rows has neither good nor bad ones.
    """
    schemas = schemas or COMMERCE_SCHEMAS
    good, bad = {}, {}
    for name, path in paths.items():
        schema = schemas[name]
        rows = (spark.read.schema(T.StructType([*schema.fields, T.StructField(RAW, T.StringType())]))
                .option("header", True).option("multiLine", name in MULTILINE_TABLES).option("escape", '"')
                .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", RAW).option("timestampNTZFormat", timestamp_format)
                .csv(path))
        # every column is written, so none is pruned from the parser and every field of a row is judged
        rows.withColumn("bad", F.col(RAW).isNotNull()).write.mode("overwrite").partitionBy("bad").parquet(f"{out}/{name}")
        table = spark.read.schema(T.StructType([*schema.fields, T.StructField(RAW, T.StringType()), T.StructField("bad", T.BooleanType())])).parquet(f"{out}/{name}")
        good[name] = table.where(~F.col("bad")).drop(RAW, "bad")
        bad[name] = table.where("bad").select(F.col(RAW).alias("raw"), reason_of(F.col(RAW), schema, timestamp_format).alias("reason"))
    return Loaded(good, bad)


def checksum(df: DataFrame) -> DataFrame:
    """One row: row count and a sum over all columns that does not depend on row order."""
    fields = F.concat_ws("\x1f", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x1e")) for c in df.columns])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(fields).cast("decimal(38,0)")).alias("sum"))
