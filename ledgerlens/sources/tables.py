"""Declared schemas for the nine commerce tables, loaders, row-count manifest."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLE_NAMES = ("customers", "orders", "order_items", "payments", "reviews", "products",
               "sellers", "geolocation", "category_translation")

MULTILINE_TABLES = ("reviews",)

_S, _D, _I, _TS = T.StringType(), T.DoubleType(), T.IntegerType(), T.TimestampNTZType()


def _schema(*cols) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


# Declared schemas (never inferSchema on large inputs). Ids are strings in the CSV source.
COMMERCE_SCHEMAS: dict[str, T.StructType] = {
    "customers": _schema(("customer_id", _S), ("customer_unique_id", _S),
                         ("customer_zip_code_prefix", _I), ("customer_city", _S), ("customer_state", _S)),
    "orders": _schema(("order_id", _S), ("customer_id", _S), ("order_status", _S),
                      ("order_purchase_timestamp", _TS), ("order_approved_at", _TS),
                      ("order_delivered_carrier_date", _TS), ("order_delivered_customer_date", _TS),
                      ("order_estimated_delivery_date", _TS)),
    "order_items": _schema(("order_id", _S), ("order_item_id", _I), ("product_id", _S), ("seller_id", _S),
                           ("shipping_limit_date", _TS), ("price", _D), ("freight_value", _D)),
    "payments": _schema(("order_id", _S), ("payment_sequential", _I), ("payment_type", _S),
                        ("payment_installments", _I), ("payment_value", _D)),
    "reviews": _schema(("review_id", _S), ("order_id", _S), ("review_score", _I),
                       ("review_comment_title", _S), ("review_comment_message", _S),
                       ("review_creation_date", _TS), ("review_answer_timestamp", _TS)),
    "products": _schema(("product_id", _S), ("product_category_name", _S), ("product_name_lenght", _I),
                        ("product_description_lenght", _I), ("product_photos_qty", _I),
                        ("product_weight_g", _D), ("product_length_cm", _D),
                        ("product_height_cm", _D), ("product_width_cm", _D)),
    "sellers": _schema(("seller_id", _S), ("seller_zip_code_prefix", _I), ("seller_city", _S), ("seller_state", _S)),
    "geolocation": _schema(("geolocation_zip_code_prefix", _I), ("geolocation_lat", _D), ("geolocation_lng", _D),
                           ("geolocation_city", _S), ("geolocation_state", _S)),
    "category_translation": _schema(("product_category_name", _S), ("product_category_name_english", _S)),
}


@dataclass
class Tables:
    """The nine logical tables as lazy DataFrames."""
    customers: DataFrame
    orders: DataFrame
    order_items: DataFrame
    payments: DataFrame
    reviews: DataFrame
    products: DataFrame
    sellers: DataFrame
    geolocation: DataFrame
    category_translation: DataFrame
    # columns that make the item row order total (T4): used by "first in row order"
    item_order: tuple = ("order_item_id",)

    def as_dict(self) -> dict[str, DataFrame]:
        return {f.name: getattr(self, f.name) for f in fields(self) if f.name in TABLE_NAMES}


def load_csv_tables(spark: SparkSession, paths: dict[str, str],
                    timestamp_format: str = "yyyy-MM-dd HH:mm:ss") -> Tables:
    """Read the nine CSV files with declared schemas.

    Review comments contain embedded newlines, hence ``multiLine`` for that table alone (such
    a file is one task; all others are split); timestamps are parsed
    once at load into TIMESTAMP_NTZ (unparseable -> null in PERMISSIVE mode).
    """
    dfs = {}
    for name in TABLE_NAMES:
        dfs[name] = (spark.read.schema(COMMERCE_SCHEMAS[name])
                     .option("header", True).option("multiLine", name in MULTILINE_TABLES)
                     .option("escape", '"').option("mode", "PERMISSIVE")
                     .option("timestampNTZFormat", timestamp_format)
                     .csv(paths[name]))
    return Tables(**dfs)


def load_parquet_tables(spark: SparkSession, base_dir: str, names=TABLE_NAMES) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{base_dir.rstrip('/')}/{n}.parquet") for n in names}


def row_count_manifest(tables: dict[str, DataFrame], expected: dict[str, int] | None = None) -> DataFrame:
    """One row per table with its row count, the expected count and an ok flag.

    Each count is a partial+final aggregate; the union of nine one-row results is tiny.
    """
    parts = []
    for name, df in tables.items():
        parts.append(df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if not expected:
        return out
    exp = out.sparkSession.createDataFrame([(k, int(v)) for k, v in expected.items()], "table_name string, expected long")
    return out.join(exp, "table_name", "left").withColumn("ok", F.when(F.col("expected").isNull(), F.lit(None).cast("boolean"))
                          .otherwise(F.col("rows") == F.col("expected")))
