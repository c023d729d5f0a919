"""The order-grain facts kept in buckets of ``order_id``: mart, RFM and roll-ups join them without a shuffle.

Orders, items, payments and reviews meet on ``order_id`` in every pipeline. Here each is shuffled by it once, when it is
written: an external bucketed table in the shared scratch folder, one file per bucket, sorted. Spark then reads equal
buckets of two facts side by side, and an aggregate by order stays where it is. What an order needs from dimensions
(product attributes of an item, person and zip of a customer) is attached before the write, as those joins
would move the rows off their buckets again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.operators.features import item_enrichment
from ledgerlens.session import remove_path, scratch_path
from ledgerlens.sources.tables import Tables

KEY = "order_id"
#: Items of one bucket, about 400 MB of rows where a task sorts them: more would spill.
BUCKET_ITEMS = 1 << 21


@dataclass
class Facts:
    """Bucketed facts, and the dimensions that still join by other keys."""
    orders: DataFrame        # with customer_unique_id, customer_zip_code_prefix
    items: DataFrame         # with product weight, volume, category
    payments: DataFrame
    reviews: DataFrame
    sellers: DataFrame
    geolocation: DataFrame
    item_order: tuple
    names: dict[str, str]    # table in the catalogue by fact

    def drop(self, spark: SparkSession) -> None:
        """Removes the tables and their files."""
        for name in self.names.values():
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove_path(spark, scratch_path(spark, name))


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> str:
    """Writes ``df`` as an external table in ``buckets`` of ``key``; returns the table's name."""
    spark = df.sparkSession
    table = f"ledgerlens_{name}_{uuid.uuid4().hex}"
    (df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
     .option("path", scratch_path(spark, table)).saveAsTable(table))
    return table


def bucketed_facts(t: Tables, buckets: int | None = None) -> Facts:
    """``buckets`` defaults to the session's shuffle partitions, or as many as hold ``BUCKET_ITEMS`` items each if
    these are more: tasks of a join without shuffle are as many.

    Rows with a null order id are kept, in one bucket of their own value; duplicates stay duplicates.
    """
    spark = t.orders.sparkSession
    buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-t.order_items.count() // BUCKET_ITEMS))
    people = t.customers.select("customer_id", "customer_unique_id", "customer_zip_code_prefix").dropDuplicates(["customer_id"])
    parts = {"orders": t.orders.join(people, "customer_id", "left"),
             "items": item_enrichment(t.order_items, t.products, t.category_translation),
             "payments": t.payments, "reviews": t.reviews}
    names = {n: bucketed(df, n, KEY, buckets) for n, df in parts.items()}
    return Facts(**{n: spark.table(x) for n, x in names.items()}, sellers=t.sellers, geolocation=t.geolocation,
                 item_order=t.item_order, names=names)


_KEPT: dict[tuple[str, str], Facts] = {}


def facts_of(spark: SparkSession, source: str, tables) -> Facts:
    """The facts of ``source`` (its path), written once per application; ``tables()`` loads what they are made of."""
    at = (spark.sparkContext.applicationId, source)
    if at not in _KEPT:
        _KEPT[at] = bucketed_facts(tables())
    return _KEPT[at]


def joined_by_order(f: Facts) -> DataFrame:
    """Every order with its payment sum, item and review counts: the facts side by side, no shuffle."""
    pay = f.payments.groupBy(KEY).agg(F.sum("payment_value").alias("payment_value"), F.count(F.lit(1)).alias("payments"))
    items = f.items.groupBy(KEY).agg(F.count(F.lit(1)).alias("items"), F.sum("price").alias("price"))
    reviews = f.reviews.groupBy(KEY).agg(F.count(F.lit(1)).alias("reviews"))
    out = f.orders.select(KEY, "order_status").join(pay, KEY, "left").join(items, KEY, "left").join(reviews, KEY, "left")
    return out.fillna(0, ["payments", "items", "reviews"])
