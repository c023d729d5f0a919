"""Proxy view of the nine commerce tables over the driver's star schema.

The driver tables (region nation customer supplier part orders lineitem events) carry no
payments, coordinates, nulls or delivery dates. This module derives each logical table
with deterministic integer arithmetic so the same rows can be rebuilt independently in SQL.
All derivations are narrow projections/filters except two joins to the 25-row ``nation``
dimension (fixed size by the TPC-H definition, so broadcasting it is bounded).

Fixed values of the mapping (must stay as written for oracle parity):
  order_status    'P' -> 'canceled', otherwise 'delivered'
  approved        purchase + (orderkey % 30) hours
  carrier         purchase + (20 + orderkey % 53 - (40 if orderkey % 67 == 0 else 0)) hours
  delivered       null if orderkey % 101 == 0, else purchase + (120 + (orderkey*37 + custkey*11) % 600) hours
  estimated       purchase + (20 + orderkey % 9) days
  item price      0.0 when partkey % 211 == 0, else extendedprice; freight = extendedprice * tax
  payments        every lineitem; type not_defined when orderkey % 61 == 0, else by (returnflag, linestatus):
                  A -> boleto, N -> credit_card, R+F -> voucher, R+O -> debit_card
                  installments = 1 + quantity % 10; value = extendedprice * (1 - discount)
  reviews         order_id = (event_id - event_id % 4) * 2 + event_id % 3;
                  score = 1 + floor(value) % 5
  products        category = p_type (null when partkey % 40 == 0); weight = size*100 (null when
                  partkey % 97 == 0); length 10+size; height 5+size%7; width 8+size%11
  geolocation     nations except 13, five points each (offset 0.01 * r, r = 0..4):
                  lat = (12.0 if nationkey == 24 else -33 + 1.5*nationkey) + 0.01*r
                  lng = -74 + 1.6 * ((7*nationkey) % 25) + 0.01*r
  translation     distinct p_type except 'PROMO' -> lower(p_type)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.sources.tables import Tables

ITEM_ORDER = ("order_item_id", "product_id", "seller_id", "shipping_limit_date", "line_value")


def _hours(n) -> F.Column:
    return F.make_dt_interval(F.lit(0), n.cast("int"))


def proxy_tables(spark: SparkSession, sf_dir: str) -> Tables:
    rd = lambda n: spark.read.parquet(f"{sf_dir.rstrip('/')}/{n}.parquet")
    o, li, ev, part = rd("orders"), rd("lineitem"), rd("events"), rd("part")
    nation = F.broadcast(rd("nation").select("n_nationkey", "n_name"))

    k, ck, ts = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
    orders = o.select(
        k.alias("order_id"),
        k.alias("customer_id"),
        F.when(F.col("o_orderstatus") == "P", "canceled").otherwise("delivered").alias("order_status"),
        ts.alias("order_purchase_timestamp"),
        (ts + _hours(k % 30)).alias("order_approved_at"),
        (ts + _hours(20 + k % 53 - F.when(k % 67 == 0, 40).otherwise(0))).alias("order_delivered_carrier_date"),
        F.when(k % 101 == 0, F.lit(None))
         .otherwise(ts + _hours(120 + (k * 37 + ck * 11) % 600)).alias("order_delivered_customer_date"),
        (ts + F.make_dt_interval((20 + k % 9).cast("int"))).alias("order_estimated_delivery_date"),
    )

    customers = (o.select("o_orderkey", "o_custkey")
                 .join(rd("customer").select("c_custkey", "c_nationkey"),
                       F.col("o_custkey") == F.col("c_custkey"), "left")
                 .join(nation, F.col("c_nationkey") == F.col("n_nationkey"), "left")
                 .select(F.col("o_orderkey").alias("customer_id"),
                         F.col("o_custkey").alias("customer_unique_id"),
                         F.col("c_nationkey").alias("customer_zip_code_prefix"),
                         F.col("n_name").alias("customer_state")))

    order_items = li.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("order_item_id"),
        F.col("l_partkey").alias("product_id"),
        F.col("l_suppkey").alias("seller_id"),
        F.col("l_shipdate").alias("shipping_limit_date"),
        F.when(F.col("l_partkey") % 211 == 0, F.lit(0.0)).otherwise(F.col("l_extendedprice")).alias("price"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("freight_value"),
        F.col("l_extendedprice").alias("line_value"),
    )

    rf, ls = F.col("l_returnflag"), F.col("l_linestatus")
    payments = li.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("payment_sequential"),
        F.when(F.col("l_orderkey") % 61 == 0, "not_defined").when(rf == "A", "boleto").when(rf == "N", "credit_card")
         .when((rf == "R") & (ls == "F"), "voucher").when((rf == "R") & (ls == "O"), "debit_card")
         .alias("payment_type"),
        (1 + F.col("l_quantity") % 10).cast("int").alias("payment_installments"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("payment_value"),
    )

    e = F.col("event_id")
    reviews = ev.select(
        e.alias("review_id"),
        ((e - e % 4) * 2 + e % 3).alias("order_id"),
        (1 + F.floor(F.col("value")).cast("long") % 5).cast("int").alias("review_score"),
        F.col("props").alias("review_comment_message"),
        F.col("ts").alias("review_creation_date"),
    )

    pk, size = F.col("p_partkey"), F.col("p_size")
    products = part.select(
        pk.alias("product_id"),
        F.when(pk % 40 == 0, F.lit(None)).otherwise(F.col("p_type")).alias("product_category_name"),
        F.when(pk % 97 == 0, F.lit(None)).otherwise(size * 100).cast("double").alias("product_weight_g"),
        (10 + size).cast("double").alias("product_length_cm"),
        (5 + size % 7).cast("double").alias("product_height_cm"),
        (8 + size % 11).cast("double").alias("product_width_cm"),
    )

    sellers = (rd("supplier").select("s_suppkey", "s_nationkey")
               .join(nation, F.col("s_nationkey") == F.col("n_nationkey"), "left")
               .select(F.col("s_suppkey").alias("seller_id"),
                       F.col("s_nationkey").alias("seller_zip_code_prefix"),
                       F.col("n_name").alias("seller_state")))

    nk = F.col("n_nationkey")
    geolocation = (rd("nation").filter(nk != 13)
                   .select(nk, F.explode(F.sequence(F.lit(0), F.lit(4))).alias("r"))
                   .select(nk.alias("geolocation_zip_code_prefix"),
                           ((F.when(nk == 24, F.lit(12.0)).otherwise(-33 + 1.5 * nk)) + 0.01 * F.col("r"))
                           .cast("double").alias("geolocation_lat"),
                           (-74 + 1.6 * ((7 * nk) % 25) + 0.01 * F.col("r"))
                           .cast("double").alias("geolocation_lng")))

    category_translation = (part.select("p_type").filter(F.col("p_type") != "PROMO").distinct()
                            .select(F.col("p_type").alias("product_category_name"),
                                    F.lower("p_type").alias("product_category_name_english")))

    return Tables(customers=customers, orders=orders, order_items=order_items, payments=payments,
                  reviews=reviews, products=products, sellers=sellers, geolocation=geolocation,
                  category_translation=category_translation, item_order=ITEM_ORDER)
