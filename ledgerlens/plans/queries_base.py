"""Registered queries: sources, validation, profiling, order mart (S*, V*, A*, F*, J*)."""

from __future__ import annotations

import uuid
from functools import lru_cache

from pyspark.sql import functions as F

from ledgerlens.operators import quality as Q
from ledgerlens.operators import profile as P
from ledgerlens.plans import delivery as D
from ledgerlens.plans.registry import R, query
from ledgerlens.session import scratch_path
from ledgerlens.sources.export import export_table
from ledgerlens.sources.proxy import proxy_tables
from ledgerlens.sources.tables import COMMERCE_SCHEMAS, load_csv_tables, row_count_manifest


def T(spark, sf_dir):
    return proxy_tables(spark, sf_dir)


def mart(spark, sf_dir):
    return D.order_mart(T(spark, sf_dir))


# ------------------------------------------------------------------ S1 S2

@query("table_counts", """
SELECT table_name, CAST("rows" AS BIGINT) AS "rows" FROM (
  SELECT 'customers' AS table_name, count(*) AS "rows" FROM c_customers UNION ALL
  SELECT 'orders', count(*) FROM c_orders UNION ALL
  SELECT 'order_items', count(*) FROM c_items UNION ALL
  SELECT 'payments', count(*) FROM c_payments UNION ALL
  SELECT 'reviews', count(*) FROM c_reviews UNION ALL
  SELECT 'products', count(*) FROM c_products UNION ALL
  SELECT 'sellers', count(*) FROM c_sellers UNION ALL
  SELECT 'geolocation', count(*) FROM c_geo UNION ALL
  SELECT 'category_translation', count(*) FROM c_translation)
""", ids="S1 S2")
def q_table_counts(spark, sf_dir):
    return row_count_manifest(T(spark, sf_dir).as_dict())


@query("csv_round_trip", """
SELECT table_name, CAST("rows" AS BIGINT) AS "rows", CAST("rows" AS BIGINT) AS expected, true AS ok FROM (
  SELECT 'customers' AS table_name, count(*) AS "rows" FROM c_customers UNION ALL
  SELECT 'orders', count(*) FROM c_orders UNION ALL
  SELECT 'orders: purchase time', count(order_purchase_timestamp) FROM c_orders UNION ALL
  SELECT 'orders: delivery time', count(order_delivered_customer_date) FROM c_orders UNION ALL
  SELECT 'order_items', count(*) FROM c_items UNION ALL
  SELECT 'payments', count(*) FROM c_payments UNION ALL
  SELECT 'reviews', count(*) FROM c_reviews UNION ALL
  SELECT 'products', count(*) FROM c_products UNION ALL
  SELECT 'sellers', count(*) FROM c_sellers UNION ALL
  SELECT 'geolocation', count(*) FROM c_geo UNION ALL
  SELECT 'category_translation', count(*) FROM c_translation)
""", ids="S1 S2 S3 S4")
def q_csv_round_trip(spark, sf_dir):
    """All nine tables exported as CSV to shared scratch and loaded again with the declared schemas:
    row counts against the source, and timestamps that read back as the same instant."""
    from ledgerlens.plans.delivery import materialise
    from ledgerlens.session import remove_path
    source = T(spark, sf_dir).as_dict()
    base = scratch_path(spark, f"csv/{uuid.uuid4().hex}")
    paths = {}
    for name, df in source.items():
        cols = [(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in COMMERCE_SCHEMAS[name]]
        paths[name] = export_table(df.select(*cols), f"{base}/{name}", "csv")
    loaded = load_csv_tables(spark, paths, "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").as_dict()
    times = {"orders: purchase time": "order_purchase_timestamp", "orders: delivery time": "order_delivered_customer_date"}
    same = {n: (loaded["orders"].select("order_id", F.col(c).alias("t"))
                .join(source["orders"].select(F.col("order_id").cast("string").alias("order_id"), F.col(c).alias("t")), ["order_id", "t"]))
            for n, c in times.items()}
    expected = {n: df.count() for n, df in source.items()} | {n: source["orders"].where(F.col(c).isNotNull()).count() for n, c in times.items()}
    out = materialise(row_count_manifest(loaded | same, expected))  # eleven rows
    remove_path(spark, base)
    return out


# ------------------------------------------------------------------ V1 V2 V3 V4

@query("duplicate_keys", """
SELECT table_name, CAST(sum(c) AS BIGINT) AS "rows", count(*) AS distinct_keys, CAST(sum(c - 1) AS BIGINT) AS duplicates FROM (
  SELECT 'orders' AS table_name, count(*) AS c FROM c_orders GROUP BY order_id UNION ALL
  SELECT 'customers', count(*) FROM c_customers GROUP BY customer_id UNION ALL
  SELECT 'order_items', count(*) FROM c_items GROUP BY order_id, line_no UNION ALL
  SELECT 'payments', count(*) FROM c_payments GROUP BY order_id, payment_sequential UNION ALL
  SELECT 'products', count(*) FROM c_products GROUP BY product_id UNION ALL
  SELECT 'sellers', count(*) FROM c_sellers GROUP BY seller_id)
GROUP BY table_name
""", ids="U1 V1")
def q_duplicate_keys(spark, sf_dir):
    t = T(spark, sf_dir)
    return Q.union_all([
        Q.duplicate_keys(t.orders, ["order_id"], "orders"),
        Q.duplicate_keys(t.customers, ["customer_id"], "customers"),
        Q.duplicate_keys(t.order_items, ["order_id", "order_item_id"], "order_items"),
        Q.duplicate_keys(t.payments, ["order_id", "payment_sequential"], "payments"),
        Q.duplicate_keys(t.products, ["product_id"], "products"),
        Q.duplicate_keys(t.sellers, ["seller_id"], "sellers"),
    ])


@query("orphan_keys", """
SELECT 'orders->customers' AS relation, count(*) AS orphans FROM c_orders o WHERE NOT EXISTS (SELECT 1 FROM c_customers c WHERE c.customer_id = o.customer_id)
UNION ALL SELECT 'order_items->orders', count(*) FROM c_items i WHERE NOT EXISTS (SELECT 1 FROM c_orders o WHERE o.order_id = i.order_id)
UNION ALL SELECT 'payments->orders', count(*) FROM c_payments p WHERE NOT EXISTS (SELECT 1 FROM c_orders o WHERE o.order_id = p.order_id)
UNION ALL SELECT 'reviews->orders', count(*) FROM c_reviews r WHERE NOT EXISTS (SELECT 1 FROM c_orders o WHERE o.order_id = r.order_id)
""", ids="U1 V2 J6")
def q_orphan_keys(spark, sf_dir):
    t = T(spark, sf_dir)
    return Q.union_all([
        Q.orphan_keys(t.orders, "customer_id", t.customers, "customer_id", "orders->customers"),
        Q.orphan_keys(t.order_items, "order_id", t.orders, "order_id", "order_items->orders"),
        Q.orphan_keys(t.payments, "order_id", t.orders, "order_id", "payments->orders"),
        Q.orphan_keys(t.reviews, "order_id", t.orders, "order_id", "reviews->orders"),
    ])


_ORDER_COLS = ["order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at",
               "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date"]


@query("null_profile", "SELECT column_name, nulls, CAST(nulls AS DOUBLE) / n AS share FROM (SELECT count(*) AS n, "
       + ", ".join(f"count(*) - count({c}) AS n_{c}" for c in _ORDER_COLS)
       + " FROM c_orders) UNPIVOT (nulls FOR column_name IN ("
       + ", ".join(f"n_{c} AS '{c}'" for c in _ORDER_COLS) + "))",
       rnd=R("share"), ids="V3")
def q_null_profile(spark, sf_dir):
    return Q.null_profile(T(spark, sf_dir).orders, _ORDER_COLS)


@query("value_counts_status", """
SELECT order_status AS value, count(*) AS n, count(*) / sum(count(*)) OVER () AS share
FROM c_orders WHERE order_status IS NOT NULL GROUP BY order_status
""", rnd=R("share"), ids="V4")
def q_value_counts_status(spark, sf_dir):
    return P.value_counts(T(spark, sf_dir).orders, "order_status")


# ------------------------------------------------------------------ order mart

_MART_DOUBLES = R("avg_price") | R("total_freight", "total_weight_g", "total_volume_cm3", "seller_lat", "seller_lng",
                  "customer_lat", "customer_lng", "seller_customer_distance_km", d=4)


@query("order_mart", "SELECT " + ", ".join(D.MART_COLUMNS) + " FROM c_mart", mart=True, rnd=_MART_DOUBLES,
       ids="A2 A4 A5 A6 A9 F1 F2 F4 F5 F9 F10 J1 J2 J7 J8 S3 X3 X8 X9 A13 T2 T4 T24")
def q_order_mart(spark, sf_dir):
    return mart(spark, sf_dir)


@query("late_rate_by_state", """
SELECT c.customer_state, count(m.is_late) AS orders, avg(CAST(m.is_late AS DOUBLE)) AS late_rate
FROM c_mart m LEFT JOIN c_customers c ON m.customer_id = c.customer_id
WHERE c.customer_state IS NOT NULL GROUP BY c.customer_state
""", mart=True, rnd=R("late_rate"), ids="A12 J1 T3")
def q_late_rate_by_state(spark, sf_dir):
    t = T(spark, sf_dir)
    m = D.order_mart(t).join(t.customers.select("customer_id", "customer_state"), "customer_id", "left")
    return P.rate_by(m, "customer_state", "is_late")


@query("late_rate_min_support", """
SELECT primary_category, count(is_late) AS orders, avg(CAST(is_late AS DOUBLE)) AS late_rate
FROM c_mart WHERE primary_category IS NOT NULL GROUP BY primary_category HAVING count(is_late) >= 300
""", mart=True, rnd=R("late_rate"), ids="A12")
def q_late_rate_min_support(spark, sf_dir):
    return P.rate_by(mart(spark, sf_dir), "primary_category", "is_late", min_n=300)


@query("monthly_late_rate", """
SELECT CAST(date_trunc('month', order_purchase_timestamp) AS TIMESTAMP) AS year_month,
       count(is_late) AS orders, avg(CAST(is_late AS DOUBLE)) AS late_rate
FROM c_mart GROUP BY 1
""", mart=True, rnd=R("late_rate"), ids="A14 X4")
def q_monthly_late_rate(spark, sf_dir):
    return P.rate_by(D.with_month(mart(spark, sf_dir)), "year_month", "is_late")
