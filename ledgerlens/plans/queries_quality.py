"""Registered queries: remaining validation checks (V5-V15) and describe."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import profile as P
from ledgerlens.operators import quality as Q
from ledgerlens.operators.features import geo_centroid, item_enrichment, rfm
from ledgerlens.plans import delivery as D
from ledgerlens.plans import segmentation as S
from ledgerlens.plans.oracle_views import CUSTOMER
from ledgerlens.plans.queries_base import T, mart
from ledgerlens.plans.registry import R, query

_DESC = ["seller_customer_distance_km", "total_freight", "avg_price"]


def _desc_sql(cols, by=None):
    b = f"{by}, " if by else ""
    un = " UNION ALL ".join(f"SELECT {b}'{c}' AS column_name, CAST({c} AS DOUBLE) AS value FROM c_mart" for c in cols)
    return f"""
SELECT {b}column_name, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min,
       quantile_cont(value, 0.25) AS q25, quantile_cont(value, 0.5) AS q50, quantile_cont(value, 0.75) AS q75, max(value) AS max
FROM ({un}) GROUP BY {b}column_name"""


_DESC_R = R("mean", "std", "min", "q25", "q50", "q75", "max", d=4)


@query("describe_distance", _desc_sql(_DESC), mart=True, rnd=_DESC_R, ids="V6")
def q_describe_distance(spark, sf_dir):
    return P.describe(mart(spark, sf_dir), _DESC)


@query("describe_by_group", _desc_sql(["seller_customer_distance_km", "payment_installments"], "is_late"),
       mart=True, rnd=_DESC_R, ids="V6 C5 D9")
def q_describe_by_group(spark, sf_dir):
    return P.describe(mart(spark, sf_dir), ["seller_customer_distance_km", "payment_installments"], by=["is_late"])


# a ratio without the zero-price guard: inf where the price is 0, NaN where the freight is 0 too
_RAW_RATIO = ("CASE WHEN price <> 0 THEN freight_value / price WHEN freight_value = 0 THEN CAST('NaN' AS DOUBLE) "
              "ELSE CAST('Infinity' AS DOUBLE) END")


@query("inf_nan_guard", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE isinf({c})) AS n_inf, count(*) FILTER (WHERE isnan({c})) AS n_nan FROM c_ready"
    for c in S.FINAL_CLUSTER_FEATURES[1:2] + ["avg_freight_ratio_log", "avg_installments", "avg_review_score"]) + f"""
 UNION ALL SELECT 'raw_freight_ratio', count(*) FILTER (WHERE isinf(x)), count(*) FILTER (WHERE isnan(x)) FROM (SELECT {_RAW_RATIO} AS x FROM c_items)""",
    extra=CUSTOMER, ids="V5")
def q_inf_nan_guard(spark, sf_dir):
    t = T(spark, sf_dir)
    ready = Q.inf_nan_guard(S.clustering_ready(t), ["monetary_log", "avg_freight_ratio_log", "avg_installments", "avg_review_score"])
    raw = t.order_items.select(F.expr(_RAW_RATIO).alias("raw_freight_ratio"))
    return ready.unionByName(Q.inf_nan_guard(raw, ["raw_freight_ratio"]))


@query("rule_violations", """
SELECT 'price_le_0' AS rule, count(*) FILTER (WHERE avg_price <= 0) AS violations FROM c_mart UNION ALL
SELECT 'freight_le_0', count(*) FILTER (WHERE total_freight <= 0) FROM c_mart UNION ALL
SELECT 'item_price_le_0', count(*) FILTER (WHERE price <= 0) FROM c_items UNION ALL
SELECT 'item_freight_le_0', count(*) FILTER (WHERE freight_value <= 0) FROM c_items
""", mart=True, ids="V7")
def q_rule_violations(spark, sf_dir):
    t = T(spark, sf_dir)
    m = D.order_mart(t)
    return Q.union_all([
        Q.rule_violations(m, {"price_le_0": F.col("avg_price") <= 0, "freight_le_0": F.col("total_freight") <= 0}),
        Q.rule_violations(t.order_items, {"item_price_le_0": F.col("price") <= 0,
                                          "item_freight_le_0": F.col("freight_value") <= 0}),
    ])


@query("key_coverage", """
SELECT 'sellers_zip' AS check_name, count(*) AS "rows", count(g.zip) AS matched, avg(CASE WHEN g.zip IS NULL THEN 0.0 ELSE 1.0 END) AS coverage
FROM c_sellers s LEFT JOIN (SELECT DISTINCT zip FROM c_geo) g ON s.seller_zip_code_prefix = g.zip
UNION ALL
SELECT 'customers_zip', count(*), count(g.zip), avg(CASE WHEN g.zip IS NULL THEN 0.0 ELSE 1.0 END)
FROM c_customers c LEFT JOIN (SELECT DISTINCT zip FROM c_geo) g ON c.customer_zip_code_prefix = g.zip
""", rnd=R("coverage"), ids="V8")
def q_key_coverage(spark, sf_dir):
    t = T(spark, sf_dir)
    return Q.union_all([
        Q.key_coverage(t.sellers, "seller_zip_code_prefix", t.geolocation, "geolocation_zip_code_prefix", "sellers_zip"),
        Q.key_coverage(t.customers, "customer_zip_code_prefix", t.geolocation, "geolocation_zip_code_prefix", "customers_zip"),
    ])


@query("fanout_sellers_per_order", """
SELECT 'sellers_per_order' AS check_name, count(*) FILTER (WHERE k > 1) AS groups_over_one, count(*) AS groups, avg(CAST(k > 1 AS DOUBLE)) * 100 AS pct
FROM (SELECT order_id, count(DISTINCT seller_id) AS k FROM c_items GROUP BY order_id)
UNION ALL
SELECT 'payment_rows_per_order', count(*) FILTER (WHERE k > 1), count(*), avg(CAST(k > 1 AS DOUBLE)) * 100
FROM (SELECT order_id, count(*) AS k FROM c_payments GROUP BY order_id)
UNION ALL
SELECT 'credit_cards_per_order', count(*) FILTER (WHERE k > 1), count(*), avg(CAST(k > 1 AS DOUBLE)) * 100
FROM (SELECT order_id, count(*) AS k FROM c_payments WHERE payment_type = 'credit_card' GROUP BY order_id)
UNION ALL
SELECT 'categories_per_order', count(*) FILTER (WHERE k > 1), count(*), avg(CAST(k > 1 AS DOUBLE)) * 100
FROM (SELECT order_id, count(DISTINCT category_en) AS k FROM c_item_feats GROUP BY order_id)
""", mart=True, rnd=R("pct"), ids="V9")
def q_fanout(spark, sf_dir):
    t = T(spark, sf_dir)
    e = item_enrichment(t.order_items, t.products, t.category_translation)
    return Q.union_all([
        Q.fanout(t.order_items, "order_id", "seller_id", "sellers_per_order"),
        Q.fanout(t.payments, "order_id", None, "payment_rows_per_order"),
        Q.fanout(t.payments.where(F.col("payment_type") == "credit_card"), "order_id", None, "credit_cards_per_order"),
        Q.fanout(e, "order_id", "category_en", "categories_per_order"),
    ])


@query("violator_sample", """
SELECT p.* FROM c_payments p JOIN (
  SELECT order_id FROM c_payments GROUP BY order_id HAVING count(*) > 1 ORDER BY order_id LIMIT 5) k
ON p.order_id = k.order_id
""", rnd=R("payment_value", d=4), ids="O1 V10 J5 O2")
def q_violator_sample(spark, sf_dir):
    t = T(spark, sf_dir)
    multi = t.payments.groupBy("order_id").count().where(F.col("count") > 1).select("order_id")
    return Q.violator_sample(t.payments, "order_id", multi, ["order_id", "payment_sequential"])


@query("zero_spend_orders", """
SELECT o.order_id, o.order_status, o.order_purchase_timestamp FROM c_orders o LEFT JOIN c_pay_order p ON o.order_id = p.order_id
WHERE coalesce(p.payment_value, 0) = 0
""", extra=CUSTOMER, ids="V10 J6")
def q_zero_spend_orders(spark, sf_dir):
    """Details of every order without any payment."""
    t = T(spark, sf_dir)
    paid = t.payments.groupBy("order_id").agg(F.sum("payment_value").alias("spend")).where("spend <> 0")
    return t.orders.join(paid, "order_id", "left_anti").select("order_id", "order_status", "order_purchase_timestamp")


@query("zero_freight_sample", """
SELECT i.order_id, i.line_no AS order_item_id, i.price, i.freight_value FROM c_items i JOIN (
  SELECT DISTINCT order_id FROM c_items WHERE freight_value = 0 ORDER BY order_id LIMIT 5) k ON i.order_id = k.order_id
""", rnd=R("price", "freight_value", d=4), ids="V10 J5 O2")
def q_zero_freight_sample(spark, sf_dir):
    t = T(spark, sf_dir)
    free = t.order_items.where(F.col("freight_value") == 0).select("order_id")
    return (Q.violator_sample(t.order_items, "order_id", free, ["order_id", "order_item_id"])
            .select("order_id", "order_item_id", "price", "freight_value"))


@query("flag_agreement", """
SELECT count(*) FILTER (WHERE slack IS NOT NULL) AS "rows",
       avg(CASE WHEN slack IS NOT NULL THEN CAST((slack < 0) = is_late AS DOUBLE) END) AS agreement
FROM (SELECT is_late, date_diff('microsecond', order_purchase_timestamp, order_estimated_delivery_date) / 86400000000.0
                     - date_diff('microsecond', order_purchase_timestamp, order_delivered_customer_date) / 86400000000.0 AS slack
      FROM c_mart)
""", mart=True, rnd=R("agreement"), ids="V11 X10")
def q_flag_agreement(spark, sf_dir):
    m = D.with_stages(mart(spark, sf_dir))
    return Q.flag_agreement(m, F.col("slack_days") < 0, F.col("is_late"))


@query("impossible_sequence", """
SELECT count(*) AS rows_before,
       count(*) FILTER (WHERE s2 >= 0 AND s3 >= 0) AS rows_after,
       count(*) FILTER (WHERE s2 < 0) AS negative_stage2_approval_to_carrier_hrs,
       count(*) FILTER (WHERE s3 < 0) AS negative_stage3_carrier_to_customer_hrs,
       count(*) - count(*) FILTER (WHERE s2 >= 0 AND s3 >= 0) AS rows_removed
FROM (SELECT date_diff('microsecond', order_approved_at, order_delivered_carrier_date) / 3600000000.0 AS s2,
             date_diff('microsecond', order_delivered_carrier_date, order_delivered_customer_date) / 3600000000.0 AS s3
      FROM c_mart)
""", mart=True, ids="V13 T19")
def q_impossible_sequence(spark, sf_dir):
    m = D.with_stages(mart(spark, sf_dir))
    return Q.impossible_sequence(m, {"stage2_approval_to_carrier_hrs": F.col("stage2_approval_to_carrier_hrs"),
                                     "stage3_carrier_to_customer_hrs": F.col("stage3_carrier_to_customer_hrs")})


@query("segment_nulls", """
SELECT count(*) AS items, count(*) - count(p.product_category_name) AS null_category
FROM c_items i LEFT JOIN c_products p ON i.product_id = p.product_id
JOIN c_bridge b ON i.order_id = b.order_id
WHERE b.person IN (SELECT customer_unique_id FROM c_rfm WHERE is_repeat_customer)
""", extra=CUSTOMER, ids="V14 J5")
def q_segment_nulls(spark, sf_dir):
    """Null categories among the items of one segment (here: repeat customers)."""
    from ledgerlens.operators.features import person_bridge
    t = T(spark, sf_dir)
    seg = rfm(t.orders, t.customers, t.payments).where("is_repeat_customer").select("customer_unique_id")
    items = (t.order_items.select("order_id", "product_id")
             .join(t.products.select("product_id", "product_category_name"), "product_id", "left")
             .join(person_bridge(t.orders, t.customers).select("order_id", "customer_unique_id"), "order_id", "inner")
             .join(seg, "customer_unique_id", "left_semi"))
    return items.agg(F.count(F.lit(1)).alias("items"),
                     F.count_if(F.col("product_category_name").isNull()).alias("null_category"))


@query("missing_payment", """
SELECT o.order_id, o.customer_id FROM c_orders o
WHERE o.order_status = 'delivered' AND NOT EXISTS (SELECT 1 FROM c_payments p WHERE p.order_id = o.order_id)
""", ids="V15 F3 J6")
def q_missing_payment(spark, sf_dir):
    t = T(spark, sf_dir)
    delivered = t.orders.where(F.col("order_status") == "delivered").select("order_id", "customer_id")
    return Q.missing_after_left_join(delivered, t.payments, "order_id")


@query("geo_centroid", "SELECT zip, avg(lat) AS lat, avg(lng) AS lng FROM c_geo GROUP BY zip",
       rnd=R("lat", "lng"), ids="A13")
def q_geo_centroid(spark, sf_dir):
    return geo_centroid(T(spark, sf_dir).geolocation)


@query("haversine_distance", """
SELECT order_id, primary_seller_id, seller_customer_distance_km FROM c_mart_dist
""", mart=True, rnd=R("seller_customer_distance_km", d=4), ids="X9 J8")
def q_haversine_distance(spark, sf_dir):
    m = D.order_mart_unfiltered(T(spark, sf_dir))
    return m.where(F.col("payment_installments").isNotNull()).select(
        "order_id", "primary_seller_id", "seller_customer_distance_km")


@query("bbox_filtered", """
SELECT count(*) AS rows_before, count(*) FILTER (WHERE seller_customer_distance_km IS NOT NULL) AS with_distance,
       (SELECT count(*) FROM c_mart) AS rows_after
FROM c_mart_dist
""", mart=True, ids="F4 F5")
def q_bbox_filtered(spark, sf_dir):
    t = T(spark, sf_dir)
    raw = D.order_mart_unfiltered(t).where(F.col("payment_installments").isNotNull())
    after = D.order_mart(t).count()
    return raw.agg(F.count(F.lit(1)).alias("rows_before"),
                   F.count("seller_customer_distance_km").alias("with_distance")).withColumn("rows_after", F.lit(after).cast("long"))


@query("top_distance", """
SELECT order_id, seller_lat, seller_lng, customer_lat, customer_lng, seller_customer_distance_km
FROM c_mart_dist WHERE seller_customer_distance_km IS NOT NULL ORDER BY seller_customer_distance_km DESC, order_id LIMIT 3
""", mart=True, rnd=R("seller_lat", "seller_lng", "customer_lat", "customer_lng", "seller_customer_distance_km", d=4),
       ids="O3 F4")
def q_top_distance(spark, sf_dir):
    m = D.order_mart_unfiltered(T(spark, sf_dir)).where(
        F.col("payment_installments").isNotNull() & F.col("seller_customer_distance_km").isNotNull())
    return (m.orderBy(F.col("seller_customer_distance_km").desc(), "order_id").limit(3)
            .select("order_id", "seller_lat", "seller_lng", "customer_lat", "customer_lng", "seller_customer_distance_km"))
