"""Registered queries: data products."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.plans import products as PR
from ledgerlens.plans.models import PROFILE_COLS
from ledgerlens.plans.oracle_views import CAUSAL, CUSTOMER, SPLIT
from ledgerlens.plans.queries_base import T
from ledgerlens.plans.queries_causal import cdata
from ledgerlens.plans.queries_models import segmented
from ledgerlens.plans.registry import R, query

_EXTRA = SPLIT + "," + CAUSAL


def orders_export(spark, sf_dir, with_segments=False):
    t = T(spark, sf_dir)
    seg = segmented(spark, sf_dir)[0] if with_segments else None
    return t, PR.export_orders(t, cdata(spark, sf_dir), seg)


@query("seller_performance", """
SELECT s.primary_seller_id, s.total_orders, s.late_orders, s.on_time_rate, s.avg_review_score, s.avg_price, s.avg_distance_km,
       se.seller_state FROM (
  SELECT primary_seller_id, count(order_id) AS total_orders, CAST(sum(CAST(is_late AS INTEGER)) AS BIGINT) AS late_orders,
         1 - avg(CAST(is_late AS DOUBLE)) AS on_time_rate, avg(review_score) AS avg_review_score, avg(avg_price) AS avg_price,
         avg(seller_customer_distance_km) AS avg_distance_km
  FROM c_cd WHERE primary_seller_id IS NOT NULL GROUP BY primary_seller_id) s
LEFT JOIN c_sellers se ON s.primary_seller_id = se.seller_id
""", mart=True, extra=_EXTRA, rnd=R("on_time_rate", "avg_review_score") | R("avg_price", "avg_distance_km", d=4),
       ids="P3 A18 J2 T28")
def q_seller_performance(spark, sf_dir):
    t, o = orders_export(spark, sf_dir)
    return PR.seller_performance(t, o)


@query("dashboard_late_by_category", """
SELECT primary_category, count(is_late) AS orders, avg(CAST(is_late AS DOUBLE)) AS late_rate
FROM c_cd WHERE primary_category IS NOT NULL GROUP BY primary_category HAVING count(is_late) >= 300
""", mart=True, extra=_EXTRA, rnd=R("late_rate"), ids="P6 A12")
def q_dashboard_late_by_category(spark, sf_dir):
    _, o = orders_export(spark, sf_dir)
    return PR.dashboard_rate(o, "primary_category", 300)


@query("dashboard_late_by_state", """
SELECT c.customer_state, count(d.is_late) AS orders, avg(CAST(d.is_late AS DOUBLE)) AS late_rate
FROM c_cd d LEFT JOIN c_customers c ON d.customer_id = c.customer_id
WHERE c.customer_state IS NOT NULL GROUP BY c.customer_state HAVING count(d.is_late) >= 100
""", mart=True, extra=_EXTRA, rnd=R("late_rate"), ids="P6 A12")
def q_dashboard_late_by_state(spark, sf_dir):
    _, o = orders_export(spark, sf_dir)
    return PR.dashboard_rate(o, "customer_state", 100)  # the report's 1000 leaves no state of the proxy


@query("regional_summary_base", """
SELECT c.customer_state, count(d.order_id) AS total_orders, avg(CAST(d.is_late AS DOUBLE)) AS late_rate,
       avg(d.review_score) AS avg_review_score, avg(d.avg_price) AS avg_price, avg(d.total_freight) AS avg_freight,
       avg(d.seller_customer_distance_km) AS avg_distance_km
FROM c_cd d LEFT JOIN c_customers c ON d.customer_id = c.customer_id
WHERE c.customer_state IS NOT NULL GROUP BY c.customer_state
""", mart=True, extra=_EXTRA, rnd=R("late_rate", "avg_review_score") | R("avg_price", "avg_freight", "avg_distance_km", d=4),
       ids="A19")
def q_regional_summary_base(spark, sf_dir):
    _, o = orders_export(spark, sf_dir)
    return PR.regional_summary(o)


@query("order_delivery_risk", ids="P1 J1 F11")
def q_order_delivery_risk(spark, sf_dir):
    _, o = orders_export(spark, sf_dir, with_segments=True)
    return o


@query("customer_segments", ids="P2 W6")
def q_customer_segments(spark, sf_dir):
    t = T(spark, sf_dir)
    return PR.customer_segments(t, segmented(spark, sf_dir)[0])


@query("regional_summary", ids="P4 A19 R4 X13")
def q_regional_summary(spark, sf_dir):
    _, o = orders_export(spark, sf_dir, with_segments=True)
    return PR.regional_summary(o)


@query("dashboard_segment_sizes", ids="P6 V4 A11")
def q_dashboard_segment_sizes(spark, sf_dir):
    _, prof = segmented(spark, sf_dir)
    tot = F.sum("size").over(Window.partitionBy())  # k rows
    return prof.select("customer_segment", "size", (F.col("size") * 100.0 / tot).alias("size_pct"))


@query("dashboard_profile_grid", ids="P6 A11")
def q_dashboard_profile_grid(spark, sf_dir):
    _, prof = segmented(spark, sf_dir)
    return PR.profile_grid(prof, PROFILE_COLS)


@query("dashboard_spotlight", ids="P6 A11")
def q_dashboard_spotlight(spark, sf_dir):
    """The dissatisfied vs satisfied-core comparison (review score gap)."""
    from ledgerlens.operators.models import SEGMENT_NAMES
    _, prof = segmented(spark, sf_dir)
    two = [SEGMENT_NAMES["dissatisfied"], SEGMENT_NAMES["core"]]
    return prof.where(F.col("customer_segment").isin(two)).select("customer_segment", "size", "avg_review_score")


@query("order_delivery_risk_checked", """
SELECT count(*) AS "rows", count(DISTINCT order_id) AS orders, count(*) AS with_person,
       count(*) FILTER (WHERE c.customer_unique_id IN (SELECT customer_unique_id FROM c_ready)) AS with_segment
FROM c_cd d JOIN c_customers c USING (customer_id)""", mart=True, extra=_EXTRA + "," + CUSTOMER, ids="P1 F11 J1")
def q_order_delivery_risk_checked(spark, sf_dir):
    """The export's grain: an order once, with its person, and with a segment exactly where the person has one."""
    _, o = orders_export(spark, sf_dir, with_segments=True)
    return o.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("order_id").alias("orders"), F.count("customer_unique_id").alias("with_person"),
                 F.count("customer_segment").alias("with_segment"))


_PAYMENTS = ["boleto", "credit_card", "debit_card", "not_defined", "voucher"]


@query("regional_payment_mix", """
SELECT customer_state, total_orders, """ + ", ".join(f"coalesce(100.0 * n_{v} / nullif(labelled, 0), 0.0) AS pct_{v}" for v in _PAYMENTS) + """
FROM (SELECT c.customer_state, count(d.order_id) AS total_orders, count(f.preferred_payment_type) AS labelled, """
       + ", ".join(f"count(*) FILTER (WHERE f.preferred_payment_type = '{v}') AS n_{v}" for v in _PAYMENTS) + """
      FROM c_cd d LEFT JOIN c_customers c ON d.customer_id = c.customer_id LEFT JOIN c_cust f ON f.customer_unique_id = c.customer_unique_id
      WHERE c.customer_state IS NOT NULL GROUP BY c.customer_state)
""", mart=True, extra=_EXTRA + "," + CUSTOMER, rnd=R(*[f"pct_{v}" for v in _PAYMENTS]), ids="P4 R4 X13")
def q_regional_payment_mix(spark, sf_dir):
    """The regional summary's mix in percent, by a label that SQL can state: the person's preferred payment type."""
    from ledgerlens.plans.segmentation import customer_table
    t, o = orders_export(spark, sf_dir)
    label = customer_table(t).select("customer_unique_id", F.col("preferred_payment_type").alias("customer_segment"))
    out = PR.regional_summary(o.join(label, "customer_unique_id", "left"), _PAYMENTS)
    return out.select("customer_state", "total_orders", *[f"pct_{v}" for v in _PAYMENTS])
