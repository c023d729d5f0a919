"""Entry point D: data products (P1-P6) built from the causal export orders and segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.ordering import keep_first
from ledgerlens.operators.profile import rate_by
from ledgerlens.operators.reshape import crosstab_pct_wide
from ledgerlens.operators.models import SEGMENT_NAMES
from ledgerlens.sources.tables import Tables

# P1 output schema (fixed list)
EXPORT_ORDER_COLS = ["order_id", "customer_id", "primary_seller_id", "primary_category",
                     "seller_customer_distance_km", "avg_price", "total_freight", "item_count",
                     "payment_installments", "seller_on_time_rate", "is_late", "review_score",
                     "order_purchase_timestamp", "purchase_month"]
SEGMENT_ORDER = [SEGMENT_NAMES[k] for k in ("dissatisfied", "core", "high_value", "repeat", "low_spend")]


def export_orders(t: Tables, causal: DataFrame, segments: DataFrame | None = None) -> DataFrame:
    """Order grain with states, person and (optionally) segment."""
    o = (causal.select(*EXPORT_ORDER_COLS)
         .join(t.customers.select("customer_id", "customer_state", "customer_unique_id"), "customer_id", "left")
         .join(t.sellers.select(F.col("seller_id").alias("primary_seller_id"), "seller_state"), "primary_seller_id", "left"))
    if segments is not None:
        o = o.join(segments.select("customer_unique_id", "cluster_final", "customer_segment"), "customer_unique_id", "left")
    return o


def seller_performance(t: Tables, orders: DataFrame) -> DataFrame:
    """Seller scorecard."""
    late = F.col("is_late").cast("double")
    sc = orders.where(F.col("primary_seller_id").isNotNull()).groupBy("primary_seller_id").agg(
        F.count("order_id").alias("total_orders"), F.sum(F.col("is_late").cast("long")).alias("late_orders"),
        (1 - F.avg(late)).alias("on_time_rate"), F.avg("review_score").alias("avg_review_score"),
        F.avg("avg_price").alias("avg_price"), F.avg("seller_customer_distance_km").alias("avg_distance_km"))
    return sc.join(t.sellers.select(F.col("seller_id").alias("primary_seller_id"), "seller_state"), "primary_seller_id", "left")


def regional_summary(orders: DataFrame, segment_values=SEGMENT_ORDER) -> DataFrame:
    """P4 / A19 + R4: per customer state, volumes and means plus the segment mix in %."""
    base = orders.where(F.col("customer_state").isNotNull())
    summ = base.groupBy("customer_state").agg(
        F.count("order_id").alias("total_orders"), F.avg(F.col("is_late").cast("double")).alias("late_rate"),
        F.avg("review_score").alias("avg_review_score"), F.avg("avg_price").alias("avg_price"),
        F.avg("total_freight").alias("avg_freight"), F.avg("seller_customer_distance_km").alias("avg_distance_km"))
    if "customer_segment" not in orders.columns:
        return summ
    mix = crosstab_pct_wide(base, "customer_state", "customer_segment", segment_values)
    return summ.join(mix, "customer_state", "left")


def customer_segments(t: Tables, segmented: DataFrame) -> DataFrame:
    """Customer grain with segment and the state of the person's first alias row."""
    state = keep_first(t.customers.select("customer_unique_id", "customer_id", "customer_state"),
                       ["customer_unique_id"], ["customer_id"]).select("customer_unique_id", "customer_state")
    cols = ["customer_unique_id", "recency_days", "monetary", "frequency", "is_repeat_customer", "category_diversity",
            "avg_freight_ratio", "avg_installments", "avg_review_score", "preferred_payment_type", "cluster_final",
            "customer_segment"]
    return segmented.select(*cols).join(state, "customer_unique_id", "left")


def dashboard_rate(orders: DataFrame, dim: str, min_n: int = 1000) -> DataFrame:
    """Late rate by a dimension with minimum support."""
    return rate_by(orders, dim, "is_late", min_n)


def profile_grid(profile: DataFrame, metrics) -> DataFrame:
    """Long (segment, metric, value) grid of the segment profile."""
    stack = ", ".join(f"'{m}', CAST(`{m}` AS DOUBLE)" for m in metrics)
    return profile.selectExpr("customer_segment", "size", f"stack({len(metrics)}, {stack}) AS (metric, value)")
