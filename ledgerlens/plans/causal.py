"""Entry point C: causal effect of late delivery on review score.

The SQL-checkable chain uses the seller-stratified propensity P(late | seller) estimated on
the full causal data (C3's rate, deliberately without threshold); the logistic-regression
propensity (C4) lives in ``plans.models`` and feeds the same matching operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.causal import attach_outcome
from ledgerlens.operators.features import entity_rate_full
from ledgerlens.sources.tables import Tables

# C4 confounders of the propensity model (fixed list)
CONFOUNDERS = ["seller_customer_distance_km", "avg_price", "total_freight",
               "seller_on_time_rate", "payment_installments", "purchase_month"]
# covariates whose balance is reported (fixed list)
BALANCE_COVARIATES = ["seller_customer_distance_km", "avg_price", "total_freight", "seller_on_time_rate"]


def causal_data(t: Tables, trimmed: DataFrame) -> DataFrame:
    """C1 + C3: orders with a review (mean score), the full-data seller on-time rate and
    the seller-stratified propensity score."""
    df, _ = attach_outcome(trimmed, t.reviews, "order_id", "review_score")
    rate = entity_rate_full(df, "primary_seller_id", "is_late")
    return (df.join(rate, "primary_seller_id", "left")
            .withColumn("propensity", 1 - F.col("seller_on_time_rate")))


def windowed_propensity(df: DataFrame, window: str) -> DataFrame:
    """C13 (seller-stratified variant): propensity re-estimated inside each window."""
    r = df.groupBy(window, "primary_seller_id").agg(F.avg(F.col("is_late").cast("double")).alias("propensity_w"))
    return df.join(r, [window, "primary_seller_id"], "left")
