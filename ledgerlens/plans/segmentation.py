"""Entry point A: customer features, clustering-ready matrix, segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.features import cluster_ready, customer_features, rfm
from ledgerlens.sources.tables import Tables

# the six behavioural features of the final segmentation (fixed list)
FINAL_CLUSTER_FEATURES = ["recency_days", "monetary_log", "category_diversity",
                          "avg_freight_ratio_log", "avg_installments", "avg_review_score"]


def customer_table(t: Tables) -> DataFrame:
    return customer_features(t, rfm(t.orders, t.customers, t.payments))


def clustering_ready(t: Tables) -> DataFrame:
    """Payment types come from the data (one dummy column each)."""
    return cluster_ready(customer_table(t))
