"""Entry point B: the delivered-order feature mart and what is derived from it.

Plan shape at scale: orders, the item roll-up and the installments roll-up are all keyed by
order_id, so they meet in sort-merge joins on one hash partitioning (the roll-ups come out
of their aggregates already partitioned by order_id). Sellers and the zip centroid table
are dimensions (AQE broadcasts them when their measured size is under the threshold,
otherwise sort-merge with skew-join splitting). The mart is written/persisted once and
everything after it is a function of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.geo import haversine_km, in_box
from ledgerlens.functions.temporal import hours_between, fractional_days, month_start, ntz_lit, weekday_mon0
from ledgerlens.operators.features import (BRAZIL_BOX, attach_point, geo_centroid, max_per_key, order_rollup,
                                           rollup_items)
from ledgerlens.sources.facts import Facts
from ledgerlens.sources.tables import Tables

MART_COLUMNS = [
    "order_id", "customer_id", "order_purchase_timestamp", "order_approved_at",
    "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date",
    "is_late", "purchase_dow", "purchase_month", "item_count", "total_freight", "avg_price",
    "total_weight_g", "total_volume_cm3", "primary_seller_id", "primary_category", "payment_installments",
    "seller_lat", "seller_lng", "customer_lat", "customer_lng", "seller_customer_distance_km",
]

# Checkout-time feature set of the delivery-risk model (fixed list)
BASELINE_FEATURES = [
    "seller_customer_distance_km", "total_weight_g", "total_volume_cm3",
    "total_freight", "avg_price", "item_count", "payment_installments",
    "seller_on_time_rate", "is_new_or_thin_history_seller",
    "purchase_dow", "purchase_month",
]


def late_flag(delivered: str = "order_delivered_customer_date",
              estimated: str = "order_estimated_delivery_date") -> F.Column:
    """Delivered after the estimate; a missing delivery date counts as on time."""
    return F.coalesce(F.col(delivered) > F.col(estimated), F.lit(False))


def delivered_orders(t: Tables | Facts) -> DataFrame:
    """F2 + F9 + X3: delivered orders with the late flag and calendar features."""
    return (t.orders.where(F.col("order_status") == "delivered")
            .withColumn("is_late", late_flag())
            .withColumn("purchase_dow", weekday_mon0("order_purchase_timestamp"))
            .withColumn("purchase_month", F.month("order_purchase_timestamp")))


def order_mart_unfiltered(t: Tables) -> DataFrame:
    """Delivered orders + roll-ups + coordinates + distance, before the exclusions."""
    roll = order_rollup(t.order_items, t.products, t.category_translation, t.item_order)
    inst = max_per_key(t.payments, "order_id", "payment_installments")
    cent = geo_centroid(t.geolocation)
    seller_geo = attach_point(t.sellers.select("seller_id", "seller_zip_code_prefix"), cent,
                              "seller_zip_code_prefix", "seller").drop("seller_zip_code_prefix")
    cust_geo = attach_point(t.customers.select("customer_id", "customer_zip_code_prefix"), cent,
                            "customer_zip_code_prefix", "customer").drop("customer_zip_code_prefix")
    m = (attach_stars(delivered_orders(t), roll, inst)
         .join(seller_geo.withColumnRenamed("seller_id", "primary_seller_id"), "primary_seller_id", "left")
         .join(cust_geo, "customer_id", "left")
         .withColumn("seller_customer_distance_km",
                     haversine_km("seller_lat", "seller_lng", "customer_lat", "customer_lng")))
    return m.select(*MART_COLUMNS)


def order_mart_of_facts(f: Facts) -> DataFrame:
    """The mart from bucketed facts: orders, item roll-up and installments meet without a shuffle; only the points of
    sellers and customers (dimensions) are joined by other keys."""
    cent = geo_centroid(f.geolocation)
    seller_geo = attach_point(f.sellers.select("seller_id", "seller_zip_code_prefix"), cent,
                              "seller_zip_code_prefix", "seller").drop("seller_zip_code_prefix")
    m = (attach_stars(delivered_orders(f), rollup_items(f.items, f.item_order), max_per_key(f.payments, "order_id", "payment_installments"))
         .join(seller_geo.withColumnRenamed("seller_id", "primary_seller_id"), "primary_seller_id", "left"))
    m = attach_point(m, cent, "customer_zip_code_prefix", "customer").withColumn(
        "seller_customer_distance_km", haversine_km("seller_lat", "seller_lng", "customer_lat", "customer_lng"))
    return in_scope(m.select(*MART_COLUMNS))


def attach_stars(orders: DataFrame, roll: DataFrame, inst: DataFrame) -> DataFrame:
    """J4 at order grain: the roll-ups beside their order."""
    return (orders.join(roll, "order_id", "left").join(inst, "order_id", "left")
            .withColumn("primary_category", F.coalesce(F.col("primary_category"), F.lit("unknown"))))


def order_mart(t: Tables) -> DataFrame:
    """The delivered-order feature mart (one row per order)."""
    return in_scope(order_mart_unfiltered(t))


def in_scope(m: DataFrame) -> DataFrame:
    """Exclusions, in the reference's order: orders without any payment row (F3), orders
    without a distance (F4), and orders with either endpoint outside the box (F5)."""
    lat_lo, lat_hi, lng_lo, lng_hi = BRAZIL_BOX
    return m.where(F.col("payment_installments").isNotNull()
                   & F.col("seller_customer_distance_km").isNotNull()
                   & in_box("customer_lat", "customer_lng", lat_lo, lat_hi, lng_lo, lng_hi)
                   & in_box("seller_lat", "seller_lng", lat_lo, lat_hi, lng_lo, lng_hi))


def with_stages(df: DataFrame) -> DataFrame:
    """Delivery legs in hours, estimated window, actual days and slack."""
    return (df.withColumn("stage1_purchase_to_approval_hrs",
                          hours_between("order_approved_at", "order_purchase_timestamp"))
              .withColumn("stage2_approval_to_carrier_hrs",
                          hours_between("order_delivered_carrier_date", "order_approved_at"))
              .withColumn("stage3_carrier_to_customer_hrs",
                          hours_between("order_delivered_customer_date", "order_delivered_carrier_date"))
              .withColumn("estimated_delivery_window_days",
                          fractional_days("order_estimated_delivery_date", "order_purchase_timestamp"))
              .withColumn("actual_total_delivery_days",
                          fractional_days("order_delivered_customer_date", "order_purchase_timestamp"))
              .withColumn("slack_days", F.col("estimated_delivery_window_days") - F.col("actual_total_delivery_days")))


def with_month(df: DataFrame, ts: str = "order_purchase_timestamp", name: str = "year_month") -> DataFrame:
    return df.withColumn(name, month_start(ts))


def auto_trim_cutoff(df: DataFrame, ts: str = "order_purchase_timestamp", share: float = 0.5):
    """W9 rule: the last day whose (zero-filled) daily count is at least ``share`` times the
    median daily count. Returns a midnight timestamp (so ``ts <= cutoff`` drops the later
    part of that day too, T10)."""
    import datetime as _dt
    from ledgerlens.operators.ordering import resample_count
    # the daily series has one row per calendar day (bounded by the time span, not by the
    # data volume), so an exact percentile over it is a small single aggregate
    daily = materialise(resample_count(df, ts, "D"))
    med = daily.agg(F.percentile("n", 0.5).alias("q")).first()["q"]
    if med is None:
        return None
    day = daily.where(F.col("n") >= share * med).agg(F.max("bucket").alias("d")).first()["d"]
    return None if day is None else _dt.datetime(day.year, day.month, day.day)


def materialise(df: DataFrame) -> DataFrame:
    """Write a reused intermediate once as Parquet in the cluster's shared folder: later eager steps read the columns
    they need instead of re-running its joins, and lineage is cut, so a lost executor does not replay the plan."""
    from ledgerlens.operators.selection import kept
    return kept(df)[0]


def trimmed_mart(t: Tables) -> tuple[DataFrame, object]:
    """The mart without its truncated export tail (W9); the mart is materialised once."""
    m = materialise(order_mart(t))
    cut = auto_trim_cutoff(m)
    return (m if cut is None else m.where(F.col("order_purchase_timestamp") <= ntz_lit(cut))), cut


def split_frame(df: DataFrame, ts: str = "order_purchase_timestamp", frac: float = 0.8) -> tuple[DataFrame, object]:
    """W1 applied: adds ``split`` = train / test around the positional split timestamp."""
    from ledgerlens.operators.ordering import chrono_split, with_split
    split_ts, _ = chrono_split(df, ts, frac)
    return with_split(df, ts, split_ts), split_ts


def comparison_windows(df: DataFrame, ts: str = "order_purchase_timestamp", k: int = 5,
                       name: str = "window_label") -> DataFrame:
    """Label the test windows of the last two rolling folds 'A' (chunk k-1) and 'B'
    (chunk k through the end of the data) in one pass."""
    from ledgerlens.operators.ordering import rank_code
    from ledgerlens.operators.selection import select_ranks
    size = lambda n: F.floor(n / (k + 1)).cast("long")
    begins = [(i / (k + 1), lambda n, i=i: F.array(size(n) * i)) for i in (k - 1, k)]
    found = {r["target"]: r for r in select_ranks(df, ts, rank_code(df, ts), [], begins + [(1.0, lambda n: F.array(n - 1))]).collect()}
    if not found or found[2]["total"] // (k + 1) == 0:
        return df.withColumn(name, F.lit(None).cast("string"))
    a, b, last = (found[t]["value"] for t in range(3))
    c = F.col(ts)
    lab = (F.when((c >= ntz_lit(a)) & (c < ntz_lit(b)), F.lit("A"))
            .when((c >= ntz_lit(b)) & (c <= ntz_lit(last)), F.lit("B")))
    return df.withColumn(name, lab)
