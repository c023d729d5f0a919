"""Entity feature builders: A7 A9 A13 A15 A16 A20 M6 M7 M8 M13 M14 J3 J4 J8 J10.

Order-level builders pre-aggregate the many-side (items, payments) on its key before joining;
person-level means need every item, payment and review once, so these meet the bridge on
``order_id`` (spread, never a category or person key). Every aggregate is partial/final (map-side combine), so a
hot key is reduced before the shuffle. "First in row order" is ``min_by`` over an explicit
ordering struct, never ``first()`` (which depends on shuffle order).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.geo import haversine_km, in_box
from ledgerlens.functions.numeric import safe_ratio
from ledgerlens.functions.temporal import ntz_lit, plus_days, whole_days_between


def first_non_null(value: str | Column, order_cols: Sequence[str]) -> Column:
    """Value of the first row (by ``order_cols``) whose value is not null."""
    v = F.col(value) if isinstance(value, str) else value
    return F.min_by(v, F.when(v.isNotNull(), F.struct(*[F.col(c) for c in order_cols])))


def sum_zero(col: str | Column) -> Column:
    """A2: sum where an all-null group gives 0 (reference-style sums, T1)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.sum(c), F.lit(0).cast("double"))


# ---------------------------------------------------------------- geography

def geo_centroid(geo: DataFrame, zip_col: str = "geolocation_zip_code_prefix",
                 lat: str = "geolocation_lat", lng: str = "geolocation_lng") -> DataFrame:
    """Mean lat/lng per zip prefix -> (zip, lat, lng)."""
    return geo.groupBy(F.col(zip_col).alias("zip")).agg(F.avg(lat).alias("lat"), F.avg(lng).alias("lng"))


def attach_point(df: DataFrame, centroid: DataFrame, zip_col: str, prefix: str) -> DataFrame:
    """Left-join the centroid of ``zip_col`` as ``{prefix}_lat``/``{prefix}_lng``."""
    c = centroid.select(F.col("zip").alias("_zip"), F.col("lat").alias(f"{prefix}_lat"),
                        F.col("lng").alias(f"{prefix}_lng"))
    return df.join(c, df[zip_col] == c["_zip"], "left").drop("_zip")


BRAZIL_BOX = (-34.0, 6.0, -75.0, -33.0)  # fixed values: lat -34..6, lng -75..-33


# ---------------------------------------------------------------- order level

def item_enrichment(items: DataFrame, products: DataFrame, translation: DataFrame | None) -> DataFrame:
    """Items + product dims + English category (falls back to the original name), X8 volume."""
    p = products.select("product_id", "product_category_name", "product_weight_g",
                        (F.col("product_length_cm") * F.col("product_height_cm") * F.col("product_width_cm"))
                        .alias("volume_cm3"))
    cat = F.col("product_category_name")
    if translation is not None:
        # translate the product dimension, never the item facts: a category is a hot key
        p = p.join(translation.select("product_category_name", "product_category_name_english"),
                   "product_category_name", "left")
        cat = F.coalesce(F.col("product_category_name_english"), cat)
    return items.join(p.withColumn("category_en", cat), "product_id", "left")


def order_rollup(items: DataFrame, products: DataFrame, translation: DataFrame | None,
                 item_order: Sequence[str], key: str = "order_id") -> DataFrame:
    """One row per order with counts, sums, mean price and primary seller/category."""
    return rollup_items(item_enrichment(items, products, translation), item_order, key)


def rollup_items(e: DataFrame, item_order: Sequence[str], key: str = "order_id") -> DataFrame:
    """A9 over items that carry their product's attributes."""
    return e.groupBy(key).agg(
        F.count("order_item_id").alias("item_count"),
        sum_zero("freight_value").alias("total_freight"),
        F.avg("price").alias("avg_price"),
        sum_zero("product_weight_g").alias("total_weight_g"),
        sum_zero("volume_cm3").alias("total_volume_cm3"),
        first_non_null("seller_id", item_order).alias("primary_seller_id"),
        first_non_null("category_en", item_order).alias("primary_category"),
    )


def max_per_key(df: DataFrame, key: str, col: str, alias: str | None = None) -> DataFrame:
    """A4: max of ``col`` per ``key``."""
    return df.groupBy(key).agg(F.max(col).alias(alias or col))


# ---------------------------------------------------------------- customer level

def person_bridge(orders: DataFrame, customers: DataFrame, person: str = "customer_unique_id") -> DataFrame:
    """One order -> person bridge (order_id, customer_id, person), built once and reused."""
    c = customers.select("customer_id", person)
    return (orders.select("order_id", "customer_id").join(c, "customer_id", "left")
            .where(F.col(person).isNotNull()))


def rfm(orders: DataFrame, customers: DataFrame, payments: DataFrame,
        person: str = "customer_unique_id", ts: str = "order_purchase_timestamp",
        status: str | None = "delivered", drop_unpaid: bool = True) -> DataFrame:
    """Recency (whole days to global max + 1 day), frequency, monetary, repeat flag.

    ``drop_unpaid`` removes persons none of whose orders has a payment row (F3,
    generalising the reference's hard-coded exclusion of the one such customer).
    """
    o = orders if status is None else orders.filter(F.col("order_status") == status)
    named = o.select("order_id", "customer_id", ts).join(customers.select("customer_id", person), "customer_id", "left")
    return rfm_of_named(named, payments, person, ts, drop_unpaid)


def rfm_of_named(named: DataFrame, payments: DataFrame, person: str = "customer_unique_id",
                 ts: str = "order_purchase_timestamp", drop_unpaid: bool = True) -> DataFrame:
    """A7 over orders that carry their person."""
    pay = payments.groupBy("order_id").agg(F.sum("payment_value").alias("payment_value"))
    base = (named.select("order_id", person, ts).where(F.col(person).isNotNull())
            .join(pay, "order_id", "left"))
    ref = base.agg(F.max(ts).alias("m")).first()["m"]  # one-row global scalar (A21)
    if ref is None:
        ref_col = F.lit(None).cast("timestamp_ntz")
    else:
        ref_col = plus_days(ntz_lit(ref), 1)
    out = base.groupBy(person).agg(
        whole_days_between(ref_col, F.max(ts)).alias("recency_days"),
        F.countDistinct("order_id").alias("frequency"),
        sum_zero("payment_value").alias("monetary"),
        F.count("payment_value").alias("_paid_orders"),
    ).withColumn("is_repeat_customer", F.col("frequency") > 1)
    if drop_unpaid:
        out = out.filter(F.col("_paid_orders") > 0)
    return out.drop("_paid_orders")


def customer_features(t, rfm_df: DataFrame | None = None, person: str = "customer_unique_id",
                      fill_unknown_category: bool = True) -> DataFrame:
    """RFM + category diversity, avg freight ratio, avg installments, avg review,
    preferred payment type (mode, ties -> lowest). Enrichments use all orders (T27).

    ``fill_unknown_category`` is the corrected diversity (T5): a null category counts as
    the value 'unknown' instead of being ignored.
    """
    r = rfm_df if rfm_df is not None else rfm(t.orders, t.customers, t.payments, person)
    bridge = person_bridge(t.orders, t.customers, person).select("order_id", person)
    named = (t.order_items.select("order_id", "product_id", "price", "freight_value")
             .join(t.products.select("product_id", "product_category_name"), "product_id", "left"))
    return enriched_people(r, bridge, named, t.payments, t.reviews, person, fill_unknown_category)


def enriched_people(r: DataFrame, bridge: DataFrame, named_items: DataFrame, payments: DataFrame, reviews: DataFrame,
                    person: str = "customer_unique_id", fill_unknown_category: bool = True) -> DataFrame:
    """M14 from the RFM table, an (order_id, person) bridge, items with their category, payments and reviews."""
    items = named_items.select("order_id", "product_category_name", "price", "freight_value").join(bridge, "order_id", "inner")
    cat = F.col("product_category_name")
    if fill_unknown_category:
        cat = F.coalesce(cat, F.lit("unknown"))
    item_feats = items.groupBy(person).agg(
        F.countDistinct(cat).alias("category_diversity"),
        F.avg(safe_ratio("freight_value", "price")).alias("avg_freight_ratio"))

    pays = payments.select("order_id", "payment_type", "payment_installments").join(bridge, "order_id", "inner")
    pay_feats = pays.groupBy(person).agg(
        F.avg("payment_installments").alias("avg_installments"),
        F.mode("payment_type", True).alias("preferred_payment_type"))

    rev = (reviews.select("order_id", "review_score").join(bridge, "order_id", "inner")
           .groupBy(person).agg(F.avg("review_score").alias("avg_review_score")))

    return (r.join(item_feats, person, "left").join(pay_feats, person, "left").join(rev, person, "left")
            .select(person, "recency_days", "frequency", "monetary", "is_repeat_customer",
                    "category_diversity", "avg_freight_ratio", "avg_installments", "avg_review_score",
                    "preferred_payment_type"))


def cluster_ready(features: DataFrame, payment_values: Sequence[str] | None = None,
                  rare_map: dict | None = None) -> DataFrame:
    """Drop customers without a review, fold rare payment type, log1p transforms,
    payment dummies (R1)."""
    from ledgerlens.operators.reshape import one_hot
    rare_map = {"not_defined": "boleto"} if rare_map is None else rare_map
    ptype = F.col("preferred_payment_type")
    for src, dst in rare_map.items():
        ptype = F.when(ptype == src, F.lit(dst)).otherwise(ptype)
    df = (features.dropna(subset=["avg_review_score"])
          .withColumn("preferred_payment_type", ptype)
          .withColumn("monetary_log", F.log1p("monetary"))
          .withColumn("avg_freight_ratio_log", F.log1p("avg_freight_ratio")))
    return one_hot(df, "preferred_payment_type", "payment", values=payment_values)


# ---------------------------------------------------------------- leakage-safe rates

def entity_rate_stats(train: DataFrame, entity: str, label: str, min_n: int = 5) -> tuple[DataFrame, float]:
    """Per-entity count and on-time rate on ``train``; (stats, overall on-time rate)."""
    lab = F.col(label).cast("double")
    overall = train.agg(F.avg(lab).alias("r")).first()["r"]
    overall_on_time = None if overall is None else 1.0 - overall
    stats = (train.groupBy(entity)
             .agg(F.count(label).alias("entity_orders"), F.avg(lab).alias("entity_late_rate"))
             .withColumn("has_sufficient_history", F.col("entity_orders") >= min_n)
             .withColumn("entity_on_time_rate",
                         F.when(F.col("has_sufficient_history"), 1 - F.col("entity_late_rate"))
                          .otherwise(F.lit(overall_on_time))))
    return stats, overall_on_time


def rate_encode(train: DataFrame, apply: DataFrame, entity: str, label: str, min_n: int = 5,
                rate_col: str = "seller_on_time_rate", flag_col: str = "is_new_or_thin_history_seller") -> DataFrame:
    """M6: attach the train-only on-time rate of ``entity``; thin (< min_n) or unseen
    entities get the overall train rate and the thin-history flag."""
    stats, overall = entity_rate_stats(train, entity, label, min_n)
    return with_entity_rates(apply, stats, overall, entity, rate_col, flag_col)


def with_entity_rates(apply: DataFrame, stats: DataFrame, overall: float | None, entity: str, rate_col: str = "seller_on_time_rate",
                      flag_col: str = "is_new_or_thin_history_seller", sent: bool = False) -> DataFrame:
    """M6 from ``entity_rate_stats``; ``sent``: the statistics go to the rows (broadcast)."""
    s = stats.select(entity, F.col("entity_on_time_rate").alias(rate_col), "has_sufficient_history")
    return (apply.join(F.broadcast(s) if sent else s, entity, "left")
            .withColumn(rate_col, F.coalesce(F.col(rate_col), F.lit(overall)))
            .withColumn(flag_col, ~F.coalesce(F.col("has_sufficient_history"), F.lit(False)))
            .drop("has_sufficient_history"))


def _cutoff_values(cutoffs: DataFrame) -> Column:
    """The sorted distinct cutoffs as one array literal: months, bounded by the calendar."""
    col = cutoffs.columns[0]
    kind = cutoffs.schema[col].dataType
    values = sorted(r[0] for r in cutoffs.select(col).where(F.col(col).isNotNull()).distinct().collect())
    return F.array(*[F.lit(str(v)).cast(kind) for v in values]).cast(f"array<{kind.simpleString()}>")


def _as_of_cutoffs(per: DataFrame, entity: str, period: str, sums: Sequence[str], cuts: Column | DataFrame) -> DataFrame:
    """For every (cutoff, entity): the entity's sums over all periods strictly before the
    cutoff.

    Running sums per entity over its own periods (a window over at most #periods rows per
    entity, so a hot entity is no larger than any other), then each cutoff joins only the
    one interval [period, next_period) that precedes it - output is exactly one row per
    (entity, cutoff) with history, never entity-periods x cutoffs.
    """
    w = Window.partitionBy(entity).orderBy(period)
    run = per.select(entity, period, F.lead(period).over(w).alias("_next"),
                     *[F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in sums])
    cuts = _cutoff_values(cuts) if isinstance(cuts, DataFrame) else cuts
    # each row explodes its own slice of the cutoffs
    mine = F.filter(cuts, lambda c: (c > F.col(period)) & (F.col("_next").isNull() | (c <= F.col("_next"))))
    return run.withColumn("cutoff", F.explode(mine)).select("cutoff", entity, *sums)


def stats_at_cutoff(df: DataFrame, entity: str, label: str, period: str, cutoffs: DataFrame,
                    min_n: int = 5) -> DataFrame:
    """M7 / §4.3-d: entity on-time rate using only rows with ``period < cutoff``, for every
    cutoff at once.

    Aggregates once to (entity, period, n, n_late) - map-side combined, so a hot entity is
    one row per period - then takes the as-of running sums for each cutoff.
    Returns (cutoff, entity, entity_orders, entity_on_time_rate, has_sufficient_history,
    overall_on_time_rate).
    """
    lab = F.col(label).cast("int")
    per = df.groupBy(entity, period).agg(F.count(label).alias("n"), F.sum(lab).cast("long").alias("n_late"))
    cuts = _cutoff_values(cutoffs)
    ent = _as_of_cutoffs(per, entity, period, ["n", "n_late"], cuts).withColumnRenamed("n", "entity_orders")
    tot_p = per.groupBy(period).agg(F.sum("n").alias("n"), F.sum("n_late").alias("n_late")).withColumn("_all", F.lit(0))
    tot = (_as_of_cutoffs(tot_p, "_all", period, ["n", "n_late"], cuts)
           .select("cutoff", (1 - F.col("n_late") / F.col("n")).alias("overall_on_time_rate")))
    return (ent.join(F.broadcast(tot), "cutoff", "left")
            .withColumn("has_sufficient_history", F.col("entity_orders") >= min_n)
            .withColumn("entity_on_time_rate",
                        F.when(F.col("has_sufficient_history"), 1 - F.col("n_late") / F.col("entity_orders"))
                         .otherwise(F.col("overall_on_time_rate")))
            .drop("n_late"))


def stage_stats_at_cutoff(df: DataFrame, entity: str, stages: Sequence[str], period: str,
                          cutoffs: DataFrame) -> DataFrame:
    """Per (cutoff, entity) mean of each stage over rows before the cutoff
    where every stage is non-negative (V13 / T19: a null stage is excluded too), plus the
    per-cutoff fallback = unweighted mean of the entity means."""
    ok = F.lit(True)
    for s in stages:
        ok = ok & (F.col(s) >= 0)
    clean = df.filter(ok)
    aggs = [F.count(F.lit(1)).alias("n")] + [F.sum(s).alias(f"_s_{s}") for s in stages]
    per = clean.groupBy(entity, period).agg(*aggs)
    ent = _as_of_cutoffs(per, entity, period, ["n"] + [f"_s_{s}" for s in stages], _cutoff_values(cutoffs))
    ent = ent.select("cutoff", entity, F.col("n").alias("stage_orders"),
                     *[(F.col(f"_s_{s}") / F.col("n")).alias(f"avg_{s}") for s in stages])
    fb = ent.groupBy("cutoff").agg(*[F.avg(f"avg_{s}").alias(f"fallback_{s}") for s in stages])
    return ent.join(F.broadcast(fb), "cutoff", "left")


def entity_rate_full(df: DataFrame, entity: str, label: str, rate_col: str = "seller_on_time_rate") -> DataFrame:
    """On-time rate per entity over the full data (no threshold, no fallback)."""
    return df.groupBy(entity).agg((1 - F.avg(F.col(label).cast("double"))).alias(rate_col))
