"""Registered queries: splits and temporal operators (W1-W9, A22, U1, F6) and seller
features (A15 M6 M7 M8 A16 A20 J10 F12), plus V12 / U2-U4 on the split."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.functions.temporal import month_start, ntz_lit
from ledgerlens.operators import ordering as O
from ledgerlens.operators import quality as Q
from ledgerlens.operators.features import rate_encode, stage_stats_at_cutoff, stats_at_cutoff
from ledgerlens.plans import delivery as D
from ledgerlens.plans.oracle_views import SPLIT
from ledgerlens.plans.queries_base import T, mart
from ledgerlens.plans.registry import R, query

TS = "order_purchase_timestamp"


def trimmed(spark, sf_dir):
    return D.trimmed_mart(T(spark, sf_dir))[0]


@query("chrono_split", """
SELECT (SELECT split_ts FROM c_split) AS split_ts, count(*) AS n_rows,
       count(*) FILTER (WHERE split = 'train') AS train_rows, count(*) FILTER (WHERE split = 'test') AS test_rows,
       avg(CAST(is_late AS DOUBLE)) FILTER (WHERE split = 'train') AS train_late_rate,
       avg(CAST(is_late AS DOUBLE)) FILTER (WHERE split = 'test') AS test_late_rate
FROM c_split_rows
""", mart=True, extra=SPLIT, rnd=R("train_late_rate", "test_late_rate"), ids="W1 T8 F6")
def q_chrono_split(spark, sf_dir):
    df, split_ts = D.split_frame(trimmed(spark, sf_dir))
    lab = F.col("is_late").cast("double")
    return df.agg(ntz_lit(split_ts).alias("split_ts"), F.count(F.lit(1)).alias("n_rows"),
                  F.count_if(F.col("split") == "train").alias("train_rows"),
                  F.count_if(F.col("split") == "test").alias("test_rows"),
                  F.avg(F.when(F.col("split") == "train", lab)).alias("train_late_rate"),
                  F.avg(F.when(F.col("split") == "test", lab)).alias("test_late_rate"))


@query("rolling_folds", """
SELECT chunk, count(*) AS "rows", min(order_purchase_timestamp) AS start_ts, max(order_purchase_timestamp) AS end_ts,
       avg(CAST(is_late AS DOUBLE)) AS late_rate
FROM c_folds WHERE chunk IS NOT NULL GROUP BY chunk
""", mart=True, extra=SPLIT, rnd=R("late_rate"), ids="W2 T9")
def q_rolling_folds(spark, sf_dir):
    f = O.rolling_folds(trimmed(spark, sf_dir), TS, "order_id", 5)
    return f.where(F.col("chunk").isNotNull()).groupBy("chunk").agg(
        F.count(F.lit(1)).alias("rows"), F.min(TS).alias("start_ts"), F.max(TS).alias("end_ts"),
        F.avg(F.col("is_late").cast("double")).alias("late_rate"))


@query("row_index", """
SELECT order_id, row_idx FROM c_idx
""", mart=True, extra=SPLIT, ids="W2")
def q_row_index(spark, sf_dir):
    return O.row_index(trimmed(spark, sf_dir), [TS, "order_id"]).select("order_id", "row_idx")


@query("walk_months", """
SELECT year_month, CAST(dense_rank() OVER (ORDER BY year_month) - 1 AS INTEGER) AS month_idx, test_size, test_late,
       CAST(coalesce(sum(test_size) OVER (ORDER BY year_month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS train_size,
       dense_rank() OVER (ORDER BY year_month) - 1 >= 9 AND test_late >= 5 AND test_size >= 50 AS evaluated
FROM (SELECT CAST(date_trunc('month', order_purchase_timestamp) AS TIMESTAMP) AS year_month,
             count(*) AS test_size, CAST(sum(CAST(is_late AS INTEGER)) AS BIGINT) AS test_late
      FROM c_trim GROUP BY 1)
""", mart=True, extra=SPLIT, ids="W3 T17")
def q_walk_months(spark, sf_dir):
    from ledgerlens.plans.walk_forward import month_plan
    return month_plan(D.with_month(trimmed(spark, sf_dir)), "year_month", "is_late")


@query("quantile_windows", """
SELECT window_label, min(order_purchase_timestamp) AS "start", max(order_purchase_timestamp) AS "end", count(*) AS n FROM (
  SELECT order_purchase_timestamp,
         CASE WHEN x <= q[1] THEN 'Q1' WHEN x <= q[2] THEN 'Q2' WHEN x <= q[3] THEN 'Q3' ELSE 'Q4' END AS window_label
  FROM (SELECT order_purchase_timestamp, CAST(epoch_us(order_purchase_timestamp) AS DOUBLE) AS x FROM c_trim),
       (SELECT quantile_cont(CAST(epoch_us(order_purchase_timestamp) AS DOUBLE), [0.25, 0.5, 0.75]) AS q FROM c_trim))
GROUP BY window_label
""", mart=True, extra=SPLIT, ids="W5 A22 T25 X11")
def q_quantile_windows(spark, sf_dir):
    from ledgerlens.operators.profile import window_range
    w = O.quantile_bins(trimmed(spark, sf_dir), TS, ["Q1", "Q2", "Q3", "Q4"], name="window_label")
    return window_range(w, "window_label", TS)


@query("trim_tail", """
SELECT (SELECT cutoff FROM c_cut) AS cutoff, (SELECT count(*) FROM c_mart) AS rows_before,
       (SELECT count(*) FROM c_trim) AS rows_after, (SELECT count(*) FROM c_mart) - (SELECT count(*) FROM c_trim) AS rows_removed
""", mart=True, extra=SPLIT, ids="W9 T10 F6")
def q_trim_tail(spark, sf_dir):
    m = mart(spark, sf_dir)
    cut = D.auto_trim_cutoff(m)
    _, rep = O.trim_tail(m, TS, ntz_lit(cut))
    return rep.select(ntz_lit(cut).alias("cutoff"), "rows_before", "rows_after", "rows_removed")


@query("weekly_volume", """
SELECT CAST(w.bucket AS TIMESTAMP) AS bucket, coalesce(c.n, 0) AS n FROM (
  SELECT CAST(unnest(generate_series(CAST(min(bucket) AS TIMESTAMP), CAST(max(bucket) AS TIMESTAMP), INTERVAL 7 DAY)) AS DATE) AS bucket
  FROM (SELECT CAST(order_purchase_timestamp AS DATE) + CAST(7 - isodow(order_purchase_timestamp) AS INTEGER) AS bucket FROM c_mart)) w
LEFT JOIN (SELECT CAST(order_purchase_timestamp AS DATE) + CAST(7 - isodow(order_purchase_timestamp) AS INTEGER) AS bucket, count(*) AS n
           FROM c_mart GROUP BY 1) c ON w.bucket = c.bucket
""", mart=True, ids="W7 T26")
def q_weekly_volume(spark, sf_dir):
    return O.resample_count(mart(spark, sf_dir), TS, "W")


@query("daily_volume", """
SELECT CAST(day AS TIMESTAMP) AS bucket, n FROM c_daily ORDER BY day DESC LIMIT 21
""", mart=True, extra=SPLIT, ids="W7 W8")
def q_daily_volume(spark, sf_dir):
    return O.resample_count(mart(spark, sf_dir), TS, "D").orderBy(F.col("bucket").desc()).limit(21)


@query("first_alias_state", """
SELECT customer_unique_id, arg_min(customer_state, customer_id) AS customer_state FROM c_customers GROUP BY customer_unique_id
""", ids="W6")
def q_first_alias_state(spark, sf_dir):
    c = T(spark, sf_dir).customers.select("customer_unique_id", "customer_id", "customer_state")
    return O.keep_first(c, ["customer_unique_id"], ["customer_id"]).select("customer_unique_id", "customer_state")


@query("domain_overlap", """
SELECT 'right_not_left' AS direction, count(*) AS n FROM (SELECT DISTINCT primary_category FROM c_split_rows WHERE split = 'test'
   EXCEPT SELECT DISTINCT primary_category FROM c_split_rows WHERE split = 'train')
UNION ALL SELECT 'left_not_right', count(*) FROM (SELECT DISTINCT primary_category FROM c_split_rows WHERE split = 'train'
   EXCEPT SELECT DISTINCT primary_category FROM c_split_rows WHERE split = 'test')
UNION ALL SELECT 'right_distinct', count(DISTINCT primary_category) FROM c_split_rows WHERE split = 'test'
UNION ALL SELECT 'unseen_sellers', count(*) FROM (SELECT DISTINCT primary_seller_id FROM c_split_rows WHERE split = 'test'
   EXCEPT SELECT DISTINCT primary_seller_id FROM c_split_rows WHERE split = 'train')
""", mart=True, extra=SPLIT, ids="V12 U2 U4")
def q_domain_overlap(spark, sf_dir):
    df, _ = D.split_frame(trimmed(spark, sf_dir))
    tr, te = df.where(F.col("split") == "train"), df.where(F.col("split") == "test")
    cats = Q.domain_overlap(tr, te, "primary_category")
    sellers = Q.domain_overlap(tr, te, "primary_seller_id").where(F.col("direction") == "right_not_left") \
        .select(F.lit("unseen_sellers").alias("direction"), "n")
    return cats.unionByName(sellers)


@query("entity_intersection", """
SELECT count(*) AS common_sellers,
       (SELECT count(DISTINCT primary_seller_id) FROM c_windows WHERE window_label = 'A') AS sellers_a,
       (SELECT count(DISTINCT primary_seller_id) FROM c_windows WHERE window_label = 'B') AS sellers_b
FROM (SELECT DISTINCT primary_seller_id FROM c_windows WHERE window_label = 'A'
      INTERSECT SELECT DISTINCT primary_seller_id FROM c_windows WHERE window_label = 'B')
""", mart=True, extra=SPLIT, ids="U3 W4")
def q_entity_intersection(spark, sf_dir):
    w = D.comparison_windows(trimmed(spark, sf_dir))
    a = w.where(F.col("window_label") == "A").select("primary_seller_id").distinct()
    b = w.where(F.col("window_label") == "B").select("primary_seller_id").distinct()
    common = a.intersect(b)
    return common.agg(F.count(F.lit(1)).alias("common_sellers")).select(
        "common_sellers", F.lit(a.count()).cast("long").alias("sellers_a"), F.lit(b.count()).cast("long").alias("sellers_b"))


# ------------------------------------------------------------------ seller features

@query("seller_rate_encoded", """
SELECT order_id, split, seller_on_time_rate, is_new_or_thin_history_seller FROM c_encoded
""", mart=True, extra=SPLIT, rnd=R("seller_on_time_rate"), ids="A15 M6 J10 F12 F7")
def q_seller_rate_encoded(spark, sf_dir):
    df, _ = D.split_frame(trimmed(spark, sf_dir))
    enc = rate_encode(df.where(F.col("split") == "train"), df, "primary_seller_id", "is_late", 5)
    return enc.select("order_id", "split", "seller_on_time_rate", "is_new_or_thin_history_seller")


_MONTHS = """
c_m AS (SELECT *, CAST(date_trunc('month', order_purchase_timestamp) AS TIMESTAMP) AS year_month FROM c_trim),
c_cutoffs AS (SELECT DISTINCT year_month AS cutoff FROM c_m)"""


@query("seller_rate_by_cutoff", """
SELECT c.cutoff, m.primary_seller_id, count(m.is_late) AS entity_orders,
       1 - (SELECT CAST(sum(CAST(is_late AS INTEGER)) AS DOUBLE) / count(*) FROM c_m WHERE year_month < c.cutoff) AS overall_on_time_rate,
       count(m.is_late) >= 5 AS has_sufficient_history,
       CASE WHEN count(m.is_late) >= 5 THEN 1 - CAST(sum(CAST(m.is_late AS INTEGER)) AS DOUBLE) / count(m.is_late)
            ELSE 1 - (SELECT CAST(sum(CAST(is_late AS INTEGER)) AS DOUBLE) / count(*) FROM c_m WHERE year_month < c.cutoff) END AS entity_on_time_rate
FROM c_cutoffs c JOIN c_m m ON m.year_month < c.cutoff
GROUP BY c.cutoff, m.primary_seller_id
""", mart=True, extra=SPLIT + "," + _MONTHS, rnd=R("overall_on_time_rate", "entity_on_time_rate"), ids="M7 §4.3-d")
def q_seller_rate_by_cutoff(spark, sf_dir):
    m = D.with_month(trimmed(spark, sf_dir))
    cut = m.select(F.col("year_month").alias("cutoff")).distinct()
    return stats_at_cutoff(m, "primary_seller_id", "is_late", "year_month", cut, 5).select(
        "cutoff", "primary_seller_id", "entity_orders", "overall_on_time_rate", "has_sufficient_history",
        "entity_on_time_rate")


_STAGES = ["stage2_approval_to_carrier_hrs", "stage3_carrier_to_customer_hrs"]


_STAGE_CTES = """
c_s AS (SELECT primary_seller_id, year_month,
                  date_diff('microsecond', order_approved_at, order_delivered_carrier_date) / 3600000000.0 AS s2,
                  date_diff('microsecond', order_delivered_carrier_date, order_delivered_customer_date) / 3600000000.0 AS s3
           FROM c_m),
c_e AS (SELECT c.cutoff, s.primary_seller_id, count(*) AS stage_orders,
             avg(s.s2) AS avg_stage2_approval_to_carrier_hrs, avg(s.s3) AS avg_stage3_carrier_to_customer_hrs
      FROM c_cutoffs c JOIN c_s s ON s.year_month < c.cutoff WHERE s.s2 >= 0 AND s.s3 >= 0
      GROUP BY c.cutoff, s.primary_seller_id)"""


@query("seller_stage_features", """
SELECT e.*, avg(avg_stage2_approval_to_carrier_hrs) OVER (PARTITION BY cutoff) AS fallback_stage2_approval_to_carrier_hrs,
       avg(avg_stage3_carrier_to_customer_hrs) OVER (PARTITION BY cutoff) AS fallback_stage3_carrier_to_customer_hrs
FROM c_e e
""", mart=True, extra=SPLIT + "," + _MONTHS + "," + _STAGE_CTES,
       rnd=R(*[f"avg_{s}" for s in _STAGES], *[f"fallback_{s}" for s in _STAGES], d=5), ids="M8 A16 A20 V13")
def q_seller_stage_features(spark, sf_dir):
    m = D.with_stages(D.with_month(trimmed(spark, sf_dir)))
    cut = m.select(F.col("year_month").alias("cutoff")).distinct()
    return stage_stats_at_cutoff(m, "primary_seller_id", _STAGES, "year_month", cut)
