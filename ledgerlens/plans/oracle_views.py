"""DuckDB-dialect SQL for the proxy tables and the shared marts, used by ``oracle_sql``.

This is an independent re-statement of ``ledgerlens.sources.proxy`` and of the mart
pipelines in plain SQL (row_number / arg_min instead of min_by structs, etc.), so the
driver's side-by-side check compares two separate implementations.
"""

PROXY = r"""
c_orders AS (
  SELECT o_orderkey AS order_id, o_orderkey AS customer_id, o_custkey AS customer_unique_id,
         CASE WHEN o_orderstatus = 'P' THEN 'canceled' ELSE 'delivered' END AS order_status,
         o_orderdate AS order_purchase_timestamp,
         o_orderdate + to_hours(CAST(o_orderkey % 30 AS INTEGER)) AS order_approved_at,
         o_orderdate + to_hours(CAST(20 + o_orderkey % 53 - CASE WHEN o_orderkey % 67 = 0 THEN 40 ELSE 0 END AS INTEGER)) AS order_delivered_carrier_date,
         CASE WHEN o_orderkey % 101 = 0 THEN NULL
              ELSE o_orderdate + to_hours(CAST(120 + (o_orderkey * 37 + o_custkey * 11) % 600 AS INTEGER)) END AS order_delivered_customer_date,
         o_orderdate + to_days(CAST(20 + o_orderkey % 9 AS INTEGER)) AS order_estimated_delivery_date
  FROM orders),
c_customers AS (
  SELECT o.o_orderkey AS customer_id, o.o_custkey AS customer_unique_id,
         c.c_nationkey AS customer_zip_code_prefix, n.n_name AS customer_state
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
                LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey),
c_items AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line_no,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS item_rank,
         l_partkey AS product_id, l_suppkey AS seller_id,
         CASE WHEN l_partkey % 211 = 0 THEN CAST(0 AS DOUBLE) ELSE l_extendedprice END AS price,
         l_extendedprice * l_tax AS freight_value
  FROM lineitem),
c_payments AS (
  SELECT l_orderkey AS order_id, l_linenumber AS payment_sequential,
         CASE WHEN l_orderkey % 61 = 0 THEN 'not_defined' WHEN l_returnflag = 'A' THEN 'boleto' WHEN l_returnflag = 'N' THEN 'credit_card'
              WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'voucher'
              WHEN l_returnflag = 'R' AND l_linestatus = 'O' THEN 'debit_card' END AS payment_type,
         CAST(1 + l_quantity % 10 AS INTEGER) AS payment_installments,
         l_extendedprice * (1 - l_discount) AS payment_value
  FROM lineitem),
c_reviews AS (
  SELECT event_id AS review_id, (event_id - event_id % 4) * 2 + event_id % 3 AS order_id,
         CAST(1 + CAST(floor(value) AS BIGINT) % 5 AS INTEGER) AS review_score,
         props AS review_comment_message
  FROM events),
c_products AS (
  SELECT p_partkey AS product_id,
         CASE WHEN p_partkey % 40 = 0 THEN NULL ELSE p_type END AS product_category_name,
         CASE WHEN p_partkey % 97 = 0 THEN NULL ELSE CAST(p_size * 100 AS DOUBLE) END AS product_weight_g,
         CAST(10 + p_size AS DOUBLE) AS product_length_cm,
         CAST(5 + p_size % 7 AS DOUBLE) AS product_height_cm,
         CAST(8 + p_size % 11 AS DOUBLE) AS product_width_cm
  FROM part),
c_sellers AS (
  SELECT s.s_suppkey AS seller_id, s.s_nationkey AS seller_zip_code_prefix, n.n_name AS seller_state
  FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey),
c_geo AS (
  SELECT n.n_nationkey AS zip,
         CAST((CASE WHEN n.n_nationkey = 24 THEN 12.0 ELSE -33 + 1.5 * n.n_nationkey END) + 0.01 * r.r_regionkey AS DOUBLE) AS lat,
         CAST(-74 + 1.6 * ((7 * n.n_nationkey) % 25) + 0.01 * r.r_regionkey AS DOUBLE) AS lng
  FROM nation n CROSS JOIN region r WHERE n.n_nationkey <> 13),
c_translation AS (
  SELECT DISTINCT p_type AS product_category_name, lower(p_type) AS product_category_name_english
  FROM part WHERE p_type <> 'PROMO')
"""

# Delivered-order feature mart (A9 J8 X9 F5 ...), the shared base of the delivery pipelines.
MART = r"""
c_centroid AS (SELECT zip, avg(lat) AS lat, avg(lng) AS lng FROM c_geo GROUP BY zip),
c_item_feats AS (
  SELECT i.order_id, i.item_rank, i.seller_id, i.price, i.freight_value, p.product_weight_g,
         p.product_length_cm * p.product_height_cm * p.product_width_cm AS volume_cm3,
         coalesce(t.product_category_name_english, p.product_category_name) AS category_en
  FROM c_items i LEFT JOIN c_products p ON i.product_id = p.product_id
                 LEFT JOIN c_translation t ON p.product_category_name = t.product_category_name),
c_rollup AS (
  SELECT order_id, count(item_rank) AS item_count,
         coalesce(sum(freight_value), 0) AS total_freight, avg(price) AS avg_price,
         coalesce(sum(product_weight_g), 0) AS total_weight_g,
         coalesce(sum(volume_cm3), 0) AS total_volume_cm3,
         arg_min(seller_id, item_rank) FILTER (WHERE seller_id IS NOT NULL) AS primary_seller_id,
         arg_min(category_en, item_rank) FILTER (WHERE category_en IS NOT NULL) AS primary_category
  FROM c_item_feats GROUP BY order_id),
c_inst AS (SELECT order_id, max(payment_installments) AS payment_installments FROM c_payments GROUP BY order_id),
c_seller_geo AS (SELECT s.seller_id, g.lat AS seller_lat, g.lng AS seller_lng
                 FROM c_sellers s LEFT JOIN c_centroid g ON s.seller_zip_code_prefix = g.zip),
c_customer_geo AS (SELECT c.customer_id, g.lat AS customer_lat, g.lng AS customer_lng
                   FROM c_customers c LEFT JOIN c_centroid g ON c.customer_zip_code_prefix = g.zip),
c_mart_raw AS (
  SELECT o.order_id, o.customer_id, o.order_purchase_timestamp, o.order_approved_at,
         o.order_delivered_carrier_date, o.order_delivered_customer_date, o.order_estimated_delivery_date,
         coalesce(o.order_delivered_customer_date > o.order_estimated_delivery_date, false) AS is_late,
         CAST(isodow(o.order_purchase_timestamp) - 1 AS INTEGER) AS purchase_dow,
         CAST(month(o.order_purchase_timestamp) AS INTEGER) AS purchase_month,
         r.item_count, r.total_freight, r.avg_price, r.total_weight_g, r.total_volume_cm3,
         r.primary_seller_id, coalesce(r.primary_category, 'unknown') AS primary_category,
         p.payment_installments, sg.seller_lat, sg.seller_lng, cg.customer_lat, cg.customer_lng
  FROM c_orders o
  LEFT JOIN c_rollup r ON o.order_id = r.order_id
  LEFT JOIN c_inst p ON o.order_id = p.order_id
  LEFT JOIN c_seller_geo sg ON r.primary_seller_id = sg.seller_id
  LEFT JOIN c_customer_geo cg ON o.customer_id = cg.customer_id
  WHERE o.order_status = 'delivered'),
c_mart_dist AS (
  SELECT * EXCLUDE (hs), 2 * 6371.0 * asin(CASE WHEN hs > 1.0 THEN 1.0 ELSE hs END) AS seller_customer_distance_km FROM (
    SELECT *, sqrt(pow(sin((radians(customer_lat) - radians(seller_lat)) / 2), 2)
                   + cos(radians(seller_lat)) * cos(radians(customer_lat))
                     * pow(sin((radians(customer_lng) - radians(seller_lng)) / 2), 2)) AS hs
    FROM c_mart_raw WHERE payment_installments IS NOT NULL)),
c_mart AS (
  SELECT * FROM c_mart_dist
  WHERE seller_customer_distance_km IS NOT NULL
    AND customer_lat BETWEEN -34 AND 6 AND customer_lng BETWEEN -75 AND -33
    AND seller_lat BETWEEN -34 AND 6 AND seller_lng BETWEEN -75 AND -33)
"""


def with_views(body: str, mart: bool = False, extra: str = "") -> str:
    """Prefix a query body with the proxy CTEs (and optionally the mart CTEs)."""
    ctes = PROXY.strip()
    if mart:
        ctes += ",\n" + MART.strip()
    if extra:
        ctes += ",\n" + extra.strip()
    return "WITH " + ctes + "\n" + body.strip()

# Customer features (A7 M14 M13), person = customer_unique_id.
CUSTOMER = r"""
c_bridge AS (SELECT o.order_id, c.customer_unique_id AS person
             FROM c_orders o LEFT JOIN c_customers c ON o.customer_id = c.customer_id
             WHERE c.customer_unique_id IS NOT NULL),
c_pay_order AS (SELECT order_id, sum(payment_value) AS payment_value FROM c_payments GROUP BY order_id),
c_rfm_base AS (SELECT o.order_id, o.order_purchase_timestamp AS ts, b.person, p.payment_value
               FROM c_orders o JOIN c_bridge b ON o.order_id = b.order_id
               LEFT JOIN c_pay_order p ON o.order_id = p.order_id
               WHERE o.order_status = 'delivered'),
c_ref AS (SELECT max(ts) + INTERVAL 1 DAY AS ref FROM c_rfm_base),
c_rfm AS (SELECT person AS customer_unique_id,
                 CAST(floor(date_diff('microsecond', max(ts), (SELECT ref FROM c_ref)) / 86400000000.0) AS INTEGER) AS recency_days,
                 count(DISTINCT order_id) AS frequency, coalesce(sum(payment_value), 0) AS monetary,
                 count(DISTINCT order_id) > 1 AS is_repeat_customer
          FROM c_rfm_base GROUP BY person HAVING count(payment_value) > 0),
c_item_person AS (SELECT b.person, coalesce(p.product_category_name, 'unknown') AS cat,
                         i.freight_value / nullif(i.price, 0) AS fr
                  FROM c_items i LEFT JOIN c_products p ON i.product_id = p.product_id
                  JOIN c_bridge b ON i.order_id = b.order_id),
c_person_items AS (SELECT person, count(DISTINCT cat) AS category_diversity, avg(fr) AS avg_freight_ratio
                 FROM c_item_person GROUP BY person),
c_pay_counts AS (SELECT b.person, p.payment_type, count(*) AS n FROM c_payments p JOIN c_bridge b ON p.order_id = b.order_id
                 WHERE p.payment_type IS NOT NULL GROUP BY b.person, p.payment_type),
c_pref AS (SELECT person, payment_type AS preferred_payment_type FROM (
             SELECT *, row_number() OVER (PARTITION BY person ORDER BY n DESC, payment_type ASC) AS rn FROM c_pay_counts) WHERE rn = 1),
c_pay_feats AS (SELECT b.person, avg(p.payment_installments) AS avg_installments
                FROM c_payments p JOIN c_bridge b ON p.order_id = b.order_id GROUP BY b.person),
c_rev AS (SELECT b.person, avg(r.review_score) AS avg_review_score
          FROM c_reviews r JOIN c_bridge b ON r.order_id = b.order_id GROUP BY b.person),
c_cust AS (SELECT r.customer_unique_id, r.recency_days, r.frequency, r.monetary, r.is_repeat_customer,
                  i.category_diversity, i.avg_freight_ratio, pf.avg_installments, rv.avg_review_score,
                  pr.preferred_payment_type
           FROM c_rfm r LEFT JOIN c_person_items i ON r.customer_unique_id = i.person
           LEFT JOIN c_pay_feats pf ON r.customer_unique_id = pf.person
           LEFT JOIN c_rev rv ON r.customer_unique_id = rv.person
           LEFT JOIN c_pref pr ON r.customer_unique_id = pr.person),
c_ready AS (SELECT * REPLACE (CASE WHEN preferred_payment_type = 'not_defined' THEN 'boleto' ELSE preferred_payment_type END AS preferred_payment_type),
                   ln(1 + monetary) AS monetary_log, ln(1 + avg_freight_ratio) AS avg_freight_ratio_log
            FROM c_cust WHERE avg_review_score IS NOT NULL)
"""

# Trimmed mart (W9 auto cutoff), exact row index, chronological split, rolling folds.
SPLIT = r"""
c_day_counts AS (SELECT CAST(order_purchase_timestamp AS DATE) AS day, count(*) AS n FROM c_mart GROUP BY 1),
c_daily AS (SELECT d.day, coalesce(c.n, 0) AS n FROM (
              SELECT CAST(unnest(generate_series(CAST(min(day) AS TIMESTAMP), CAST(max(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day
              FROM c_day_counts) d LEFT JOIN c_day_counts c ON d.day = c.day),
c_cut AS (SELECT CAST(max(day) AS TIMESTAMP) AS cutoff FROM c_daily
          WHERE n >= 0.5 * (SELECT quantile_cont(n, 0.5) FROM c_daily)),
c_trim AS (SELECT * FROM c_mart WHERE order_purchase_timestamp <= (SELECT cutoff FROM c_cut)),
c_idx AS (SELECT *, row_number() OVER (ORDER BY order_purchase_timestamp, order_id) - 1 AS row_idx FROM c_trim),
c_split AS (SELECT order_purchase_timestamp AS split_ts FROM c_idx
            WHERE row_idx = (SELECT CAST(floor(count(*) * 0.8) AS BIGINT) FROM c_trim)),
c_split_rows AS (SELECT *, CASE WHEN order_purchase_timestamp < (SELECT split_ts FROM c_split) THEN 'train' ELSE 'test' END AS split FROM c_trim),
c_fold_size AS (SELECT count(*) // 6 AS size FROM c_trim),
c_folds AS (SELECT *, CASE WHEN row_idx < (SELECT size FROM c_fold_size) * 6 THEN CAST(row_idx // (SELECT size FROM c_fold_size) AS INTEGER) END AS chunk FROM c_idx),
c_win_bounds AS (SELECT min(order_purchase_timestamp) FILTER (WHERE chunk = 4) AS a_start,
                        min(order_purchase_timestamp) FILTER (WHERE chunk = 5) AS b_start,
                        max(order_purchase_timestamp) AS b_end FROM c_folds),
c_windows AS (SELECT t.*, CASE WHEN t.order_purchase_timestamp >= w.a_start AND t.order_purchase_timestamp < w.b_start THEN 'A'
                               WHEN t.order_purchase_timestamp >= w.b_start AND t.order_purchase_timestamp <= w.b_end THEN 'B' END AS window_label
              FROM c_trim t, c_win_bounds w),
c_train_stats AS (SELECT primary_seller_id, count(is_late) AS n, avg(CAST(is_late AS DOUBLE)) AS late_rate
                  FROM c_split_rows WHERE split = 'train' GROUP BY primary_seller_id),
c_overall AS (SELECT 1 - avg(CAST(is_late AS DOUBLE)) AS on_time FROM c_split_rows WHERE split = 'train'),
c_encoded AS (SELECT r.*, coalesce(CASE WHEN s.n >= 5 THEN 1 - s.late_rate ELSE (SELECT on_time FROM c_overall) END,
                                   (SELECT on_time FROM c_overall)) AS seller_on_time_rate,
                     NOT coalesce(s.n >= 5, false) AS is_new_or_thin_history_seller
              FROM c_split_rows r LEFT JOIN c_train_stats s ON r.primary_seller_id = s.primary_seller_id)
"""

# Windows joined with the train-only seller rate and delivery stages (D*), and the scored split (E*).
DRIFT = r"""
c_wfull AS (SELECT w.*, e.seller_on_time_rate, e.is_new_or_thin_history_seller, e.split,
                   date_diff('microsecond', w.order_purchase_timestamp, w.order_approved_at) / 3600000000.0 AS stage1_purchase_to_approval_hrs,
                   date_diff('microsecond', w.order_approved_at, w.order_delivered_carrier_date) / 3600000000.0 AS stage2_approval_to_carrier_hrs,
                   date_diff('microsecond', w.order_delivered_carrier_date, w.order_delivered_customer_date) / 3600000000.0 AS stage3_carrier_to_customer_hrs,
                   date_diff('microsecond', w.order_purchase_timestamp, w.order_estimated_delivery_date) / 86400000000.0 AS estimated_delivery_window_days,
                   date_diff('microsecond', w.order_purchase_timestamp, w.order_estimated_delivery_date) / 86400000000.0
                     - date_diff('microsecond', w.order_purchase_timestamp, w.order_delivered_customer_date) / 86400000000.0 AS slack_days
            FROM c_windows w JOIN c_encoded e ON w.order_id = e.order_id),
c_scored AS (SELECT order_id, split, is_late, CAST(is_late AS INTEGER) AS label, 1 - seller_on_time_rate AS score,
                    is_new_or_thin_history_seller FROM c_encoded)
"""

# Causal data with the seller-stratified propensity and brute-force 1-NN pairs.
CAUSAL = r"""
c_causal AS (SELECT t.*, r.review_score FROM c_trim t
             JOIN (SELECT order_id, avg(review_score) AS review_score FROM c_reviews GROUP BY order_id) r ON t.order_id = r.order_id),
c_rate_full AS (SELECT primary_seller_id, 1 - avg(CAST(is_late AS DOUBLE)) AS seller_on_time_rate FROM c_causal GROUP BY primary_seller_id),
c_cd AS (SELECT c.*, f.seller_on_time_rate, 1 - f.seller_on_time_rate AS propensity
         FROM c_causal c LEFT JOIN c_rate_full f ON c.primary_seller_id = f.primary_seller_id),
c_ctrl AS (SELECT propensity AS score, min(order_id) AS cid FROM c_cd WHERE NOT is_late AND propensity IS NOT NULL GROUP BY propensity),
c_pairs AS (SELECT treated_id, treated_score, control_id, control_score, distance FROM (
              SELECT t.order_id AS treated_id, t.propensity AS treated_score, c.cid AS control_id, c.score AS control_score,
                     abs(t.propensity - c.score) AS distance,
                     row_number() OVER (PARTITION BY t.order_id ORDER BY abs(t.propensity - c.score), c.score, c.cid) AS rn
              FROM c_cd t CROSS JOIN c_ctrl c WHERE t.is_late) WHERE rn = 1),
c_pv AS (SELECT p.*, t.review_score AS t_review_score, c.review_score AS c_review_score,
                t.seller_customer_distance_km AS t_seller_customer_distance_km, c.seller_customer_distance_km AS c_seller_customer_distance_km,
                t.avg_price AS t_avg_price, c.avg_price AS c_avg_price, t.total_freight AS t_total_freight, c.total_freight AS c_total_freight,
                t.seller_on_time_rate AS t_seller_on_time_rate, c.seller_on_time_rate AS c_seller_on_time_rate
         FROM c_pairs p LEFT JOIN c_cd t ON p.treated_id = t.order_id LEFT JOIN c_cd c ON p.control_id = c.order_id)
"""
