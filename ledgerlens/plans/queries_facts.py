"""Registered queries over bucketed facts, observed writes, quarantined loads, publications, running state, resampling."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerlens.operators import drift as DR
from ledgerlens.operators import features as FE
from ledgerlens.operators import history as HI
from ledgerlens.operators import observed as OB
from ledgerlens.operators.models import run_parallel
from ledgerlens.plans import delivery as D
from ledgerlens.operators.silhouette import sampled_silhouette
from ledgerlens.plans import segmentation as S
from ledgerlens.plans.oracle_views import CUSTOMER, SPLIT
from ledgerlens.plans.queries_base import T, _MART_DOUBLES
from ledgerlens.plans.queries_customer import _CUST_DOUBLES
from ledgerlens.plans.queries_drift import _EXTRA as DRIFT_EXTRA, windows
from ledgerlens.plans.queries_split import trimmed
from ledgerlens.plans.registry import R, query
from ledgerlens.session import remove_path, scratch_path
from ledgerlens.sources import publish as PB
from ledgerlens.sources import quarantine as QU
from ledgerlens.sources.facts import facts_of, joined_by_order
from ledgerlens.sources.tables import COMMERCE_SCHEMAS

TS = "order_purchase_timestamp"


def facts(spark, sf_dir):
    return facts_of(spark, sf_dir, lambda: T(spark, sf_dir))


# ------------------------------------------------------------------ bucketed facts

@query("order_mart_of_facts", "SELECT " + ", ".join(D.MART_COLUMNS) + " FROM c_mart", mart=True, rnd=_MART_DOUBLES, ids="J4 A9 A4 F3 F4 F5")
def q_order_mart_of_facts(spark, sf_dir):
    return D.order_mart_of_facts(facts(spark, sf_dir))


@query("rfm_of_facts", "SELECT * FROM c_rfm", extra=CUSTOMER, rnd=R("monetary", d=4), ids="A7 J3")
def q_rfm_of_facts(spark, sf_dir):
    f = facts(spark, sf_dir)
    return FE.rfm_of_named(f.orders.where(F.col("order_status") == "delivered"), f.payments)


@query("customer_features_of_facts", "SELECT * FROM c_cust", extra=CUSTOMER, rnd=_CUST_DOUBLES, ids="M14 J4")
def q_customer_features_of_facts(spark, sf_dir):
    f = facts(spark, sf_dir)
    person = "customer_unique_id"
    return FE.enriched_people(q_rfm_of_facts(spark, sf_dir), f.orders.select("order_id", person).where(F.col(person).isNotNull()),
                              f.items, f.payments, f.reviews)


@query("orders_joined_by_bucket", """
SELECT o.order_id, o.order_status, p.payment_value, coalesce(p.payments, 0) AS payments, coalesce(i.items, 0) AS items, i.price,
       coalesce(r.reviews, 0) AS reviews
FROM c_orders o LEFT JOIN (SELECT order_id, sum(payment_value) AS payment_value, count(*) AS payments FROM c_payments GROUP BY 1) p ON p.order_id = o.order_id
LEFT JOIN (SELECT order_id, count(*) AS items, sum(price) AS price FROM c_items GROUP BY 1) i ON i.order_id = o.order_id
LEFT JOIN (SELECT order_id, count(*) AS reviews FROM c_reviews GROUP BY 1) r ON r.order_id = o.order_id
""", rnd=R("payment_value", "price", d=4), ids="J4 A9")
def q_orders_joined_by_bucket(spark, sf_dir):
    return joined_by_order(facts(spark, sf_dir))


# ------------------------------------------------------------------ observed writes

_CHECKED = ["avg_price", "total_freight", "total_weight_g", "seller_customer_distance_km"]
_RULES = {"late": "is_late", "no weight": "total_weight_g = 0", "distance above 3000 km": "seller_customer_distance_km > 3000",
          "carrier before approval": "order_delivered_carrier_date < order_approved_at"}


@query("mart_reports_observed", "SELECT 'rows' AS report, 'mart' AS item, count(*) AS n FROM c_mart"
       + "".join(f" UNION ALL SELECT 'nulls', '{c}', count(*) - count({c}) FROM c_mart" for c in D.MART_COLUMNS)
       + "".join(f" UNION ALL SELECT '{k}', '{c}', count(*) FILTER (WHERE {e}) FROM c_mart" for c in _CHECKED
                 for k, e in (("inf", f"isinf({c})"), ("nan", f"isnan({c})")))
       + "".join(f" UNION ALL SELECT 'violations', '{r}', count(*) FILTER (WHERE {e}) FROM c_mart" for r, e in _RULES.items())
       + " UNION ALL SELECT 'until cutoff', '1996-01-01', count(*) FILTER (WHERE order_purchase_timestamp <= TIMESTAMP '1996-01-01') FROM c_mart",
       mart=True, ids="S2 V3 V5 V7 C1 W9")
def q_mart_reports_observed(spark, sf_dir):
    """Row count, null profile, inf and NaN guard, rule violations and a cutoff's row count, all taken while the mart is written."""
    cut = F.col(TS) <= F.lit("1996-01-01").cast("timestamp_ntz")
    kept, counts = OB.write_observed(spark, lambda s: D.order_mart(T(s, sf_dir)), "mart", nulls=D.MART_COLUMNS, numbers=_CHECKED, rules={n: F.expr(e) for n, e in _RULES.items()}, extra={("until cutoff", "1996-01-01"): cut})
    remove_path(spark, kept.inputFiles()[0].rsplit("/", 1)[0]) if kept.inputFiles() else None
    return OB.long_report(spark, counts, "mart")


# ------------------------------------------------------------------ quarantined loads

_MESSAGE = "review_comment_message"
CSV_RECORDS = 1 << 20


def planted_csv(spark, sf_dir, base):
    """Four tables as CSV with unreadable values planted by key, and review texts with quotes and line feeds."""
    t = T(spark, sf_dir).as_dict()
    texts = {n: t[n].select(*[(F.col(f.name) if f.name in t[n].columns else F.lit(None)).cast(f.dataType).cast("string").alias(f.name) for f in COMMERCE_SCHEMAS[n]])
             for n in ("orders", "order_items", "payments", "reviews")}
    k = F.col("order_id").cast("long")
    bad = lambda df, c, when, what: df.withColumn(c, F.when(when, F.lit(what)).otherwise(F.col(c)))
    texts["orders"] = bad(bad(texts["orders"], TS, k % 97 == 0, "31/02/1998"), "order_delivered_customer_date", k % 89 == 0, "soon")
    texts["order_items"] = bad(texts["order_items"], "price", (k % 83 == 0) & (F.col("order_item_id") == "1"), "12,50")
    texts["payments"] = bad(texts["payments"], "payment_installments", k % 79 == 0, "two")
    texts["reviews"] = texts["reviews"].withColumn(_MESSAGE, F.concat(F.lit('said "'), F.coalesce(_MESSAGE, F.lit("")), F.lit('",\nand left')))
    paths = {}
    for n, df in texts.items():
        paths[n] = f"{base}/{n}"
        # a file with line feeds inside its values is read by one task: files are kept small
        df.write.option("header", True).option("escape", '"').option("maxRecordsPerFile", CSV_RECORDS).csv(paths[n])
    return paths


@query("csv_quarantine", """
SELECT table_name, reason, CAST(n AS BIGINT) AS n FROM (
  SELECT 'orders' AS table_name, CASE WHEN order_id % 97 = 0 THEN 'order_purchase_timestamp: not a timestamp_ntz' WHEN order_id % 89 = 0
         THEN 'order_delivered_customer_date: not a timestamp_ntz' ELSE 'good' END AS reason, count(*) AS n FROM c_orders GROUP BY 2
  UNION ALL SELECT 'order_items', CASE WHEN order_id % 83 = 0 AND line_no = 1 THEN 'price: not a double' ELSE 'good' END, count(*) FROM c_items GROUP BY 2
  UNION ALL SELECT 'payments', CASE WHEN order_id % 79 = 0 THEN 'payment_installments: not a int' ELSE 'good' END, count(*) FROM c_payments GROUP BY 2
  UNION ALL SELECT 'reviews', 'good', count(*) FROM c_reviews)
""", ids="S1 S2 S3")
def q_csv_quarantine(spark, sf_dir):
    """Rows by table and reason after loading CSV files in which every so many-th row has an unreadable value."""
    base = scratch_path(spark, f"csv/{uuid.uuid4().hex}")
    loaded = QU.load_quarantined(spark, planted_csv(spark, sf_dir, base), f"{base}/loaded", "yyyy-MM-dd HH:mm:ss[.SSSSSS]")
    out = D.materialise(loaded.counts())
    remove_path(spark, base)
    return out


@query("csv_checksums", """
SELECT table_name, CAST(n AS BIGINT) AS "rows", true AS same FROM (
  SELECT 'orders' AS table_name, count(*) AS n FROM c_orders WHERE order_id % 97 <> 0 AND order_id % 89 <> 0
  UNION ALL SELECT 'order_items', count(*) FROM c_items WHERE NOT (order_id % 83 = 0 AND line_no = 1)
  UNION ALL SELECT 'payments', count(*) FROM c_payments WHERE order_id % 79 <> 0
  UNION ALL SELECT 'reviews', count(*) FROM c_reviews)
""", ids="S1 S3 S4")
def q_csv_checksums(spark, sf_dir):
    """Good rows after the load: every column of every row reads back as what was written (a checksum over all columns)."""
    base = scratch_path(spark, f"csv/{uuid.uuid4().hex}")
    loaded = QU.load_quarantined(spark, planted_csv(spark, sf_dir, base), f"{base}/loaded", "yyyy-MM-dd HH:mm:ss[.SSSSSS]")
    source, k = T(spark, sf_dir).as_dict(), F.col("order_id")
    good = {"orders": (k % 97 != 0) & (k % 89 != 0), "order_items": ~((k % 83 == 0) & (F.col("order_item_id") == 1)), "payments": k % 79 != 0, "reviews": F.lit(True)}

    def compared(n, keep):
        df = source[n].where(keep)
        df = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in COMMERCE_SCHEMAS[n]])
        if n == "reviews":
            df = df.withColumn(_MESSAGE, F.concat(F.lit('said "'), F.coalesce(_MESSAGE, F.lit("")), F.lit('",\nand left')))
        a, b = QU.checksum(df).first(), QU.checksum(loaded.good[n]).first()
        return n, b["rows"], a == b

    rows = run_parallel([lambda n=n, keep=keep: compared(n, keep) for n, keep in good.items()])  # tables are independent jobs
    remove_path(spark, base)
    return spark.createDataFrame(rows, "table_name string, rows long, same boolean")


# ------------------------------------------------------------------ Euclidean silhouette (M3)

_SIL = ["recency_days", "monetary_log", "avg_review_score"]


@query("silhouette_by_payment", f"""
SELECT * FROM (WITH p AS (SELECT customer_unique_id AS k, preferred_payment_type AS c, {", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in _SIL)} FROM c_ready
           WHERE preferred_payment_type IS NOT NULL AND {" AND ".join(f"{c} IS NOT NULL" for c in _SIL)}),
s AS (SELECT * FROM p ORDER BY md5(CAST(k AS VARCHAR)) LIMIT 200),
z AS (SELECT c, count(*) AS size FROM p GROUP BY c),
d AS (SELECT s.k, s.c AS mine, p.c AS other, sum(sqrt({" + ".join(f"pow(s.{c} - p.{c}, 2)" for c in _SIL)})) AS total FROM s CROSS JOIN p GROUP BY 1, 2, 3),
m AS (SELECT d.k, d.mine, max(z0.size) AS size, max(CASE WHEN d.other = d.mine THEN d.total / nullif(z.size - 1, 0) END) AS a,
             min(CASE WHEN d.other <> d.mine THEN d.total / z.size END) AS b
      FROM d JOIN z ON z.c = d.other JOIN z AS z0 ON z0.c = d.mine GROUP BY 1, 2),
v AS (SELECT CASE WHEN size > 1 THEN (b - a) / greatest(a, b) ELSE 0 END AS v FROM m)
SELECT avg(v) AS silhouette, stddev_samp(v) / sqrt(count(*)) * sqrt(1 - count(*) / (SELECT count(*) FROM p)::DOUBLE) AS standard_error,
       count(*) AS sampled, (SELECT count(*) FROM p) AS n FROM v)""", extra=CUSTOMER, rnd=R("silhouette", "standard_error"), ids="M3")
def q_silhouette_by_payment(spark, sf_dir):
    """Euclidean silhouette of customers grouped by preferred payment type, from 200 points against all."""
    return sampled_silhouette(S.clustering_ready(T(spark, sf_dir)), _SIL, "preferred_payment_type", "customer_unique_id", 200)


# ------------------------------------------------------------------ fixed-size bootstrap

def _fixed_sql(reps: int = 20, frac: float = 0.7, seed: int = 42) -> str:
    block = DR.RESAMPLE_BLOCK
    return f"""
SELECT * FROM (WITH w AS (SELECT row_number() OVER (ORDER BY md5(CAST(order_id AS VARCHAR)), order_id) - 1 AS pos,
                  CAST(seller_customer_distance_km AS DOUBLE) AS x, CAST(CAST(is_late AS INTEGER) AS DOUBLE) AS y FROM c_wfull WHERE window_label = 'B'),
n AS (SELECT count(*) AS n FROM w),
g AS (SELECT rep, unnest(range(CAST(floor((SELECT n FROM n) * {frac} + 0.5) AS BIGINT))) AS id FROM (SELECT range AS rep FROM range({reps}))),
b AS (SELECT rep, CAST(floor(floor({DR.draw_uniform_sql("id", "rep", "0", seed)} * (SELECT n FROM n)) / {block}) AS BIGINT) AS block FROM g),
c AS (SELECT rep, block, unnest(range(count(*))) AS id, least({block}, (SELECT n FROM n) - block * {block}) AS many FROM b GROUP BY rep, block),
h AS (SELECT rep, block * {block} + CAST(floor({DR.draw_uniform_sql("id", "rep", "block + 1", seed)} * many) AS BIGINT) AS pos FROM c),
r AS (SELECT rep, count(*) AS size, avg(x) AS mx, avg(y) AS my, avg(x * x) AS mxx, avg(y * y) AS myy, avg(x * y) AS mxy FROM h JOIN w USING (pos) GROUP BY rep)
SELECT CAST(rep AS INTEGER) AS rep, size, CASE WHEN (mxx - mx * mx) * (myy - my * my) > 0 THEN (mxy - mx * my) / sqrt((mxx - mx * mx) * (myy - my * my)) END AS r FROM r)"""


@query("bootstrap_fixed_size", _fixed_sql(), mart=True, extra=DRIFT_EXTRA, rnd=R("r", d=5), ids="D4")
def q_bootstrap_fixed_size(spark, sf_dir):
    """Twenty replicates of exactly 70 % of window B, drawn with replacement: size and correlation of each."""
    w = windows(spark, sf_dir).where(F.col("window_label") == "B")
    return DR.fixed_bootstrap(w, "order_id", "seller_customer_distance_km", "is_late", 20, 0.7, 42)


# ------------------------------------------------------------------ publication

@query("published_orders", """
SELECT CAST(count(DISTINCT date_trunc('month', order_purchase_timestamp)) AS BIGINT) AS first_written, CAST(1 AS BIGINT) AS then_written, CAST(0 AS BIGINT) AS last_written,
       count(*) AS "rows", CAST(sum(item_count) + count(*) FILTER (WHERE date_trunc('month', order_purchase_timestamp) = TIMESTAMP '1995-03-01') AS BIGINT) AS items,
       CAST(sum(item_count) AS BIGINT) AS items_before
FROM c_mart""", mart=True, ids="S4 P1")
def q_published_orders(spark, sf_dir):
    """The mart published by month, again after one month changed, and again unchanged: partitions written each time, and
    the sums that readers of the newest and of the first version see."""
    root = scratch_path(spark, f"published/{uuid.uuid4().hex}")
    m = D.materialise(D.with_month(D.order_mart(T(spark, sf_dir))))
    hit = F.col("year_month") == F.lit("1995-03-01").cast("timestamp_ntz")
    later = m.withColumn("item_count", F.col("item_count") + F.when(hit, 1).otherwise(0))
    written = [len(PB.publish(df, root, "year_month")) for df in (m, later, later)]
    row = PB.read_published(spark, root).agg(F.count(F.lit(1)).alias("n"), F.sum("item_count").alias("i")).first()
    first = PB.read_published(spark, root, version=0).agg(F.sum("item_count").alias("i")).first()
    remove_path(spark, root)
    return spark.createDataFrame([(*written, row["n"], row["i"], first["i"])],
                                 "first_written long, then_written long, last_written long, rows long, items long, items_before long")


# ------------------------------------------------------------------ running state

@query("seller_history_extended", """
SELECT m.primary_seller_id, count(*) AS entity_orders, count(*) >= 5 AS has_sufficient_history, max(o.r) AS overall_on_time_rate,
       CASE WHEN count(*) >= 5 THEN 1 - avg(CAST(is_late AS DOUBLE)) ELSE max(o.r) END AS entity_on_time_rate
FROM c_trim m, (SELECT 1 - avg(CAST(is_late AS DOUBLE)) AS r FROM c_trim WHERE order_purchase_timestamp < TIMESTAMP '1996-04-01') o
WHERE order_purchase_timestamp < TIMESTAMP '1996-04-01' GROUP BY 1
""", mart=True, extra=SPLIT, rnd=R("overall_on_time_rate", "entity_on_time_rate"), ids="M7 A15")
def q_seller_history_extended(spark, sf_dir):
    """Seller statistics at a cutoff from a running state: built up to a month, then extended by three months one by one."""
    path = scratch_path(spark, f"history/{uuid.uuid4().hex}")
    m = D.materialise(D.with_month(trimmed(spark, sf_dir)).select("primary_seller_id", "is_late", F.date_format("year_month", "yyyy-MM").alias("month")))
    state = HI.RunningState(spark, path, "primary_seller_id", {"n_late": F.col("is_late").cast("long")})
    state.extend("1995-12", m.where("month <= '1995-12'"))
    for month in ("1996-01", "1996-02", "1996-03"):
        state.extend(month, m.where(F.col("month") == month))
    out = D.materialise(HI.rates_of_state(state.before("1996-04"), "primary_seller_id"))
    remove_path(spark, path)
    return out
