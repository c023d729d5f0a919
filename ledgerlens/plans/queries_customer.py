"""Registered queries: customer side."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import profile as P
from ledgerlens.operators.features import person_bridge
from ledgerlens.operators.reshape import crosstab_pct, one_hot
from ledgerlens.operators.scaling import scale_apply, scale_fit
from ledgerlens.plans import segmentation as S
from ledgerlens.plans.oracle_views import CUSTOMER
from ledgerlens.plans.queries_base import T, mart
from ledgerlens.plans.registry import R, query

# the ratio is a mean of two-decimal taxes: at 6 decimals it may end on a half, which summation order decides
_CUST_DOUBLES = R("avg_freight_ratio", d=9) | R("avg_installments", "avg_review_score") | R("monetary", d=4)


@query("orders_per_customer", """
SELECT k AS orders_per_customer, count(*) AS customers, count(*) / sum(count(*)) OVER () AS share
FROM (SELECT person, count(DISTINCT order_id) AS k FROM c_bridge GROUP BY person) GROUP BY k
""", extra=CUSTOMER, rnd=R("share"), ids="A10")
def q_orders_per_customer(spark, sf_dir):
    t = T(spark, sf_dir)
    return P.orders_per_entity(person_bridge(t.orders, t.customers))


@query("repeat_rate", """
SELECT count(*) AS customers, count(*) FILTER (WHERE k > 1) AS repeat_customers, avg(CAST(k > 1 AS DOUBLE)) AS repeat_rate
FROM (SELECT person, count(DISTINCT order_id) AS k FROM c_bridge GROUP BY person)
""", extra=CUSTOMER, rnd=R("repeat_rate"), ids="A10")
def q_repeat_rate(spark, sf_dir):
    t = T(spark, sf_dir)
    return P.repeat_rate(person_bridge(t.orders, t.customers))


@query("rfm", "SELECT * FROM c_rfm", extra=CUSTOMER, rnd=R("monetary", d=4), ids="A7 X1 X5 T1 T6 F3")
def q_rfm(spark, sf_dir):
    from ledgerlens.operators.features import rfm
    t = T(spark, sf_dir)
    return rfm(t.orders, t.customers, t.payments)


@query("customer_features", "SELECT * FROM c_cust", extra=CUSTOMER, rnd=_CUST_DOUBLES,
       ids="M14 A1 A3 A8 J3 J4 F7 X7 T5 T7 T23 T27")
def q_customer_features(spark, sf_dir):
    return S.customer_table(T(spark, sf_dir))


@query("preferred_payment", """
SELECT preferred_payment_type AS value, count(*) AS n FROM c_cust WHERE preferred_payment_type IS NOT NULL GROUP BY 1
""", extra=CUSTOMER, ids="A8 V4")
def q_preferred_payment(spark, sf_dir):
    return P.value_counts(S.customer_table(T(spark, sf_dir)), "preferred_payment_type", normalize=False)


@query("payment_dummies", """
SELECT customer_unique_id, preferred_payment_type, monetary_log, avg_freight_ratio_log,
       CAST(preferred_payment_type = 'boleto' AS INTEGER) AS payment_boleto,
       CAST(preferred_payment_type = 'credit_card' AS INTEGER) AS payment_credit_card,
       CAST(preferred_payment_type = 'debit_card' AS INTEGER) AS payment_debit_card,
       CAST(preferred_payment_type = 'voucher' AS INTEGER) AS payment_voucher
FROM c_ready
""", extra=CUSTOMER, rnd=R("monetary_log", "avg_freight_ratio_log"), ids="M13 R1 F4 F8 X6 F13")
def q_payment_dummies(spark, sf_dir):
    df = S.clustering_ready(T(spark, sf_dir))
    return df.select("customer_unique_id", "preferred_payment_type", "monetary_log", "avg_freight_ratio_log",
                     *[c for c in df.columns if c.startswith("payment_")])


_CATS = ["economy", "large", "medium", "small", "standard", "unknown", "PROMO"]


@query("dummies_drop_first", """
SELECT order_id, """ + ",\n".join(
    f"CAST(coalesce(primary_category = '{v}', false) AS INTEGER) AS cat_{v}"
    for v in sorted(_CATS)[1:]) + " FROM c_mart", mart=True, ids="R2")
def q_dummies_drop_first(spark, sf_dir):
    m = mart(spark, sf_dir)
    return one_hot(m.select("order_id", "primary_category"), "primary_category", "cat", drop_first=True).drop("primary_category")


@query("crosstab_pct", """
SELECT is_repeat_customer, preferred_payment_type, n, n * 100.0 / sum(n) OVER (PARTITION BY is_repeat_customer) AS pct
FROM (SELECT is_repeat_customer, preferred_payment_type, count(*) AS n FROM c_cust
      WHERE is_repeat_customer IS NOT NULL AND preferred_payment_type IS NOT NULL GROUP BY 1, 2)
""", extra=CUSTOMER, rnd=R("pct"), ids="R3")
def q_crosstab_pct(spark, sf_dir):
    return crosstab_pct(S.customer_table(T(spark, sf_dir)), "is_repeat_customer", "preferred_payment_type")


@query("scaled_features", "SELECT customer_unique_id, " + ", ".join(
    f"({c} - avg({c}) OVER ()) / coalesce(nullif(stddev_pop({c}) OVER (), 0), 1) AS {c}"
    for c in S.FINAL_CLUSTER_FEATURES) + " FROM c_ready", extra=CUSTOMER,
    rnd=R(*S.FINAL_CLUSTER_FEATURES, d=5), ids="M1")
def q_scaled_features(spark, sf_dir):
    df = S.clustering_ready(T(spark, sf_dir)).select("customer_unique_id", *S.FINAL_CLUSTER_FEATURES)
    return scale_apply(df, scale_fit(df, S.FINAL_CLUSTER_FEATURES))
