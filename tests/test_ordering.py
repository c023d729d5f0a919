import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.operators import ordering as O


def _ts(d, h=0):
    return dt.datetime(2020, 1, 1) + dt.timedelta(days=d, hours=h)


def test_row_index_exact_and_partition_invariant(spark):
    random.seed(1)
    rows = [(i, _ts(random.randint(0, 5))) for i in range(500)]  # many ties on ts
    random.shuffle(rows)
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz")
    expect = {r[0]: i for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    for parts in (1, 3, 16):
        got = {r["id"]: r["row_idx"] for r in O.row_index(df.repartition(parts), ["ts", "id"], n_parts=parts).collect()}
        assert got == expect


def test_chrono_split_whole_tie_goes_to_test(spark):
    # 10 rows, rows 7..10 share a timestamp; int(10*0.8)=8 falls inside the tie
    rows = [(i, _ts(i)) for i in range(6)] + [(i, _ts(9)) for i in range(6, 10)]
    df = spark.createDataFrame(rows, "id long, ts timestamp_ntz")
    split_ts, n = O.chrono_split(df, "ts", 0.8)
    assert n == 10 and split_ts == _ts(9)
    s = O.with_split(df, "ts", split_ts).groupBy("split").count().collect()
    assert dict((r[0], r[1]) for r in s) == {"train": 6, "test": 4}


def test_rolling_folds_sizes(spark):
    df = spark.createDataFrame([(i, _ts(i // 3)) for i in range(20)], "id long, ts timestamp_ntz")
    f = O.rolling_folds(df, "ts", "id", k=5)  # size = 20 // 6 = 3; rows 18, 19 unused
    counts = {r[0]: r[1] for r in f.groupBy("chunk").count().collect()}
    assert counts == {0: 3, 1: 3, 2: 3, 3: 3, 4: 3, 5: 3, None: 2}


def test_exact_quantiles_match_numpy(spark):
    vals = [float(x) for x in np.random.RandomState(3).randint(0, 50, size=333)]
    df = spark.createDataFrame([(v, i % 2) for i, v in enumerate(vals)], "v double, g int")
    q = {(r["p"]): r["q"] for r in O.exact_quantiles(df, "v", [0.1, 0.25, 0.5, 0.9]).collect()}
    for p, x in q.items():
        assert abs(x - np.quantile(vals, p)) < 1e-9
    qg = {(r["g"], r["p"]): r["q"] for r in O.exact_quantiles(df, "v", [0.5], by=["g"]).collect()}
    for g in (0, 1):
        assert abs(qg[(g, 0.5)] - np.quantile(vals[g::2], 0.5)) < 1e-9


def test_quantile_bins_right_closed(spark):
    # Values 1..8 -> edges 2.75, 4.5, 6.25; lowest in Q1, right-closed
    df = spark.createDataFrame([(float(i),) for i in range(1, 9)], "x double")
    got = {r["x"]: r["bin"] for r in O.quantile_bins(df, "x", ["Q1", "Q2", "Q3", "Q4"]).collect()}
    assert got == {1.0: "Q1", 2.0: "Q1", 3.0: "Q2", 4.0: "Q2", 5.0: "Q3", 6.0: "Q3", 7.0: "Q4", 8.0: "Q4"}


def test_resample_zero_fill_and_sunday_labels(spark):
    # 2020-01-06 is a Monday, 2020-01-05 a Sunday
    rows = [(_ts(4),), (_ts(5),), (_ts(5, 5),), (_ts(20),)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz")
    wk = {r["bucket"].date(): r["n"] for r in O.resample_count(df, "ts", "W").collect()}
    assert wk[dt.date(2020, 1, 5)] == 1 and wk[dt.date(2020, 1, 12)] == 2 and wk[dt.date(2020, 1, 19)] == 0
    d = O.resample_count(df, "ts", "D").collect()
    assert len(d) == 17 and sum(r["n"] for r in d) == 4


def test_keep_first(spark):
    df = spark.createDataFrame([("p", 2, "B"), ("p", 1, "A"), ("q", 5, "C")], "k string, o int, v string")
    got = {r["k"]: r["v"] for r in O.keep_first(df, ["k"], ["o"]).collect()}
    assert got == {"p": "A", "q": "C"}


def test_a_folds_seller_rates_go_to_its_rows(spark):
    from ledgerlens.operators.features import rate_encode
    from ledgerlens.plans.queries_models import fold_rates
    df = spark.range(600).select("id", F.when(F.col("id") % 13 > 0, F.col("id") % 40).alias("primary_seller_id"),
                                 (F.col("id") % 5 == 0).alias("is_late"), (F.col("id") % 3).alias("chunk"))
    train = df.where("chunk < 2 AND primary_seller_id < 30")
    want = {r["id"]: (r["seller_on_time_rate"], int(r["is_new_or_thin_history_seller"])) for r in rate_encode(train, df, "primary_seller_id", "is_late", 5).collect()}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sent = fold_rates(df, train)
        assert "Exchange hashpartitioning" not in sent._jdf.queryExecution().executedPlan().toString()
        for got in (sent, fold_rates(df, train, most=0)):
            assert {r["id"]: (r["seller_on_time_rate"], r["is_new_or_thin_history_seller"]) for r in got.collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
