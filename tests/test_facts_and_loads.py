"""Bucketed facts join without a shuffle, observed writes count in one pass, unreadable rows are set aside."""
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.operators import features as FE
from ledgerlens.operators import observed as OB
from ledgerlens.operators import quality as Q
from ledgerlens.plans import delivery as D
from ledgerlens.sources import facts as FA
from ledgerlens.sources import quarantine as QU
from ledgerlens.sources.proxy import proxy_tables

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def facts(spark):
    f = FA.bucketed_facts(proxy_tables(spark, SF), 4)
    yield f
    f.drop(spark)


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_facts_meet_without_an_exchange(spark, facts, no_broadcast):
    assert "Exchange" not in plan(FA.joined_by_order(facts))
    stars = D.attach_stars(D.delivered_orders(facts), FE.rollup_items(facts.items, facts.item_order), FE.max_per_key(facts.payments, "order_id", "payment_installments"))
    assert "Exchange" not in plan(stars) and "SortMergeJoin" in plan(stars)
    assert "hashpartitioning(order_id" not in plan(D.order_mart_of_facts(facts))
    t = proxy_tables(spark, SF)
    assert "hashpartitioning(order_id" in plan(D.order_mart(t))  # what the buckets spare


def test_rfm_of_facts_shuffles_persons_only(spark, facts, no_broadcast):
    p = plan(FE.rfm_of_named(facts.orders.where("order_status = 'delivered'"), facts.payments))
    assert "hashpartitioning(order_id" not in p and "hashpartitioning(customer_unique_id" in p


def test_facts_keep_null_and_repeated_keys(spark):
    t = proxy_tables(spark, SF)
    t.payments = t.payments.limit(20).unionByName(t.payments.limit(20)).unionByName(t.payments.limit(3).withColumn("order_id", F.lit(None).cast("long")))
    f = FA.bucketed_facts(t, 3)
    assert f.payments.count() == 43 and f.payments.where("order_id is null").count() == 3
    f.drop(spark)
    assert not spark.catalog.tableExists(f.names["payments"])


def test_facts_are_written_once_per_source(spark):
    calls = []
    load = lambda: (calls.append(1), proxy_tables(spark, SF))[1]
    a, b = FA.facts_of(spark, "here", load), FA.facts_of(spark, "here", load)
    assert a is b and len(calls) == 1
    FA._KEPT.pop((spark.sparkContext.applicationId, "here")).drop(spark)


# ---- observed writes

ROWS = [(1, 1.0, "a", True), (2, None, None, None), (3, float("inf"), "b", False), (4, float("nan"), "c", True), (5, float("-inf"), None, True)]


def test_observed_counts_are_those_of_the_single_reports(spark):
    df = spark.createDataFrame(ROWS, "id long, x double, s string, flag boolean").repartition(3)
    rules = {"flagged": F.col("flag"), "large": F.col("x") > 0}
    make = lambda s: s.createDataFrame(ROWS, df.schema).repartition(3)
    kept, counts = OB.write_observed(spark, make, "t", nulls=df.columns, numbers=["id", "x"], rules=rules, extra={("until", "3"): F.col("id") <= 3})
    same = lambda a, b: sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert same(OB.null_profile_of(spark, counts), Q.null_profile(df))
    assert same(OB.inf_nan_of(spark, counts), Q.inf_nan_guard(df, ["id", "x"]))
    assert same(OB.violations_of(spark, counts), Q.rule_violations(df, rules))
    assert counts["rows", ""] == 5 and counts["until", "3"] == 3
    assert kept.count() == 5 and kept.schema == df.schema


def test_observed_write_is_one_job_over_the_input(spark):
    seen = spark.sparkContext.accumulator(0)

    def tick(rows):
        for b in rows:
            seen.add(b.num_rows)
            yield b
    schema = "id long, x double, s string, flag boolean"
    OB.write_observed(spark, lambda s: s.createDataFrame(ROWS, schema).coalesce(1).mapInArrow(tick, schema), "t", nulls=["id", "s"], numbers=["x"])
    assert seen.value == len(ROWS)


def test_models_still_run_in_a_session_that_wrote_observed_tables(spark):
    from pyspark.sql import SparkSession

    from ledgerlens.operators import models as M
    OB.write_observed(spark, lambda s: s.createDataFrame(ROWS, "id long, x double, s string, flag boolean"), "t", nulls=["id"])
    assert SparkSession.active()._jsparkSession.equals(spark._jsparkSession)
    df = spark.createDataFrame([(float(i), "ab"[i % 2]) for i in range(20)], "x double, c string")
    cat = M.category_vector(df, ["c"])
    M.assemble(cat.transform(df), ["x"], vectors=["c_vec"]).select("features").write.format("noop").mode("overwrite").save()


def test_observed_counts_of_an_empty_table(spark):
    kept, counts = OB.write_observed(spark, lambda s: s.createDataFrame([], "id long, x double"), "t", nulls=["id"], numbers=["x"], rules={"r": F.col("x") > 1})
    assert set(counts.values()) == {0} and kept.count() == 0
    assert OB.null_profile_of(spark, counts).collect()[0]["share"] is None


# ---- quarantine

SCHEMA = {"t": T.StructType([T.StructField("id", T.IntegerType()), T.StructField("at", T.TimestampNTZType()), T.StructField("price", T.DoubleType()), T.StructField("note", T.StringType())])}


def load(spark, tmp_path, text):
    (tmp_path / "t.csv").write_text(text)
    return QU.load_quarantined(spark, {"t": str(tmp_path / "t.csv")}, str(tmp_path / "out"), schemas=SCHEMA)


def test_bad_rows_come_back_by_reason_and_good_ones_unchanged(spark, tmp_path):
    got = load(spark, tmp_path, 'id,at,price,note\n1,2020-01-02 03:04:05,1.5,"a, ""quoted"" one"\n2,02/01/2020,1.5,x\nthree,2020-01-02 03:04:05,1.5,x\n'
                                '4,2020-01-02 03:04:05,"1,5",x\n5,,,\n6,2020-01-02 03:04:05,2\n7,2020-01-02 03:04:05,2.0,x,more\n8,2020-02-30 00:00:00,1.0,y\nx,never,1.0,z\n\n')
    assert sorted(r["id"] for r in got.good["t"].collect()) == [1, 5]
    assert got.good["t"].where("id = 1").first()["note"] == 'a, "quoted" one' and got.good["t"].schema == SCHEMA["t"]
    reasons = {r["raw"].split(",")[0]: r["reason"] for r in got.bad["t"].collect()}
    assert reasons == {"2": "at: not a timestamp_ntz", "three": "id: not a int", "4": "price: not a double", "6": QU.OTHER, "7": QU.OTHER,
                       "8": "at: not a timestamp_ntz", "x": "id: not a int"}
    assert {(r["reason"], r["n"]) for r in got.counts().collect()} >= {("good", 2), (QU.OTHER, 2), ("at: not a timestamp_ntz", 2)}


def test_projecting_good_rows_judges_all_fields(spark, tmp_path):
    got = load(spark, tmp_path, "id,at,price,note\n1,2020-01-02 03:04:05,bad,x\n2,2020-01-02 03:04:05,1.0,x\n")
    assert [r["id"] for r in got.good["t"].select("id").collect()] == [2]  # price is not read, yet its row is bad


def test_file_without_rows(spark, tmp_path):
    got = load(spark, tmp_path, "id,at,price,note\n")
    assert got.good["t"].count() == 0 and got.bad["t"].count() == 0


def test_checksum_sees_values_and_not_order(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a\nb")], "i int, s string")
    sums = [QU.checksum(d).first() for d in (df, df.orderBy(F.desc("i")).repartition(3), df.withColumn("s", F.coalesce("s", F.lit(""))), df.limit(2))]
    assert sums[0] == sums[1] and sums[0] != sums[2] and sums[0] != sums[3]


def test_buckets_follow_the_number_of_items(spark, monkeypatch):
    t = proxy_tables(spark, SF)
    monkeypatch.setattr(FA, "BUCKET_ITEMS", 500)
    f = FA.bucketed_facts(t)
    wanted = -(-t.order_items.count() // 500)
    assert wanted > int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name in f.names.values():
        assert {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}["Num Buckets"] == str(wanted)
    assert FA.joined_by_order(f).count() == t.orders.count()
    f.drop(spark)


def test_csv_files_with_line_feeds_stay_small(spark, monkeypatch, tmp_path):
    from ledgerlens.plans import queries_facts as QF
    monkeypatch.setattr(QF, "CSV_RECORDS", 100, raising=False)
    n = proxy_tables(spark, SF).reviews.count()
    path = QF.planted_csv(spark, SF, str(tmp_path))["reviews"]
    import glob
    assert len(glob.glob(f"{path}/*.csv")) >= n / 100 > 1
