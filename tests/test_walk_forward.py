"""Walk-forward months: how seller statistics meet the history."""
import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize("sellers,broadcast", [(3, True), (1 << 40, False)])
def test_history_stays_where_it_is_for_a_month_of_few_sellers(spark, sellers, broadcast):
    from ledgerlens.plans import models as PM
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        part = spark.range(50).withColumn("primary_seller_id", F.when(F.col("id") > 0, F.col("id") % 5))
        out = PM.with_sellers(part, spark.createDataFrame([(0, 0.5), (1, 0.25), (2, 1.0)], "primary_seller_id long, rate double"), sellers)
        assert ("BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()) == broadcast
        assert out.count() == 50 and out.where("rate is null").count() == 21
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
