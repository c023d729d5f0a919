"""Exact 1-nearest-neighbour join on a scalar score, with replacement.

No cross join, no single-partition sort:

1. controls collapse to their distinct scores, keeping the lowest control id per score
   (T20 tie rule); treated rows collapse to distinct scores too and are joined back at the
   end. A score that more than one of ``HOT`` treated rows share is joined back by broadcast: there are fewer than
   ``HOT`` of these, so no task of the other join holds more than that share of the rows under one score;
2. the union of both is range-partitioned on (by, score) and written once;
3. inside each range partition a running ``last`` of the control struct, in rising and in falling
   order, gives the nearest control at-or-below / at-or-above;
4. a tiny per-partition table of min/max controls, scanned with running windows over the
   partition index, supplies the carry-in when a partition has no control on one side;
5. choose the closer side; on equal distance the lower control score wins (then lower id).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.operators.ordering import null_safe_join
from ledgerlens.operators.selection import kept

HOT = 1000


def nearest_join(treated: DataFrame, control: DataFrame, id_col: str, score: str,
                 by: Sequence[str] = (), n_parts: int | None = None) -> DataFrame:
    """For every treated row: (by..., treated_id, treated_score, control_id, control_score,
    distance). Treated rows in a group with no control get null control columns."""
    by = list(by)
    n = int(n_parts or treated.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ctrl = (control.where(F.col(score).isNotNull())
            .groupBy(*by, F.col(score).alias("_s")).agg(F.min(id_col).alias("_cid"))
            .withColumn("_kind", F.lit(0)).withColumn("_n", F.lit(0).cast("long")))
    tsc = (treated.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("_s")).agg(F.count(F.lit(1)).alias("_n"))
           .withColumn("_cid", F.lit(None).cast(ctrl.schema["_cid"].dataType)).withColumn("_kind", F.lit(1)))
    u = ctrl.unionByName(tsc)
    u = u.repartitionByRange(n, *[F.col(c) for c in by], F.col("_s"), F.col("_kind")) \
         .withColumn("_rp", F.spark_partition_id())
    u, _ = kept(u, "matching")  # the partition number depends on sampled bounds: written, it stays what it is

    cstruct = F.when(F.col("_kind") == 0, F.struct(F.col("_s").alias("s"), F.col("_cid").alias("id")))
    order = [F.col("_s"), F.col("_kind")]
    w_below = Window.partitionBy(*by, "_rp").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # a frame that ends at the last row is evaluated anew for every row: the rows above are those before in falling order
    w_above = Window.partitionBy(*by, "_rp").orderBy(*[c.desc() for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    inpart = u.select("*", F.last(cstruct, ignorenulls=True).over(w_below).alias("_bl"),
                      F.last(cstruct, ignorenulls=True).over(w_above).alias("_ab")).where(F.col("_kind") == 1)

    # carry-in across range partitions: table of (by, partition) -> extreme controls
    ext = u.where(F.col("_kind") == 0).groupBy(*by, "_rp").agg(
        F.min_by(F.struct(F.col("_s").alias("s"), F.col("_cid").alias("id")), F.struct(-F.col("_s"), F.col("_cid"))).alias("_mx"),
        F.min(F.struct(F.col("_s").alias("s"), F.col("_cid").alias("id"))).alias("_mn"))
    parts = u.select(*by, "_rp").distinct()
    ext = null_safe_join(parts, ext, by + ["_rp"])
    wp = Window.partitionBy(*by).orderBy("_rp")
    carry = ext.select(*by, "_rp",
                       F.last(F.col("_mx"), ignorenulls=True)
                       .over(wp.rowsBetween(Window.unboundedPreceding, -1)).alias("_cb"),
                       F.last(F.col("_mn"), ignorenulls=True)
                       .over(Window.partitionBy(*by).orderBy(F.col("_rp").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("_ca"))
    carry = F.broadcast(carry) if not by else carry  # n_parts rows when ungrouped

    j = null_safe_join(inpart, carry, by + ["_rp"])
    below = F.coalesce(F.col("_bl"), F.col("_cb"))
    above = F.coalesce(F.col("_ab"), F.col("_ca"))
    j = j.select(*by, "_s", "_n", below.alias("b"), above.alias("a"))
    db = F.col("_s") - F.col("b.s")
    da = F.col("a.s") - F.col("_s")
    take_below = F.col("b").isNotNull() & (F.col("a").isNull() | (db <= da))
    best = j.select(*by, "_s", "_n",
                    F.when(take_below, F.col("b.id")).otherwise(F.col("a.id")).alias("control_id"),
                    F.when(take_below, F.col("b.s")).otherwise(F.col("a.s")).alias("control_score"))
    best = best.withColumn("distance", F.abs(F.col("_s") - F.col("control_score")))
    best, _ = kept(best.select(*[F.col(b).alias(f"_g_{b}") for b in by], "_s", "_n", "control_id", "control_score", "distance"), "matched")
    t = treated.select(*by, F.col(id_col).alias("treated_id"), F.col(score).alias("treated_score"))
    cond = [F.col(b).eqNullSafe(F.col(f"_g_{b}")) for b in by] + [F.col("treated_score") == F.col("_s")]
    total = best.agg(F.sum("_n").alias("n"), F.max("_n").alias("most")).first()
    if total["n"] and total["most"] * HOT > total["n"]:
        is_hot = F.col("_n") * HOT > total["n"]
        hot = F.broadcast(best.where(is_hot))  # fewer than HOT rows
        out = t.join(hot, cond, "inner").unionByName(t.join(hot, cond, "left_anti").join(best.where(~is_hot), cond, "left"))
    else:
        out = t.join(best, cond, "left")
    return out.select(*by, "treated_id", "treated_score", "control_id", "control_score", "distance")
