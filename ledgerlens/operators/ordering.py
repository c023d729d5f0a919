"""Positional and temporal operators without a single-partition sort.

The building block is :func:`running_totals`: range-partition the rows on the ordering key
(Spark samples the key, so one hot leading value is split across partitions by the later
keys), take per-partition totals (a table of at most ``n_parts`` rows per group), turn them
into partition offsets with a window over that tiny table, and add an in-partition running
sum. Every row gets its exact cumulative position; no task ever holds more than one range
partition.

Built on it: exact row index (W2). Values at a few wanted positions (chronological cut W1, exact linear
quantiles V6 and W5, quantile bins) need no order of all rows: see ``selection``. Resampling (W7) joins per-bucket counts to a generated calendar.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions.temporal import epoch_micros, ntz_lit
from ledgerlens.operators.selection import kept, select_ranks


def _n_parts(df: DataFrame, n_parts: int | None) -> int:
    if n_parts:
        return int(n_parts)
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join on ``keys`` where null equals null (a null group is a group)."""
    r = right.select(*[F.col(k).alias(f"_j_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    cond = [F.col(k).eqNullSafe(F.col(f"_j_{k}")) for k in keys]
    return left.join(r, cond, "left").drop(*[f"_j_{k}" for k in keys])


def running_totals(df: DataFrame, order_cols: Sequence[str], value_cols: Sequence[str],
                   by: Sequence[str] = (), n_parts: int | None = None,
                   prefix: str = "cum_", totals: str | None = None) -> DataFrame:
    """Add ``{prefix}{v}``: sum of ``v`` over all rows strictly before this row in
    (``by``, ``order_cols``) order, restarting per ``by`` group; with ``totals`` also
    ``{totals}{v}``, the group's sum.

    ``order_cols`` must make the order total within a group for a row-exact result.
    """
    by, order_cols, value_cols = list(by), list(order_cols), list(value_cols)
    n = _n_parts(df, n_parts)
    r = df.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in by + order_cols]) \
          .withColumn("_rp", F.spark_partition_id())
    # The partition id depends on the sampled range bounds, which depend on upstream row
    # order; written once to the shared folder, so the totals and the in-partition sums see
    # the same assignment, also after a lost executor.
    r, _ = kept(r, "ranges")
    tot = r.groupBy(*by, "_rp").agg(*[F.sum(v).alias(f"_t_{v}") for v in value_cols])
    wo = Window.partitionBy(*by).orderBy("_rp").rowsBetween(Window.unboundedPreceding, -1)
    offs = tot.select(*by, "_rp", *[F.coalesce(F.sum(f"_t_{v}").over(wo), F.lit(0)).alias(f"_o_{v}")
                                    for v in value_cols],
                      *[F.sum(f"_t_{v}").over(Window.partitionBy(*by)).alias(f"_n_{v}") for v in value_cols])
    wi = Window.partitionBy(*by, "_rp").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    inner = r.select("*", *[F.coalesce(F.sum(v).over(wi), F.lit(0)).alias(f"_i_{v}") for v in value_cols])
    offs = F.broadcast(offs) if not by else offs  # n_parts rows when ungrouped
    j = null_safe_join(inner, offs, by + ["_rp"])
    return j.select(*df.columns, *[(F.col(f"_o_{v}") + F.col(f"_i_{v}")).alias(f"{prefix}{v}") for v in value_cols],
                    *([F.col(f"_n_{v}").alias(f"{totals}{v}") for v in value_cols] if totals else []))


def row_index(df: DataFrame, order_cols: Sequence[str], by: Sequence[str] = (), name: str = "row_idx",
              n_parts: int | None = None) -> DataFrame:
    """Exact 0-based row position in (by, order_cols) order; ``order_cols`` should end
    with a unique tie-break key (T9)."""
    one = df.withColumn("_one", F.lit(1).cast("long"))
    out = running_totals(one, order_cols, ["_one"], by, n_parts, prefix="_cum")
    return out.withColumnRenamed("_cum_one", name).drop("_one")


def value_positions(df: DataFrame, col: str, by: Sequence[str] = (), n_parts: int | None = None,
                    weight: str | None = None) -> DataFrame:
    """Distinct values of ``col`` (non-null) with their count and the number of rows
    before them: (by..., value, cnt, before, total). Hot values collapse in the partial
    aggregate before any ordering work; ``total`` is the group's count."""
    by = list(by)
    w = F.sum(weight) if weight else F.count(F.lit(1))
    g = df.where(F.col(col).isNotNull()).groupBy(*by, F.col(col).alias("value")).agg(w.cast("long").alias("cnt"))
    out = running_totals(g, ["value"], ["cnt"], by, n_parts, prefix="_b_", totals="_a_")
    return out.withColumnRenamed("_b_cnt", "before").withColumnRenamed("_a_cnt", "total")


def chrono_split(df: DataFrame, ts: str, frac: float = 0.8, n_parts: int | None = None):
    """Sort by ``ts``; split_ts = ts of row ``int(n * frac)``; train ``ts < split_ts``,
    test ``ts >= split_ts`` (a whole tie goes to test, T8).

    Returns ``(split_ts, n_rows)``; the caller compares with a literal.
    """
    share = lambda n: F.array(F.floor(n * F.lit(float(frac))).cast("long"))
    row = select_ranks(df, ts, rank_code(df, ts), [], [(frac, share)], n_parts=n_parts).first()
    return (row["value"], row["total"]) if row else (None, 0)


def with_split(df: DataFrame, ts: str, split_ts, name: str = "split") -> DataFrame:
    return df.withColumn(name, F.when(F.col(ts) < ntz_lit(split_ts), "train").otherwise("test"))


def rolling_folds(df: DataFrame, ts: str, key: str, k: int = 5, n_parts: int | None = None,
                  name: str = "chunk") -> DataFrame:
    """chunk = row index // (n // (k+1)) for rows before (k+1)*fold_size, else null
    (remainder unused). Fold i trains on chunks < i and tests on chunk i (i = 1..k).

    Only (ts, key) is ordered; the k+1 rows that begin a chunk come to the driver, and every
    row finds its chunk by comparing itself with them.
    """
    idx = row_index(df.select(ts, key), [ts, key], n_parts=n_parts)
    n = idx.agg(F.max("row_idx")).first()[0]
    size = 0 if n is None else (n + 1) // (k + 1)
    if size == 0:
        return df.withColumn(name, F.lit(None).cast("int"))
    rows = idx.where(F.col("row_idx").isin([size * i for i in range(1, k + 2)])).orderBy("row_idx").collect()
    kind = df.schema[ts].dataType.simpleString()

    def reached(r):
        at = ntz_lit(r[ts]) if kind == "timestamp_ntz" else F.lit(r[ts]).cast(kind)
        tie = F.col(ts).eqNullSafe(at) & (F.col(key) >= F.lit(r[key]))
        return tie | (F.col(ts).isNotNull() if r[ts] is None else F.coalesce(F.col(ts) > at, F.lit(False)))

    passed = sum((reached(r).cast("int") for r in rows), F.lit(0))
    return df.withColumn(name, F.when(passed <= k, passed))


def rank_code(df: DataFrame, col: str) -> Column:
    """A double or long that orders like ``col`` (a timestamp or number)."""
    kind = dict(df.dtypes)[col]
    return epoch_micros(col).cast("long") if kind.startswith("timestamp") else F.col(col).cast(
        "double" if kind in ("double", "float") or kind.startswith("decimal") else "long")


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = (),
                    n_parts: int | None = None, narrow: bool = False) -> DataFrame:
    """Linear-interpolated quantiles (pandas / numpy default), exact and distributed.

    For each p, h = (n-1)p; q = v[floor h] + (h - floor h) * (v[ceil h] - v[floor h]).
    Only values near the positions floor(h)/ceil(h) are ordered (``selection.select_ranks``; ``narrow`` as there).
    Output: (by..., p, q).
    """
    by = list(by)
    x = df.select(*by, F.col(col).cast("double").alias("_x"))
    h = lambda n, p: F.lit(float(p)) * (n - 1)
    ranks = [(float(p), lambda n, p=p: F.array(F.floor(h(n, p)).cast("long"), F.ceil(h(n, p)).cast("long"))) for p in probs]
    hit = select_ranks(x, "_x", F.col("_x"), by, ranks, narrow, n_parts).withColumn("p", F.array(*[F.lit(p) for p, _ in ranks])[F.col("target")])
    at = F.col("p") * (F.col("total") - 1)
    low = F.floor(at).cast("long")
    agg = hit.groupBy(*by, "p", at.alias("_h"), low.alias("_lo")).agg(
        F.max(F.when(F.col("position") == low, F.col("value"))).alias("_vlo"),
        F.max(F.when(F.col("position") != low, F.col("value"))).alias("_vhi"))
    # a rank outside its bracket would be an error of the sketch beyond its bound: an error, not a null
    vlo = F.coalesce(F.col("_vlo"), F.raise_error(F.lit("rank outside its bracket")).cast("double"))
    vhi = F.coalesce(F.col("_vhi"), vlo)
    return agg.select(*by, "p", (vlo + (F.col("_h") - F.col("_lo")) * (vhi - vlo)).alias("q"))


def quantile_edges(df: DataFrame, col: str, n_bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Interior edges for ``n_bins`` equal-frequency bins (linear interpolation), one row
    per group with columns e1..e{n_bins-1}."""
    probs = [i / n_bins for i in range(1, n_bins)]
    q = exact_quantiles(df, col, probs, by)
    return q.groupBy(*by).pivot("p", probs).agg(F.first("q")).select(
        *by, *[F.col(f"`{p}`").alias(f"e{i + 1}") for i, p in enumerate(probs)])


def quantile_bins(df: DataFrame, col: str, labels: Sequence[str], by: Sequence[str] = (),
                  name: str = "bin", numeric: Column | None = None) -> DataFrame:
    """Pandas ``qcut`` semantics - interpolated edges, right-closed bins, the
    lowest value included in the first bin. ``numeric`` maps a timestamp to a number
    (defaults to epoch microseconds for timestamp columns)."""
    by = list(by)
    dtype = dict(df.dtypes)[col]
    num = numeric if numeric is not None else (
        epoch_micros(col).cast("double") if dtype.startswith("timestamp") else F.col(col).cast("double"))
    x = df.withColumn("_qv", num)
    k = len(labels)
    edges = quantile_edges(x, "_qv", k, by)
    if by:
        j = null_safe_join(x, edges, by)
        e = [F.col(f"e{i}") for i in range(1, k)]
    else:  # one row of k-1 edges: bound as literals (no cross join)
        row = edges.first()
        j = x
        e = [F.lit(None if row is None else row[f"e{i}"]).cast("double") for i in range(1, k)]
    chain = F.when(F.col("_qv").isNull(), F.lit(None).cast("string"))
    for i in range(1, k):
        chain = chain.when(F.col("_qv") <= e[i - 1], F.lit(labels[i - 1]))
    chain = chain.otherwise(F.lit(labels[-1]))
    return j.withColumn(name, chain).drop("_qv", *([f"e{i}" for i in range(1, k)] if by else []))


def resample_count(df: DataFrame, ts: str, freq: str = "D", name: str = "n") -> DataFrame:
    """Row count per day ('D') or per week ending Sunday, labelled by that Sunday
    ('W', T26), with empty buckets zero-filled between the first and last bucket.

    Counts are a partial aggregate; the calendar is generated from the min/max bucket
    (its size is the time span, not the data size) and left-joined to the counts.
    """
    d = F.to_date(F.col(ts))
    if freq == "W":
        bucket = F.date_add(d, (6 - F.weekday(d)))  # Monday=0 .. Sunday=6 -> the Sunday ending the week
        step = F.expr("INTERVAL 7 DAYS")
    else:
        bucket = d
        step = F.expr("INTERVAL 1 DAY")
    counts = df.where(F.col(ts).isNotNull()).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias(name))
    span = counts.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    cal = span.select(F.explode(F.sequence("lo", "hi", step)).alias("bucket"))
    return cal.join(counts, "bucket", "left").select(F.col("bucket").cast("timestamp_ntz").alias("bucket"),
                                                     F.coalesce(F.col(name), F.lit(0)).alias(name))


def trim_tail(df: DataFrame, ts: str, cutoff) -> tuple[DataFrame, DataFrame]:
    """Keep rows with ``ts <= cutoff`` (a timestamp compare, so a date cutoff
    means midnight). Returns (kept rows, one-row before/after/removed report)."""
    kept = df.where(F.col(ts) <= ntz_lit(cutoff))
    rep = df.agg(F.count(F.lit(1)).alias("rows_before"),
                 F.count_if(F.col(ts) <= ntz_lit(cutoff)).alias("rows_after"))
    rep = rep.withColumn("rows_removed", F.col("rows_before") - F.col("rows_after"))
    return kept, rep


def month_index(df: DataFrame, month_col: str) -> DataFrame:
    """Dense 0-based index over the months *present* (small distinct table)."""
    months = df.select(month_col).distinct()
    w = Window.orderBy(month_col)  # over distinct months only: bounded by the calendar span
    return months.withColumn("month_idx", (F.dense_rank().over(w) - 1).cast("int"))


def keep_first(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str]) -> DataFrame:
    """One row per key, the first by ``order_cols`` (min_by over a struct, partial
    aggregate, so a hot key does not land in one task)."""
    others = [c for c in df.columns if c not in keys]
    o = F.struct(*[F.col(c) for c in order_cols])
    row = F.struct(*[F.col(c) for c in others])
    return df.groupBy(*keys).agg(F.min_by(row, o).alias("_r")).select(*keys, "_r.*")
