"""Mixing sources to target weights by Poisson replication (operator 4, native).

A source with weight w and n documents gets the mean repetition rate w * total / n, so its expected
share of the mixed corpus is w. Each document draws its number of copies from a Poisson
distribution by inverting the cumulative distribution at a uniform number hashed from the seed and
the document, is exploded by that count, and the copies are dealt out and sorted by a second hash:
a global shuffle whose order depends on the seed alone, not on executors or retries.

Rates above ``CHUNK`` are the sum of independent draws of at most ``CHUNK`` each (a sum of Poisson
variables is Poisson), so no exponential underflows and no mass is cut off.

Skew: counts per source are aggregated map-side before the shuffle. The rate table has one row per
source; it is broadcast if it is counted to have at most ``BROADCAST_SOURCES`` rows, else the planner
chooses and splits skewed partitions. The final shuffle is on a hash of document and copy, which no
key can heat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK = 16.0
#: Steps of one inversion: at a mean of 16 the tail beyond 100 is under 2^-100, below a double's grain.
STEPS = 100
BROADCAST_SOURCES = 100_000
HEX = 13  # hex digits of a hash that make the uniform number: 52 bits


def hashed_uniform(*parts):
    """Uniform in (0, 1) from the MD5 of the parts joined by ``:`` (52 bits, centred)."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    digits = F.conv(F.substring(F.md5(text.cast("binary")), 1, HEX), 16, 10).cast("double")
    return (digits + F.lit(0.5)) / F.lit(16.0 ** HEX)


def poisson_quantile(u, rate):
    """The least k with P(X <= k) > u for X ~ Poisson(rate), rate at most ``CHUNK``."""
    first = F.exp(-rate)
    done = F.aggregate(
        F.sequence(F.lit(1), F.lit(STEPS)),
        F.struct(first.alias("p"), first.alias("cdf"), F.lit(0).alias("k")),
        lambda s, i: F.struct((s["p"] * rate / i).alias("p"), (s["cdf"] + s["p"] * rate / i).alias("cdf"),
                              F.when(s["cdf"] > u, s["k"]).otherwise(i).alias("k")))
    return done["k"]


def source_rates(docs: DataFrame, weights: DataFrame | None = None, source_col: str = "source",
                 total: int | None = None) -> DataFrame:
    """(source, n_docs, rate) per source. ``weights``: (source, weight), any non-negative scale;
    without it all sources weigh the same. A source that ``weights`` does not name has weight 0.
    ``total``: expected size of the mixture, the number of documents if not given."""
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"))
    weighed = (counts.withColumn("weight", F.lit(1.0)) if weights is None else
               counts.join(weights.select(F.col("source").alias("w_source"), F.col("weight").cast("double").alias("weight")),
                           F.col("source").eqNullSafe(F.col("w_source")), "left").drop("w_source"))
    weighed = weighed.withColumn("weight", F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)))
    sums = weighed.agg(F.sum("weight").alias("all_weight"), F.sum("n_docs").alias("all_docs"), F.count(F.lit(1)).alias("n")).first()
    size, weight = float(total if total is not None else sums["all_docs"] or 0), float(sums["all_weight"] or 0.0)
    rates = weighed.select("source", "n_docs", "weight",
                           (F.col("weight") / F.lit(weight if weight > 0 else 1.0) * F.lit(size) / F.col("n_docs")).alias("rate"))
    return F.broadcast(rates) if sums["n"] <= BROADCAST_SOURCES else rates


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, source_col: str = "source",
                id_col: str = "doc_id", seed: int = 0, total: int | None = None) -> DataFrame:
    """All columns of ``docs`` plus ``copy_no`` (from 1), ``rate`` and ``mix_order``; one row per copy,
    globally shuffled (dealt out by ``mix_order`` and sorted by it within each partition).

    A null source is a source of its own. Documents whose draw is 0 do not appear: that is the
    operator. Rows that repeat a ``doc_id`` draw the same count. Null ids draw as the word ``null``.
    Null or empty texts are kept. Input columns named like an added one are replaced by it. An
    empty table gives an empty result.
    """
    kept = docs.drop("copy_no", "rate", "mix_order", "_rate", "_source")
    rates = source_rates(docs, weights, source_col, total).select(F.col("source").alias("_source"), F.col("rate").alias("_rate"))
    rated = kept.join(rates, F.col(source_col).eqNullSafe(F.col("_source"))).drop("_source")
    parts = F.greatest(F.ceil(F.col("_rate") / CHUNK), F.lit(1)).cast("int")
    draws = F.transform(F.sequence(F.lit(1), parts), lambda j: poisson_quantile(
        hashed_uniform(F.lit(seed), F.col(id_col), j), F.col("_rate") / parts))
    copies = F.aggregate(draws, F.lit(0), lambda a, x: a + x)
    exploded = (rated.withColumn("_copies", copies).where("_copies > 0")
                .withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
                .withColumn("mix_order", F.md5(F.concat_ws(":", F.lit(f"order{seed}"), F.col(id_col).cast("string"),
                                                           F.col("copy_no").cast("string")).cast("binary"))))
    out = exploded.select(*kept.columns, "copy_no", F.col("_rate").alias("rate"), "mix_order")
    return out.repartition("mix_order").sortWithinPartitions("mix_order")
