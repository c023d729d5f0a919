"""Exact values at wanted ranks without ordering the values: a mergeable sketch brackets each rank, counts make it exact.

Pass 1 writes the described columns once (Parquet, nothing else of the input) and takes per group the row count and
a quantile sketch (``percentile_approx``, combined before the shuffle). The sketch's error bound gives, for each
wanted rank, two values between which it lies. Pass 2 counts the rows below each bracket exactly; pass 3 keeps
only the rows inside (a few of ``ACCURACY`` of all rows a target) and finds the rank among these by position. What
is shuffled and ordered is that narrow part, so neither a hot value nor a hot group gathers in a task.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import remove_path, scratch_path

ACCURACY = 10_000
#: Brackets reach three times the sketch's error bound to each side; groups of fewer rows than this are taken whole.
MARGIN, WHOLE = 3 / ACCURACY, 5 * ACCURACY
GROUPS_SENT = 10_000  # brackets of at most so many groups are broadcast


def kept(df: DataFrame, name: str = "kept") -> tuple[DataFrame, str]:
    """``df`` written once as Parquet in the shared scratch folder, and where."""
    path = scratch_path(df.sparkSession, f"{name}/{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def select_ranks(df: DataFrame, value: str, code: Column, by: Sequence[str], targets: Sequence[tuple[float, Callable[[Column], Column]]],
                 narrow: bool = False, n_parts: int | None = None) -> DataFrame:
    """(by..., target, position, value, total): the values at the 0-based positions that each target asks for.

    ``code``: a double or long in the order of ``value``. A target is (share, from the group's row count to an array of
    positions), the positions lying within eight rows of share * rows. Null values take no part; NaN is greatest.
    ``narrow``: ``df`` is a written table of little else than these columns and needs no copy.
    """
    from ledgerlens.operators.ordering import null_safe_join, value_positions
    by = list(by)
    x, path = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_v"), code.alias("_c")), None
    if not narrow:
        x, path = kept(x, "ranks")
    kind = x.schema["_c"].dataType.simpleString()
    floating = kind in ("double", "float")
    top = F.lit(float("inf"))
    sketched = F.when(F.isnan("_c"), top).otherwise(F.col("_c")) if floating else F.col("_c")
    ends = [(max(p - MARGIN, 0.0), min(p + MARGIN, 1.0)) for p, _ in targets]
    sketch = x.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx(sketched, [q for e in ends for q in e], ACCURACY).alias("_q"))
    some = F.col("_n") >= WHOLE
    low = F.array(*[F.when(some & F.lit(p - MARGIN > 0), F.col("_q")[2 * i]) for i, (p, _) in enumerate(targets)])
    high = F.array(*[F.when(some & F.lit(p + MARGIN < 1) & ((F.col("_q")[2 * i + 1] < top) if floating else F.lit(True)), F.col("_q")[2 * i + 1])
                     for i, (p, _) in enumerate(targets)])
    brackets, bracket_path = kept(sketch.select(*by, "_n", low.cast(f"array<{kind}>").alias("_low"), high.cast(f"array<{kind}>").alias("_high")), "brackets")
    if by:
        groups = brackets.count()
        joined = null_safe_join(x, F.broadcast(brackets) if groups <= GROUPS_SENT else brackets, by)
    else:
        row = brackets.first()
        held = lambda v: F.array(*[F.lit(e).cast(kind) for e in v])
        joined = x.select("*", F.lit(row["_n"]).cast("long").alias("_n"), held(row["_low"] or [None] * len(targets)).alias("_low"),
                          held(row["_high"] or [None] * len(targets)).alias("_high"))
    below, below_path = kept(joined.groupBy(*by).agg(F.max("_n").alias("_n"), F.array(
        *[F.count_if(F.coalesce(F.col("_c") < F.col("_low")[i], F.lit(False))) for i in range(len(targets))]).alias("_below")), "below")
    inside = F.filter(F.sequence(F.lit(0), F.lit(len(targets) - 1)), lambda t: F.coalesce(F.col("_c") >= F.get("_low", t), F.lit(True))
                      & F.coalesce(F.col("_c") <= F.get("_high", t), F.lit(True)))
    places = value_positions(joined.select(*by, "_v", F.explode(inside).alias("target")), "_v", by + ["target"], n_parts)
    positions = F.array(*[rank(F.col("_n")) for _, rank in targets])
    if by:
        found = null_safe_join(places, F.broadcast(below) if groups <= GROUPS_SENT else below, by)
    else:
        row = below.first()
        found = places.select("*", F.lit(row["_n"] if row else 0).cast("long").alias("_n"),
                              F.array(*[F.lit(b).cast("long") for b in (row["_below"] if row and row["_below"] else [0] * len(targets))]).alias("_below"))
    at = F.col("before") + F.get("_below", F.col("target"))
    mine = F.filter(F.array_distinct(F.get(positions, F.col("target"))), lambda r: (at <= r) & (r < at + F.col("cnt")))
    out, _ = kept(found.select(*by, "target", F.explode(mine).alias("position"), "value", F.col("_n").alias("total")), "ranks-found")
    for done in (path, bracket_path, below_path):
        if done is not None:
            remove_path(df.sparkSession, done)
    return out
