"""M1: standard scaling fitted on one frame and applied to another.

Mean and *population* std (ddof 0) as the reference's scaler; a constant column divides
by 1. The fit is one aggregate row, bound to the apply side as literals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scale_fit(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*[F.avg(F.col(c).cast("double")).alias(f"m{i}") for i, c in enumerate(cols)],
                 *[F.stddev_pop(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)]).first()
    out = {}
    for i, c in enumerate(cols):
        m, s = row[f"m{i}"], row[f"s{i}"]
        out[c] = (m if m is not None else 0.0, s if s else 1.0)
    return out


def scale_apply(df: DataFrame, stats: dict[str, tuple[float, float]], suffix: str = "") -> DataFrame:
    """Replace (or add with ``suffix``) each column by (x - mean) / std."""
    exprs = {c: ((F.col(c).cast("double") - F.lit(m)) / F.lit(s)) for c, (m, s) in stats.items()}
    if suffix:
        return df.select("*", *[e.alias(f"{c}{suffix}") for c, e in exprs.items()])
    return df.select(*[exprs[c].alias(c) if c in exprs else F.col(c) for c in df.columns])
