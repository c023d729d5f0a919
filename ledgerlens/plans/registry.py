"""Query registry: key -> (Spark builder, oracle SQL, rounding spec).

Every Spark builder takes (spark, sf_dir) and returns a lazy DataFrame over the proxy
tables of ``sf_dir``. Double columns listed in ``rnd`` are rounded the same way on both
sides (summation order differs between engines).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.plans.oracle_views import with_views


@dataclass
class QuerySpec:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    rnd: dict = field(default_factory=dict)
    ids: str = ""


REGISTRY: dict[str, QuerySpec] = {}


def _round_df(df: DataFrame, rnd: dict) -> DataFrame:
    if not rnd:
        return df
    return df.select(*[F.round(F.col(c), rnd[c]).alias(c) if c in rnd else F.col(c) for c in df.columns])


def _round_sql(sql: str, rnd: dict) -> str:
    if not rnd:
        return sql
    rep = ", ".join(f"round({c}, {d}) AS {c}" for c, d in rnd.items())
    return f"SELECT * REPLACE ({rep}) FROM (\n{sql}\n) AS oracle_q"


def query(name: str, body: str | None = None, mart: bool = False, extra: str = "",
          rnd: dict | None = None, ids: str = ""):
    """Register a Spark builder; ``body`` is the oracle SQL over the proxy CTEs."""
    rnd = dict(rnd or {})

    def deco(fn):
        def build(spark: SparkSession, sf_dir: str) -> DataFrame:
            return _round_df(fn(spark, sf_dir), rnd)
        build.__name__ = fn.__name__
        build.__doc__ = fn.__doc__
        sql = _round_sql(with_views(body, mart=mart, extra=extra), rnd) if body is not None else None
        REGISTRY[name] = QuerySpec(name, build, sql, rnd, ids)
        return fn
    return deco


def R(*cols, d: int = 6) -> dict:
    """Rounding spec helper: the same number of decimals for several columns."""
    return {c: d for c in cols}
