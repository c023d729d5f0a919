"""Small SQL-text helpers for oracle statements (guarded correlation, normal tail p)."""

from __future__ import annotations


def corr_sql(x: str, y: str) -> str:
    both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    xs, ys = f"CASE WHEN {both} THEN CAST({x} AS DOUBLE) END", f"CASE WHEN {both} THEN CAST({y} AS DOUBLE) END"
    return f"(covar_pop({xs}, {ys}) / nullif(sqrt(var_pop({xs}) * var_pop({ys})), 0))"


def n_sql(x: str, y: str) -> str:
    return f"count(*) FILTER (WHERE {x} IS NOT NULL AND {y} IS NOT NULL)"


def t_sql(r: str, n: str) -> str:
    return f"({r} * sqrt(CAST({n} - 2 AS DOUBLE) / nullif(1 - {r} * {r}, 0)))"


def p_sql(t: str) -> str:
    x = f"(abs({t}) / sqrt(2.0))"
    tt = f"(1.0 / (1.0 + 0.3275911 * {x}))"
    poly = (f"({tt} * (0.254829592 + {tt} * (-0.284496736 + {tt} * (1.421413741 + {tt} * "
            f"(-1.453152027 + {tt} * 1.061405429)))))")
    return f"({poly} * exp(-{x} * {x}))"


def corr_rows_sql(source: str, label: str, features: list[str], by: str | None = None) -> str:
    """UNION of one row per feature: (by, feature, r, n, t, p)."""
    parts = []
    for f in features:
        b = f"{by}, " if by else ""
        g = f" GROUP BY {by}" if by else ""
        parts.append(f"SELECT {b}'{f}' AS feature, {corr_sql(f, label)} AS r, {n_sql(f, label)} AS n FROM {source}{g}")
    inner = " UNION ALL ".join(parts)
    return f"SELECT *, {t_sql('r', 'n')} AS t, {p_sql(t_sql('r', 'n'))} AS p FROM ({inner})"
