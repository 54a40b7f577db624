"""Final shape of query results: rounded doubles and textual times."""

from __future__ import annotations

from pyspark.sql import DataFrame


def present(df: DataFrame, digits: int = 6, coarse: dict[str, int] | None = None) -> DataFrame:
    """The small shift takes exact halves off the rounding edge, where two
    engines may round to different sides; both zeros become one."""
    coarse = coarse or {}
    out = []
    for name, kind in df.dtypes:
        if kind in ("double", "float"):
            out.append(_real(name, coarse.get(name, digits)))
        elif kind in ("timestamp", "timestamp_ntz", "date"):
            out.append(f"CAST(`{name}` AS STRING) AS `{name}`")
        else:
            out.append(f"`{name}`")
    return df.selectExpr(*out)


def _real(name: str, digits: int) -> str:
    r = f"round(`{name}` + 1e-{digits + 4}, {digits})"
    return f"CASE WHEN {r} = 0 THEN 0D ELSE {r} END AS `{name}`"


def sql_real(expression: str, name: str, digits: int = 6) -> str:
    """The same rounding in SQL."""
    r = f"round({expression} + 1e-{digits + 4}, {digits})"
    return f"CASE WHEN {r} = 0 THEN CAST(0 AS DOUBLE) ELSE {r} END AS {name}"
