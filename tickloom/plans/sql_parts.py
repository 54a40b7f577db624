"""Shared pieces of the comparison SQL (DuckDB dialect).

The statements are written from the definitions of the features, with plain
windows per entity, and share no code with the Spark operators.
"""

from __future__ import annotations

from collections.abc import Iterable

from tickloom.plans.present import sql_real

HOURLY_BARS = """
bars AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS bar_ts,
         arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events GROUP BY 1, 2)"""

SESSION_BARS = """
bars AS (
  SELECT 'S' || (user_id % 3) AS symbol, time_bucket(INTERVAL '5 minutes', ts) AS bar_ts,
         arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume
  FROM events
  WHERE event_type <> 'error' AND isodow(ts) <= 5 AND hour(ts) BETWEEN 4 AND 19
  GROUP BY 1, 2)"""

ARTICLES = """
scored AS (
  SELECT event_id AS article_id, 'S' || (user_id % 3) AS symbol, ts AS time_published,
         (CAST(json_extract(props, '$.k') AS INTEGER) - 50) / 50.0::DOUBLE AS score
  FROM events WHERE event_type = 'error'),
articles AS (
  SELECT *, CASE WHEN score >= 0.6 THEN 'Bullish' WHEN score >= 0.2 THEN 'Somewhat-Bullish'
                 WHEN score <= -0.6 THEN 'Bearish' WHEN score <= -0.2 THEN 'Somewhat-Bearish'
                 ELSE 'Neutral' END AS label
  FROM scored)"""

ORDER_BARS = """
bars AS (
  SELECT o_orderpriority AS symbol, o_orderdate AS bar_ts,
         arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close,
         CAST(count(*) AS DOUBLE) AS volume
  FROM orders GROUP BY 1, 2)"""

DAILY = """
pieces AS (
  SELECT CAST(l_shipdate AS DATE) AS day, 20 + 1000 * (avg(l_discount) - 0.05) AS VIX,
         avg(l_quantity) AS DXY,
         100 * avg(CASE WHEN l_linestatus = 'O' THEN l_tax END) AS FVX,
         100 * avg(CASE WHEN l_linestatus = 'F' THEN l_tax END) AS TNX
  FROM lineitem GROUP BY 1),
daily AS (
  SELECT 'VIX' AS series, day, VIX AS close FROM pieces WHERE VIX IS NOT NULL
  UNION ALL SELECT 'DXY', day, DXY FROM pieces WHERE DXY IS NOT NULL
  UNION ALL SELECT 'FVX', day, FVX FROM pieces WHERE FVX IS NOT NULL
  UNION ALL SELECT 'TNX', day, TNX FROM pieces WHERE TNX IS NOT NULL
  UNION ALL SELECT 'XL' || l_returnflag, CAST(l_shipdate AS DATE),
                   sum(l_extendedprice) / sum(l_quantity)
  FROM lineitem GROUP BY 1, 2)"""


def windows(part: str = "symbol", order: str = "bar_ts", sizes: Iterable[int] = ()) -> str:
    """WINDOW clause: e (ordered), c (so far) and w<n> (last n rows)."""
    base = f"PARTITION BY {part} ORDER BY {order}"
    named = [f"e AS ({base})", f"c AS ({base} ROWS UNBOUNDED PRECEDING)"]
    named += [f"w{n} AS ({base} ROWS {n - 1} PRECEDING)" for n in sorted(set(sizes))]
    return "WINDOW " + ", ".join(named)


def roll(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) OVER w{n} = {n} THEN {agg}({x}) OVER w{n} END"


def roll_quantile(x: str, q: float, n: int) -> str:
    return f"CASE WHEN count({x}) OVER w{n} = {n} THEN quantile_cont({x}, {q}) OVER w{n} END"


def flag(condition: str) -> str:
    return f"CAST(coalesce(CAST(({condition}) AS INTEGER), 0) AS INTEGER)"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def final(source: str, texts: Iterable[str], reals: Iterable[str], whole: Iterable[str] = (),
          digits: int = 6, coarse: dict[str, int] | None = None) -> str:
    coarse = coarse or {}
    columns = [f"CAST({c} AS VARCHAR) AS {c}" for c in texts]
    columns += [c for c in whole]
    columns += [sql_real(c, c, coarse.get(c, digits)) for c in reals]
    return f"SELECT {', '.join(columns)} FROM {source}"


def ewm(x: str, span: int, part: str = "symbol", order: str = "bar_ts") -> str:
    """Weighted mean over all rows so far, as a list expression."""
    d = 1 - 2 / (span + 1)
    held = f"list(struct_pack(v := {x})) OVER c"
    top = f"list_sum(list_transform({held}, (s, i) -> s.v * pow({d!r}, len({held}) - i)))"
    low = (
        f"list_sum(list_transform({held}, (s, i) -> CASE WHEN s.v IS NULL THEN 0 "
        f"ELSE pow({d!r}, len({held}) - i) END))"
    )
    return f"({top}) / nullif({low}, 0)"


def single(x: str) -> str:
    """A value to nine places, in single precision."""
    return f"CAST(CAST(CASE WHEN abs({x}) < 1e9 THEN round_even({x} * 1e9, 0) / 1e9 ELSE {x} END AS FLOAT) AS DOUBLE)"
