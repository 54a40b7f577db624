"""Side-by-side check of registered queries and their SQL.

`python tests/compare.py [name-prefix ...] [--sf 0.01]` prints one line each.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def canonical(value):
    if isinstance(value, float):
        return "NULL" if math.isnan(value) else f"{value:.9g}"
    if value is None:
        return "NULL"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    if isinstance(value, int):
        return f"{float(value):.9g}" if abs(value) < 2**53 else str(value)
    return str(value)


def difference(left, right, left_names, right_names) -> str | None:
    """What differs between two row lists, or None."""
    if sorted(left_names) != sorted(right_names):
        return f"columns {sorted(set(left_names) ^ set(right_names))}"
    if len(left) != len(right):
        return f"rows {len(left)} against {len(right)}"
    names = sorted(left_names)
    order = lambda rows, has: sorted(
        tuple(canonical(r[has.index(n)]) for n in names) for r in rows
    )
    a, b = order(left, left_names), order(right, right_names)
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if not wrong:
        return None
    x, y = wrong[0]
    cells = [(n, p, q) for n, p, q in zip(names, x, y) if p != q]
    return f"{len(wrong)} rows differ, first {cells[:4]}"


def compare(spark, con, folder, name, query, sql) -> str | None:
    df = query(spark, folder)
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return None
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    return difference(rows, result.fetchall(), df.columns, names)


def main() -> None:
    import __spark_entry__ as entry
    from tickloom.session import local_session

    args = sys.argv[1:]
    sf = "0.01"
    if "--sf" in args:
        at = args.index("--sf")
        sf = args[at + 1]
        del args[at : at + 2]
    folder = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    con = connect(folder)
    oracle = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            found = compare(spark, con, folder, name, query, oracle.get(name))
        except Exception as error:  # report and go on with the next query
            found = f"{type(error).__name__}: {str(error)[:600]}"
        bad += found is not None
        mark = "FAIL" if found else ("ok" if name in oracle else "rows")
        print(f"{mark:5} {name:34} {time.time() - start:6.2f}s {found or ''}", flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
