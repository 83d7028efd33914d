"""Run registered queries in Spark and their check SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return round(float(v), 6) + 0.0
    return str(v)


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is not None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, con, fn, sql, sf_dir: str) -> str | None:
    """None when equal, else a short text on the first difference."""
    df = fn(spark, sf_dir)
    got = sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = sorted_rows(names, res.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2]
        lost = [r for r in want if r not in set(got)][:2]
        return f"rows {len(got)} vs {len(want)}; only spark {str(extra)[:300]}; only sql {str(lost)[:300]}"
    for a, b in zip(got, want):
        if a != b:
            n = sum(x != y for x, y in zip(got, want))
            return f"{n} of {len(got)} rows differ: {str(a)[:300]} vs {str(b)[:300]}"
    return None


def main() -> None:
    from conftest import make_session

    import __spark_entry__ as e

    sf_dir = sys.argv[1]
    wanted = sys.argv[2:]
    spark, con = make_session(), oracle(sf_dir)
    bad = 0
    for name, fn in e.queries().items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            sql = e.oracle_sql().get(name)
            if sql:
                why = compare(spark, con, fn, sql, sf_dir)
            else:
                why = None if fn(spark, sf_dir).count() >= 0 else "no rows"
        except Exception as error:
            why = f"{type(error).__name__}: {str(error)[:700]}"
            if wanted:
                traceback.print_exc()
        bad += why is not None
        print(f"{'ok ' if why is None else 'BAD'} {name} {time.time() - start:.1f}s {why or ''}", flush=True)
    print(f"{bad} bad")


if __name__ == "__main__":
    main()
