"""Run registered queries next to their SQL: ``python tests/check_oracle.py [sf] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return float(value)
    return str(value)


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(plain, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def compare(df, con, sql) -> str | None:
    """None when equal, otherwise a short description of the difference."""
    a_cols, a = _sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    start = time.time()
    cur = con.execute(sql)
    b_cols, b = _sorted_rows([d[0] for d in cur.description], cur.fetchall())
    if time.time() - start > 10:
        print(f"  slow SQL: {time.time() - start:.0f}s")
    if a_cols != b_cols:
        return f"columns {sorted(set(a_cols) ^ set(b_cols))}"
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    wrong = [(x, y) for x, y in zip(a, b) if x != y]
    if wrong:
        x, y = wrong[0]
        diff = [(c, u, v) for c, u, v in zip(a_cols, x, y) if u != v]
        return f"{len(wrong)} of {len(a)} rows differ, first: {diff[:4]} in {dict(zip(a_cols, x)) if len(x) < 15 else ''}"
    return None


def main() -> int:
    from conftest import make_session

    from fieldseries.catalog import ORACLES, QUERIES

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    wanted = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = make_session()
    con = duck(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if wanted and name not in wanted:
            continue
        start = time.time()
        try:
            if name in ORACLES:
                result = compare(fn(spark, sf_dir), con, ORACLES[name]) or "ok"
            else:
                result = f"rows only: {len(fn(spark, sf_dir).collect())}"
        except Exception as exc:  # report and go on with the next query
            result = f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += result != "ok" and not result.startswith("rows only")
        print(f"{name:32s} {time.time() - start:6.1f}s  {result}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
