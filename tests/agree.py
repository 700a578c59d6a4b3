"""Run registered queries beside their DuckDB text and compare schema names, counts and values."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb

from tidemark.plans import catalog
from tidemark.session import local_session
from tidemark.sources.estate import TABLES


def duck(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def rows_of(columns: list[str], rows) -> tuple[list[str], list[str]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    named = [columns[i] for i in order]
    return named, sorted(repr(tuple(row[i] for i in order)) for row in rows)


def compare(spark, con, name: str, sf_dir: str) -> str:
    df = catalog.QUERIES[name](spark, sf_dir)
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if name not in catalog.ORACLES:
        return f"rows only: {len(got)}"
    done = con.execute(catalog.ORACLES[name])
    names = [d[0] for d in done.description]
    want_names, want = rows_of(names, done.fetchall())
    if got_names != want_names:
        return f"DIFFERENT columns {got_names} {want_names}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:2]
        lost = [r for r in want if r not in set(got)][:2]
        return f"DIFFERENT {len(got)} rows, wanted {len(want)}; only here {extra}; missing {lost}"
    return f"agrees: {len(got)}"


if __name__ == "__main__":
    sf = sys.argv[1]
    picked = [n for n in catalog.QUERIES if len(sys.argv) < 3 or any(n.startswith(p) for p in sys.argv[2:])]
    spark, con = local_session(), duck(sf)
    for name in picked:
        t0 = time.time()
        try:
            said = compare(spark, con, name, sf)
        except Exception as problem:  # noqa: BLE001
            said = f"FAILED {str(problem)[:600]}"
        print(f"{name:34} {time.time() - t0:6.2f}s {said}", flush=True)
