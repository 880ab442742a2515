"""Run every query against its SQL twin: ``python tests/check_oracles.py [folder] [query ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

import __spark_entry__ as entry  # noqa: E402
from vacantia.session import local_session  # noqa: E402


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return round(v, 9)
    return v


def rows_of(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = [tuple(_cell(None if v is frame.__class__ else v) for v in r) for r in frame.astype(object).where(frame.notna(), None).itertuples(index=False)]
    return sorted(rows, key=repr)


def connect(folder: str):
    con = duckdb.connect()
    for path in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def compare(spark, con, folder: str, name: str) -> str | None:
    """What differs, None when nothing does."""
    sql = entry.oracle_sql().get(name)
    ours = entry.queries()[name](spark, folder).toPandas()
    if sql is None:
        return None
    theirs = con.execute(sql).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} / {sorted(theirs.columns)}"
    a, b = rows_of(ours), rows_of(theirs)
    if len(a) != len(b):
        return f"{len(a)} rows, expected {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ, first {str(bad[0])[:600]}" if bad else None


def main() -> int:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark, con = local_session(), connect(folder)
    failed = 0
    for name in sys.argv[2:] or entry.queries():
        t = time.time()
        try:
            problem = compare(spark, con, folder, name)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        failed += problem is not None
        twin = "" if name in entry.oracle_sql() else " (no SQL)"
        print(f"@@ {'ok  ' if problem is None else 'FAIL'} {name}{twin} {time.time() - t:.1f}s {problem or ''}", flush=True)
    print(f"@@ {failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
