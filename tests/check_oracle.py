"""Compare registered queries with their SQL in DuckDB: python tests/check_oracle.py SF [names...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
import pandas as pd

from framewright.plans.catalog import ORACLES, QUERIES
from framewright.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canon(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)

    def cell(v):
        if v is None or v is pd.NaT or v is pd.NA:
            return "NULL"
        if isinstance(v, float):
            if v != v:
                return "NULL"
            return repr(v + 0.0) if v != int(v if abs(v) < 1e300 else 0) else str(int(v))
        if hasattr(v, "isoformat"):
            return v.isoformat()
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if type(v).__name__.startswith(("int", "uint")):
            return str(int(v))
        if type(v).__name__.startswith("float"):
            return cell(float(v))
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in pdf[cols].itertuples(index=False))


def compare(spark, con, sf: str, name: str) -> tuple[bool, str]:
    t0 = time.time()
    got = QUERIES[name](spark, sf).toPandas()
    took = time.time() - t0
    if name not in ORACLES:
        return len(got) > 0, f"rows={len(got)} (no SQL) {took:.1f}s"
    t0 = time.time()
    want = con.execute(ORACLES[name]).fetchdf()
    sql_took = time.time() - t0
    if sorted(got.columns) != sorted(want.columns):
        return False, f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    a, b = canon(got), canon(want)
    if a == b:
        note = "" if len(a) else " EMPTY"
        return True, f"rows={len(a)}{note} {took:.1f}s sql {sql_took:.1f}s"
    sa, sb = set(a), set(b)
    only_a = [r for r in a if r not in sb][:3]
    only_b = [r for r in b if r not in sa][:3]
    return False, f"rows {len(a)} vs {len(b)}\n   spark {only_a}\n   sql   {only_b}"


def main() -> None:
    sf = f"/root/testdata/sf{sys.argv[1]}"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session("check")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = []
    for name in names:
        try:
            ok, note = compare(spark, con, sf, name)
        except Exception as exc:  # report and go on with the next query
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        print(("ok  " if ok else "FAIL"), name, note, flush=True)
        if not ok:
            bad.append(name)
    print(f"{len(names) - len(bad)}/{len(names)} ok", bad)


if __name__ == "__main__":
    main()
