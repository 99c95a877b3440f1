"""Run queries() against oracle_sql() on one scale factor and report per-query agreement.

usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
import pandas as pd  # noqa: E402

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    if isinstance(v, (bool,)):
        return bool(v)
    try:
        import numpy as np
        if isinstance(v, np.generic):
            return _norm(v.item())
    except Exception:
        pass
    return v


def rows_of(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    out = []
    for rec in df[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(v) for v in rec))
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def compare(spark_pdf: pd.DataFrame, oracle_pdf: pd.DataFrame) -> str:
    if sorted(spark_pdf.columns) != sorted(oracle_pdf.columns):
        return f"COLUMNS spark={sorted(spark_pdf.columns)} oracle={sorted(oracle_pdf.columns)}"
    if len(spark_pdf) != len(oracle_pdf):
        return f"ROWS spark={len(spark_pdf)} oracle={len(oracle_pdf)}"
    a, b = rows_of(spark_pdf), rows_of(oracle_pdf)
    diffs = [(x, y) for x, y in zip(a, b) if x != y]
    if diffs:
        return f"VALUES {len(diffs)} differ, e.g. spark={diffs[0][0]} oracle={diffs[0][1]}"
    return "OK"


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    import __spark_entry__ as E
    from cardpulse.session import get_session
    spark = get_session("local[8]")
    qs, oq = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name, fn in qs.items():
        if names and name not in names:
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf_dir).toPandas()
        except Exception as e:  # noqa: BLE001
            print(f"{name:28s} SPARK-ERROR {type(e).__name__}: {str(e)[:300]}")
            bad += 1
            continue
        t1 = time.time()
        if name not in oq:
            print(f"{name:28s} rows-only {len(sdf)} rows  spark {t1 - t0:.1f}s")
            continue
        try:
            odf = con.execute(oq[name]).df()
        except Exception as e:  # noqa: BLE001
            print(f"{name:28s} ORACLE-ERROR {str(e)[:300]}")
            bad += 1
            continue
        res = compare(sdf, odf)
        bad += res != "OK"
        print(f"{name:28s} {res[:400]}  ({len(sdf)} rows, spark {t1 - t0:.1f}s)")
    print("FAILED" if bad else "ALL OK", bad)


if __name__ == "__main__":
    main()
