"""Spark query vs DuckDB oracle comparison (what the driver's verify does).

Usage: python tests/compare.py [sf_dir] [key ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return round(v, 6)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def canonical(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    rows = []
    for rec in df[cols].itertuples(index=False, name=None):
        rows.append(tuple(_norm(v) for v in rec))
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, sf_dir: str, keys: list[str] | None = None) -> dict[str, dict]:
    import __spark_entry__ as E

    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for key in keys or list(qs):
        res = {"key": key}
        t = time.time()
        try:
            sdf = qs[key](spark, sf_dir)
            s_pdf = sdf.toPandas()
            res["spark_sec"] = round(time.time() - t, 2)
            res["rows"] = len(s_pdf)
            if key not in sqls:
                res["status"] = "rows-only"
                out[key] = res
                continue
            d_pdf = con.execute(sqls[key]).fetchdf()
            res["oracle_rows"] = len(d_pdf)
            if sorted(s_pdf.columns) != sorted(d_pdf.columns):
                res["status"] = "COLUMNS"
                res["detail"] = (sorted(set(s_pdf.columns) ^ set(d_pdf.columns)))
            elif len(s_pdf) != len(d_pdf):
                res["status"] = "ROWCOUNT"
            else:
                a, b = canonical(s_pdf), canonical(d_pdf)
                if a == b:
                    res["status"] = "ok"
                else:
                    res["status"] = "VALUES"
                    diffs = [(x, y) for x, y in zip(a, b) if x != y]
                    res["detail"] = f"{len(diffs)} rows differ; first: {diffs[:2]}; cols {sorted(s_pdf.columns)}"
            dt = {c: (str(s_pdf[c].dtype), str(d_pdf[c].dtype)) for c in s_pdf.columns
                  if c in d_pdf.columns and str(s_pdf[c].dtype) != str(d_pdf[c].dtype)}
            if dt:
                res["dtypes"] = dt
        except Exception as e:  # noqa: BLE001
            res["status"] = "ERROR"
            res["detail"] = f"{type(e).__name__}: {str(e)[:600]}"
        out[key] = res
    return out


if __name__ == "__main__":
    from loanroll.session import get_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    keys = sys.argv[2:] or None
    spark = get_session("local[8]", 8)
    results = compare(spark, sf, keys)
    bad = 0
    for k, r in results.items():
        flag = r["status"]
        bad += flag not in ("ok", "rows-only")
        print(f"{flag:9s} {k:34s} rows={r.get('rows')} oracle={r.get('oracle_rows')} "
              f"t={r.get('spark_sec')} {r.get('dtypes', '')} {r.get('detail', '')}")
    print(f"{len(results) - bad}/{len(results)} ok")
