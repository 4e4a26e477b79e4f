"""Run queries against their DuckDB oracle: python tests/oracle.py [name-part ...]"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype == object or str(df[c].dtype) in ("str", "string"):
            df[c] = df[c].map(lambda v: None if v is None or v is pd.NA or (isinstance(v, float) and np.isnan(v)) else str(v))
        else:
            df[c] = df[c].astype("float64")
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def compare(spark_df: pd.DataFrame, sql_df: pd.DataFrame) -> str:
    """Empty when equal, else a short description of the first differences."""
    if sorted(spark_df.columns) != sorted(sql_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(sql_df.columns)}"
    if len(spark_df) != len(sql_df):
        return f"rows {len(spark_df)} != {len(sql_df)}"
    a, b = normal(spark_df), normal(sql_df)
    notes = []
    for c in a.columns:
        x, y = a[c], b[c]
        same = (x == y) | (x.isna() & y.isna())
        if not same.all():
            i = int(np.argmin(same.values))
            notes.append(f"{c}: {int((~same).sum())} differ, e.g. {x[i]!r} vs {y[i]!r}")
    return "; ".join(notes)


if __name__ == "__main__":
    from tickloom.queries.catalog import QUERIES
    from tickloom.session import local_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    parts = sys.argv[1:]
    spark = local_session(**({"tickloom.block.rows": os.environ["BLOCK"]} if "BLOCK" in os.environ else {}))
    con = connect(folder)
    bad = 0
    for name, query in QUERIES.items():
        if parts and not any(p in name for p in parts):
            continue
        t = time.time()
        try:
            got = query.run(spark, folder).toPandas()
            took = time.time() - t
            if query.sql is None:
                print(f"rows   {name} {len(got)} {took:.2f}s", flush=True)
                continue
            t = time.time()
            note = compare(got, con.execute(query.oracle()).df())
            nulls = [c for c in got.columns if got[c].isna().all()]
            bad += bool(note)
            print(f"{'DIFF' if note else 'ok  '}   {name} {len(got)} {took:.2f}s duck {time.time() - t:.2f}s {note}"
                  + (f" ALL-NULL {nulls}" if nulls else ""), flush=True)
        except Exception as e:  # report and go on with the next query
            bad += 1
            print(f"ERROR  {name} {str(e)[:600]}", flush=True)
    print("bad:", bad)
