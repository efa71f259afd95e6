"""Runs registered queries beside their SQL in DuckDB: python tests/oracle.py SF_DIR [NAME...]"""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        where = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{where}')")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NA or isinstance(x, float) and x != x:
            return None
        return round(x, 6) if isinstance(x, float) else x.item() if hasattr(x, "item") and not isinstance(x, pd.Timestamp) else x

    out = [tuple(plain(x) for x in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)]
    return sorted([tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in out], key=repr)


def differs(spark, con, sf_dir: str, query, sql: str) -> str | None:
    ours, theirs = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    if sorted(ours.columns) != sorted(theirs.columns):
        return f"columns {sorted(ours.columns)} {sorted(theirs.columns)}"
    a, b = rows(ours), rows(theirs)
    if a != b:
        odd = next(((x, y) for x, y in zip(a, b, strict=False) if x != y), None)
        return f"{len(a)} rows, SQL {len(b)}; first odd {odd}"
    return None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e
    from graphloom.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, sql = connection(sys.argv[1]), e.queries(), e.oracle_sql()
    for name in sys.argv[2:] or sql:
        began = time.time()
        try:
            why = differs(spark, con, sys.argv[1], queries[name], sql[name])
        except Exception as x:
            why = f"{type(x).__name__}: {str(x)[:600]}"
        print(f"{name}: {why or 'ok'} ({time.time() - began:.1f} s)", flush=True)
