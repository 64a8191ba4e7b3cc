"""Run registered queries and their SQL side by side.

    python -m tests.compare <folder> [name ...]
"""
from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time
import traceback

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


def session(cores: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName("rosterlake-check").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(root: str):
    con = duckdb.connect()
    for f in glob.glob(f"{root}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, int):
        return f"{float(v):.9g}" if abs(v) < 1e9 else str(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, x or "") for x in r))


def compare(spark, con, root, name, fn, sql):
    started = time.time()
    df = fn(spark, root)
    got = df.collect()
    took = time.time() - started
    if sql is None:
        return "rows-only", len(got), took, ""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return "COLUMNS", len(got), took, f"{sorted(df.columns)} vs {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a == b:
        return "ok", len(got), took, ""
    sa, sb = set(a), set(b)
    extra, miss = [r for r in a if r not in sb][:3], [r for r in b if r not in sa][:3]
    return "DIFF", len(got), took, f"{len(a)} vs {len(b)} rows {sorted(names)}\n   spark only {extra}\n   sql only   {miss}"


def main(root: str, wanted: list[str]) -> int:
    import __spark_entry__ as entry

    spark, con = session(), duck(root)
    oracle, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            state, n, took, note = compare(spark, con, root, name, fn, oracle.get(name))
        except Exception as exc:
            state, n, took = "ERROR", 0, 0.0
            text = str(exc) or traceback.format_exc()
            note = text[:700]
        bad += state not in ("ok", "rows-only")
        print(f"{state:10} {name:28} {n:7} rows {took:6.2f}s {note}", flush=True)
    print("failed:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
