"""Runs registered queries next to their SQL in DuckDB and compares the rows.

``python tests/check.py [sf] [name ...]``
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def session() -> SparkSession:
    return (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = []
    for row in rows:
        cells = []
        for i in order:
            v = row[i]
            if isinstance(v, float):
                v = None if math.isnan(v) else v + 0.0
            cells.append(v)
        out.append(tuple(cells))
    return [names[i] for i in order], sorted(out, key=lambda t: tuple((c is None, str(c)) for c in t))


def compare(spark: SparkSession, con, sf_dir: str, name: str) -> str:
    df = entry.queries()[name](spark, sf_dir)
    names, rows = canonical([tuple(r) for r in df.collect()], df.columns)
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return f"rows only: {len(rows)}"
    result = con.execute(sql)
    onames, orows = canonical(result.fetchall(), [d[0] for d in result.description])
    if names != onames:
        return f"MISMATCH columns: {set(names) ^ set(onames)}"
    if len(rows) != len(orows):
        return f"MISMATCH rows {len(rows)} vs {len(orows)}"
    bad = [(a, b) for a, b in zip(rows, orows) if a != b]
    if bad:
        a, b = bad[0]
        cells = [(names[i], a[i], b[i]) for i in range(len(names)) if a[i] != b[i]]
        return f"MISMATCH {len(bad)} of {len(rows)} rows, e.g. {cells[:4]}"
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    types = {d[0]: str(d[1]) for d in result.description}
    odd = {n: (t, types[n]) for n, t in df.dtypes if same.get(t) != types[n]}
    if odd:
        return f"MISMATCH types {odd}"
    return f"equal: {len(rows)} rows x {len(names)}"


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    failed = 0
    for name in sys.argv[2:] or entry.queries():
        start = time.time()
        try:
            outcome = compare(spark, con, sf_dir, name)
        except Exception as e:  # noqa: BLE001
            outcome = f"MISMATCH error {type(e).__name__}: {str(e)[:600]}"
        failed += outcome.startswith("MISMATCH")
        print(f"{name:24s} {time.time() - start:6.1f}s {outcome}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
