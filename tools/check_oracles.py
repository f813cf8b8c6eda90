"""Compare registered queries with their SQL oracles on one data folder.

usage: check_oracles.py SF_DIR [name ...]
"""

import glob
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def canonical(rows):
    def cell(v):
        if isinstance(v, float) and math.isnan(v):
            return None
        return v

    rows = [tuple(cell(v) for v in row) for row in rows]
    return sorted(rows, key=lambda row: [(v is None, type(v).__name__, v) if not isinstance(v, (list, dict)) else (False, "x", str(v)) for v in row])


def compare(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    columns = sorted(df.columns)
    got = canonical([[row[c] for c in columns] for row in df.collect()])
    if sql is None:
        return f"rows-only {len(got)}"
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return f"MISMATCH columns {columns} vs {sorted(names)}"
    index = [names.index(c) for c in columns]
    want = canonical([[row[i] for i in index] for row in cursor.fetchall()])
    if len(got) != len(want):
        return f"MISMATCH rows {len(got)} vs {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    kinds = [(c, type(g).__name__, type(w).__name__) for row in zip(got, want) for c, g, w in zip(columns, *row) if type(g) is not type(w)]
    if bad:
        return f"MISMATCH {len(bad)}/{len(got)} {columns} got={bad[0][0]} want={bad[0][1]}"
    return f"ok {len(got)}" + (f" TYPES {kinds[0]}" if kinds else "") + (" EMPTY" if not got else "")


def main():
    from tagloom.catalogue import ORACLES, QUERIES

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    for name, fn in QUERIES.items():
        if names and name not in names and fn.family not in names:
            continue
        start = time.time()
        try:
            verdict = compare(spark, con, name, fn, ORACLES.get(name), sf_dir)
        except Exception as e:  # report and go on
            verdict = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        print(f"{name}: {verdict} [{time.time() - start:.1f}s]", flush=True)


if __name__ == "__main__":
    main()
