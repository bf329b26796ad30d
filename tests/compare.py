"""Run registered queries against their DuckDB twins: ``python tests/compare.py SF_DIR [key ...]``."""

from __future__ import annotations

import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages"
          " benchmark labels conversations").split()


def cell(value):
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float):
        return f"{value:.6g}"
    if isinstance(value, bool):
        return str(value)
    return str(value)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(c for c in columns), Counter(tuple(cell(r[i]) for i in order) for r in rows)


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def compare(spark, con, key, sf_dir, build, sql):
    started = time.time()
    df = build(spark, sf_dir)
    got = bag(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - started
    if sql is None:
        return f"rows {sum(got[1].values())}", took, 0.0
    started = time.time()
    cur = con.execute(sql)
    want = bag([d[0] for d in cur.description], cur.fetchall())
    duck_took = time.time() - started
    if got == want:
        return f"ok {sum(got[1].values())}", took, duck_took
    note = "" if got[0] == want[0] else f" columns {got[0]} vs {want[0]}"
    extra, missing = got[1] - want[1], want[1] - got[1]
    return (f"DIFF rows {sum(got[1].values())} vs {sum(want[1].values())}{note}"
            f"\n   spark only {list(extra)[:3]}\n   duckdb only {list(missing)[:3]}"), took, duck_took


def session():
    import tempfile

    from pyspark.sql import SparkSession

    spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="clinspan-"))
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    import __spark_entry__ as entry

    sf_dir, keys = sys.argv[1], sys.argv[2:]
    spark, con = session(), duck(sf_dir)
    for key, build in entry.queries().items():
        if keys and key not in keys:
            continue
        try:
            result, took, duck_took = compare(spark, con, key, sf_dir, build, entry.oracle_sql().get(key))
        except Exception as error:  # noqa: BLE001 - report and go on
            result, took, duck_took = "ERROR " + type(error).__name__ + " " + str(error)[:600], 0, 0
        print(f"{key:28} {took:6.2f}s {duck_took:6.2f}s {result}", flush=True)
