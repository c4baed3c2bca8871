"""Compare named queries with their SQL: python tests/run_checks.py [sf] [names...]"""

import decimal
import math
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from askbase.registry.fixtures import BASE  # noqa: E402


def session(cores=int(os.environ.get("TEST_CPUS", 8))):
    from pyspark.sql import SparkSession
    spark = (SparkSession.builder.master(f"local[{cores}]")
             .config("spark.sql.shuffle.partitions", str(cores)).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="askbase-"))
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain(v):
    if v is None:
        return None
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else repr(v + 0.0)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def oracle(sf_dir, sql):
    con = duckdb.connect()
    for name in BASE:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    got = con.execute(sql)
    columns = [d[0] for d in got.description]
    return columns, got.fetchall()


def compare(spark, sf_dir, name):
    """None when equal, else what differs; and the two run times."""
    t0 = time.time()
    frame = entry.queries()[name](spark, sf_dir)
    got = frame.collect()
    t1 = time.time()
    if name not in entry.oracle_sql():
        return f"no SQL, {len(got)} rows", t1 - t0, 0.0
    columns, want = oracle(sf_dir, entry.oracle_sql()[name])
    t2 = time.time()
    if sorted(columns) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} / {sorted(columns)}", t1 - t0, t2 - t1
    a, b = rows_of(frame.columns, got), rows_of(columns, want)
    if a == b:
        return (None if a else "both empty"), t1 - t0, t2 - t1
    only_a, only_b = sorted(set(a) - set(b), key=repr), sorted(set(b) - set(a), key=repr)
    return (f"{len(a)} / {len(b)} rows; {sorted(columns)}\n  spark  {str(only_a[:2])[:700]}\n"
            f"  sql    {str(only_b[:2])[:700]}"), t1 - t0, t2 - t1


if __name__ == "__main__":
    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    spark = session()
    names = sys.argv[2:] or sorted(entry.queries())
    bad = []
    for name in names:
        try:
            problem, spark_s, sql_s = compare(spark, f"/root/testdata/sf{scale}", name)
        except Exception as exc:  # show every failing query, not the first only
            problem, spark_s, sql_s = f"{type(exc).__name__}: {str(exc)[:1500]}", 0, 0
        if problem:
            bad.append(name)
        print(f"{'ok  ' if not problem else 'FAIL'} {name} {spark_s:.1f}s {sql_s:.1f}s {problem or ''}",
              flush=True)
    print(f"{len(names) - len(bad)} of {len(names)} equal; not: {bad}")
