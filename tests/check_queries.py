"""Run registered queries next to their SQL twins: ``python tests/check_queries.py sf_dir [name ...]``."""
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as entry  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def compare(spark, con, name, fn, sql, sf_dir):
    """(ok, message, seconds)"""
    at = time.time()
    df = fn(spark, sf_dir)
    names = sorted(df.columns)
    got = sorted([tuple(r[c] for c in names) for r in df.collect()], key=repr)
    took = time.time() - at
    if sql is None:
        return len(got) > 0, f"rows {len(got)}", took
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    if sorted(cols) != names:
        return False, f"columns {names} / {sorted(cols)}", took
    order = [cols.index(c) for c in names]
    want = sorted([tuple(r[i] for i in order) for r in cur.fetchall()], key=repr)
    if len(got) != len(want):
        return False, f"rows {len(got)} / {len(want)}", took
    bad = [(g, w) for g, w in zip(got, want) if g != w or [type(v) for v in g] != [type(v) for v in w]]
    return not bad, f"rows {len(got)}" + (f", {len(bad)} differ, first {bad[0]}" if bad else ""), took


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    sf_dir, only = sys.argv[1], sys.argv[2:]
    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(sf_dir), entry.oracle_sql()
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        try:
            ok, msg, took = compare(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, msg, took = False, f"{type(e).__name__}: {str(e)[:600]}", 0
        print(f"{'ok ' if ok else 'BAD'} {name:24s} {took:6.2f}s {'sql' if name in sqls else '   '} {msg}", flush=True)
