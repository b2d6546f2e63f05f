"""Runs queries against their SQL twins: ``python tests/compare.py SF_DIR [NAME...]``."""

import hashlib
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def norm(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(norm(x) for x in v) + "]"
    return str(v)


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return len(lines), [columns[i] for i in order], hashlib.md5("\n".join(lines).encode()).hexdigest(), lines


def duck(sf):
    import duckdb

    con = duckdb.connect()
    for f in sorted(os.listdir(sf)):
        if f.endswith(".parquet"):
            path = os.path.join(sf, f)
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def main(sf, names):
    from pyspark.sql import SparkSession

    import __spark_entry__ as e

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, qs, sql = duck(sf), e.queries(), e.oracle_sql()
    bad = 0
    for name in names or list(qs):
        t = time.time()
        try:
            df = qs[name](spark, sf)
            n, cols, h, lines = digest(df.columns, [tuple(r) for r in df.collect()])
            took = time.time() - t
            if name not in sql:
                print(f"{name}: rows {n}, {took:.1f}s, no SQL", flush=True)
                continue
            cur = con.execute(sql[name])
            n2, cols2, h2, lines2 = digest([d[0] for d in cur.description], cur.fetchall())
            ok = (n, cols, h) == (n2, cols2, h2)
            bad += not ok
            print(f"{name}: {'OK' if ok else 'DIFFERENT'} rows {n}/{n2} {took:.1f}s, SQL {time.time() - t - took:.1f}s", flush=True)
            if not ok:
                a, b = set(lines), set(lines2)
                print("   ", cols, cols2, "\n    only here:", sorted(a - b)[:4], "\n    only SQL: ", sorted(b - a)[:4], flush=True)
        except Exception as x:  # noqa: BLE001
            bad += 1
            print(f"{name}: ERROR {str(x)[:700]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
