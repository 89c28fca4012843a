"""Runs a registered query and its SQL twin and compares the whole results."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads = 8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (dt.datetime, dt.date)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def sort_key(row):
    return tuple((v is not None, str(type(v).__name__ if not isinstance(v, (int, float)) else "n"), v if not isinstance(v, (bool,)) else int(v)) if v is not None else (False, "", 0) for v in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=sort_key)


def compare(name, spark, con, sf_dir, fn, sql):
    t0 = time.time()
    df = fn(spark, sf_dir)
    spark_rows = [tuple(r) for r in df.collect()]
    t1 = time.time()
    if sql is None:
        return True, f"{name}: {len(spark_rows)} rows, no SQL twin ({t1 - t0:.1f}s)"
    cur = con.execute(sql)
    duck_rows = cur.fetchall()
    duck_cols = [d[0] for d in cur.description]
    duck_types = {d[0]: str(d[1]) for d in cur.description}
    t2 = time.time()
    c1, r1 = rows_of(df.columns, spark_rows)
    c2, r2 = rows_of(duck_cols, duck_rows)
    times = f"(spark {t1 - t0:.1f}s, sql {t2 - t1:.1f}s)"
    if c1 != c2:
        return False, f"{name}: columns {c1} != {c2}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP", "date": "DATE"}
    odd = [f"{c}:{t}/{duck_types[c]}" for c, t in df.dtypes if kinds.get(t, t) != duck_types[c]]
    note = f" types {odd}" if odd else ""
    if r1 != r2:
        diff = [(a, b) for a, b in zip(r1, r2) if a != b][:4]
        return False, f"{name}: MISMATCH {len(r1)} vs {len(r2)} rows {times}{note}\n   {c1}\n" + "\n".join(f"   {a}\n   {b}" for a, b in diff)
    return True, f"{name}: ok {len(r1)} rows {times}{note}"


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from corpusmill.session import get_spark

    sf = sys.argv[1]
    wanted = sys.argv[2:]
    spark = get_spark("oracle-check", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            ok, message = compare(name, spark, con, sf, fn, sqls.get(name))
        except Exception as error:  # report and go on
            ok, message = False, f"{name}: ERROR {type(error).__name__} {str(error)[:600]}"
        bad += not ok
        print(message if ok else "!! " + message, flush=True)
    print("failed:", bad)
