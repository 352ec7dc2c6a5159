"""Run registered queries against their SQL at one scale: ``python tests/compare.py [sf_dir] [names…]``."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(value):
    if isinstance(value, float):
        return None if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int):
        return str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(str(norm(v)) for v in value) + "]"
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(norm(r[i]) for i in order)) for r in rows)


def kind(t):
    t = t.upper()
    for key in ("BIGINT", "INTEGER", "INT", "DOUBLE", "VARCHAR", "STRING", "BOOLEAN", "DATE", "TIMESTAMP"):
        if t.startswith(key):
            return {"STRING": "VARCHAR", "INTEGER": "INT"}.get(key, key)
    return t


def compare(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    names = df.columns
    if sql is None:
        return f"rows-only {len(got)}"
    rel = con.sql(sql)
    want, want_names = rel.fetchall(), rel.columns
    if sorted(names) != sorted(want_names):
        return f"FAIL columns {sorted(names)} vs {sorted(want_names)}"
    spark_types = {f.name: kind(f.dataType.simpleString()) for f in df.schema}
    duck_types = {n: kind(str(t)) for n, t in zip(rel.columns, rel.types)}
    types = {n: (spark_types[n], duck_types[n]) for n in names if spark_types[n] != duck_types[n]}
    a, b = rows_of(names, got), rows_of(want_names, want)
    if a != b:
        only_a = sorted(set(a) - set(b))[:4]
        only_b = sorted(set(b) - set(a))[:4]
        return f"FAIL {len(a)} vs {len(b)} rows {sorted(names)}\n  spark: {only_a}\n  duck:  {only_b}"
    if not a:
        return "FAIL no rows"
    return f"ok {len(a)}" + (f" types {types}" if types else "")


if __name__ == "__main__":
    import __spark_entry__ as entry
    from labelwright.session import build_session

    args = sys.argv[1:]
    sf = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in args or queries:
        start = time.time()
        try:
            out = compare(spark, con, name, queries[name], oracles.get(name), sf)
        except Exception as exc:  # report and go on with the next query
            out = f"FAIL {type(exc).__name__}: {str(exc)[:700]}"
        bad += out.startswith("FAIL")
        print(f"{name}: {out} ({time.time() - start:.1f}s)", flush=True)
    print("failures:", bad)
