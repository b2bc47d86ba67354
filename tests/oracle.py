"""Runs registered queries beside their SQL and compares the rows exactly.

    python -m tests.oracle [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import decimal
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        return ("decimal", str(v))
    if isinstance(v, float):
        return ("float", repr(v))
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return (type(v).__name__, str(v))


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


def compare(spark, con, name, query, sql, sf_dir):
    t = time.time()
    df = query(spark, sf_dir)
    got = df.collect()
    t1 = time.time()
    res = con.execute(sql)
    names = [c[0] for c in res.description]
    want = res.fetchall()
    t2 = time.time()
    a, b = rows_of(df.columns, got), rows_of(names, want)
    problem = ""
    if sorted(df.columns) != sorted(names):
        problem = f"columns {sorted(df.columns)} != {sorted(names)}"
    elif len(a) != len(b):
        problem = f"rows {len(a)} != {len(b)}"
    elif a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y]
        x, y = bad[0]
        cells = [(n, str(p)[:300], str(q)[:300]) for n, p, q in zip(sorted(names), x, y) if p != q]
        problem = f"{len(bad)} rows differ, first: {cells[:3]}"
    return problem, len(a), t1 - t, t2 - t1


def main() -> int:
    sys.path.insert(0, os.getcwd())
    import __spark_entry__ as entry
    from quillmill.session import build_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
                                                "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, sql = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if args and not any(name.startswith(p) for p in args):
            continue
        try:
            if name in sql:
                problem, n, ts, td = compare(spark, con, name, fn, sql[name], sf_dir)
            else:
                t = time.time()
                problem, n, ts, td = "", len(fn(spark, sf_dir).collect()), time.time() - t, 0.0
                name += " (rows only)"
        except Exception as e:  # noqa: BLE001
            problem, n, ts, td = "error " + str(e)[:700], 0, 0.0, 0.0
        bad += bool(problem)
        print(f"{'BAD ' if problem else 'ok  '} {name} rows={n} spark={ts:.2f}s sql={td:.2f}s {problem}", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
