"""Compare registered queries with their SQL on DuckDB: python tests/check_queries.py SF_DIR [name …]."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

BASE = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
        "conversations").split()


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(plain(r[i]) for i in order) for r in rows)


def connect(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def compare(spark, con, folder, name, fn, sql):
    t0 = time.time()
    df = fn(spark, folder)
    got = rows_of(df.columns, df.collect())
    t1 = time.time()
    if sql is None:
        return f"rows-only {len(got[1])} rows, {t1 - t0:.2f}s", True
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    t2 = time.time()
    times = f"{t1 - t0:.2f}s, check {t2 - t1:.2f}s"
    if got == want:
        return f"ok {len(got[1])} rows, {times}", True
    if got[0] != want[0]:
        return f"COLUMNS {got[0]} <> {want[0]}", False
    a, b = set(got[1]), set(want[1])
    return (f"DIFFERS {len(got[1])} <> {len(want[1])} rows, {times}; only ours {sorted(a - b)[:3]}; "
            f"only check {sorted(b - a)[:3]}"), False


def main(argv):
    import __spark_entry__ as entry
    from provenant.session import local_session

    folder, names = argv[0], argv[1:]
    import os
    conf = {"spark.provenant.hotKeyRows": os.environ["HOT_ROWS"]} if "HOT_ROWS" in os.environ else {}
    spark = local_session(**conf)
    spark.sparkContext.setLogLevel("OFF")
    con = connect(folder)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sorted(qs):
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        try:
            text, good = compare(spark, con, folder, name, qs[name], sqls.get(name))
        except Exception as e:  # noqa: BLE001
            text, good = f"FAILED {type(e).__name__}: {str(e)[:400]}", False
        bad += not good
        print(f"{name}: {text}", flush=True)
    print(f"{bad} not good")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
