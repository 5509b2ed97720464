"""Runs queries beside their SQL: python tests/verify.py [--sf DIR] [NAME ...]. Prints rows, seconds and agreement."""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry  # noqa: E402
from annalist.session import local_session  # noqa: E402
from annalist.sources.tables import TABLES  # noqa: E402


def plain(x):
    if isinstance(x, float):
        return f"{x:.9g}"
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    return tuple(plain(y) for y in x) if isinstance(x, (list, tuple)) else x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def oracle(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        at = Path(f"{sf_dir}/{t}.parquet")
        if at.exists():
            con.sql(f"create view {t} as select * from read_parquet('{at}{'/*.parquet' if at.is_dir() else ''}')")
    r = con.sql(sql)
    return list(r.columns), r.fetchall()


def compare(spark, name, sf_dir):
    df = entry.queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return len(got), None, ""
    columns, rows = oracle(sf_dir, sql)
    if sorted(columns) != sorted(df.columns):
        return len(got), False, f"columns {sorted(df.columns)} / {sorted(columns)}"
    a, b = rows_of(df.columns, got), rows_of(columns, rows)
    if a == b:
        return len(got), True, ""
    sa, sb = set(map(repr, a)), set(map(repr, b))
    return len(got), False, f"{len(a)} / {len(b)} rows\n  spark only: {sorted(sa - sb)[:3]}\n  sql only: {sorted(sb - sa)[:3]}"


if __name__ == "__main__":
    args = sys.argv[1:]
    sf = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    spark = local_session(partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    for n in args or entry.queries():
        t = time.time()
        try:
            rows, ok, why = compare(spark, n, sf)
            print(n, rows, {True: "equal", False: "DIFFERENT", None: "no SQL"}[ok], f"{time.time() - t:.1f}s", why, flush=True)
        except Exception as e:  # noqa: BLE001
            print(n, "FAILED", repr(e)[:1500], flush=True)
