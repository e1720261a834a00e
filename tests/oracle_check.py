"""Run registered queries against their SQL in DuckDB: ``python tests/oracle_check.py <sf> [name-prefix ..]``."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(os.path.join(folder, "*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def normal(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return value + 0.0
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(normal(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(out, key=lambda r: tuple((v is None, str(type(v)), v) for v in r))


def compare(spark, con, folder, name, fn, sql):
    """(message or None, row count); values must be equal, not merely close."""
    df = fn(spark, folder)
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return (None if got else "no rows"), len(got)
    cur = con.execute(sql)
    want_names, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if got_names != want_names:
        return f"columns {got_names} != {want_names}", len(got)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", len(got)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} rows differ, first {bad[0][0]} != {bad[0][1]}", len(got)
    kinds = [{type(v).__name__ for v in c if v is not None} for c in zip(*got)], [{type(v).__name__ for v in c if v is not None} for c in zip(*want)]
    if kinds[0] != kinds[1]:
        return f"types {kinds[0]} != {kinds[1]}", len(got)
    return None, len(got)


def main():
    import __spark_entry__ as entry
    from tallymark.session import local_session

    sf, prefixes = sys.argv[1], sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    oracles, failed, total = entry.oracle_sql(), 0, 0.0
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        start = time.time()
        try:
            message, n = compare(spark, con, folder, name, fn, oracles.get(name))
        except Exception as e:
            message, n = f"{type(e).__name__}: {str(e)[:3000]}", -1
        took = time.time() - start
        total += took
        failed += message is not None
        print(f"{'FAIL' if message else 'ok  '} {name:36} {n:7} rows {took:6.2f}s {'' if name in oracles else '(rows only) '}{message or ''}", flush=True)
    print(f"{failed} failed, {total:.1f}s")


if __name__ == "__main__":
    main()
