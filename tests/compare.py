"""Run registered queries next to their SQL in DuckDB and compare rows and types.

``python tests/compare.py [--sf DIR] [name or section ...]``
"""

from __future__ import annotations

import os
import sys
import time
import traceback

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TYPES = {"INTEGER": "int", "BIGINT": "bigint", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean",
         "FLOAT": "float", "TIMESTAMP": "timestamp_ntz", "DATE": "date"}


def connect(sf_dir):
    from glyphlake.catalog.views import BASE
    con = duckdb.connect()
    for t in BASE:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    return repr(v) if not isinstance(v, float) else f"{v:.9g}"


def compare(spark, con, sf_dir, fn, sql):
    """(row count, list of differences)."""
    df = fn(spark, sf_dir)
    names = sorted(df.columns)
    types = dict(df.dtypes)
    got = sorted(tuple(_norm(r[n]) for n in names) for r in df.collect())
    if sql is None:
        return len(got), []
    rel = con.execute(sql)
    desc = [(d[0], str(d[1])) for d in rel.description]
    want_names = sorted(d[0] for d in desc)
    if want_names != names:
        return len(got), [f"columns {names} != {want_names}"]
    bad = []
    for n, t in desc:
        if TYPES.get(t, t) != types[n]:
            bad.append(f"type of {n}: spark {types[n]} duckdb {t}")
    ix = [[d[0] for d in desc].index(n) for n in names]
    want = sorted(tuple(_norm(r[i]) for i in ix) for r in rel.fetchall())
    if len(got) != len(want):
        bad.append(f"rows {len(got)} != {len(want)}")
    if got != want:
        gs, ws = set(got), set(want)
        bad.append(f"only spark {sorted(gs - ws)[:3]} only duckdb {sorted(ws - gs)[:3]} of {names}")
    if not got:
        bad.append("no rows")
    return len(got), bad


def main(argv):
    import __spark_entry__ as entry
    from glyphlake.session import local_session
    sf = "/root/testdata/sf0.01"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    con = connect(sf)
    qs, sqls = entry.queries(), entry.oracle_sql()
    names = [n for n in qs if not argv or any(n == a or n.startswith(a) for a in argv)]
    failed = 0
    for n in names:
        t = time.time()
        try:
            rows, bad = compare(spark, con, sf, qs[n], sqls.get(n))
        except Exception as e:  # noqa: BLE001
            rows, bad = -1, [str(e)[:1500] if os.environ.get("SHORT", "1") == "1" else traceback.format_exc()]
        failed += bool(bad)
        print(f"{'FAIL' if bad else 'ok  '} {n} rows={rows} sql={'yes' if n in sqls else 'no'} {time.time() - t:.1f}s", flush=True)
        for b in bad:
            print("     ", b, flush=True)
    print(f"{len(names)} run, {failed} failed")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
