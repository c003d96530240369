"""Run registered queries beside their SQL on DuckDB and compare row by row.

    python tests/oracle.py [name-substring ...]
"""

from __future__ import annotations

import decimal
import glob
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")


def connect(sf_dir: str = SF_DIR):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def norm(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return float(f"{value:.10g}")
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((str(k), norm(v)) for k, v in value.items()))
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


def compare(df, con, sql):
    """`None` when equal, else what differs."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    theirs = rows_of(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if len(mine) != len(theirs):
        return f"rows {len(mine)} vs {len(theirs)}"
    bad = [(a, b) for a, b in zip(mine, theirs) if a != b]
    if bad:
        return f"{len(bad)} of {len(mine)} rows differ, first {bad[0][0]} vs {bad[0][1]} ({sorted(names)})"
    return None


def main(argv):
    import __spark_entry__ as entry
    from meterloom.session import build_session

    spark = build_session()
    con = connect()
    queries, oracle = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, query in queries.items():
        if argv and not any(a in name for a in argv):
            continue
        start = time.time()
        try:
            df = query(spark, SF_DIR)
            if name in oracle:
                problem = compare(df, con, oracle[name])
                note = "ok" if problem is None else "DIFF " + problem
            else:
                problem = None
                note = f"rows-only {df.count()}"
        except Exception as error:  # report and go on
            problem = note = "ERROR " + str(error)[:1500]
        failed += problem is not None
        print(f"{time.time() - start:6.1f}s {name}: {note}", flush=True)
    print(f"{failed} problem(s)")


if __name__ == "__main__":
    main(sys.argv[1:])
