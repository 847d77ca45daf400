"""Runs registered queries next to their SQL and reports differences.

    python -m checks.compare [--sf 0.01] [name-part ...]
"""

import argparse
import glob
import math
import os
import time

from checks.registry import QUERIES, SQL

DATA = "/root/testdata"


def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for file in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(file)[:-8]} AS SELECT * FROM '{file}'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return f"{f + 0.0:.9g}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, sf_dir):
    start = time.time()
    df = QUERIES[name](spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    spent = time.time() - start
    if name not in SQL:
        return f"rows-only {len(got[1])} rows", spent, 0.0
    start = time.time()
    rel = con.execute(SQL[name])
    want = rows_of([d[0] for d in rel.description], rel.fetchall())
    sql_spent = time.time() - start
    if got == want:
        return f"ok {len(got[1])} rows", spent, sql_spent
    if got[0] != want[0]:
        return f"DIFFERENT columns {got[0]} / {want[0]}", spent, sql_spent
    a, b = set(got[1]), set(want[1])
    show = lambda s: [tuple(x[:300] for x in r) for r in sorted(s)[:3]]
    return f"DIFFERENT {len(got[1])}/{len(want[1])} rows; spark only {len(a - b)} {show(a - b)}; sql only {len(b - a)} {show(b - a)}", spent, sql_spent


def main():
    from unitloom.session import local_session

    import checks.all  # noqa: F401

    args = argparse.ArgumentParser()
    args.add_argument("--sf", default="0.01")
    args.add_argument("names", nargs="*")
    opts = args.parse_args()
    sf_dir = f"{DATA}/sf{opts.sf}"
    spark, con = local_session(), duck(sf_dir)
    bad = 0
    for name in QUERIES:
        if opts.names and not any(n in name for n in opts.names):
            continue
        try:
            text, spent, sql_spent = compare(spark, con, name, sf_dir)
        except Exception as e:  # report and go on with the next query
            text, spent, sql_spent = f"FAILED {type(e).__name__} {str(e)[:1500]}", 0.0, 0.0
        bad += not text.startswith(("ok", "rows-only"))
        print(f"{name}: {text} [{spent:.1f}s, sql {sql_spent:.1f}s]", flush=True)
    print(f"{bad} of {len(QUERIES)} not equal")


if __name__ == "__main__":
    main()
