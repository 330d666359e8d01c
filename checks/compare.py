"""Run registered queries next to their SQL and report differences.

python -m checks.compare [sf_dir] [key ...]
"""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal

import duckdb

from .fixtures import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    table = [tuple(canonical(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(table, key=repr)


def compare(spark, con, sf_dir, key, build, sql):
    """(ok, message) for one key."""
    df = build(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return True, f"rows only: {len(got)}"
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    want_cols, want = rows_of(names, relation.fetchall())
    if got_cols != want_cols:
        return False, f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return False, f"{len(got)} rows != {len(want)}; spark {got[:2]} sql {want[:2]}"
    for g, w in zip(got, want):
        if g != w:
            diff = [(c, a, b) for c, a, b in zip(got_cols, g, w) if a != b]
            return False, f"first difference {diff} in {g}"
    kinds = [
        (c, type(a).__name__, type(b).__name__)
        for c, a, b in zip(got_cols, got[0], want[0])
        if type(a) is not type(b) and a is not None and b is not None
    ] if got else []
    note = f" type notes {kinds}" if kinds else ""
    return True, f"{len(got)} rows{note}" + ("  EMPTY" if not got else "")


def main(argv):
    from scarpline.session import local_session
    from . import QUERIES, ORACLES

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    keys = argv[1:] or list(QUERIES)
    spark, con = local_session("checks", 8), connect(sf_dir)
    spark.sparkContext.setLogLevel("ERROR")
    bad = 0
    for key in keys:
        t = time.time()
        try:
            ok, message = compare(spark, con, sf_dir, key, QUERIES[key], ORACLES.get(key))
        except Exception as error:  # report and go on to the next key
            ok, message = False, f"{type(error).__name__}: {str(error)[:900]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {key:26s} {time.time() - t:6.2f}s {message}", flush=True)
    print(f"{len(keys) - bad} of {len(keys)} agree", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
