"""Compare registered queries with their SQL on one data folder.

``python tests/oracle_check.py /root/testdata/sf0.01 [name ...]``
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import __spark_entry__ as registered  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    if type(value).__name__ == "Decimal":
        return float(value) if value % 1 else int(value)
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    return names, sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: [str(v) for v in r])


def compare(spark, con, sf: str, name: str) -> str:
    """Empty when both sides agree, else what differs."""
    df = registered.queries()[name](spark, sf)
    got_names, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    sql = registered.oracle_sql().get(name)
    if sql is None:
        return "" if got else "no rows"
    cursor = con.execute(sql)
    exp_names, exp = _rows([d[0] for d in cursor.description], cursor.fetchall())
    if got_names != exp_names:
        return f"columns {got_names} != {exp_names}"
    if len(got) != len(exp):
        return f"{len(got)} rows != {len(exp)}; first {got[:2]} {exp[:2]}"
    kinds = {c: t for c, t in df.dtypes}
    for a, b in zip(got, exp):
        if a != b:
            return f"{[(n, x, y, kinds[n]) for n, x, y in zip(got_names, a, b) if x != y]}"
    if not got:
        return "both empty"
    expected = {d[0]: str(d[1]) for d in cursor.description}
    loose = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string",
             "BOOLEAN": "boolean"}
    odd = [(n, kinds[n], expected[n]) for n in got_names if loose.get(expected[n]) != kinds[n]]
    return f"TYPES {odd}" if odd else ""


def main() -> int:
    from shelfmark.session import local_session

    sf, names = sys.argv[1], sys.argv[2:]
    spark, con = local_session(cores="8"), connect(sf)
    bad = 0
    for name in names or list(registered.queries()):
        start = time.time()
        try:
            problem = compare(spark, con, sf, name)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        bad += bool(problem)
        print(f"{'BAD ' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem[:1800]}",
              flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
