"""Run registered queries in Spark and their SQL in DuckDB and compare the results."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def _norm(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


def compare(spark, con, sf: str, query, sql: str) -> str:
    """Empty text when both engines agree exactly, otherwise what differs."""
    cur = con.execute(sql)
    want_names = [d[0] for d in cur.description]
    want_types = [str(d[1]) for d in cur.description]
    want = _rows(want_names, cur.fetchall())
    df = query(spark, sf)
    got_rows = [tuple(r) for r in df.collect()]
    if sorted(df.columns) != sorted(want_names):
        return f"columns {sorted(df.columns)} vs {sorted(want_names)}"
    got = _rows(df.columns, got_rows)
    if len(got) != len(want):
        return f"{len(got)} rows vs {len(want)}"
    if not got:
        return "no rows"
    for g, w in zip(got, want):
        if g != w or [type(x) for x in g] != [type(x) for x in w]:
            return f"first difference {g} vs {w} (columns {sorted(df.columns)})"
    alias = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    types = {n: t for n, t in zip(want_names, want_types)}
    for name, kind in df.dtypes:
        if alias.get(kind, kind) != types[name]:
            return f"type of {name}: {kind} vs {types[name]}"
    return ""


def main(argv: list[str]) -> int:
    from tests.conftest import make_session

    import __spark_entry__ as E

    sf = argv[0] if argv else "/root/testdata/sf0.01"
    picks = argv[1:]
    spark, con = make_session(), connect(sf)
    queries, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for key, query in queries.items():
        if picks and not any(key.startswith(p) for p in picks):
            continue
        start = time.time()
        try:
            if key in sqls:
                diff = compare(spark, con, sf, query, sqls[key])
            else:
                rows = query(spark, sf).count()
                diff = "" if rows else "no rows"
        except Exception as error:  # report and go on with the next query
            diff = f"{type(error).__name__}: {str(error)[:600]}"
        took = time.time() - start
        kind = "sql " if key in sqls else "rows"
        print(f"{'ok  ' if not diff else 'FAIL'} {kind} {took:6.2f}s {key} {diff}", flush=True)
        bad += bool(diff)
    print(f"{bad} failing")
    return bad


if __name__ == "__main__":
    sys.path.insert(0, ".")
    raise SystemExit(main(sys.argv[1:]))
