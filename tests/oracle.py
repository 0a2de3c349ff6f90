"""Compare registered queries with their SQL in DuckDB: ``python tests/oracle.py [-s sf] [name ...]``."""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder):
    import duckdb
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def normal(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, int):
        return repr(value)
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(normal(r[i]) for i in order) for r in rows)


def kind(value):
    return {bool: "bool", int: "int", float: "float", str: "str"}.get(type(value), type(value).__name__)


def compare(spark, con, fn, sql, folder):
    """None when equal, else a short text."""
    df = fn(spark, folder)
    mine = [tuple(r) for r in df.collect()]
    names, left = rows_of(df.columns, mine)
    if sql is None:
        return None if left else "no rows"
    cur = con.execute(sql)
    their_names = [c[0] for c in cur.description]
    theirs = cur.fetchall()
    names2, right = rows_of(their_names, theirs)
    if names != names2:
        return f"columns {names} vs {names2}"
    if len(left) != len(right):
        return f"rows {len(left)} vs {len(right)}"
    if not left:
        return "both empty"
    for a, b in zip(left, right):
        if a != b:
            diff = [(n, x[:300], y[:300]) for n, x, y in zip(names, a, b) if x != y]
            return f"first difference {diff} in {[x[:40] for x in a]}"
    return None


def main():
    from prefmill.plans import catalog
    from prefmill.session import build_session
    args = sys.argv[1:]
    sf = "0.01"
    if args[:1] == ["-s"]:
        sf, args = args[1], args[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = build_session("local[8]", 8, **{"spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in args or list(catalog.QUERIES):
        start = time.time()
        try:
            fault = compare(spark, con, catalog.QUERIES[name], catalog.ORACLES.get(name), folder)
        except Exception as error:  # report and go on
            fault = f"{type(error).__name__}: {str(error)[:1500]}"
        mark = "ok " if fault is None else "BAD"
        bad += fault is not None
        print(mark, f"{time.time() - start:6.2f}s", "sql " if name in catalog.ORACLES else "rows", name, fault or "", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main()
