"""Compare registered queries with their DuckDB statements: rows, columns and values."""

from __future__ import annotations

import datetime
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if hasattr(value, "as_tuple"):
        return float(value) if value != value.to_integral_value() else int(value)
    return value


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr), [names[i] for i in order]


def compare(spark, con, fn, sql: str, folder: str) -> str | None:
    """None when equal, else a short description of the difference."""
    df = fn(spark, folder)
    ours, names = normal([tuple(r) for r in df.collect()], df.columns)
    result = con.execute(sql)
    theirs, expected = normal(result.fetchall(), [d[0] for d in result.description])
    if names != expected:
        return f"columns {names} != {expected}"
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    different = [(a, b) for a, b in zip(ours, theirs) if a != b or [type(x) for x in a] != [type(x) for x in b]]
    if different:
        a, b = different[0]
        cells = [(n, x, y) for n, x, y in zip(names, a, b) if x != y or type(x) is not type(y)]
        return f"{len(different)} rows differ, first: {str(cells)[:400]}"
    return None


def main(names: list[str], folder: str = "/root/testdata/sf0.01") -> int:
    import __spark_entry__ as e
    from wardlight.session import local_session

    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, failed = connect(folder), e.oracle_sql(), 0
    for name, fn in e.queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            if name in sql:
                problem = compare(spark, con, fn, sql[name], folder)
            else:
                problem = None if fn(spark, folder).count() else "no rows"
                name += " (rows only)"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"@@ {'FAIL' if problem else 'ok'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"@@ {failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
