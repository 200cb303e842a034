"""Compare a Spark result with the DuckDB result of its SQL counterpart, by value."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle_connection(folder: str):
    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{folder}/{name}.parquet'")
    return connection


def canonical(value):
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    return str(value)


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark_df, connection, sql):
    """Return None when equal, else a description of the first difference."""
    left_columns, left = sorted_rows(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    cursor = connection.execute(sql)
    right_columns, right = sorted_rows([d[0] for d in cursor.description], cursor.fetchall())
    if left_columns != right_columns:
        return f"columns differ: {sorted(set(left_columns) ^ set(right_columns))}"
    if len(left) != len(right):
        return f"row counts differ: {len(left)} != {len(right)}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        a, b = bad[0]
        cells = [(c, x, y) for c, x, y in zip(left_columns, a, b) if x != y][:6]
        return f"{len(bad)} of {len(left)} rows differ, e.g. {cells} in {a[:6]}"
    if not left:
        return "both results are empty"
    return None


def main(argv):
    import __spark_entry__ as entry
    from feldspark.session import local_session

    folder = "/root/testdata/sf0.01"
    names = []
    for a in argv:
        if a.startswith("/"):
            folder = a
        else:
            names.append(a)
    import os

    spark = local_session(os.environ.get("CORES", "8"))
    connection = oracle_connection(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    chosen = [n for n in queries if not names or any(n == w or (w.endswith("*") and n.startswith(w[:-1])) for w in names)]
    failed = []
    for name in chosen:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracles:
                problem = compare(df, connection, oracles[name])
            else:
                rows = df.collect()
                problem = None if rows else "no rows"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:700]}"
        kind = "sql" if name in oracles else "rows"
        print(f"{'ok  ' if problem is None else 'FAIL'} {kind:4} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(chosen) - len(failed)} of {len(chosen)} agree; failed: {failed}")


if __name__ == "__main__":
    main(sys.argv[1:])
