"""Compare registered queries with their SQL twins in DuckDB, order-insensitively."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _norm(value):
    if value is None:
        return "<null>"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (float, decimal.Decimal)):
        number = float(value)
        if math.isnan(number):
            return "nan"
        return f"{number + 0.0:.6f}"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, (dt.datetime, dt.date)):
        return value.isoformat()
    return str(value)


def _kind(value) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, (float, decimal.Decimal)):
        return "float"
    return type(value).__name__


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    kinds: dict[str, set] = {n: set() for n in names}
    for row in rows:
        for n, v in zip(names, row):
            if v is not None:
                kinds[n].add(_kind(v))
    return sorted(names), sorted(tuple(_norm(r[i]) for i in order) for r in rows), kinds


def compare(spark, folder: str, query, sql: str, con=None) -> str | None:
    """None when equal, otherwise what differs."""
    con = con or connect(folder)
    df = query(spark, folder)
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    right = rows_of([c[0] for c in cur.description], cur.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if left[2] != right[2]:
        return f"types {[(n, left[2][n], right[2][n]) for n in left[0] if left[2][n] != right[2][n]]}"
    if len(left[1]) != len(right[1]):
        return f"rows {len(left[1])} != {len(right[1])}"
    if left[1] != right[1]:
        from collections import Counter

        a, b = Counter(left[1]), Counter(right[1])
        only_a, only_b = list((a - b).elements()), list((b - a).elements())
        return f"values differ in {len(only_a)} rows: spark {only_a[:2]} sql {only_b[:2]}"
    return None


def main() -> None:
    import sys

    sys.path.insert(0, ".")
    from __spark_entry__ import oracle_sql, queries
    from runloom.session import local_session

    sf, names = sys.argv[1], sys.argv[2:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    folder = f"/root/testdata/sf{sf}"
    con = connect(folder)
    sqls = oracle_sql()
    bad = 0
    for name, query in queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            if name in sqls:
                result = compare(spark, folder, query, sqls[name], con)
                count = "=" if result is None else "x"
            else:
                result, count = None, f"{len(query(spark, folder).collect())} rows"
        except Exception as exc:  # report and go on with the next query
            result = f"{type(exc).__name__}: {str(exc)[:900]}"
            count = "!"
        bad += result is not None
        print(f"{name:28s} {time.time() - start:6.2f}s {count} {(result or '')[:1500]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
