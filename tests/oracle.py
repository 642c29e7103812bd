"""Compare named queries with their SQL counterparts in DuckDB, value by value.

Run as a script: ``python tests/oracle.py FOLDER [name ...]``.
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, (bool, str)):
        return value
    if hasattr(value, "is_integer") or hasattr(value, "as_tuple"):
        value = float(value)
        return 0.0 if value == 0 else value
    return value


def _rows(rows, order):
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=lambda r: tuple((v is not None, str(v)) for v in r))


def compare(spark, con, folder, query, sql):
    """Return (rows, problem): problem is None when both results hold the same values."""
    df = query(spark, folder)
    got_names = df.columns
    got = df.collect()
    result = con.execute(sql)
    want_names = [d[0] for d in result.description]
    want = result.fetchall()
    if sorted(got_names) != sorted(want_names):
        return len(got), f"columns {sorted(got_names)} != {sorted(want_names)}"
    if len(got) != len(want):
        return len(got), f"rows {len(got)} != {len(want)}"
    names = sorted(got_names)
    left = _rows(got, [got_names.index(n) for n in names])
    right = _rows(want, [want_names.index(n) for n in names])
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    return len(got), f"{len(bad)} rows differ, first {names}: {bad[0]}" if bad else None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from isotrend.plans.registry import ORACLES, QUERIES
    from isotrend.session import build_session

    folder, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = build_session("oracle", "local[8]", spark_sql_shuffle_partitions="8", spark_ui_enabled="false",
                          spark_ui_showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    for name in names:
        start = time.time()
        try:
            if name in ORACLES:
                n, problem = compare(spark, con, folder, QUERIES[name], ORACLES[name])
            else:
                n, problem = len(QUERIES[name](spark, folder).collect()), "no SQL"
        except Exception as error:  # report and go on to the next query
            n, problem = -1, f"{type(error).__name__}: {str(error)[:400]}"
        print(f"{'ok ' if problem is None else 'BAD'} {name} rows={n} {time.time() - start:.2f}s {problem or ''}",
              flush=True)
