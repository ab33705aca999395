"""Run every query on Spark and its SQL on DuckDB and compare values."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(spark, con, sf_dir, name, query, sql) -> str | None:
    """None when equal, else what differs."""
    frame = query(spark, sf_dir)
    spark_rows = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    duck_rows = rows_of(columns, result.fetchall())
    if sorted(frame.columns) != sorted(columns):
        return f"columns {sorted(frame.columns)} != {sorted(columns)}"
    if spark_rows != duck_rows:
        left, right = set(spark_rows), set(duck_rows)
        return (f"{len(spark_rows)} vs {len(duck_rows)} rows; columns {sorted(columns)}; "
                f"only spark {sorted(left - right)[:3]}; only sql {sorted(right - left)[:3]}")
    return None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from faultlens.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    session = local_session()
    session.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    sqls = oracle_sql()
    bad = 0
    for name, query in queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            problem = differences(session, con, sf, name, query, sqls[name])
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s"
              + (f"\n    {problem}" if problem else ""), flush=True)
    print(f"{bad} different of {len(queries())}")
