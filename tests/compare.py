"""Run registered queries against DuckDB: ``python tests/compare.py [sf_dir] [name ...]``."""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parents[1]))

import duckdb

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf}/{name}.parquet'")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(
        (tuple(plain(r[i]) for i in order) for r in rows), key=repr
    )


def expected(connection, sql):
    result = connection.execute(sql)
    return rows_of([d[0] for d in result.description], result.fetchall())


def actual(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def difference(df, connection, sql) -> str | None:
    """None when names and values agree."""
    ours, truth = actual(df), expected(connection, sql)
    if ours[0] != truth[0]:
        return f"columns {ours[0]} != {truth[0]}"
    if ours[1] != truth[1]:
        extra = [r for r in ours[1] if r not in set(truth[1])][:5]
        missing = [r for r in truth[1] if r not in set(ours[1])][:5]
        return f"{len(ours[1])} vs {len(truth[1])} rows; extra {extra}; missing {missing}"
    return None


if __name__ == "__main__":
    from session import make_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(entry.queries())
    spark, connection, sqls = make_session(), connect(sf), entry.oracle_sql()
    failed = 0
    for name in wanted:
        started = time.time()
        try:
            df = entry.queries()[name](spark, sf)
            if name in sqls:
                problem = difference(df, connection, sqls[name])
            else:
                problem = None if df.count() else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - started:.1f}s", problem or "", flush=True)
    print("failed:", failed)
