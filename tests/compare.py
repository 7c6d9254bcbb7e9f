"""Run registered queries on Spark and their SQL on DuckDB and compare all rows."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def oracle_connection(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    return connection


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    return value


def _sorted(rows):
    return sorted((tuple(_plain(v) for v in row) for row in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


def differences(spark, connection, name, folder, queries, oracle) -> list[str]:
    """What differs between both results; an empty list when they agree."""
    frame = queries[name](spark, folder)
    names = sorted(frame.columns)
    collected = frame.select(*[f"`{n}`" for n in names]).toArrow().to_pylist()
    ours = _sorted(tuple(row[n] for n in names) for row in collected)
    relation = connection.execute(oracle[name])
    theirs_names = [d[0] for d in relation.description]
    if sorted(theirs_names) != names:
        return [f"columns {names} against {sorted(theirs_names)}"]
    order = [theirs_names.index(n) for n in names]
    theirs = _sorted(tuple(row[i] for i in order) for row in relation.fetchall())
    found = []
    if len(ours) != len(theirs):
        found.append(f"rows {len(ours)} against {len(theirs)}")
    for a, b in zip(ours, theirs):
        if a != b:
            found.append(f"\n  spark  {a}\n  oracle {b}")
            if len(found) > 3:
                break
        elif any(type(x) is not type(y) for x, y in zip(a, b)):
            found.append(f"types {[type(x).__name__ for x in a]} against {[type(y).__name__ for y in b]}")
            break
    return found


if __name__ == "__main__":
    import os
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from __spark_entry__ import oracle_sql, queries
    from contractflow.session import build_session
    session = build_session("local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false")
    session.sparkContext.setLogLevel("ERROR")
    folder = "/root/testdata/sf" + (sys.argv[1] if len(sys.argv) > 1 else "0.001")
    wanted = sys.argv[2:] or list(queries())
    duck = oracle_connection(folder)
    all_queries, all_sql = queries(), oracle_sql()
    for query_name in wanted:
        started = time.time()
        if query_name not in all_sql:
            print(f"{query_name}: no SQL, rows={all_queries[query_name](session, folder).count()}")
            continue
        try:
            found = differences(session, duck, query_name, folder, all_queries, all_sql)
        except Exception as error:  # a report per query is the point here
            found = [f"{type(error).__name__}: {str(error)[:1500]}"]
        print(f"{query_name}: {'ok' if not found else 'DIFFERS ' + ' '.join(found)} ({time.time() - started:.1f}s)", flush=True)
