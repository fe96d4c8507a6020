"""Run queries on Spark and their SQL counterparts on DuckDB and compare the rows.

    python tests/oracle.py [folder] [name ...]
"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from greenframe.plans.queries.support import TABLES  # noqa: E402


def duck(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, (list, tuple)):
        return tuple(cell(v) for v in value)
    return value


def difference(spark_df, con, sql: str) -> str | None:
    """None when rows and column names agree, else what differs."""
    got_cols = sorted(spark_df.columns)
    got = Counter(tuple(cell(row[c]) for c in got_cols) for row in spark_df.collect())
    relation = con.sql(sql)
    want_cols = list(relation.columns)
    if sorted(want_cols) != got_cols:
        return f"columns {got_cols} != {sorted(want_cols)}"
    order = [want_cols.index(c) for c in got_cols]
    want = Counter(tuple(cell(row[i]) for i in order) for row in relation.fetchall())
    if got == want:
        return None
    extra, missing = got - want, want - got
    return (f"{sum(got.values())} rows, {sum(want.values())} expected; only in Spark "
            f"{list(extra.items())[:3]}; only in SQL {list(missing.items())[:3]}")


def types(spark_df, con, sql):
    relation = con.sql(sql)
    sql_types = dict(zip(relation.columns, [str(t) for t in relation.types]))
    alike = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean",
             "TIMESTAMP": "timestamp_ntz"}
    return {c: (t, sql_types.get(c)) for c, t in spark_df.dtypes if alike.get(sql_types.get(c)) != t}


if __name__ == "__main__":
    import __spark_entry__ as entry
    from greenframe.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark = local_session("oracle", "8")
    spark.sparkContext.setLogLevel("ERROR")
    con, oracles, bad = duck(folder), entry.oracle_sql(), 0
    for name in names:
        began = time.time()
        try:
            df = entry.queries()[name](spark, folder)
            if name in oracles:
                found = difference(df, con, oracles[name])
                note = types(df, con, oracles[name])
            else:
                found, note = None, f"rows only: {df.count()}"
        except Exception as error:  # noqa: BLE001
            found, note = f"{type(error).__name__}: {str(error)[:600]}", ""
        bad += found is not None
        print(f"{'FAIL' if found else 'ok  '} {time.time() - began:6.2f}s {name} {found or ''} {note or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
