"""Run every query next to its SQL: ``python tests/compare.py [folder] [name ...]``."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

import __spark_entry__ as entry
from sievra.session import local_session

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return repr(value)


def difference(df, con, sql: str) -> str | None:
    """None if both sides have the same columns, kinds of values and rows."""
    table = df.toArrow()
    other = con.execute(sql).to_arrow_table()
    if sorted(table.column_names) != sorted(other.column_names):
        return f"columns {table.column_names} vs {other.column_names}"
    names = sorted(table.column_names)
    kinds = [(n, str(table.schema.field(n).type), str(other.schema.field(n).type)) for n in names]
    kinds = [k for k in kinds if k[1].replace("large_", "") != k[2].replace("large_", "")]
    if kinds:
        return f"types {kinds}"
    rows = [sorted(zip(*[map(_plain, t[n].to_pylist()) for n in names])) for t in (table, other)]
    if rows[0] == rows[1]:
        return None
    wrong = [(a, b) for a, b in zip(*rows) if a != b]
    return f"{len(rows[0])} vs {len(rows[1])} rows, {len(wrong)} differ, first {str(wrong[:1])[:700]}"


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con = local_session("compare", 8), connect(sf)
    sqls, failed = entry.oracle_sql(), []
    for name, query in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            problem = difference(query(spark, sf), con, sqls[name]) if name in sqls else f"rows only: {query(spark, sf).count()}"
        except Exception as error:
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
        failed += [name] if problem else []
    print(f"{len(failed)} failed: {failed}")
    return len(failed)


if __name__ == "__main__":
    sys.exit(main())
