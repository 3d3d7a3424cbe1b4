"""Spark result against DuckDB result of a registered query.

``python tests/parity.py [name ...]`` checks the named queries, or all, at PARITY_SF_DIR.
"""

from __future__ import annotations

import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _kind(type_name: str) -> str:
    text = str(type_name).lower()
    if text in ("integer", "bigint", "int", "long", "smallint"):
        return "integer" if text in ("integer", "int") else "bigint"
    return {"varchar": "string", "double": "double", "boolean": "boolean"}.get(text, text)


def compare(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """Differences, worded; empty if equal."""
    result = con.execute(sql)
    sql_types = {d[0]: _kind(d[1]) for d in result.description}
    sql_rows = result.fetchall()
    names = sorted(sql_types)
    problems = []
    if sorted(spark_df.columns) != names:
        return [f"columns {sorted(spark_df.columns)} against {names}"]
    spark_types = {f.name: _kind(f.dataType.simpleString()) for f in spark_df.schema.fields}
    for n in names:
        if spark_types[n] != sql_types[n]:
            problems.append(f"type of {n}: {spark_types[n]} against {sql_types[n]}")
    place = {d: i for i, d in enumerate(sql_types)}
    key = lambda row: tuple((v is None, str(type(v)), v) if v is not None else (True, "", "") for v in row)
    right = sorted((tuple(r[place[n]] for n in names) for r in sql_rows), key=key)
    left = sorted((tuple(r[n] for n in names) for r in spark_df.select(*names).collect()), key=key)
    if len(left) != len(right):
        problems.append(f"{len(left)} rows against {len(right)}")
    different = [(a, b) for a, b in zip(left, right, strict=False) if [repr(v) for v in a] != [repr(v) for v in b]]
    if different:
        problems.append(f"{len(different)} rows differ: {names} {different[:3]}")
    if not right:
        problems.append("no rows")
    return problems


def main() -> int:
    from rimlight.oracle import ORACLE_SQL
    from rimlight.queries import QUERIES
    from rimlight.session import build_session

    sf_dir = os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.01")
    spark = build_session("local[8]", "parity", spark__sql__shuffle__partitions="8", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    names = sys.argv[1:] or list(QUERIES)
    bad = 0
    for name in names:
        start = time.time()
        try:
            problems = compare(QUERIES[name](spark, sf_dir), con, ORACLE_SQL[name])
        except Exception as error:  # noqa: BLE001
            problems = [f"{type(error).__name__}: {str(error)[:900]}"]
        bad += bool(problems)
        print(f"{name:26s} {time.time() - start:6.2f}s {'ok' if not problems else 'BAD'}", flush=True)
        for p in problems:
            print("    ", p)
    print(f"{len(names) - bad} of {len(names)} equal; no SQL: {sorted(set(QUERIES) - set(ORACLE_SQL))}")
    return bad


if __name__ == "__main__":
    sys.exit(main())
