"""Run contract queries against DuckDB: ``python -m contract.check [sf] [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return connection


def _text(value) -> str:
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return "NULL"
    if isinstance(value, float):
        return repr(round(value, 9) + 0.0)
    return str(value)


def rows(columns, records) -> tuple[list[str], list[tuple]]:
    """Columns by name, and the rows as sorted text."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_text(r[i]) for i in order) for r in records)


def difference(spark, connection, sf_dir: str, plan, oracle: str | None) -> str | None:
    """None if both agree, else what is wrong."""
    mine = plan(spark, sf_dir)
    columns, found = rows(mine.columns, mine.collect())
    if oracle is None:
        return None
    cursor = connection.execute(oracle)
    wanted_columns, wanted = rows([d[0] for d in cursor.description], cursor.fetchall())
    if columns != wanted_columns:
        return f"columns {columns} instead of {wanted_columns}"
    if found != wanted:
        extra = sorted(set(found) - set(wanted))[:3]
        missing = sorted(set(wanted) - set(found))[:3]
        return f"{len(found)} rows instead of {len(wanted)}; extra {extra}; missing {missing}"
    if not found:
        return "no rows"
    return None


def main(argv: list[str]) -> int:
    from cohortry import session
    from contract import ORACLES, QUERIES

    sf_dir = f"/root/testdata/sf{argv[0] if argv else '0.001'}"
    names = argv[1:] or list(QUERIES)
    spark = session("contract", **{
        "spark.master": "local[8]", "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "12g", "spark.log.level": "ERROR",
    })
    connection = connect(sf_dir)
    failed = 0
    for name in names:
        begin = time.time()
        try:
            wrong = difference(spark, connection, sf_dir, QUERIES[name], ORACLES.get(name))
        except Exception as error:  # one broken query must not hide the others
            wrong = f"{type(error).__name__}: {str(error)[:600]}"
        failed += wrong is not None
        print(f"{'FAIL' if wrong else 'ok  '} {name} {time.time() - begin:.2f}s {wrong or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
