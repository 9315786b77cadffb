"""Comparison of a query with its SQL in DuckDB."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return c


def differences(df, sql: str, sf_dir: str) -> tuple[list[str], int, int]:
    """(columns of the SQL, rows that only the query has, rows that only the SQL has)."""
    c = connect(sf_dir)
    got = df.toArrow()  # noqa: F841
    c.sql("CREATE TABLE g AS SELECT * FROM got")
    c.sql(f"CREATE TABLE w AS {sql}")
    names = [r[0] for r in c.sql("DESCRIBE w").fetchall()]
    assert sorted(names) == sorted(df.columns), (names, df.columns)
    cols = ", ".join(f'"{n}"' for n in names)
    count = lambda a, b: c.sql(f"SELECT count(*) FROM (SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b})").fetchall()[0][0]
    return names, count("g", "w"), count("w", "g")
