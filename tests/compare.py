"""Compare a Spark result with a DuckDB result: columns by name, rows as a multiset."""

from __future__ import annotations

import math
from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, bool) or value is None or isinstance(value, (str, datetime, date)):
        return value
    if isinstance(value, (float, Decimal)):
        number = float(value)
        return "nan" if math.isnan(number) else float(f"{number:.12g}")
    return value


def spark_rows(df: DataFrame) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(_plain(v) for v in row) for row in df.select(*[f"`{n}`" for n in names]).collect())


def duck_rows(connection: duckdb.DuckDBPyConnection, sql: str) -> tuple[list[str], Counter]:
    result = connection.execute(sql)
    columns = [c[0] for c in result.description]
    names = sorted(columns)
    order = [columns.index(n) for n in names]
    return names, Counter(tuple(_plain(row[i]) for i in order) for row in result.fetchall())


def difference(df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str:
    """What differs, or an empty text."""
    names, ours = spark_rows(df)
    other_names, theirs = duck_rows(connection, sql)
    if names != other_names:
        return f"columns {names} / {other_names}"
    if ours != theirs:
        only_ours, only_theirs = ours - theirs, theirs - ours
        return (
            f"{ours.total()} / {theirs.total()} rows; only ours {only_ours.total()}, e.g. "
            f"{list(only_ours)[:2]}; only theirs {only_theirs.total()}, e.g. {list(only_theirs)[:2]}"
        )
    return "" if ours else "no rows"
