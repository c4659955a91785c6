"""Run a registered query and its SQL twin and compare rows, order aside."""

from __future__ import annotations

import math
from datetime import date, datetime
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def sql_connection(directory: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        path = Path(directory) / f"{table}.parquet"
        if path.exists():
            connection.execute(f"create view {table} as select * from read_parquet('{path}')")
    return connection


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(value)
    if isinstance(value, datetime):
        return value.isoformat()
    if isinstance(value, date):
        return value.isoformat()
    return value


def _sorted(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(_cell(row[i]) for i in order) for row in rows]
    return sorted(cells, key=lambda r: tuple((v is None, str(type(v)), v) for v in r))


def spark_rows(df):
    return sorted(df.columns), _sorted([tuple(r) for r in df.collect()], df.columns)


def sql_rows(connection, sql):
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    return sorted(columns), _sorted(result.fetchall(), columns)


_FAMILY = {
    "TINYINT": "int", "SMALLINT": "int", "INTEGER": "int", "BIGINT": "int",
    "tinyint": "int", "smallint": "int", "int": "int", "bigint": "int",
    "DOUBLE": "float", "FLOAT": "float", "double": "float", "float": "float",
    "VARCHAR": "text", "string": "text",
    "DATE": "date", "date": "date",
    "TIMESTAMP": "time", "timestamp_ntz": "time",
    "BOOLEAN": "bool", "boolean": "bool",
}


def families(pairs):
    return {name: _FAMILY[str(kind)] for name, kind in pairs}
