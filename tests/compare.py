"""Run one query on Spark and in DuckDB and compare the rows as multisets."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float) and not math.isnan(value):
        return round(value, 9)
    return value


def _rows(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_cell(row[i]) for i in order) for row in rows)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} against {sorted(names)}"]
    ours, theirs = _rows(df.columns, df.collect()), _rows(names, found.fetchall())
    return [
        f"{sum(side.values())} rows only in {where}, such as {next(iter(side))}"
        for where, side in (("spark", ours - theirs), ("duckdb", theirs - ours))
        if side
    ] + ([] if ours else ["no rows"])


def explained(df) -> str:
    """The formatted plan as text."""
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
