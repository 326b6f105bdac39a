"""Run a registered query in Spark and its SQL in DuckDB and compare the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir) / f"{t}.parquet"
        if path.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(v):
    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def rows_of(pdf: pd.DataFrame) -> list[tuple]:
    columns = sorted(pdf.columns)
    out = [tuple(_plain(v) for v in r) for r in pdf[columns].astype(object).itertuples(index=False, name=None)]
    return sorted(out, key=repr)


def differences(spark_pdf: pd.DataFrame, sql_pdf: pd.DataFrame) -> str | None:
    if sorted(spark_pdf.columns) != sorted(sql_pdf.columns):
        return f"columns {sorted(set(spark_pdf.columns) ^ set(sql_pdf.columns))}"
    if len(spark_pdf) != len(sql_pdf):
        return f"rows {len(spark_pdf)} != {len(sql_pdf)}"
    a, b = rows_of(spark_pdf), rows_of(sql_pdf)
    if a == b:
        return None
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    columns = sorted(spark_pdf.columns)
    cells = [(c, u, v) for c, u, v in zip(columns, *bad[0]) if u != v]
    per_column = {c: n for i, c in enumerate(columns) if (n := sum(x[i] != y[i] for x, y in bad))}
    return f"{len(bad)} of {len(a)} rows differ; first {cells[:6]}; columns {dict(list(per_column.items())[:8])}"
