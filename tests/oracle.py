"""Holds a query's rows against those of its SQL in DuckDB."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x: object) -> object:
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float)):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in x.items()))
    return str(x)


def rows_of_sql(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    db = duckdb.connect()
    for t in TABLES:
        path = Path(sf_dir, f"{t}.parquet")
        if path.exists():
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if path.is_dir() else ''}')")
    found = db.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in found.fetchall())


def rows_of(df: DataFrame) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(v) for v in r) for r in df.select(*[f"`{n}`" for n in names]).collect())


def assert_same(df: DataFrame, sql: str, sf_dir: str) -> None:
    (a, x), (b, y) = rows_of(df), rows_of_sql(sql, sf_dir)
    assert a == b, f"columns {a} and {b}"
    assert x == y, f"only Spark: {list((x - y).items())[:5]}; only SQL: {list((y - x).items())[:5]}"
