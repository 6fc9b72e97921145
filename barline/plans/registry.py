"""Registry of runnable queries, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.session import utc


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    columns: str | None
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, columns: str | None = None, sql: str | None = None):
    """Register ``fn(spark, sf_dir)``.

    ``columns`` lists the output, e.g. ``"series_id ts ret:6"``: a digit rounds, ``i`` is a
    bigint, ``t`` a timestamp, ``s`` a string. ``sql`` is a WITH list whose last entry is ``t``.
    """

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(fn, columns, sql)
        return fn

    return register


def _items(columns: str) -> list[tuple[str, str]]:
    return [(c.split(":") + [""])[:2] for c in columns.split()]  # type: ignore[misc]


def pick(df: DataFrame, columns: str) -> DataFrame:
    out = []
    for name, kind in _items(columns):
        c = F.col(name)
        if kind.isdigit():
            c = F.round(c.cast("double"), int(kind)) + F.lit(0.0)
        elif kind:
            c = c.cast({"i": "bigint", "t": "timestamp", "s": "string"}[kind])
        out.append(c.alias(name))
    return df.select(*out)


def pick_sql(columns: str, ctes: str) -> str:
    out = []
    for name, kind in _items(columns):
        if kind.isdigit():
            out.append(f"round(CAST({name} AS DOUBLE), {kind}) + 0.0 AS {name}")
        elif kind:
            t = {"i": "BIGINT", "t": "TIMESTAMP", "s": "VARCHAR"}[kind]
            out.append(f"CAST({name} AS {t}) AS {name}")
        else:
            out.append(name)
    return f"WITH {ctes.strip()}\nSELECT {', '.join(out)} FROM t"


def run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    q = QUERIES[name]
    df = q.build(utc(spark), sf_dir)
    return pick(df, q.columns) if q.columns else df


def oracle(name: str) -> str | None:
    q = QUERIES[name]
    if q.sql is None:
        return None
    return pick_sql(q.columns, q.sql) if q.columns else q.sql
