"""Queries over whole tables, and the operators under them on small tables with gaps."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from barline.grid import DAY, Grid
from barline.modelling import splits as S
from barline.operators import contracts as C
from barline.operators import joins as J
from barline.sources import upsert as U
from check import canonical

SF = "/root/testdata/sf0.001"
GRID = Grid(step=DAY)
NAMES = ["asof_fill_shared", "model_input", "left_join_columns", "freshness_status", "outer_join_ranges", "outer_merge"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in entry.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = entry.queries()[name](spark, SF).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


def days(spark, rows, *columns, keyed=True):
    """Rows (series, day of 2020-01, value ...) or, without a key, (day, value ...)."""
    names = (["series_id"] if keyed else []) + ["day", *columns]
    kinds = ", ".join(f"{n} {'string' if n == 'series_id' else 'int' if n == 'day' else 'double'}" for n in names)
    df = spark.createDataFrame(rows, kinds)
    return df.selectExpr(*[n for n in names if n != "day"], "timestamp '2020-01-01' + make_interval(0, 0, 0, day - 1) as ts")


def got(df, *columns):
    return sorted(((r.series_id, r.ts.day, *[r[c] for c in columns]) for r in df.collect()), key=str)


def test_gaps_in_joins(spark):
    fast = days(spark, [("a", d, float(d)) for d in range(1, 7)], "close")
    slow = days(spark, [(2, 20.0), (5, None), (6, 60.0)], "value", keyed=False)
    assert [r[2] for r in got(J.join_left(fast, slow, ["ts"], ["value"]), "value")] == [None, 20.0, None, None, None, 60.0]
    assert [r[2] for r in got(J.asof_shared(fast, slow, GRID, ["value"]), "value")] == [None, None, 20.0, 20.0, 20.0, 20.0]
    near, far = days(spark, [("a", 1, 1.0), ("a", 3, 3.0)], "near"), days(spark, [("a", 2, 2.0), ("a", 3, 4.0)], "far")
    want = [("a", 1, 1.0, None), ("a", 2, None, 2.0), ("a", 3, 3.0, 4.0)]
    assert got(J.join_outer([near, far], ["series_id", "ts"]), "near", "far") == want
    assert got(U.outer_merge([near, far], ["series_id", "ts"]), "near", "far") == want


def test_gaps_in_model_input_and_freshness(spark):
    rows = days(spark, [("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, None), ("b", 1, 1.0)], "r")
    states = days(spark, [("a", 1, 0.7), ("a", 3, 0.2), ("b", 1, None)], "p")
    assert [r[:2] for r in got(S.model_input(rows, states, ["series_id", "ts"], "p", ["r"]), "p")] == [("a", 1)]
    seen = days(spark, [("a", 9, 1.0), ("a", 8, None), ("b", 2, 1.0)], "x")
    expected = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5)], "series_id string, max_days int")
    out = {r.series_id: (r.status, r.recent_nulls) for r in C.freshness(seen, expected, "2020-01-10", "x", GRID).collect()}
    assert out == {"a": ("FRESH", 1), "b": ("STALE", 0), "c": ("MISSING", None)}
