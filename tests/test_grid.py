"""Chunked windows must equal whole-series windows, whatever the chunk size."""

from dataclasses import replace

import numpy as np
import pytest
from conftest import by_key, close_to, per_series
from pyspark.sql import functions as F

from barline.grid import Grid, Roll, first_of, last_of, max_of, min_of, numbered, over_series, running, sum_of
from barline.operators import labels as L
from barline.operators import rolling as R
from barline.operators.smoothing import ewm, macd

GRIDS = [
    Grid(chunk_rows=1, block_rows=1),
    Grid(chunk_rows=8, block_rows=2),
    Grid(chunk_rows=40, block_rows=5),
    Grid(chunk_rows=65_536, block_rows=4_096),
]


@pytest.mark.parametrize("grid", GRIDS, ids=lambda g: f"{g.chunk_rows}x{g.block_rows}")
def test_windows_do_not_depend_on_chunks(table, series, grid):
    out = over_series(
        table,
        grid,
        {"m": R.roll_mean("close", 20), "top": R.drawdown("close", 90, 1), "f": L.fwd_return("close", 7), "lag3": R.lagged("close", 3)},
        {"s": R.roll_std("m", 10)},
    )
    got = by_key(out, ["m", "top", "f", "lag3", "s"])
    close_to(got.m, per_series(series, lambda g: g.close.rolling(20).mean()))
    close_to(got.top, per_series(series, lambda g: g.close / g.close.rolling(90, min_periods=1).max() - 1))
    close_to(got.f, per_series(series, lambda g: g.close.shift(-7) / g.close - 1))
    close_to(got.lag3, per_series(series, lambda g: g.close.shift(3)))
    close_to(got.s, per_series(series, lambda g: g.close.rolling(20).mean().rolling(10).std()), 1e-7)


@pytest.mark.parametrize("grid", GRIDS, ids=lambda g: f"{g.chunk_rows}x{g.block_rows}")
def test_running_values_do_not_depend_on_chunks(table, series, grid):
    out = running(
        table,
        grid,
        {"total": sum_of("x"), "top": max_of("x"), "low": min_of("x"), "last": last_of("x"), "first": first_of("x")},
    )
    got = by_key(out, ["total", "top", "low", "last", "first"])
    pad = per_series(series, lambda g: g.x.ffill())
    close_to(got["last"], pad)
    close_to(got.total, per_series(series, lambda g: g.x.cumsum().ffill()))
    close_to(got.top, per_series(series, lambda g: g.x.cummax().ffill()))
    close_to(got.low, per_series(series, lambda g: g.x.cummin().ffill()))
    close_to(got["first"], per_series(series, lambda g: g.x.ffill() * 0 + g.x.dropna().iloc[0]))
    back = by_key(running(table, grid, {"nxt": last_of("x")}, reverse=True), ["nxt"])
    close_to(back.nxt, per_series(series, lambda g: g.x.bfill()))


@pytest.mark.parametrize("grid", GRIDS[1:3], ids=lambda g: f"{g.chunk_rows}")
def test_staged_means_and_exponents(table, series, grid):
    out = ewm(table, grid, {"e12": ("close", 12), "e200": ("close", 200), "ex": ("x", 26)})
    got = by_key(out, ["e12", "e200", "ex"])
    close_to(got.e12, per_series(series, lambda g: g.close.ewm(span=12, adjust=False).mean()))
    close_to(got.e200, per_series(series, lambda g: g.close.ewm(span=200, adjust=False).mean()))
    close_to(got.ex, per_series(series, lambda g: g.x.ewm(span=26, adjust=False).mean()))
    want = per_series(series, lambda g: g.close.ewm(span=12, adjust=False).mean() - g.close.ewm(span=26, adjust=False).mean())
    line = per_series(series.assign(close=want.to_numpy()), lambda g: g.close.ewm(span=9, adjust=False).mean())
    hist = by_key(macd(table, grid, "close"), ["macd_hist_norm", "close"])
    close_to(hist.macd_hist_norm * hist.close, want - line, 1e-6)

    def rs(v):
        d = np.cumsum(v - v.mean())
        r, s = d.max() - d.min(), v.std()
        return 0.5 if len(v) < 10 or s == 0 or r == 0 else np.log(r / s) / np.log(len(v))

    ret = {"r": R.log_return("close")}
    got = by_key(over_series(table, grid, ret, *R.hurst_stages("r", 30, "h")), ["h"])
    want = per_series(series, lambda g: np.log(g.close / g.close.shift(1)).rolling(30).apply(rs, raw=True))
    close_to(got.h, want, 1e-6)


def test_row_numbers_and_fit(table, series):
    fitted = Grid().fit(table, target_rows=50)
    assert len(fitted.cuts) > 10
    got = by_key(numbered(table, fitted, "n"), ["n"])
    close_to(got.n, per_series(series, lambda g: g.close * 0 + np.arange(1, len(g) + 1)))
    out = by_key(over_series(table, fitted, {"m": R.roll_mean("close", 20)}), ["m"])
    close_to(out.m, per_series(series, lambda g: g.close.rolling(20).mean()))
    assert Grid().fit(table).cuts == (float("inf"),)


def test_hot_series_is_split(table):
    """No window task sees a whole series once chunks are smaller than it."""
    grid = replace(Grid(), chunk_rows=32, block_rows=4)
    out = over_series(table, grid, {"n": Roll(lambda w: F.count(F.lit(1)).over(w.spec.rowsBetween(-10_000, 10_000)), back=5)})
    assert out.agg(F.max("n")).first()[0] <= 32 + 5 + 4


def test_duplicate_times_need_a_tie_breaker(spark):
    rows = [("a", "2024-01-01 00:00:00", i, float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "series_id string, ts string, id int, v double").withColumn("ts", F.col("ts").cast("timestamp"))
    got = running(df, Grid(step=1, tie=("id",), chunk_rows=4, block_rows=2), {"s": sum_of("v")}).orderBy("id").toPandas()
    assert got.s.tolist() == np.cumsum(np.arange(20.0)).tolist()
