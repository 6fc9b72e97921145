"""Forward and backward fills and the calendar grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.grid import Grid, last_of, running, sum_of


def ffill(df: DataFrame, grid: Grid, columns: list[str], suffix: str = "") -> DataFrame:
    """Last non-null value so far, per column."""
    return running(df, grid, {c + suffix: last_of(c) for c in columns})


def bfill(df: DataFrame, grid: Grid, columns: list[str], suffix: str = "") -> DataFrame:
    """Next non-null value, per column. Looks ahead."""
    return running(df, grid, {c + suffix: last_of(c) for c in columns}, reverse=True)


def padded(df: DataFrame, grid: Grid, columns: list[str]) -> DataFrame:
    """Add ``<column>_pad``: the forward-filled input that ``pct_change`` works on."""
    return ffill(df, grid, columns, "_pad")


def repair_quotes(df: DataFrame, grid: Grid, columns: list[str], backfill: bool = False) -> DataFrame:
    """Replace null and non-positive quotes by the last good one.

    A leading gap stays null; ``backfill`` fills it from the first good quote, which looks ahead.
    """
    good = {c: F.when(F.col(c) > 0, F.col(c)) for c in columns}
    out = df.withColumns(good)
    out = ffill(out, grid, columns)
    return bfill(out, grid, columns) if backfill else out


def calendar(df: DataFrame, grid: Grid, business: bool = False) -> DataFrame:
    """Every day from the first to the last row of each series; weekdays only with ``business``."""
    day = F.date_trunc("day", F.col(grid.time))
    spans = df.groupBy(*grid.key).agg(F.min(day).alias("a"), F.max(day).alias("b"))
    days = spans.select(*grid.key, F.explode(F.expr("sequence(a, b, interval 1 day)")).alias(grid.time))
    return days.filter(F.weekday(grid.time) < 5) if business else days


def regrid(df: DataFrame, grid: Grid, fill: list[str], business: bool = False, keep: list[str] | None = None) -> DataFrame:
    """Place rows on the calendar; ``fill`` columns are carried forward, ``keep`` only match exactly."""
    grid_rows = calendar(df, grid, business)
    out = grid_rows.join(df.select(*grid.key, grid.time, *fill, *(keep or [])), [*grid.key, grid.time], "left")
    return ffill(out, grid, fill)


def cusum(df: DataFrame, grid: Grid, columns: dict[str, str | Column]) -> DataFrame:
    """Running sums, null-skipping."""
    return running(df, grid, {name: sum_of(c) for name, c in columns.items()})
