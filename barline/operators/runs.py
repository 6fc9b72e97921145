"""Runs of equal states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.grid import Grid, last_of, over_series, running, sum_of
from barline.operators.rolling import run_starts


def with_runs(df: DataFrame, grid: Grid, state: str) -> DataFrame:
    """Add ``row_no``, ``run_id`` (counts runs from 1) and ``run_start`` (row number of the run's first row)."""
    out = over_series(df, grid, {"_starts": run_starts(state)}, keep_chunk=True)
    out = running(
        out,
        grid,
        {"row_no": sum_of(F.lit(1).cast("long")), "run_id": sum_of(F.col("_starts").cast("long"))},
        keep_chunk=True,
    )
    out = running(out, grid, {"run_start": last_of(F.when(F.col("_starts"), F.col("row_no")))})
    return out.drop("_starts")


def regime_age(df: DataFrame, grid: Grid, state: str, new_until: int = 2) -> DataFrame:
    """Rows since the current state began (1 on the first), its log, and a flag for young states."""
    out = with_runs(df, grid, state)
    age = F.when(F.col(state).isNotNull(), F.col("row_no") - F.col("run_start") + 1)
    return out.withColumn("age", age).withColumns(
        {
            "age_log": F.ln(F.col("age") + 1.0),
            "is_new": F.when(F.col("age").isNotNull(), (F.col("age") <= new_until).cast("double")),
        }
    ).drop("row_no", "run_start", "run_id")


def run_durations(df: DataFrame, grid: Grid, state: str) -> DataFrame:
    """Number of runs and mean length per series and state.

    Every row of a run carries its start, so a run's length is a count; the mean needs only
    the number of rows and of runs, both plain sums.
    """
    out = over_series(df, grid, {"_starts": run_starts(state)}).filter(F.col(state).isNotNull())
    return out.groupBy(*grid.key, state).agg(
        F.sum(F.col("_starts").cast("long")).alias("runs"),
        (F.count(F.lit(1)) / F.sum(F.col("_starts").cast("long"))).alias("mean_duration"),
    )
