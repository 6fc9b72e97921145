"""Incremental refresh: cursors, upserts, novelty, retention, closed bars."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.grid import DAY, Grid, numbered, over_series
from barline.operators import rolling as R


def dedupe_last(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """Keep the row with the highest order per key.

    An aggregate, not a window: copies are reduced before the shuffle, however many there are.
    """
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*[(F.col(o) if isinstance(o, str) else o).alias(f"o{i}") for i, o in enumerate(order)])
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("_row"))
    return best.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*df.columns)


def concat(dfs: list[DataFrame]) -> DataFrame:
    """All rows, columns matched by name; missing columns become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def high_watermark(df: DataFrame, series: DataFrame, start: str, asof: str, key: str = "series_id", time: str = "ts", step: int = DAY) -> DataFrame:
    """Next instant to fetch per expected series, and whether the series is already up to date."""
    seen = df.groupBy(key).agg(F.max(time).alias("_last"))
    nxt = F.col("_last") + F.expr("INTERVAL '0.001' SECOND")
    return series.select(key).distinct().join(seen, key, "left").select(
        key,
        F.coalesce(nxt, F.lit(start).cast("timestamp")).alias("next_start"),
        F.coalesce(
            F.col("_last") + F.expr(f"INTERVAL {step} SECONDS") > F.lit(asof).cast("timestamp"), F.lit(False)
        ).alias("up_to_date"),
    )


def upsert(
    old: DataFrame,
    new: DataFrame,
    keys: list[str],
    drop_null: list[str] | None = None,
    drop_all_null: list[str] | None = None,
    order: list[str] | None = None,
) -> DataFrame:
    """Old and new rows, the new one winning per key; within one batch the highest ``order`` wins.

    Rows without values are dropped first, so they never replace a stored value.
    """
    both = concat([old.withColumn("_batch", F.lit(0)), new.withColumn("_batch", F.lit(1))])
    if drop_null:
        both = both.na.drop("any", subset=drop_null)
    if drop_all_null:
        both = both.na.drop("all", subset=drop_all_null)
    return dedupe_last(both, keys, ["_batch", *(order or [])]).drop("_batch")


def outer_merge(dfs: list[DataFrame], on: list[str]) -> DataFrame:
    """Full outer merge of several tables with distinct value columns; first non-null per key.

    One union and one aggregate instead of a chain of joins.
    """
    values = [c for df in dfs for c in df.columns if c not in on]
    return concat(dfs).groupBy(*on).agg(*[F.first(c, ignorenulls=True).alias(c) for c in values])


def anti_new(new: DataFrame, old: DataFrame, key: list[str]) -> DataFrame:
    """New rows whose key is not stored yet."""
    return new.join(old.select(*key).distinct(), key, "left_anti")


def retain(df: DataFrame, time: str, asof: str, days: int) -> DataFrame:
    """Rows of the last ``days`` days before ``asof``."""
    return df.filter(F.col(time) >= F.lit(asof).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))


def closed_bars(df: DataFrame, time: str, asof: str, seconds: int) -> DataFrame:
    """Without the bar that is still open at ``asof``."""
    now = F.unix_seconds(F.lit(asof).cast("timestamp"))
    return df.filter(F.unix_seconds(F.col(time)) < F.floor(now / seconds) * seconds)


def infer_frequency(df: DataFrame, grid: Grid) -> DataFrame:
    """daily / weekly / monthly from the median day gap; fewer than 3 rows count as daily."""
    gaps = over_series(df.select(*grid.key, *grid.order), grid, {"_before": R.lagged(grid.time)})
    days = F.datediff(F.col(grid.time), F.col("_before"))
    out = gaps.groupBy(*grid.key).agg(F.count(F.lit(1)).alias("rows"), F.percentile(days, F.lit(0.5)).alias("median_gap"))
    frequency = (
        F.when(F.col("rows") < 3, "daily")
        .when(F.col("median_gap") <= 2, "daily")
        .when(F.col("median_gap").between(5, 10), "weekly")
        .otherwise("monthly")
    )
    return out.withColumn("frequency", frequency)


def temporal_contract(df: DataFrame, grid: Grid, start: str, days: int = 1) -> DataFrame:
    """Per series from ``start``: rows, most common day gap and whether it is the required one."""
    rows = df.filter(F.col(grid.time) >= F.lit(start).cast("timestamp")).select(*grid.key, *grid.order)
    gaps = over_series(rows, grid, {"_before": R.lagged(grid.time)})
    counted = gaps.groupBy(*grid.key, F.datediff(F.col(grid.time), F.col("_before")).alias("gap")).agg(
        F.count(F.lit(1)).alias("n")
    )
    known = F.when(F.col("gap").isNotNull(), F.struct(F.col("n"), -F.col("gap")))
    out = counted.groupBy(*grid.key).agg(F.sum("n").alias("rows"), F.max_by("gap", known).alias("modal_gap"))
    return out.withColumn("ok", F.coalesce(F.col("modal_gap") == days, F.lit(False)))


def tail_n(df: DataFrame, grid: Grid, n: int, start: str | None = None) -> DataFrame:
    """The n most recent rows of each series, none before ``start``."""
    out = numbered(df, grid, "_no", descending=True).filter(F.col("_no") <= n).drop("_no")
    return out.filter(F.col(grid.time) >= F.lit(start).cast("timestamp")) if start else out


def missing(expected: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """Expected keys that have no row."""
    return expected.select(*key).distinct().join(actual.select(*key).distinct(), key, "left_anti")


