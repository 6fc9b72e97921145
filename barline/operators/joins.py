"""Joins on series and time: as-of fills, lookups, interval aggregates, event windows, grids."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.grid import Grid, Roll, Running, last_of, over_series, running

SIDE = "_side"


def join_inner(a: DataFrame, b: DataFrame, on: list[str], suffix: str = "_r") -> DataFrame:
    """Equi-join; columns of b that clash with a get the suffix."""
    clash = {c: c + suffix for c in b.columns if c in a.columns and c not in on}
    return a.join(b.withColumnsRenamed(clash), on, "inner")


def require_rows(df: DataFrame, what: str) -> DataFrame:
    """The frame itself, or an error when it is empty."""
    if df.isEmpty():
        raise ValueError(f"{what} is empty")
    return df


def join_left(a: DataFrame, b: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    return a.join(b.select(*on, *columns), on, "left")


def join_outer(dfs: list[DataFrame], on: list[str]) -> DataFrame:
    """Full outer join of several tables with distinct value columns."""
    return reduce(lambda x, y: x.join(y, on, "full"), dfs)


def align(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """Rows of a whose key also occurs in b."""
    return a.join(b.select(*on).distinct(), on, "left_semi")


def _shifted(slow: DataFrame, time: str, lag: str | None) -> DataFrame:
    return slow.withColumn(time, F.col(time) + F.expr(f"INTERVAL {lag}")) if lag else slow


def asof_ffill(
    fast: DataFrame,
    slow: DataFrame,
    grid: Grid,
    columns: list[str],
    lag: str | None = "1 DAY",
    strict: bool = False,
    reverse: bool = False,
) -> DataFrame:
    """Put the last known slow values on the fast rows.

    The slow table is delayed by ``lag``. Each column carries its own last non-null value; there is
    no age limit. A slow row at the very time of a fast row is visible to it unless ``strict``.
    ``reverse`` takes the next slow values instead. Both sides are merged and filled forward, so
    no range join is needed.
    """
    delayed = _shifted(slow, grid.time, lag).select(*grid.key, grid.time, *columns)
    extra = [c for c in fast.columns if c not in grid.key and c != grid.time]
    if set(extra) & set(columns):
        raise ValueError(f"columns on both sides: {set(extra) & set(columns)}")
    # Within one instant the side that is filled from must come first in reading order.
    fast_side = 0 if strict != reverse else 1
    left = fast.withColumn(SIDE, F.lit(fast_side))
    right = delayed.withColumn(SIDE, F.lit(1 - fast_side))
    left, right = left.withColumn("_fast", F.lit(True)), right.withColumn("_fast", F.lit(False))
    both = left.unionByName(right, allowMissingColumns=True)
    tied = replace(grid, tie=(SIDE, *grid.tie))
    filled = running(both, tied, {c: last_of(c) for c in columns}, reverse=reverse)
    return filled.filter("_fast").drop(SIDE, "_fast")


def asof_shared(
    fast: DataFrame, slow: DataFrame, grid: Grid, columns: list[str], lag: str | None = "1 DAY", **kw
) -> DataFrame:
    """As-of fill from one slow table that serves every series.

    The fill is done once on the distinct times of the fast table and joined back on time.
    """
    clock = replace(grid, key=("_all",), tie=())
    times = fast.select(grid.time).distinct().withColumn("_all", F.lit(0))
    filled = asof_ffill(times, slow.withColumn("_all", F.lit(0)), clock, columns, lag, **kw)
    return fast.join(filled.drop("_all"), grid.time)


def asof_before(fast: DataFrame, slow: DataFrame, grid: Grid, columns: list[str]) -> DataFrame:
    """Last slow row of a day before the fast row's day."""
    day = replace(grid, time="_day", tie=())
    left = fast.withColumn("_day", F.date_trunc("day", F.col(grid.time)))
    right = slow.withColumnRenamed(grid.time, "_day")
    return asof_ffill(left, right, day, columns, None, strict=True).drop("_day")


def asof_lookup(
    events: DataFrame, series: DataFrame, grid: Grid, columns: list[str], offsets_hours: list[int], id_col: str
) -> DataFrame:
    """Last known values at each event time plus each offset; one row per (event, offset)."""
    moved = events.select(
        *grid.key, id_col, F.col(grid.time).alias("event_ts"), F.explode(F.array(*map(F.lit, offsets_hours))).alias("offset_h")
    ).withColumn(grid.time, F.col("event_ts") + F.make_dt_interval(hours=F.col("offset_h")))
    return asof_ffill(moved, series, grid, columns, None)


def asof_forward(events: DataFrame, grid_rows: DataFrame, grid: Grid, strict: bool = False, name: str = "next_ts") -> DataFrame:
    """First grid time at (or, if strict, after) each event time."""
    marks = grid_rows.select(*grid.key, grid.time).distinct().withColumn(name, F.col(grid.time))
    return asof_ffill(events, marks, grid, [name], None, strict=strict, reverse=True)


def range_agg(
    events: DataFrame, series: DataFrame, grid: Grid, seconds: int, aggs: list[Column], id_cols: list[str]
) -> DataFrame:
    """Aggregate the series over [t, t + seconds) of every event.

    Series rows are sent to the slots of length ``seconds`` they can be reached from, so the join
    is an equi-join on (series, slot) with a range filter; the aggregate is partial before shuffling.
    An event without rows in reach is kept, with the aggregates of no row.
    """
    t = F.unix_seconds(F.col(grid.time))
    slot = F.floor(t / seconds)
    left = events.select(*grid.key, *id_cols, F.col(grid.time).alias("_from"), slot.alias("_slot"))
    right = series.select(
        *[F.col(c).alias(f"_k_{c}") for c in grid.key],
        *[c for c in series.columns if c not in grid.key],
        F.explode(F.array(slot, slot - 1)).alias("_s"),
    )
    same = F.col("_slot") == F.col("_s")
    for c in grid.key:
        same &= left[c] == F.col(f"_k_{c}")
    hit = (F.col(grid.time) >= F.col("_from")) & (
        F.col(grid.time) < F.col("_from") + F.expr(f"INTERVAL {seconds} SECONDS")
    )
    found = left.join(right, same & hit, "left")
    return found.groupBy(*grid.key, *id_cols, F.col("_from").alias(grid.time)).agg(*aggs)


def range_fold(events: DataFrame, series: DataFrame, grid: Grid, seconds: int, folds: dict[str, Running], id_cols: list[str]) -> DataFrame:
    """Fold the series (min, max or sum) over [t, t + seconds) of every event, without pairs of events and rows.

    Time is cut into slots of ``seconds``. A window is the end of the event's slot and the beginning
    of the next one, so two running folds within the slots answer every window: one from the slot's
    end back to t, one from the next slot's start up to t + seconds. Events take part as probes; the
    table has one row per series row and two per event, whatever they have in common. A slot of any
    size is chunked by ``grid`` like a series. An event without rows in reach is kept with nulls.
    """
    keys, end = list(grid.key), F.expr(f"INTERVAL {seconds} SECONDS")
    time = F.col(grid.time)

    def part(df: DataFrame, at: Column, kind: int, ids: list[str], values: dict[str, Column]) -> DataFrame:
        own = [F.col(c).alias(f"_id{i}") if c in ids else F.lit(None).cast(events.schema[c].dataType).alias(f"_id{i}") for i, c in enumerate(id_cols)]
        begun = time if ids or not values else F.lit(None).cast(events.schema[grid.time].dataType)
        given = [values.get(n, F.lit(None)).cast("double").alias(f"_v_{n}") for n in folds]
        return df.select(*keys, at.alias("_at"), F.lit(kind).alias("_kind"), (F.lit(kind) == 0).cast("int").alias("_tie"), begun.alias("_from"), *own, *given)

    table = part(series, time, 0, [], {n: f.column for n, f in folds.items()})
    for kind, at in ((1, time), (2, time + end)):
        table = table.unionByName(part(events, at, kind, id_cols, {}))
    table = table.withColumn("_slot", F.floor(F.unix_seconds(F.col("_at").cast("timestamp")) / seconds))
    # At equal times a row comes after a probe, so windows begin with t and end before t + seconds.
    order = replace(grid, key=(*keys, "_slot"), time="_at", tie=("_tie",))
    back = running(table, order, {f"_b_{n}": Running(f.kind, F.col(f"_v_{n}")) for n, f in folds.items()}, reverse=True, keep_chunk=True)
    both = running(back, order, {f"_f_{n}": Running(f.kind, F.col(f"_v_{n}")) for n, f in folds.items()})
    merge = {"min": F.min, "max": F.max, "sum": F.sum}
    found = [merge[f.kind](F.when(F.col("_kind") == 1, F.col(f"_b_{n}")).otherwise(F.col(f"_f_{n}"))).alias(n) for n, f in folds.items()]
    ids = [F.col(f"_id{i}").alias(c) for i, c in enumerate(id_cols)]
    return both.filter("_kind > 0").groupBy(*keys, *ids, F.col("_from").alias(grid.time)).agg(*found)


def event_windows(df: DataFrame, dates: DataFrame, grid: Grid, pre: int = 3, post: int = 3) -> DataFrame:
    """Flags: the row is on an event date, within ``pre`` rows before one, within ``post`` rows after one."""
    marked = df.join(dates.select(grid.time).distinct().withColumn("is_event", F.lit(1)), grid.time, "left")
    marked = marked.withColumn("is_event", F.coalesce("is_event", F.lit(0)))

    def near(lo: int, hi: int) -> Roll:
        return Roll(
            lambda w: F.coalesce(F.max("is_event").over(w.between(lo, hi)), F.lit(0)), back=max(0, -lo), ahead=max(0, hi)
        )

    return over_series(marked, grid, {"pre_event": near(1, pre), "post_event": near(-post, -1)})


def days_to_next(df: DataFrame, dates: DataFrame, grid: Grid, none: int = 30) -> DataFrame:
    """Days to the next later event date (``none`` without one) and proximity 1/(days+1)."""
    clock = replace(grid, key=("_all",), tie=())
    times = df.select(grid.time).distinct().withColumn("_all", F.lit(0))
    nxt = asof_forward(times, dates.select(grid.time).withColumn("_all", F.lit(0)), clock, strict=True, name="_next")
    out = df.join(nxt.drop("_all"), grid.time)
    days = F.coalesce(F.datediff(F.col("_next"), F.col(grid.time)), F.lit(none))
    return out.withColumn("days_to_next", days).withColumn("proximity", 1.0 / (F.col("days_to_next") + 1)).drop("_next")


def cross_grid(df: DataFrame, scenarios: list[dict], name: str = "scenario") -> DataFrame:
    """Repeat every row per scenario; the scenario list is a literal array in the plan."""
    rows = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in s.items()]) for s in scenarios])
    return df.withColumn(name, F.explode(rows)).select(*df.columns, f"{name}.*")
