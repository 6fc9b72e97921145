"""Bars from ticks and coarser bars from finer bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions.mathx import exact_sum


def order_key(time: str | Column, tie: str | Column | None = None) -> Column:
    """A fixed-width key that sorts by time, then by a 64-bit id.

    Being fixed-width it lets min_by / max_by aggregate in a hash map instead of sorting.
    """
    t = F.unix_micros(F.col(time) if isinstance(time, str) else time)
    if tie is None:
        return t
    tie = F.col(tie) if isinstance(tie, str) else tie
    scale = F.lit("10000000000000000000").cast("decimal(20,0)")
    return (t.cast("decimal(18,0)") * scale + tie.cast("decimal(19,0)")).cast("decimal(38,0)")


def bucket_start(time: str, seconds: int) -> Column:
    """Start of the epoch-aligned bucket that holds the instant."""
    t = F.unix_seconds(F.col(time))
    return F.timestamp_seconds(F.floor(t / F.lit(seconds)) * F.lit(seconds))


def ticks_to_bars(
    ticks: DataFrame,
    seconds: int,
    price: str,
    size: str,
    tie: str | None = None,
    taker: Column | None = None,
    key: tuple[str, ...] = ("series_id",),
    time: str = "ts",
    exact: bool = False,
) -> DataFrame:
    """Open/high/low/close/volume bars; buckets without ticks give no bar.

    Aggregation is partial on the map side, so a series holding most ticks is not a hot spot.
    ``exact`` adds sizes up as decimals: bars of equal volume then have the same double, which ranks need.
    """
    total = exact_sum if exact else F.sum
    rows = ticks.filter(F.col(price).isNotNull()).withColumn("_bar", bucket_start(time, seconds))
    at = order_key(time, tie)
    taken = F.coalesce(total(F.when(taker, F.col(size))), F.lit(0.0)) if taker is not None else F.lit(None).cast("double")
    bars = rows.groupBy(*key, F.col("_bar")).agg(
        F.min_by(price, at).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, at).alias("close"),
        total(size).alias("volume"),
        F.count(F.lit(1)).alias("trades"),
        taken.alias("taker_buy_base_volume"),
    )
    width = F.expr(f"INTERVAL {seconds} SECONDS") - F.expr("INTERVAL '0.000001' SECOND")
    return bars.select(
        *key,
        F.col("_bar").alias(time),
        (F.col("_bar") + width).alias("close_time"),
        "open",
        "high",
        "low",
        "close",
        "volume",
        F.col("volume").alias("quote_volume"),
        "trades",
        "taker_buy_base_volume",
        F.col("taker_buy_base_volume").alias("taker_buy_quote_volume"),
    )


def resample_bars(
    bars: DataFrame, seconds: int, key: tuple[str, ...] = ("series_id",), time: str = "ts"
) -> DataFrame:
    """Coarser bars: first open, highest high, lowest low, last close, summed volumes.

    ``first`` and ``last`` skip nulls; buckets whose prices are all null are dropped.
    """
    t = F.unix_micros(F.col(time))
    sums = [c for c in bars.columns if c in _SUMMED]
    out = bars.withColumn("_bar", bucket_start(time, seconds)).groupBy(*key, F.col("_bar").alias(time + "_")).agg(
        F.min_by("open", F.when(F.col("open").isNotNull(), t)).alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", F.when(F.col("close").isNotNull(), t)).alias("close"),
        *[F.sum(c).alias(c) for c in sums],
    )
    return out.withColumnRenamed(time + "_", time).na.drop("any", subset=["open", "high", "low", "close"])


_SUMMED = {"volume", "quote_volume", "trades", "taker_buy_base_volume", "taker_buy_quote_volume"}


def daily_snap(df: DataFrame, time: str, keep: list[str], key: tuple[str, ...] = ("series_id",), tie: str | None = None) -> DataFrame:
    """Last row of each UTC day, stamped at midnight."""
    at = order_key(time, tie)
    return df.groupBy(*key, F.date_trunc("day", F.col(time)).alias("_day")).agg(
        *[F.max_by(c, at).alias(c) for c in keep]
    ).withColumnRenamed("_day", time)


def resample_mixed(
    df: DataFrame,
    rules: dict[str, tuple[str, str]],
    unit: str = "day",
    key: tuple[str, ...] = ("series_id",),
    time: str = "ts",
    tie: str | None = None,
) -> DataFrame:
    """One pass with a rule per output column: name -> (source column, rule).

    Rules: first, last, mean, max, min, sum, count, std.
    """
    at = order_key(time, tie)

    def agg(src: str, rule: str) -> Column:
        x = F.col(src)
        seen = F.when(x.isNotNull(), at)
        return {
            "first": lambda: F.min_by(x, seen),
            "last": lambda: F.max_by(x, seen),
            "mean": lambda: F.avg(x),
            "max": lambda: F.max(x),
            "min": lambda: F.min(x),
            "sum": lambda: F.coalesce(F.sum(x), F.lit(0.0)),
            "count": lambda: F.count(x),
            "std": lambda: F.stddev_samp(x),
        }[rule]()

    return (
        df.groupBy(*key, F.date_trunc(unit, F.col(time)).alias("_bucket"))
        .agg(*[agg(src, rule).alias(name) for name, (src, rule) in rules.items()])
        .withColumnRenamed("_bucket", time)
    )
