"""API payloads to rows: record lists, parallel arrays, maps of arrays, nested lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions.mathx import row_sum
from barline.sources.upsert import dedupe_last


def parse_epoch(c: str | Column, floor: str | None = None) -> Column:
    """A UTC instant from milliseconds (above 1e12), seconds, or ISO text."""
    text = (F.col(c) if isinstance(c, str) else c).cast("string")
    number = text.try_cast("double")
    ts = (
        F.when(number > 1e12, F.timestamp_millis(number.cast("bigint")))
        .when(number.isNotNull(), F.timestamp_seconds(number.cast("bigint")))
        .otherwise(text.try_cast("timestamp"))
    )
    return F.date_trunc(floor, ts) if floor else ts


def coerce_double(df: DataFrame, columns: list[str]) -> DataFrame:
    """Cast to double; unparsable text and NaN become null."""
    casts = {c: F.col(c).cast("string").try_cast("double") for c in columns}
    return df.withColumns({c: F.when(~F.isnan(v), v) for c, v in casts.items()})


def flatten_records(
    df: DataFrame,
    payload: str,
    fields: dict[str, str],
    prefix: str,
    key: list[str],
    time_field: str = "time",
    order: str | None = None,
) -> DataFrame:
    """A JSON list of records to columns ``{prefix}__{name}``, the last record per time kept."""
    ddl = ", ".join(f"`{f}` STRING" for f in [time_field, *fields])
    rows = df.select(*key, *([order] if order else []), F.posexplode(F.from_json(payload, f"array<struct<{ddl}>>")))
    out = rows.select(
        *key,
        *([order] if order else []),
        "pos",
        parse_epoch(F.col("col")[time_field]).alias("ts"),
        *[F.col("col")[src].try_cast("double").alias(f"{prefix}__{name}") for src, name in fields.items()],
    ).filter(F.col("ts").isNotNull())
    by = [F.col(order)] if order else []
    return dedupe_last(out, [*key, "ts"], [*by, F.col("pos")]).drop("pos", *([order] if order else []))


def zip_arrays(df: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """Parallel arrays to rows."""
    return df.select(*(keep or []), F.inline(F.arrays_zip(*columns)))


def map_arrays_to_wide(
    df: DataFrame,
    dates: str,
    values: str,
    names: list[str],
    until: str | None = None,
    null_total: bool = False,
) -> DataFrame:
    """A map of arrays next to a date list, to one row per date with a column per map key and a total.

    ``until`` drops later dates. ``null_total`` makes the total null where every value is null
    instead of 0.
    """
    by_name = df.select(F.col(dates).alias("ts"), F.explode(values).alias("name", "v"))
    long = by_name.select("name", F.inline(F.arrays_zip("ts", "v")))
    if until is not None:
        long = long.filter(F.col("ts") <= F.lit(until).cast("timestamp"))
    wide = long.groupBy("ts").pivot("name", names).agg(F.sum("v"))
    return wide.withColumn("total", row_sum(names, need_any=null_total))


def explode_pivot(
    df: DataFrame, list_col: str, time: str, key: str, value: str, names: list[str]
) -> DataFrame:
    """A nested record list to one row per time with a summed column per key, plus the total."""
    long = df.select(time, F.explode_outer(list_col).alias("e")).select(time, F.col(f"e.{key}").alias("k"), F.col(f"e.{value}").alias("v"))
    totals = F.sum("v").alias("total")
    return long.groupBy(time).agg(*[F.sum(F.when(F.col("k") == n, F.col("v"))).alias(n) for n in names], totals)


def consolidate(df: DataFrame, time: str, key: str, value: str, names: list[str], total: str = "total") -> DataFrame:
    """Long per-entity values to wide with a row total that is null when every entity is null."""
    wide = df.groupBy(time).pivot(key, names).agg(F.sum(value))
    return wide.withColumn(total, row_sum(names, need_any=True))


def coalesce_case(df: DataFrame, columns: list[str]) -> DataFrame:
    """Merge ``Close``-style duplicates into their lower-case column (needs case-sensitive mode)."""
    for c in columns:
        upper = c.capitalize()
        if upper in df.columns:
            merged = F.coalesce(F.col(f"`{c}`"), F.col(f"`{upper}`")) if c in df.columns else F.col(f"`{upper}`")
            df = df.withColumn("_merged", merged).drop(f"{upper}", f"{c}").withColumnRenamed("_merged", c)
    return df
