"""Series tables on disk: partitioned parquet and header-less candle files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.grid import CHUNK, Grid
from barline.sources.upsert import dedupe_last

BAR_CSV_FIELDS = (
    "open_time open high low close volume close_time quote_volume trades "
    "taker_buy_base_volume taker_buy_quote_volume ignore"
).split()


def write_series(df: DataFrame, path: str, grid: Grid, mode: str = "overwrite") -> None:
    """Snappy parquet, one folder per series, sorted by time so row-group statistics prune.

    Rows are spread by (series, time chunk): a long series is written by many tasks.
    """
    (
        grid.with_chunk(df)
        .repartition(*grid.key, CHUNK)
        .sortWithinPartitions(*grid.key, *grid.order)
        .drop(CHUNK)
        .write.mode(mode)
        .option("compression", "snappy")
        .partitionBy(*grid.key)
        .parquet(path)
    )


def read_series(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """One long table from a folder per series; the key column comes from the folder names."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def read_bar_csv(spark: SparkSession, path: str, series_id: str | None = None) -> DataFrame:
    """Candle files without header: microsecond epochs within 2020-2030 are kept, last copy wins.

    Stray header lines and rows that do not parse drop out because their epoch is null.
    """
    raw = spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in BAR_CSV_FIELDS])).csv(path)
    micros = F.col("open_time").try_cast("bigint")
    lo = F.unix_micros(F.lit("2020-01-01 00:00:00").cast("timestamp"))
    hi = F.unix_micros(F.lit("2030-01-01 00:00:00").cast("timestamp"))
    numbers = [c for c in BAR_CSV_FIELDS[1:11] if c not in ("close_time", "trades")]
    rows = raw.filter(micros.between(lo, hi)).select(
        (F.lit(series_id) if series_id else F.regexp_extract(F.input_file_name(), r"series_id=([^/]+)", 1)).alias(
            "series_id"
        ),
        F.timestamp_micros(micros).alias("ts"),
        F.timestamp_micros(F.col("close_time").try_cast("bigint")).alias("close_time"),
        F.col("trades").try_cast("bigint").alias("trades"),
        *[F.col(c).try_cast("double").alias(c) for c in numbers],
    )
    return dedupe_last(rows, ["series_id", "ts"], [F.col("close_time"), F.col("volume")])
