"""Streams replayed as several files equal the batch result."""

import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.operators.resample import ticks_to_bars
from barline.sources.upsert import dedupe_last
from barline.streaming import jobs as J


@pytest.fixture(scope="module")
def feed(spark):
    """Ticks in six files by time, plus one late tick in the last file."""
    rng = np.random.default_rng(9)
    n = 600
    pdf = pd.DataFrame(
        {
            "series_id": rng.choice(["a", "b"], n),
            "ts": pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 3 * 86400, n)), "s"),
            "event_id": np.arange(n),
            "value": rng.random(n).round(3),
        }
    )
    path = tempfile.mkdtemp(prefix="barline-feed-")
    for i in range(6):
        spark.createDataFrame(pdf.iloc[i * 100 : (i + 1) * 100]).coalesce(1).write.mode("append").parquet(path)
    return path, spark.createDataFrame(pdf)


def test_bars_equal_batch_for_closed_windows(spark, feed):
    path, df = feed
    stream = J.read_stream(spark, path, df.schema, files_per_batch=1)
    got, q, late = J.run_counted(J.stream_bars(stream, 3600, "10 minutes", tie="event_id"), "bars")
    mark = df.agg((F.max("ts") - F.expr("INTERVAL 10 MINUTES")).alias("m")).first().m
    want = ticks_to_bars(df, 3600, "value", "value", "event_id").filter(F.col("ts") + F.expr("INTERVAL 1 HOUR") <= F.lit(mark))
    cols = ["series_id", "ts", "open", "high", "low", "close", "trades"]
    a, b = (x.select(cols).toPandas().sort_values(cols[:2]).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(a, b)
    assert len(q.recentProgress) >= 6 and late == 0


def test_upsert_equals_batch_and_replays(spark, feed):
    path, df = feed
    keyed = df.withColumn("slot", F.col("event_id") % 7)
    stream = J.read_stream(spark, path, df.schema, files_per_batch=1).withColumn("slot", F.col("event_id") % 7)
    got, _ = J.stream_upsert(stream, "upsert", ["series_id", "slot"], order=["ts", "event_id"])
    want = dedupe_last(keyed.withColumn("day", F.date_format("ts", "yyyy-MM-dd")), ["day", "series_id", "slot"], ["ts", "event_id"])
    assert {r.event_id for r in got.collect()} == {r.event_id for r in want.collect()}

    table = tempfile.mkdtemp(prefix="barline-sink-") + "/t"
    sink = J.upsert_sink(table, keyed.schema, ["series_id", "slot"], order=["ts", "event_id"])
    sink(keyed.filter("event_id < 300"), 0)
    sink(keyed.filter("event_id >= 300"), 1)
    first = {r.event_id for r in spark.read.parquet(table).collect()}
    sink(keyed.filter("event_id >= 300"), 1)
    assert {r.event_id for r in spark.read.parquet(table).collect()} == first == {r.event_id for r in want.collect()}
