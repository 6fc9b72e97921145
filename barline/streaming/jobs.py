"""Structured Streaming forms of the periodic updates. Each gives the batch operator's result."""

from __future__ import annotations

import threading
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from barline.operators.resample import order_key
from barline.session import shared_dir
from barline.sources.upsert import upsert


def event_time(df: DataFrame, time: str = "ts") -> DataFrame:
    """Zone-less timestamps to instants: watermarks need the latter."""
    return df.withColumn(time, F.col(time).cast("timestamp"))


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_bars(
    ticks: DataFrame,
    seconds: int,
    delay: str,
    price: str = "value",
    size: str = "value",
    tie: str | None = None,
    key: tuple[str, ...] = ("series_id",),
    time: str = "ts",
) -> DataFrame:
    """Closed bars only: in append mode a bar appears once the watermark has passed its end."""
    at = order_key(time, tie)
    bars = ticks.withWatermark(time, delay).groupBy(*key, F.window(time, f"{seconds} seconds").alias("_w")).agg(
        F.min_by(price, at).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, at).alias("close"),
        F.sum(size).alias("volume"),
        F.count(F.lit(1)).alias("trades"),
    )
    return bars.select(*key, F.col("_w.start").alias(time), "open", "high", "low", "close", "volume", "trades")


def stream_news(news: DataFrame, delay: str, hours: int = 24, slide: str = "1 hour", time: str = "published_at") -> DataFrame:
    """Counts and sentiment over trailing windows."""
    sign = F.when(F.col("sentiment") == "POSITIVE", 1).when(F.col("sentiment") == "NEGATIVE", -1).otherwise(0)
    out = news.withWatermark(time, delay).groupBy(F.window(time, f"{hours} hours", slide).alias("_w")).agg(
        F.count(F.lit(1)).alias("news_count"),
        F.sum(sign).alias("net_sentiment"),
        F.sum("score").alias("total_score"),
    )
    return out.select(F.col("_w.end").alias("window_end"), "news_count", "net_sentiment", "total_score")


def stream_dedupe(df: DataFrame, key: list[str], retention: str, time: str = "published_at") -> DataFrame:
    """First row per key within the retention."""
    return df.withWatermark(time, retention).dropDuplicatesWithinWatermark(key)


def stream_enrich(df: DataFrame, daily: DataFrame, columns: list[str], key: list[str], time: str = "ts") -> DataFrame:
    """Join each row with the context of the day before."""
    context = daily.select(*key, F.col(time).alias("_day"), *columns)
    day = F.date_trunc("day", F.col(time)) - F.expr("INTERVAL 1 DAY")
    return df.withColumn("_day", day).join(context, [*key, "_day"], "left").drop("_day")


def run_to_table(stream: DataFrame, name: str, mode: str = "append") -> tuple[DataFrame, StreamingQuery]:
    """Run what is available into a parquet table in the shared folder; return the table and the query."""
    spark = stream.sparkSession
    path, checkpoint = shared_dir(spark, name), shared_dir(spark, f"{name}-checkpoint")
    q = (
        stream.writeStream.format("parquet")
        .outputMode(mode)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path), q


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Files per day that the upsert sink writes at most.
DAY_FILES = 8


def upsert_sink(
    path: str, schema: T.StructType, keys: list[str], time: str = "ts", order: list[str] | None = None, slot: Column | None = None
):
    """A ``foreachBatch`` function keeping the last row per key in a table partitioned by day.

    Only the days of the batch are read and rewritten. The merged rows are first written to a
    staging folder named by the batch id; a batch that is run again after a failure finishes from
    there, so a half-replaced table is never read back.
    """
    day = slot if slot is not None else F.date_format(time, "yyyy-MM-dd")
    full = T.StructType([*schema.fields, T.StructField("day", T.StringType())])

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        staging = f"{path.rstrip('/')}_staging/batch={batch_id}"
        if not _exists(spark, f"{staging}/_SUCCESS"):
            new = batch.select(*[f.name for f in schema.fields]).withColumn("day", day)
            old = spark.read.schema(full).parquet(path) if _exists(spark, path) else None
            if old is None:
                old = spark.createDataFrame([], full)
            touched = old.join(new.select("day").distinct(), "day", "left_semi")
            upsert(touched, new, ["day", *keys], order=order).select(*[f.name for f in full.fields]).write.mode("overwrite").parquet(staging)
        merged = spark.read.schema(full).parquet(staging)
        (
            merged.repartition("day", F.pmod(F.xxhash64(*keys), F.lit(DAY_FILES)))
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("day")
            .parquet(path)
        )
        _delete(spark, f"{path.rstrip('/')}_staging/batch={batch_id - 1}")

    return write


def stream_upsert(
    stream: DataFrame, name: str, keys: list[str], time: str = "ts", order: list[str] | None = None
) -> tuple[DataFrame, StreamingQuery]:
    """Run what is available through the upsert sink; return the table and the query."""
    spark = stream.sparkSession
    path, checkpoint = shared_dir(spark, name), shared_dir(spark, f"{name}-checkpoint")
    q = (
        stream.writeStream.foreachBatch(upsert_sink(path, stream.schema, keys, time, order))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path), q


class LateRows(StreamingQueryListener):
    """Sums, batch by batch, what each query's stateful operators dropped as later than the watermark.

    An operator that aggregates first counts groups, not the rows in them.
    """

    def __init__(self):
        self._dropped, self._ended, self._change = Counter(), set(), threading.Condition()

    def onQueryStarted(self, event):
        pass

    def onQueryIdle(self, event):
        pass

    def onQueryProgress(self, event):
        with self._change:
            self._dropped[str(event.progress.runId)] += sum(int(op.numRowsDroppedByWatermark) for op in event.progress.stateOperators)

    def onQueryTerminated(self, event):
        with self._change:
            self._ended.add(str(event.runId))
            self._change.notify_all()

    def total(self, query: StreamingQuery, seconds: float = 60) -> int:
        """The sum over all batches of a query that has ended."""
        run = str(query.runId)
        with self._change:
            if not self._change.wait_for(lambda: run in self._ended, seconds):
                raise TimeoutError("the end of the query was not reported")
            return self._dropped[run]


def run_counted(stream: DataFrame, name: str) -> tuple[DataFrame, StreamingQuery, int]:
    """``run_to_table`` with the number of late groups over all batches."""
    streams, late = stream.sparkSession.streams, LateRows()
    streams.addListener(late)
    try:
        out, query = run_to_table(stream, name)
        return out, query, late.total(query)
    finally:
        streams.removeListener(late)
