"""Queries that run streams over the tables to completion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.plans.adapters import BARS_4H_SQL, NEWS_SQL, bars_4h, news, table
from barline.plans.registry import query
from barline.session import shared_dir
from barline.streaming import jobs as J


def tick_stream(spark, sf):
    schema = table(spark, sf, "events").schema
    stream = J.event_time(J.read_stream(spark, f"{sf}/events*.parquet", schema))
    return stream.select(F.col("event_type").alias("series_id"), "ts", "event_id", "value", "user_id")


@query(
    "stream_bars",
    "series_id ts open:4 high:4 low:4 close:4 volume:4 trades:i",
    f"""{BARS_4H_SQL}, m AS (SELECT epoch_ms(epoch_us(max(ts::TIMESTAMP)) // 1000) - INTERVAL 10 MINUTE AS mark FROM events),
    t AS (SELECT b.* FROM bars b, m WHERE b.ts + INTERVAL 4 HOUR <= mark)""",
)
def _(spark, sf):
    return J.run_to_table(J.stream_bars(tick_stream(spark, sf), 4 * 3600, "10 minutes", tie="event_id"), "stream_bars")[0]


def news_stream(spark, sf):
    """The feed as files in the shared folder, read as a stream."""
    path = shared_dir(spark, "news_feed")
    feed = news(spark, sf).withColumn("norm", F.lower("title"))
    feed.write.parquet(path)
    return J.read_stream(spark, path, feed.schema)


#: Trailing windows of the feed, in hours.
WINDOWS = (1, 4, 24)


@query(
    "stream_news_windows",
    "hours:i window_end:t news_count:i net_sentiment:i total_score:4",
    f"""{NEWS_SQL}, m AS (SELECT max(published_at) - INTERVAL 1 HOUR AS mark FROM news),
    w AS (SELECT unnest(generate_series(date_trunc('hour', min(published_at)), max(published_at) + INTERVAL 24 HOUR, INTERVAL 1 HOUR)) AS asof FROM news),
    t AS (SELECT hours, w.asof AS window_end, count(*) AS news_count, sum(CASE sentiment WHEN 'POSITIVE' THEN 1 WHEN 'NEGATIVE' THEN -1 ELSE 0 END) AS net_sentiment, sum(score) AS total_score
      FROM (VALUES {", ".join(f"({h})" for h in WINDOWS)}) v(hours), w, m, news n
      WHERE n.published_at < w.asof AND n.published_at >= w.asof - to_hours(hours) AND w.asof <= mark GROUP BY hours, w.asof)""",
)
def _(spark, sf):
    feed = news_stream(spark, sf)
    runs = [J.run_to_table(J.stream_news(feed, "1 hour", hours=h), f"stream_news_{h}")[0].withColumn("hours", F.lit(h)) for h in WINDOWS]
    return reduce(DataFrame.unionByName, runs)


@query("stream_dedupe", "norm", f"{NEWS_SQL}, t AS (SELECT DISTINCT lower(title) AS norm FROM news)")
def _(spark, sf):
    return J.run_to_table(J.stream_dedupe(news_stream(spark, sf), ["norm"], "400 days"), "stream_dedupe")[0]


@query(
    "stream_upsert",
    "series_id user_id:i ts event_id:i value:4",
    """k AS (SELECT event_type AS series_id, user_id, ts::TIMESTAMP AS ts, event_id, value, row_number() OVER (PARTITION BY event_type, user_id, date_trunc('day', ts) ORDER BY ts DESC, event_id DESC) AS rn FROM events),
    t AS (SELECT * FROM k WHERE rn = 1)""",
)
def _(spark, sf):
    return J.stream_upsert(tick_stream(spark, sf), "stream_upsert", ["series_id", "user_id"], order=["ts", "event_id"])[0]


@query(
    "stream_enrich",
    "series_id ts event_id:i value:4 high:4",
    """d AS (SELECT event_type, date_trunc('day', ts::TIMESTAMP) AS d, max(value) AS high FROM events GROUP BY 1, 2),
    t AS (SELECT e.event_type AS series_id, e.ts::TIMESTAMP AS ts, event_id, value, high FROM events e
      LEFT JOIN d ON d.event_type = e.event_type AND d.d = date_trunc('day', e.ts::TIMESTAMP) - INTERVAL 1 DAY)""",
)
def _(spark, sf):
    daily = bars_4h(spark, sf).groupBy("series_id", F.date_trunc("day", "ts").alias("ts")).agg(F.max("high").alias("high"))
    return J.run_to_table(J.stream_enrich(tick_stream(spark, sf), daily, ["high"], ["series_id"]), "stream_enrich")[0]


def late_stream(spark, sf):
    """All events in three deliveries, the last of which comes after the second has moved the watermark."""
    path = shared_dir(spark, "deliveries")
    events = table(spark, sf, "events")
    turn = F.pmod("event_id", F.lit(7))
    counts = []
    for part in (turn >= 2, turn == 0, turn == 1):
        events.filter(part).write.mode("append").parquet(path)
        counts.append(len(spark.read.schema(events.schema).parquet(path).inputFiles()))
    if counts != [counts[0] * (i + 1) for i in range(3)]:
        raise ValueError("the deliveries differ in their numbers of files")
    stream = J.event_time(J.read_stream(spark, path, events.schema, counts[0]))
    return stream.select(F.col("event_type").alias("series_id"), "ts", "event_id", "value", "user_id")


@query(
    "stream_late_rows",
    "bars:i late:i",
    """e AS (SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts::TIMESTAMP) AS h, ts::TIMESTAMP AS ts, event_id % 7 AS turn FROM events),
    m AS (SELECT epoch_ms(epoch_us(max(ts) FILTER (WHERE turn >= 2)) // 1000) - INTERVAL 10 MINUTE AS early, epoch_ms(epoch_us(max(ts)) // 1000) - INTERVAL 10 MINUTE AS mark FROM e),
    l AS (SELECT e.*, turn = 1 AND h + INTERVAL 1 HOUR <= early AS late, h + INTERVAL 1 HOUR <= mark AS closed FROM e, m),
    t AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT event_type, h FROM l WHERE closed AND NOT late)) AS bars,
      (SELECT count(*) FROM (SELECT DISTINCT event_type, h FROM l WHERE late)) AS late)""",
)
def _(spark, sf):
    bars = J.stream_bars(late_stream(spark, sf), 3600, "10 minutes", tie="event_id")
    out, _, late = J.run_counted(bars, "late_rows")
    return out.agg(F.count(F.lit(1)).alias("bars")).withColumn("late", F.lit(late))
