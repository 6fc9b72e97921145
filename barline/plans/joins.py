"""Queries over joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.grid import HOUR, min_of, sum_of
from barline.operators import joins as J
from barline.operators.fill import regrid
from barline.plans.adapters import (
    BARS_1D,
    BARS_1D_SQL,
    BARS_1H,
    BARS_1H_SQL,
    BARS_4H,
    BARS_4H_SQL,
    DEPTH_SQL,
    SLOW_1D_SQL,
    bars_1d,
    bars_1h,
    bars_4h,
    depth,
    slow_1d,
    table,
)
from barline.plans.registry import query

DAILY_CTX_SQL = """ctx AS (SELECT event_type AS series_id, date_trunc('day', ts::TIMESTAMP) AS ts,
      CASE WHEN day(ts) % 4 = 0 THEN NULL ELSE max(value) END AS hi, CASE WHEN day(ts) % 3 = 0 THEN NULL ELSE avg(value) END AS mean
      FROM events GROUP BY event_type, date_trunc('day', ts::TIMESTAMP), day(ts))"""


def daily_context(spark, sf):
    e = table(spark, sf, "events").select(
        F.col("event_type").alias("series_id"), F.date_trunc("day", F.col("ts").cast("timestamp")).alias("ts"), "value"
    )
    d = F.dayofmonth("ts")
    return (
        e.groupBy("series_id", "ts")
        .agg(F.max("value").alias("hi"), F.avg("value").alias("mean"))
        .withColumns({"hi": F.when(d % 4 != 0, F.col("hi")), "mean": F.when(d % 3 != 0, F.col("mean"))})
    )


@query(
    "inner_join_suffix",
    "series_id ts close:4 close_1h:4 trades:i trades_1h:i",
    f"""{BARS_4H_SQL}, h AS ({BARS_1H_SQL.split('(', 1)[1].rsplit(')', 1)[0]}),
    t AS (SELECT b.series_id, b.ts, b.close, h.close AS close_1h, b.trades, h.trades AS trades_1h FROM bars b JOIN h USING (series_id, ts))""",
)
def _(spark, sf):
    hourly = bars_1h(spark, sf).select("series_id", "ts", "close", "trades")
    return J.join_inner(bars_4h(spark, sf), hourly, ["series_id", "ts"], "_1h")


@query(
    "left_join_columns",
    "series_id ts close:4 value:6",
    f"""{BARS_1D_SQL}, {SLOW_1D_SQL}, t AS (SELECT b.series_id, ts, close, value FROM bars b
      LEFT JOIN slow s USING (ts))""",
)
def _(spark, sf):
    return J.join_left(bars_1d(spark, sf), slow_1d(spark, sf), ["ts"], ["value"])


@query(
    "outer_join_ranges",
    "series_id ts near:2 far:2 deep:2",
    f"""{DEPTH_SQL}, a AS (SELECT series_id, ts, bids_usd AS near FROM depth WHERE range = 'r05'),
    b AS (SELECT series_id, ts, bids_usd AS far FROM depth WHERE range = 'r1'),
    c AS (SELECT series_id, ts, bids_usd AS deep FROM depth WHERE range = 'r2'),
    t AS (SELECT * FROM a FULL JOIN b USING (series_id, ts) FULL JOIN c USING (series_id, ts))""",
)
def _(spark, sf):
    d = depth(spark, sf)

    def side(r: str, name: str):
        return d.filter(F.col("range") == r).select("series_id", "ts", F.col("bids_usd").alias(name))

    return J.join_outer([side("r05", "near"), side("r1", "far"), side("r2", "deep")], ["series_id", "ts"])


@query(
    "asof_fill_lagged",
    "series_id ts close:4 hi:4 mean:6",
    f"""{BARS_4H_SQL}, {DAILY_CTX_SQL},
    u AS (SELECT series_id, ts, 1 AS side, close, NULL AS hi, NULL AS mean FROM bars
      UNION ALL SELECT series_id, ts + INTERVAL 1 DAY, 0, NULL, hi, mean FROM ctx),
    f AS (SELECT series_id, ts, side, close, last_value(hi IGNORE NULLS) OVER w AS hi, last_value(mean IGNORE NULLS) OVER w AS mean
      FROM u WINDOW w AS (PARTITION BY series_id ORDER BY ts, side ROWS UNBOUNDED PRECEDING)),
    t AS (SELECT series_id, ts, close, hi, mean FROM f WHERE side = 1)""",
)
def _(spark, sf):
    return J.asof_ffill(bars_4h(spark, sf).select("series_id", "ts", "close"), daily_context(spark, sf), BARS_4H, ["hi", "mean"])


@query(
    "asof_fill_shared",
    "series_id ts close:4 value:6",
    f"""{BARS_1D_SQL}, {SLOW_1D_SQL}, s AS (SELECT ts + INTERVAL 1 DAY AS ts, value FROM slow),
    t AS (SELECT b.series_id, b.ts, b.close, s.value FROM bars b ASOF LEFT JOIN s ON b.ts >= s.ts)""",
)
def _(spark, sf):
    return J.asof_shared(bars_1d(spark, sf).select("series_id", "ts", "close"), slow_1d(spark, sf), BARS_1D, ["value"])


@query(
    "asof_previous_day",
    "series_id ts close:4 hi:4 mean:6",
    f"""{BARS_4H_SQL}, {DAILY_CTX_SQL},
    u AS (SELECT series_id, ts, date_trunc('day', ts) AS d, 0 AS side, close, NULL AS hi, NULL AS mean FROM bars
      UNION ALL SELECT series_id, ts, ts, 1, NULL, hi, mean FROM ctx),
    f AS (SELECT series_id, ts, side, close, last_value(hi IGNORE NULLS) OVER w AS hi, last_value(mean IGNORE NULLS) OVER w AS mean
      FROM u WINDOW w AS (PARTITION BY series_id ORDER BY d, side ROWS UNBOUNDED PRECEDING)),
    t AS (SELECT series_id, ts, close, hi, mean FROM f WHERE side = 0)""",
)
def _(spark, sf):
    return J.asof_before(bars_4h(spark, sf).select("series_id", "ts", "close"), daily_context(spark, sf), BARS_4H, ["hi", "mean"])


SIGNALS_SQL = "sig AS (SELECT event_type AS series_id, event_id, ts::TIMESTAMP AS event_ts FROM events WHERE value > 100)"


def signal_events(spark, sf):
    return table(spark, sf, "events").filter(F.col("value") > 100).select(
        F.col("event_type").alias("series_id"), "event_id", F.col("ts").cast("timestamp").alias("ts")
    )


@query(
    "asof_lookup_offsets",
    "series_id event_id:i offset_h:i close:4",
    f"""{BARS_1H_SQL}, {SIGNALS_SQL}, m AS (SELECT *, event_ts + to_hours(offset_h) AS at FROM sig,
      (VALUES (0), (4), (12), (24)) o(offset_h)),
    t AS (SELECT m.series_id, event_id, offset_h, b.close FROM m ASOF LEFT JOIN bars b ON m.series_id = b.series_id AND m.at >= b.ts)""",
)
def _(spark, sf):
    series = bars_1h(spark, sf).select("series_id", "ts", "close")
    events = signal_events(spark, sf)
    return J.asof_lookup(events, series, BARS_1H.fit(events), ["close"], [0, 4, 12, 24], "event_id")


@query(
    "asof_forward_grid",
    "series_id event_id:i next_ts:t",
    f"""{BARS_4H_SQL}, {SIGNALS_SQL}, t AS (SELECT s.series_id, event_id, b.ts AS next_ts FROM sig s
      ASOF LEFT JOIN bars b ON s.series_id = b.series_id AND s.event_ts <= b.ts)""",
)
def _(spark, sf):
    events = signal_events(spark, sf)
    return J.asof_forward(events, bars_4h(spark, sf), BARS_4H.fit(events))


@query(
    "interval_join_min",
    "series_id event_id:i low:4 bars:i",
    f"""{BARS_1H_SQL}, {SIGNALS_SQL}, t AS (SELECT s.series_id, event_id, min(b.low) AS low, count(b.low) AS bars FROM sig s LEFT JOIN bars b
      ON s.series_id = b.series_id AND b.ts >= s.event_ts AND b.ts < s.event_ts + INTERVAL 4 HOUR GROUP BY 1, 2)""",
)
def _(spark, sf):
    folds = {"low": min_of("low"), "bars": sum_of(F.col("low").isNotNull().cast("int"))}
    found = J.range_fold(signal_events(spark, sf), bars_1h(spark, sf).select("series_id", "ts", "low"), BARS_1H, 4 * HOUR, folds, ["event_id"])
    return found.withColumn("bars", F.coalesce("bars", F.lit(0.0)))


@query(
    "calendar_regrid",
    "series_id ts close:4 exact:4",
    f"""{BARS_1D_SQL}, c AS (SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 DAY)) AS ts FROM bars GROUP BY 1),
    j AS (SELECT c.series_id, c.ts, b.close AS exact FROM c LEFT JOIN bars b USING (series_id, ts) WHERE isodow(c.ts) <= 5),
    t AS (SELECT *, last_value(exact IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts) AS close FROM j)""",
)
def _(spark, sf):
    df = bars_1d(spark, sf).select("series_id", "ts", "close", F.col("close").alias("exact"))
    return regrid(df, BARS_1D, ["close"], business=True, keep=["exact"])


@query(
    "index_alignment",
    "series_id ts close:4",
    f"""{BARS_1D_SQL}, t AS (SELECT series_id, ts, close FROM bars WHERE ts IN (SELECT ts FROM bars WHERE series_id = '1-URGENT'))""",
)
def _(spark, sf):
    bars = bars_1d(spark, sf)
    return J.align(bars, bars.filter(F.col("series_id") == "1-URGENT"), ["ts"])


EVENT_DATES_SQL = "ed AS (SELECT DISTINCT o_orderdate::TIMESTAMP AS ts FROM orders WHERE day(o_orderdate) = 15 AND month(o_orderdate) % 2 = 0)"


def event_dates(spark, sf):
    d = F.col("o_orderdate").cast("timestamp")
    o = table(spark, sf, "orders").filter((F.dayofmonth("o_orderdate") == 15) & (F.month("o_orderdate") % 2 == 0))
    return o.select(d.alias("ts")).distinct()


@query(
    "event_windows",
    "series_id ts is_event:i pre_event:i post_event:i",
    f"""{BARS_1D_SQL}, {EVENT_DATES_SQL}, f AS (SELECT series_id, ts, (ts IN (SELECT ts FROM ed))::INT AS is_event FROM bars),
    t AS (SELECT series_id, ts, is_event,
      coalesce(max(is_event) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), 0) AS pre_event,
      coalesce(max(is_event) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 0) AS post_event FROM f)""",
)
def _(spark, sf):
    return J.event_windows(bars_1d(spark, sf).select("series_id", "ts"), event_dates(spark, sf), BARS_1D)


@query(
    "days_to_next_event",
    "series_id ts days_to_next:i proximity:6",
    f"""{BARS_1D_SQL}, {EVENT_DATES_SQL}, n AS (SELECT b.series_id, b.ts, ed.ts AS nxt FROM bars b ASOF LEFT JOIN ed ON b.ts < ed.ts),
    t AS (SELECT series_id, ts, coalesce(date_diff('day', ts, nxt), 30) AS days_to_next, 1.0 / (coalesce(date_diff('day', ts, nxt), 30) + 1) AS proximity FROM n)""",
)
def _(spark, sf):
    return J.days_to_next(bars_1d(spark, sf).select("series_id", "ts"), event_dates(spark, sf), BARS_1D)


@query(
    "scenario_grid",
    "series_id cost_bps:i leverage:2 rows:i net:4",
    f"""{BARS_4H_SQL}, t AS (SELECT series_id, cost_bps, leverage, count(*) AS rows, sum((close / open - 1) * leverage - cost_bps / 10000.0) AS net
      FROM bars, (VALUES (5, 1.0), (10, 1.0), (10, 2.0)) s(cost_bps, leverage) GROUP BY 1, 2, 3)""",
)
def _(spark, sf):
    grid = [{"cost_bps": 5, "leverage": 1.0}, {"cost_bps": 10, "leverage": 1.0}, {"cost_bps": 10, "leverage": 2.0}]
    net = (F.col("close") / F.col("open") - 1) * F.col("leverage") - F.col("cost_bps") / 10000.0
    return (
        J.cross_grid(bars_4h(spark, sf), grid)
        .groupBy("series_id", "cost_bps", "leverage")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum(net).alias("net"))
    )
