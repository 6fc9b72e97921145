"""Series tables derived from the driver's tables, as Spark plans and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.grid import DAY, HOUR, Grid
from barline.operators.resample import order_key, ticks_to_bars

BARS_4H = Grid(step=4 * HOUR)
BARS_1H = Grid(step=HOUR)
BARS_1D = Grid(step=DAY)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_type").alias("series_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        "value",
        "user_id",
    )


def bars_from_events(spark: SparkSession, sf: str, seconds: int) -> DataFrame:
    return ticks_to_bars(
        ticks(spark, sf),
        seconds,
        price="value",
        size="value",
        tie="event_id",
        taker=F.col("user_id") % 2 == 0,
    )


def bars_4h(spark: SparkSession, sf: str) -> DataFrame:
    return bars_from_events(spark, sf, 4 * HOUR)


def bars_1h(spark: SparkSession, sf: str) -> DataFrame:
    return bars_from_events(spark, sf, HOUR)


def bars_1d(spark: SparkSession, sf: str, series: str = "o_orderpriority", exact: bool = False) -> DataFrame:
    o = table(spark, sf, "orders").select(
        F.col(series).alias("series_id"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        "o_orderkey",
        "o_totalprice",
        "o_orderstatus",
    )
    taker = F.col("o_orderstatus") == "F"
    return ticks_to_bars(o, DAY, price="o_totalprice", size="o_totalprice", tie="o_orderkey", taker=taker, exact=exact)


def slow_1d(spark: SparkSession, sf: str) -> DataFrame:
    """One daily series: mean order value and order count."""
    o = table(spark, sf, "orders")
    return o.groupBy(F.date_trunc("day", F.col("o_orderdate").cast("timestamp")).alias("ts")).agg(
        F.avg("o_totalprice").alias("value"), F.count(F.lit(1)).alias("cnt")
    )


def depth(spark: SparkSession, sf: str) -> DataFrame:
    """Order-book style table: (series_id, range, ts) with both sides; ranges nest."""
    li = table(spark, sf, "lineitem")
    ranges = F.when(F.col("l_linenumber") <= 2, F.array(*map(F.lit, ("r05", "r1", "r2")))).when(
        F.col("l_linenumber") <= 4, F.array(*map(F.lit, ("r1", "r2")))
    ).otherwise(F.array(F.lit("r2")))
    bid, ask = F.col("l_returnflag") == "R", F.col("l_returnflag") != "R"
    daily = li.groupBy(
        F.date_trunc("day", F.col("l_shipdate").cast("timestamp")).alias("ts"), "l_linenumber"
    ).agg(
        F.sum(F.when(bid, F.col("l_extendedprice"))).alias("bids_usd"),
        F.sum(F.when(bid, F.col("l_quantity"))).alias("bids_quantity"),
        F.sum(F.when(ask, F.col("l_extendedprice"))).alias("asks_usd"),
        F.sum(F.when(ask, F.col("l_quantity"))).alias("asks_quantity"),
    )
    return (
        daily.withColumn("range", F.explode(ranges))
        .groupBy(F.lit("book").alias("series_id"), "range", "ts")
        .agg(*[F.sum(c).alias(c) for c in ("bids_usd", "bids_quantity", "asks_usd", "asks_quantity")])
    )


def derivatives(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    disc, tax, qty = F.col("l_discount") + 0.0, F.col("l_tax") + 0.0, F.col("l_quantity")
    return li.groupBy(
        F.lit("deriv").alias("series_id"), F.date_trunc("day", F.col("l_shipdate").cast("timestamp")).alias("ts")
    ).agg(
        F.sum(F.when(F.col("l_linestatus") == "O", qty)).alias("oi_binance"),
        F.sum(qty).alias("oi_aggregated"),
        F.avg(disc).alias("funding_binance"),
        (F.sum(disc * qty) / F.sum(qty)).alias("funding_oi_weighted"),
        F.avg(tax).alias("funding_vol_weighted"),
    )


def news(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as a news feed; labels give sentiment where known."""
    d, lab = table(spark, sf, "documents"), table(spark, sf, "labels")
    quality, toxic = F.col("quality"), F.col("toxic")
    score = F.when(toxic == 1, -4.0).when(quality == 1, 3.0).when(quality == 0, -1.0).otherwise(0.0)
    return d.join(lab, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.col("text").alias("title"),
        F.col("text").alias("body"),
        "source",
        F.col("lang").alias("search_group"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=F.col("doc_id").cast("int"))).alias(
            "published_at"
        ),
        F.when(toxic == 1, "NEGATIVE").when(quality == 1, "POSITIVE").otherwise("NEUTRAL").alias("sentiment"),
        (F.col("n_chars") % 7).alias("upvotes"),
        (score * (1 + F.col("n_chars") % 3)).alias("score"),
        F.when(F.col("n_chars") > 2000, "HIGH").when(F.col("n_chars") > 500, "MEDIUM").otherwise("LOW").alias("impact"),
        F.when(toxic == 1, "ESCALATION").when(quality == 1, "DEESCALATION").otherwise("OTHER").alias("event_type"),
        F.concat(F.lit("topic_"), (F.col("doc_id") % 5).cast("string")).alias("topic"),
    )


# ---- the same tables as SQL ------------------------------------------------------------------


def _bars_sql(name: str, source: str, series: str, t: str, bucket: str, key: str, v: str, taker: str, width: str) -> str:
    return f"""{name} AS (
  SELECT {series} AS series_id, {bucket} AS ts,
         {bucket} + INTERVAL {width} - INTERVAL 1 MICROSECOND AS close_time,
         first({v} ORDER BY {t}, {key}) AS open, max({v}) AS high, min({v}) AS low,
         last({v} ORDER BY {t}, {key}) AS close, sum({v}) AS volume, sum({v}) AS quote_volume,
         count(*) AS trades,
         coalesce(sum({v}) FILTER (WHERE {taker}), 0.0) AS taker_buy_base_volume,
         coalesce(sum({v}) FILTER (WHERE {taker}), 0.0) AS taker_buy_quote_volume
  FROM {source} GROUP BY 1, 2, 3)"""


BARS_4H_SQL = _bars_sql(
    "bars", "events", "event_type", "ts", "time_bucket(INTERVAL 4 HOUR, ts)", "event_id", "value", "user_id % 2 = 0", "4 HOUR"
)
BARS_1H_SQL = _bars_sql(
    "bars", "events", "event_type", "ts", "time_bucket(INTERVAL 1 HOUR, ts)", "event_id", "value", "user_id % 2 = 0", "1 HOUR"
)


def bars_1d_sql(series: str = "o_orderpriority", name: str = "bars") -> str:
    return _bars_sql(
        name,
        "orders",
        series,
        "o_orderdate",
        "date_trunc('day', o_orderdate::TIMESTAMP)",
        "o_orderkey",
        "o_totalprice",
        "o_orderstatus = 'F'",
        "1 DAY",
    )


BARS_1D_SQL = bars_1d_sql()
SLOW_1D_SQL = """slow AS (
  SELECT date_trunc('day', o_orderdate::TIMESTAMP) AS ts, avg(o_totalprice) AS value, count(*) AS cnt
  FROM orders GROUP BY 1)"""
DEPTH_SQL = """depth AS (
  SELECT 'book' AS series_id, r.range, date_trunc('day', l_shipdate::TIMESTAMP) AS ts,
         sum(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS bids_usd,
         sum(l_quantity) FILTER (WHERE l_returnflag = 'R') AS bids_quantity,
         sum(l_extendedprice) FILTER (WHERE l_returnflag <> 'R') AS asks_usd,
         sum(l_quantity) FILTER (WHERE l_returnflag <> 'R') AS asks_quantity
  FROM lineitem JOIN (VALUES ('r05', 2), ('r1', 4), ('r2', 1000)) AS r(range, top) ON l_linenumber <= r.top
  GROUP BY 1, 2, 3)"""
DERIVATIVES_SQL = """deriv AS (
  SELECT 'deriv' AS series_id, date_trunc('day', l_shipdate::TIMESTAMP) AS ts,
         sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS oi_binance,
         sum(l_quantity) AS oi_aggregated, avg(l_discount + 0.0) AS funding_binance,
         sum(l_discount * l_quantity) / sum(l_quantity) AS funding_oi_weighted,
         avg(l_tax + 0.0) AS funding_vol_weighted
  FROM lineitem GROUP BY 1, 2)"""
NEWS_SQL = """news AS (
  SELECT d.doc_id AS id, text AS title, text AS body, source,
         lang AS search_group, TIMESTAMP '2024-01-01' + to_minutes(d.doc_id) AS published_at,
         CASE WHEN toxic = 1 THEN 'NEGATIVE' WHEN quality = 1 THEN 'POSITIVE' ELSE 'NEUTRAL' END AS sentiment,
         n_chars % 7 AS upvotes,
         (CASE WHEN toxic = 1 THEN -4.0 WHEN quality = 1 THEN 3.0 WHEN quality = 0 THEN -1.0 ELSE 0.0 END)::DOUBLE
           * (1 + n_chars % 3) AS score,
         CASE WHEN n_chars > 2000 THEN 'HIGH' WHEN n_chars > 500 THEN 'MEDIUM' ELSE 'LOW' END AS impact,
         CASE WHEN toxic = 1 THEN 'ESCALATION' WHEN quality = 1 THEN 'DEESCALATION' ELSE 'OTHER' END AS event_type,
         'topic_' || (d.doc_id % 5)::VARCHAR AS topic
  FROM documents d LEFT JOIN labels l USING (doc_id))"""


# ---- SQL window shorthands -------------------------------------------------------------------


def frame(lo: int, hi: int = 0, part: str = "series_id", order: str = "ts") -> str:
    def bound(n: int) -> str:
        return "CURRENT ROW" if n == 0 else f"{abs(n)} {'PRECEDING' if n < 0 else 'FOLLOWING'}"

    return f"(PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {bound(lo)} AND {bound(hi)})"


def roll(agg: str, x: str, n: int, least: int | None = None, part: str = "series_id") -> str:
    """Rolling aggregate, null unless the frame holds ``least`` (default n) non-null values of x."""
    w = frame(-(n - 1), 0, part)
    return f"(CASE WHEN count({x}) OVER {w} >= {least or n} THEN {agg} OVER {w} END)"


def lag(x: str, k: int = 1, part: str = "series_id") -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY {part} ORDER BY ts)"


def lead(x: str, k: int = 1, part: str = "series_id") -> str:
    return f"lead({x}, {k}) OVER (PARTITION BY {part} ORDER BY ts)"


def t_tail_sql(t: str, v: str) -> str:
    """Two-sided Student tail by Simpson's rule on the angle atan(t / sqrt(v))."""
    th = f"atan(abs({t}) / sqrt({v}))"
    terms = (
        "list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
        f" * pow(cos({th} * i / 2000), {v} - 1)))"
    )
    return f"(1 - exp(lgamma(({v} + 1) / 2.0) - lgamma({v} / 2.0)) * 2 / sqrt(pi()) * ({th} / 6000) * {terms})"


def norm_tail_sql(z: str) -> str:
    terms = (
        "list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)"
        f" * exp(-pow({z} * i / 2000, 2) / 2)))"
    )
    return f"(1 - 2 / sqrt(2 * pi()) * (abs({z}) / 6000) * {terms})"


SCORES_SQL = f"""{BARS_4H_SQL}, sc0 AS (SELECT series_id, ts, close,
      floor(taker_buy_quote_volume / quote_volume * 100) / 100 AS p, (close > open)::INT AS state,
      CASE WHEN lead(close) OVER w IS NOT NULL THEN (lead(close) OVER w > close)::INT END AS y,
      lead(close, 6) OVER w / close - 1 AS ret, ln(close / lag(close) OVER w) AS r,
      CASE WHEN ts < TIMESTAMP '2024-01-11' THEN 's1' WHEN ts < TIMESTAMP '2024-01-21' THEN 's2' ELSE 's3' END AS split
      FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
    scores AS (SELECT *, CASE WHEN p > 0.6 THEN 1 WHEN p < 0.4 THEN -1 ELSE 0 END AS signal,
      CASE WHEN r > 0.3 THEN 'up' WHEN r < -0.3 THEN 'down' WHEN r IS NOT NULL THEN 'flat' END AS regime FROM sc0)"""


def scores(spark: SparkSession, sf: str) -> DataFrame:
    """4-hour bars as if scored by a model: probability, outcome, forward return, signal, regime, split."""
    from barline.grid import Roll, over_series
    from barline.operators import labels as L
    from barline.operators import rolling as R

    def nxt(w):
        return (F.lead("close", 1).over(w.spec) > F.col("close")).cast("int")

    df = over_series(
        bars_4h(spark, sf),
        BARS_4H,
        {"y": Roll(nxt, ahead=1), "ret": L.fwd_return("close", 6), "r": R.log_return("close")},
    )
    p, r, ts = F.floor(F.try_divide("taker_buy_quote_volume", "quote_volume") * 100) / 100, F.col("r"), F.col("ts")
    df = df.select(
        "series_id",
        "ts",
        "close",
        p.alias("p"),
        (F.col("close") > F.col("open")).cast("int").alias("state"),
        "y",
        "ret",
        "r",
        F.when(ts < "2024-01-11", "s1").when(ts < "2024-01-21", "s2").otherwise("s3").alias("split"),
    )
    return df.withColumns(
        {
            "signal": F.when(F.col("p") > 0.6, 1).when(F.col("p") < 0.4, -1).otherwise(0),
            "regime": F.when(r > 0.3, "up").when(r < -0.3, "down").when(r.isNotNull(), "flat"),
        }
    )
