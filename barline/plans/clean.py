"""Queries over contracts, repairs and monitoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.functions.mathx import clip, entropy2, safe_div
from barline.grid import over_series
from barline.operators import contracts as C
from barline.operators import rolling as R
from barline.plans.adapters import (
    BARS_1D,
    BARS_1D_SQL,
    BARS_1H,
    BARS_1H_SQL,
    BARS_4H,
    BARS_4H_SQL,
    DEPTH_SQL,
    DERIVATIVES_SQL,
    bars_1d,
    bars_1h,
    bars_4h,
    depth,
    derivatives,
    slow_1d,
    SLOW_1D_SQL,
)
from barline.plans.registry import query
from barline.operators.rolling import buy_pressure

# Bars damaged by rule, so that every check has something to find.
DAMAGED_SQL = f"""{BARS_1D_SQL}, d AS (SELECT series_id, ts, close_time,
      CASE WHEN trades % 13 = 0 THEN NULL ELSE open END AS open,
      CASE WHEN trades % 5 = 0 THEN low ELSE high END AS high, CASE WHEN trades % 7 = 0 THEN high ELSE low END AS low,
      CASE WHEN trades % 11 = 0 THEN -close ELSE close END AS close, volume, quote_volume, trades,
      CASE WHEN trades % 17 = 0 THEN volume * 2 ELSE taker_buy_base_volume END AS taker_buy_base_volume, taker_buy_quote_volume
      FROM bars)"""


def damaged(spark, sf):
    n = F.col("trades")
    return bars_1d(spark, sf).select(
        "series_id",
        "ts",
        "close_time",
        F.when(n % 13 != 0, F.col("open")).alias("open"),
        F.when(n % 5 == 0, F.col("low")).otherwise(F.col("high")).alias("high"),
        F.when(n % 7 == 0, F.col("high")).otherwise(F.col("low")).alias("low"),
        F.when(n % 11 == 0, -F.col("close")).otherwise(F.col("close")).alias("close"),
        "volume",
        "quote_volume",
        "trades",
        F.when(n % 17 == 0, F.col("volume") * 2).otherwise(F.col("taker_buy_base_volume")).alias("taker_buy_base_volume"),
        "taker_buy_quote_volume",
    )


def rules_sql(rules: dict[str, str]) -> str:
    return "\n UNION ALL ".join(
        f"SELECT series_id, '{name}' AS rule, coalesce(sum(({cond})::INT), 0) AS violations FROM g GROUP BY 1"
        for name, cond in rules.items()
    )


BAR_RULES = {
    "null_value": "open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR volume IS NULL OR quote_volume IS NULL "
    "OR trades IS NULL OR taker_buy_base_volume IS NULL OR taker_buy_quote_volume IS NULL",
    "close_before_open_time": "close_time < ts",
    "high_below_body": "high < greatest(open, close)",
    "low_above_body": "low > least(open, close)",
    "high_below_low": "high < low",
    "price_not_positive": "open <= 0 OR high <= 0 OR low <= 0 OR close <= 0",
    "size_negative": "volume < 0 OR quote_volume < 0 OR trades < 0 OR taker_buy_base_volume < 0 OR taker_buy_quote_volume < 0",
    "taker_above_total": "taker_buy_base_volume > volume OR taker_buy_quote_volume > quote_volume",
    "duplicate_time": "ts = before",
    "gap": "ts <> before AND ts - before <> INTERVAL 1 DAY",
}


@query(
    "bar_contract",
    "series_id rule violations:i",
    f"""{DAMAGED_SQL}, g AS (SELECT *, lag(ts) OVER (PARTITION BY series_id ORDER BY ts) AS before FROM d),
    t AS ({rules_sql(BAR_RULES)})""",
)
def _(spark, sf):
    return C.check_bars(damaged(spark, sf), BARS_1D)


@query(
    "gap_detector",
    "series_id ts previous:t gap_seconds:i",
    f"""{BARS_1H_SQL}, g AS (SELECT series_id, ts, lag(ts) OVER (PARTITION BY series_id ORDER BY ts) AS previous FROM bars),
    t AS (SELECT *, date_diff('second', previous, ts) AS gap_seconds FROM g WHERE ts - previous <> INTERVAL 1 HOUR)""",
)
def _(spark, sf):
    return C.gaps(bars_1h(spark, sf), BARS_1H)


REPAIR_SQL = f"""{DAMAGED_SQL}, r AS (SELECT *, (open IS NOT NULL AND high < greatest(open, close)) AS fh,
      (open IS NOT NULL AND low > least(open, close)) AS fl FROM d),
    s AS (SELECT *, CASE WHEN fh THEN greatest(open, close) ELSE high END AS h2,
      CASE WHEN fl THEN least(open, close) ELSE low END AS l2 FROM r),
    fixed AS (SELECT series_id, ts, open, CASE WHEN h2 < l2 THEN l2 ELSE h2 END AS high, l2 AS low, close,
      fh::INT AS fixed_high, fl::INT AS fixed_low FROM s WHERE open IS NOT NULL)"""


@query(
    "bar_repair",
    "series_id ts open:4 high:4 low:4 close:4 fixed_high:i fixed_low:i",
    f"{REPAIR_SQL}, t AS (SELECT * FROM fixed)",
)
def _(spark, sf):
    return C.repair_bars(damaged(spark, sf))


@query(
    "bar_repair_counts",
    "series_id rows:i fixed_high:i fixed_low:i",
    f"""{REPAIR_SQL}, t AS (SELECT series_id, count(*) AS rows, sum(fixed_high) AS fixed_high, sum(fixed_low) AS fixed_low FROM fixed GROUP BY 1)""",
)
def _(spark, sf):
    return C.repair_counts(C.repair_bars(damaged(spark, sf)), ["series_id"])


@query(
    "clean_intraday_bars",
    "series_id ts open:4 close:4 volume:4",
    f"""{BARS_4H_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS rn FROM bars),
    t AS (SELECT series_id, ts, open + 1 AS open, close, volume FROM k WHERE rn <= 100 AND ts >= TIMESTAMP '2024-01-15')""",
)
def _(spark, sf):
    bars = bars_4h(spark, sf)
    text = bars.withColumns({c: F.col(c).cast("string") for c in ("open", "close", "volume")}).withColumn("copy", F.lit(0))
    later = bars.withColumns({"open": (F.col("open") + 1).cast("string"), "close": F.col("close").cast("string"), "volume": F.col("volume").cast("string"), "copy": F.lit(1)})
    return C.clean_bars(text.unionByName(later), BARS_4H, "2024-01-15", 100, order="copy")


@query(
    "clean_derivatives",
    "series_id ts oi_binance:4 oi_aggregated:4 funding_oi_weighted:6 funding_vol_weighted:6",
    f"{DERIVATIVES_SQL}, t AS (SELECT series_id, ts, oi_binance + 1 AS oi_binance, oi_aggregated, funding_oi_weighted, funding_vol_weighted FROM deriv)",
)
def _(spark, sf):
    raw = derivatives(spark, sf)
    raw = raw.select("series_id", "ts", *[F.col(b).alias(a) for a, b in C.DERIVATIVE_NAMES.items()])
    later = raw.withColumn("oi__close", F.col("oi__close") + 1)
    both = raw.withColumn("copy", F.lit(0)).unionByName(later.withColumn("copy", F.lit(1)))
    return C.clean_derivatives(both, BARS_1D, "copy")


BOOK = ["bids_usd", "bids_quantity", "asks_usd", "asks_quantity"]


@query(
    "orderbook_contract",
    "series_id range rule violations:i",
    f"""{DEPTH_SQL}, g AS (SELECT series_id, range, ts, bids_usd, bids_quantity, CASE WHEN month(ts) = 3 THEN -asks_usd ELSE asks_usd END AS asks_usd, asks_quantity FROM depth
      UNION ALL SELECT series_id, range, ts, bids_usd, bids_quantity, asks_usd, asks_quantity FROM depth WHERE day(ts) = 5),
    c AS (SELECT series_id, range, ts, count(*) AS n FROM g GROUP BY 1, 2, 3),
    t AS (SELECT series_id, range, 'duplicate_time' AS rule, sum((n > 1)::INT) AS violations FROM c GROUP BY 1, 2
      {' '.join(f"UNION ALL SELECT series_id, range, 'negative_{b}', coalesce(sum(({b} < 0)::INT), 0) FROM g GROUP BY 1, 2 UNION ALL SELECT series_id, range, 'null_{b}', sum(({b} IS NULL)::INT) FROM g GROUP BY 1, 2" for b in BOOK)})""",
)
def _(spark, sf):
    d = depth(spark, sf)
    worse = d.withColumn("asks_usd", F.when(F.month("ts") == 3, -F.col("asks_usd")).otherwise(F.col("asks_usd")))
    return C.check_orderbook(worse.unionByName(d.filter(F.dayofmonth("ts") == 5)), BARS_1D.by("range"))


@query(
    "clean_index_series",
    "series_id ts value:6",
    f"{SLOW_1D_SQL}, t AS (SELECT 'idx' AS series_id, ts, CASE WHEN cnt % 4 = 0 THEN NULL ELSE value END AS value FROM slow)",
)
def _(spark, sf):
    s = slow_1d(spark, sf).withColumn("series_id", F.lit("idx"))
    text = s.withColumns({"value": F.when(F.col("cnt") % 4 == 0, "bad").otherwise(F.col("value").cast("string")), "copy": F.lit(1)})
    old = s.withColumns({"value": F.lit("1.0"), "copy": F.lit(0)})
    return C.clean_index(text.unionByName(old), BARS_1D, "copy")


@query(
    "clean_macro_values",
    "ts a:6 b:6",
    f"""{SLOW_1D_SQL}, m AS (SELECT ts, CASE WHEN cnt % 4 = 0 THEN NULL ELSE value END AS a, CASE WHEN cnt % 3 = 0 THEN NULL ELSE value * 2 END AS b FROM slow),
    t AS (SELECT * FROM m WHERE a IS NOT NULL OR b IS NOT NULL)""",
)
def _(spark, sf):
    s = slow_1d(spark, sf).select(
        F.col("ts").alias("date"),
        F.when(F.col("cnt") % 4 != 0, F.col("value")).alias("a"),
        F.when(F.col("cnt") % 3 == 0, ".").otherwise((F.col("value") * 2).cast("string")).alias("b"),
    )
    return C.clean_macro(s, ["a", "b"])


@query(
    "macro_contract",
    "series_id rule violations:i",
    f"""{BARS_1D_SQL}, m AS (SELECT series_id, date_trunc('month', ts) AS ts, CASE WHEN series_id <> '5-LOW' THEN close END AS value FROM bars),
    c AS (SELECT series_id, ts, count(*) AS n, count(value) AS v FROM m GROUP BY 1, 2),
    t AS (SELECT series_id, 'duplicate_time' AS rule, sum((n > 1)::INT) AS violations FROM c GROUP BY 1
      UNION ALL SELECT series_id, 'all_null_value', (sum(v) = 0)::INT FROM c GROUP BY 1)""",
)
def _(spark, sf):
    m = bars_1d(spark, sf).select(
        "series_id", F.date_trunc("month", "ts").alias("ts"), F.when(F.col("series_id") != "5-LOW", F.col("close")).alias("value")
    )
    return C.check_macro(m, BARS_1D, ["value"], forbid_all_null=True)


@query(
    "layer_reconciliation",
    "matched:i only_a:i only_b:i diff_close:2 diff_volume:2 verdict",
    f"""{BARS_1D_SQL}, a AS (SELECT * FROM bars WHERE trades % 19 <> 0),
    b AS (SELECT series_id, ts, CASE WHEN trades % 6 = 0 THEN close + 1 ELSE close END AS close, volume FROM bars WHERE trades % 23 <> 0),
    j AS (SELECT a.series_id AS ka, b.series_id AS kb, a.close AS ac, b.close AS bc, a.volume AS av, b.volume AS bv
      FROM a FULL JOIN b USING (series_id, ts)),
    t AS (SELECT sum((ka IS NOT NULL AND kb IS NOT NULL)::INT) AS matched, sum((kb IS NULL)::INT) AS only_a,
      sum((ka IS NULL)::INT) AS only_b, sum(abs(ac - bc)) AS diff_close, sum(abs(av - bv)) AS diff_volume, 'different' AS verdict FROM j)""",
)
def _(spark, sf):
    bars, n = bars_1d(spark, sf), F.col("trades")
    other = bars.filter(n % 23 != 0).withColumn("close", F.when(n % 6 == 0, F.col("close") + 1).otherwise(F.col("close")))
    return C.reconcile(bars.filter(n % 19 != 0), other, ["series_id", "ts"], ["close", "volume"])


@query(
    "freshness_status",
    "series_id max_days:i last_ts:t days_ago:1 status recent_nulls:1",
    f"""{BARS_1D_SQL}, s AS (SELECT series_id, ts, CASE WHEN trades % 2 = 0 THEN close END AS x FROM bars),
    n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS rn FROM s),
    l AS (SELECT series_id, max(ts) AS last_ts, sum((rn <= 5 AND x IS NULL)::INT) AS recent_nulls FROM n GROUP BY 1),
    e AS (SELECT DISTINCT o_orderpriority AS series_id, 5 AS max_days FROM orders UNION ALL SELECT DISTINCT 'x' || o_orderstatus, 9 FROM orders),
    t AS (SELECT e.series_id, max_days, last_ts, date_diff('day', last_ts, TIMESTAMP '2001-08-05') AS days_ago, recent_nulls,
      CASE WHEN last_ts IS NULL THEN 'MISSING' WHEN date_diff('day', last_ts, TIMESTAMP '2001-08-05') <= max_days THEN 'FRESH' ELSE 'STALE' END AS status
      FROM e LEFT JOIN l USING (series_id))""",
)
def _(spark, sf):
    bars = bars_1d(spark, sf).withColumn("x", F.when(F.col("trades") % 2 == 0, F.col("close")))
    o = spark.read.parquet(f"{sf}/orders.parquet")
    expected = (
        o.select(F.col("o_orderpriority").alias("series_id"), F.lit(5).alias("max_days")).distinct()
        .unionByName(o.select(F.concat(F.lit("x"), "o_orderstatus").alias("series_id"), F.lit(9).alias("max_days")).distinct())
    )
    return C.freshness(bars, expected, "2001-08-05", "x", BARS_1D)


@query(
    "coverage_audit",
    "series_id start:t until:t rows:i late_days:i verdict",
    f"""{BARS_1D_SQL}, s AS (SELECT series_id, min(ts) AS start, max(ts) AS until, count(*) AS rows FROM bars GROUP BY 1),
    n AS (SELECT DISTINCT o_orderpriority AS series_id, CASE WHEN o_orderpriority = '1-URGENT' THEN TIMESTAMP '1995-01-01' ELSE TIMESTAMP '1990-01-01' END AS nat FROM orders),
    l AS (SELECT *, date_diff('day', greatest(TIMESTAMP '1994-11-15', nat), start) AS late_days FROM s JOIN n USING (series_id)),
    t AS (SELECT *, CASE WHEN late_days <= 5 THEN 'ok' WHEN late_days <= 90 THEN 'warn' ELSE 'bad' END AS verdict FROM l)""",
)
def _(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    natural = F.when(F.col("o_orderpriority") == "1-URGENT", "1995-01-01").otherwise("1990-01-01").cast("timestamp")
    targets = o.select(F.col("o_orderpriority").alias("series_id"), natural.alias("natural_start")).distinct()
    return C.coverage(bars_1d(spark, sf), targets, "1994-11-15", BARS_1D)


@query(
    "column_completeness",
    "series_id rows:i feature non_null:i share:6 low:i",
    f"""{DAMAGED_SQL}, t AS (SELECT series_id, count(*) AS rows, 'open' AS feature, count(open) AS non_null, count(open) / count(*) AS share, (count(open) / count(*) < 0.95)::INT AS low FROM d GROUP BY 1
      UNION ALL SELECT series_id, count(*), 'close', count(close), count(close) / count(*), (count(close) / count(*) < 0.95)::INT FROM d GROUP BY 1)""",
)
def _(spark, sf):
    return C.completeness(damaged(spark, sf), ["open", "close"], ["series_id"])


@query(
    "burnin_and_slice",
    "series_id ts open:4",
    f"{DAMAGED_SQL}, t AS (SELECT * FROM d WHERE open IS NOT NULL AND ts BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31')",
)
def _(spark, sf):
    return C.slice_time(C.drop_burnin(damaged(spark, sf), ["open"]), "ts", "1995-01-01", "1996-12-31")


FEATURE_CONFIG = {
    "assets": {"click": ["ret", "vol"], "view": ["ret"]},
    "indices": {"view": ["vol"], "purchase": ["vol", "other"]},
}


@query(
    "feature_projection",
    "series_id feature rows:i known_asset:i",
    """f AS (SELECT upper(event_type) || 'USDT' AS series_id, CASE WHEN event_id % 3 = 0 THEN 'ret' WHEN event_id % 3 = 1 THEN 'vol' ELSE 'other' END AS feature FROM events),
    k AS (SELECT *, regexp_replace(trim(lower(series_id)), 'usdt$', '') AS a FROM f),
    p AS (SELECT *, a IN ('click', 'view', 'purchase') AS known_asset,
      (a = 'click' AND feature IN ('ret', 'vol')) OR (a = 'view' AND feature = 'ret') OR (a = 'purchase' AND feature IN ('vol', 'other')) AS ok FROM k),
    t AS (SELECT series_id, feature, known_asset, count(*) AS rows FROM p WHERE ok OR NOT known_asset GROUP BY 1, 2, 3)""",
)
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    k = F.col("event_id") % 3
    long = e.select(
        F.concat(F.upper("event_type"), F.lit("USDT")).alias("series_id"),
        F.when(k == 0, "ret").when(k == 1, "vol").otherwise("other").alias("feature"),
    )
    out = C.allowed_features(long, FEATURE_CONFIG)
    return out.groupBy("series_id", "feature", "known_asset").agg(F.count(F.lit(1)).alias("rows"))


WIDE_CONFIG = {"assets": {"1-urgent": ["close", "volume"]}, "indices": {"1-urgent": ["open"], "5-low": ["high", "trades"]}}


@query(
    "wide_projection",
    "asset series_id ts a:4 b:4",
    f"""{BARS_1D_SQL}, t AS (SELECT '1-URGENT' AS asset, series_id, ts, close AS a, volume AS b FROM bars WHERE series_id = '1-URGENT'
      UNION ALL SELECT '5-LOWUSDT', series_id, ts, high, trades FROM bars WHERE series_id = '5-LOW')""",
)
def _(spark, sf):
    """Each asset's configured columns of the wide table, under common names; assets win over indices."""
    bars = bars_1d(spark, sf)

    def of(asset: str, series: str):
        own = C.select_features(bars.filter(F.col("series_id") == series), WIDE_CONFIG, asset)
        a, b = own.columns[2:]
        return own.select(F.lit(asset).alias("asset"), "series_id", "ts", F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))

    return of("1-URGENT", "1-URGENT").unionByName(of("5-LOWUSDT", "5-LOW"))


FAMILIES = [
    {"name": "alpha", "source": "F", "categories": ["1-URGENT", "2-HIGH"], "features": {"ret": ["r1", "r5"], "vol": ["v7"]}},
    {"name": "beta", "source": "O", "categories": ["1-URGENT", "3-MEDIUM"], "features": {"z": ["z30"]}},
    {"name": "gamma", "source": "O", "categories": ["3-MEDIUM"], "features": {"z": ["z90"]}},
]


@query(
    "family_resolution",
    "source category matches:i family n_features:1",
    """a AS (SELECT DISTINCT o_orderstatus AS source, o_orderpriority AS category FROM orders),
    f AS (SELECT * FROM (VALUES ('alpha', 'F', '1-URGENT', 3), ('alpha', 'F', '2-HIGH', 3), ('beta', 'O', '1-URGENT', 1), ('beta', 'O', '3-MEDIUM', 1), ('gamma', 'O', '3-MEDIUM', 1)) v(family, source, category, n)),
    t AS (SELECT a.source, a.category, count(family) AS matches, CASE WHEN count(family) = 1 THEN max(family) END AS family,
      CASE WHEN count(family) = 1 THEN max(n) END AS n_features FROM a LEFT JOIN f ON a.source = f.source AND a.category = f.category GROUP BY 1, 2)""",
)
def _(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    assets = o.select(F.col("o_orderstatus").alias("source"), F.col("o_orderpriority").alias("category")).distinct()
    out = C.resolve_family(assets, FAMILIES)
    return out.withColumn("n_features", F.when(F.col("features").isNotNull(), F.size("features")))


@query(
    "safe_division_and_clip",
    "series_id ts ratio:6 clipped:6",
    f"""{BARS_4H_SQL}, t AS (SELECT series_id, ts, volume / nullif(taker_buy_base_volume, 0) AS ratio,
      CASE WHEN volume / nullif(taker_buy_base_volume, 0) IS NOT NULL THEN least(greatest(volume / nullif(taker_buy_base_volume, 0), 1.5), 3.0) END AS clipped FROM bars)""",
)
def _(spark, sf):
    ratio = safe_div("volume", "taker_buy_base_volume")
    return bars_4h(spark, sf).withColumns({"ratio": ratio, "clipped": clip(ratio, 1.5, 3.0)})


@query(
    "probability_sanity",
    "series_id rows:i null_entropy:i out_of_range:i corr_with_top:6",
    f"""{BARS_4H_SQL}, p AS (SELECT series_id, taker_buy_quote_volume / quote_volume AS p FROM bars),
    k AS (SELECT *, greatest(least(p, 1 - 1e-10), 1e-10) AS a, greatest(least(1 - p, 1 - 1e-10), 1e-10) AS b FROM p),
    e AS (SELECT series_id, greatest(p, 1 - p) AS top, -(a * log2(a) + b * log2(b)) AS e FROM k),
    t AS (SELECT series_id, count(*) AS rows, count(*) - count(e) AS null_entropy, sum((e < 0 OR e > 1 + 1e-9)::INT) AS out_of_range,
      corr(e, top) AS corr_with_top FROM e GROUP BY 1)""",
)
def _(spark, sf):
    p = F.col("p")
    df = bars_4h(spark, sf).withColumn("p", buy_pressure("taker_buy_quote_volume", "quote_volume"))
    df = df.withColumns({"q": 1 - p, "e": entropy2(p, 1 - p)})
    return C.check_probs(df, ["p", "q"], "e", ["series_id"])


@query(
    "probability_difference",
    "p:6 q:6",
    f"""{BARS_4H_SQL}, a AS (SELECT series_id, ts, taker_buy_quote_volume / quote_volume AS p FROM bars),
    b AS (SELECT series_id, ts, taker_buy_base_volume / volume AS p, avg(taker_buy_base_volume / volume) OVER (PARTITION BY series_id ORDER BY ts ROWS 2 PRECEDING) AS m FROM bars),
    t AS (SELECT max(abs(a.p - b.p)) AS p, max(abs(1 - a.p - (1 - m))) AS q FROM a LEFT JOIN b USING (series_id, ts))""",
)
def _(spark, sf):
    """The largest difference between two tables of probabilities: of the bars, and of their three-bar means."""
    bars = bars_4h(spark, sf)
    one = bars.select("series_id", "ts", F.try_divide("taker_buy_quote_volume", "quote_volume").alias("p")).withColumn("q", 1 - F.col("p"))
    other = bars.select("series_id", "ts", F.try_divide("taker_buy_base_volume", "volume").alias("p"))
    other = over_series(other, BARS_4H, {"_m": R.roll_mean("p", 3, 1)}).select("series_id", "ts", "p", (1 - F.col("_m")).alias("q"))
    return C.max_abs_difference(one, other, ["series_id", "ts"], ["p", "q"])
