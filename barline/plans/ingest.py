"""Queries over sources, payload shaping and incremental refresh."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.operators.resample import daily_snap
from barline.operators.fill import repair_quotes
from barline.plans.adapters import (
    BARS_1D,
    BARS_1D_SQL,
    BARS_1H,
    BARS_1H_SQL,
    BARS_4H,
    BARS_4H_SQL,
    NEWS_SQL,
    SLOW_1D_SQL,
    bars_1d,
    bars_1h,
    bars_4h,
    news,
    slow_1d,
    table,
    ticks,
)
from barline.plans.registry import query
from barline.session import shared_dir
from barline.sources import series_io, shaping, upsert as U


@query("series_store", "series_id ts open:4 close:4 volume:4 trades:i", f"{BARS_4H_SQL}, t AS (SELECT * FROM bars)")
def _(spark, sf):
    path = shared_dir(spark, "series_store")
    series_io.write_series(bars_4h(spark, sf), path, BARS_4H)
    return series_io.read_series(spark, path)


@query(
    "bar_csv",
    "series_id ts close_time open:4 high:4 low:4 close:4 volume:4 trades:i",
    f"{BARS_1H_SQL}, t AS (SELECT * FROM bars)",
)
def _(spark, sf):
    path = shared_dir(spark, "bar_csv")
    bars = bars_1h(spark, sf)
    lines = bars.select(
        "series_id",
        F.concat_ws(
            ",",
            F.unix_micros("ts"),
            *["open", "high", "low", "close", "volume"],
            F.unix_micros("close_time"),
            *["quote_volume", "trades", "taker_buy_base_volume", "taker_buy_quote_volume"],
            F.lit("0"),
        ).alias("value"),
    )
    headers = bars.select("series_id", F.lit(",".join(series_io.BAR_CSV_FIELDS)).alias("value")).distinct()
    lines.union(headers).write.partitionBy("series_id").text(path)
    return series_io.read_bar_csv(spark, f"{path}/*/*.txt")


@query(
    "flatten_records",
    "series_id ts px__close:4 px__alt:4",
    """r AS (SELECT event_type AS series_id, event_id, 0 AS pos, epoch_us(ts::TIMESTAMP) // 1000 AS ms, value AS c, NULL AS a FROM events
      UNION ALL SELECT event_type, event_id, 1, epoch_us(ts::TIMESTAMP) // 1000 + 60000, value * 2, value / 2 FROM events),
    k AS (SELECT *, row_number() OVER (PARTITION BY series_id, ms ORDER BY event_id DESC, pos DESC) AS rn FROM r),
    t AS (SELECT series_id, epoch_ms(ms) AS ts, c AS px__close, a AS px__alt FROM k WHERE rn = 1)""",
)
def _(spark, sf):
    ms = F.unix_millis("ts")

    def record(at, c, a):
        return F.struct(at.alias("time"), c.cast("string").alias("close"), a.alias("alt"))

    v = F.col("value")
    payload = F.to_json(F.array(record(ms, v, F.lit("n/a")), record(ms + 60000, v * 2, (v / 2).cast("string"))))
    df = ticks(spark, sf).select("series_id", "event_id", payload.alias("payload"))
    return shaping.flatten_records(df, "payload", {"close": "close", "alt": "alt"}, "px", ["series_id"], order="event_id")


@query(
    "zip_arrays",
    "o_orderkey day:t price:4",
    """t AS (SELECT o_orderkey, o_orderdate::TIMESTAMP AS day, o_totalprice AS price FROM orders
      UNION ALL SELECT o_orderkey, o_orderdate::TIMESTAMP + INTERVAL 1 DAY, o_totalprice * 2 FROM orders)""",
)
def _(spark, sf):
    d = F.col("o_orderdate").cast("timestamp")
    o = table(spark, sf, "orders").select(
        "o_orderkey",
        F.array(d, d + F.expr("INTERVAL 1 DAY")).alias("day"),
        F.array(F.col("o_totalprice"), F.col("o_totalprice") * 2).alias("price"),
    )
    return shaping.zip_arrays(o, ["day", "price"], ["o_orderkey"])


@query(
    "map_arrays_to_wide",
    "ts f:4 o:4 total:4 total_nullable:4",
    """r AS (SELECT o_orderdate::TIMESTAMP AS ts, 'f' AS name, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS v FROM orders
      UNION ALL SELECT o_orderdate::TIMESTAMP + INTERVAL 1 DAY, 'f', CASE WHEN o_orderstatus = 'P' THEN o_totalprice END FROM orders
      UNION ALL SELECT o_orderdate::TIMESTAMP, 'o', CASE WHEN o_orderstatus = 'O' THEN o_totalprice END FROM orders
      UNION ALL SELECT o_orderdate::TIMESTAMP + INTERVAL 1 DAY, 'o', NULL FROM orders),
    w AS (SELECT ts, sum(v) FILTER (WHERE name = 'f') AS f, sum(v) FILTER (WHERE name = 'o') AS o FROM r
      WHERE ts <= TIMESTAMP '1998-01-01' GROUP BY 1),
    t AS (SELECT *, coalesce(f, 0) + coalesce(o, 0) AS total,
      CASE WHEN f IS NOT NULL OR o IS NOT NULL THEN coalesce(f, 0) + coalesce(o, 0) END AS total_nullable FROM w)""",
)
def _(spark, sf):
    d, p, s = F.col("o_orderdate").cast("timestamp"), F.col("o_totalprice"), F.col("o_orderstatus")
    nothing = F.lit(None).cast("double")
    o = table(spark, sf, "orders").select(
        F.array(d, d + F.expr("INTERVAL 1 DAY")).alias("dates"),
        F.create_map(
            F.lit("f"), F.array(F.when(s == "F", p), F.when(s == "P", p)), F.lit("o"), F.array(F.when(s == "O", p), nothing)
        ).alias("m"),
    )
    wide = shaping.map_arrays_to_wide(o, "dates", "m", ["f", "o"], until="1998-01-01")
    from barline.functions.mathx import row_sum

    return wide.withColumn("total_nullable", row_sum(["f", "o"], need_any=True))


@query(
    "explode_pivot",
    "ts F:4 O:4 P:4 total:4",
    """t AS (SELECT o_orderdate::TIMESTAMP AS ts, sum(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS F,
      sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS O, sum(o_totalprice) FILTER (WHERE o_orderstatus = 'P') AS P,
      sum(o_totalprice) + sum(1.0) AS total FROM orders GROUP BY 1)""",
)
def _(spark, sf):
    flow = F.struct(F.col("o_orderstatus").alias("ticker"), F.col("o_totalprice").alias("usd"))
    fee = F.struct(F.lit("fee").alias("ticker"), F.lit(1.0).alias("usd"))
    o = table(spark, sf, "orders").select(F.col("o_orderdate").cast("timestamp").alias("ts"), F.array(flow, fee).alias("flows"))
    return shaping.explode_pivot(o, "flows", "ts", "ticker", "usd", ["F", "O", "P"])


@query(
    "consolidate_entities",
    "ts click:4 purchase:4 view:4 total:4",
    f"""{BARS_1H_SQL}, w AS (SELECT ts, sum(volume) FILTER (WHERE series_id = 'click') AS click,
      sum(volume) FILTER (WHERE series_id = 'purchase') AS purchase, sum(volume) FILTER (WHERE series_id = 'view') AS view
      FROM bars GROUP BY 1),
    t AS (SELECT *, CASE WHEN coalesce(click, purchase, view) IS NOT NULL
      THEN coalesce(click, 0) + coalesce(purchase, 0) + coalesce(view, 0) END AS total FROM w)""",
)
def _(spark, sf):
    return shaping.consolidate(bars_1h(spark, sf), "ts", "series_id", "volume", ["click", "purchase", "view"])


@query(
    "parse_epoch",
    "event_id a:t b:t c:t d:t",
    """t AS (SELECT event_id, epoch_ms(epoch_us(ts::TIMESTAMP) // 1000) AS a, date_trunc('second', ts::TIMESTAMP) AS b,
      date_trunc('second', ts::TIMESTAMP) AS c, date_trunc('day', ts::TIMESTAMP) AS d FROM events)""",
)
def _(spark, sf):
    t = F.col("ts")
    return ticks(spark, sf).select(
        "event_id",
        shaping.parse_epoch(F.unix_millis(t)).alias("a"),
        shaping.parse_epoch(F.unix_seconds(t)).alias("b"),
        shaping.parse_epoch(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("c"),
        shaping.parse_epoch(F.unix_millis(t), "day").alias("d"),
    )


@query(
    "numeric_coercion",
    "event_id user_text:2 props_number:2",
    """t AS (SELECT event_id, user_id::DOUBLE AS user_text, TRY_CAST(CASE WHEN user_id % 3 = 0 THEN 'n/a' ELSE value::VARCHAR END AS DOUBLE) AS props_number FROM events)""",
)
def _(spark, sf):
    df = ticks(spark, sf).select(
        "event_id",
        F.col("user_id").cast("string").alias("user_text"),
        F.when(F.col("user_id") % 3 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("props_number"),
    )
    return shaping.coerce_double(df, ["user_text", "props_number"])


@query(
    "fetch_cursor",
    "series_id next_start:t up_to_date:i",
    """e AS (SELECT event_type AS series_id, max(ts::TIMESTAMP) AS last FROM events WHERE event_type <> 'view' GROUP BY 1),
    s AS (SELECT DISTINCT event_type AS series_id FROM events),
    t AS (SELECT series_id, coalesce(last + INTERVAL 1 MILLISECOND, TIMESTAMP '2023-01-01') AS next_start,
      coalesce((last + INTERVAL 1 HOUR > TIMESTAMP '2024-01-31')::INT, 0) AS up_to_date FROM s LEFT JOIN e USING (series_id))""",
)
def _(spark, sf):
    t = ticks(spark, sf)
    return U.high_watermark(t.filter(F.col("series_id") != "view"), t, "2023-01-01", "2024-01-31", step=3600)


def day_of(c):
    return F.date_trunc("day", c)


OLD_NEW_SQL = """o AS (SELECT event_type AS series_id, time_bucket(INTERVAL 4 HOUR, ts) AS ts, value, event_id, 0 AS batch
      FROM events WHERE ts < TIMESTAMP '2024-01-20'
      UNION ALL SELECT event_type, time_bucket(INTERVAL 4 HOUR, ts), CASE WHEN event_id % 11 = 0 THEN NULL ELSE -value END, event_id, 1
      FROM events WHERE ts >= TIMESTAMP '2024-01-15'),
    k AS (SELECT *, row_number() OVER (PARTITION BY series_id, ts ORDER BY batch DESC, event_id DESC) AS rn FROM o)"""


def old_and_new(spark, sf):
    t = ticks(spark, sf)
    from barline.operators.resample import bucket_start

    slot = bucket_start("ts", 4 * 3600)
    old = t.filter(F.col("ts") < F.lit("2024-01-20").cast("timestamp")).select("series_id", slot.alias("ts"), "value", "event_id")
    new = t.filter(F.col("ts") >= F.lit("2024-01-15").cast("timestamp")).select(
        "series_id", slot.alias("ts"), F.when(F.col("event_id") % 11 != 0, -F.col("value")).alias("value"), "event_id"
    )
    return old, new


@query(
    "upsert_keep_last",
    "series_id ts value:4 event_id:i",
    f"{OLD_NEW_SQL}, t AS (SELECT series_id, ts, value, event_id FROM k WHERE rn = 1)",
)
def _(spark, sf):
    old, new = old_and_new(spark, sf)
    return U.upsert(old, new, ["series_id", "ts"], order=["event_id"])


@query(
    "upsert_drop_null_value",
    "series_id ts value:4",
    f"{OLD_NEW_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY series_id, ts ORDER BY batch DESC, event_id DESC) AS pos FROM o WHERE value IS NOT NULL), t AS (SELECT series_id, ts, value FROM f WHERE pos = 1)",
)
def _(spark, sf):
    old, new = old_and_new(spark, sf)
    return U.upsert(old, new, ["series_id", "ts"], drop_null=["value"], order=["event_id"])


@query(
    "upsert_drop_empty_bars",
    "series_id ts open:4 close:4",
    f"""{BARS_4H_SQL}, b AS (SELECT series_id, ts, open, close, 0 AS batch FROM bars
      UNION ALL SELECT series_id, ts, CASE WHEN trades % 3 = 0 THEN NULL ELSE open END,
        CASE WHEN trades % 3 = 0 OR trades % 5 = 0 THEN NULL ELSE close END, 1 FROM bars WHERE ts >= TIMESTAMP '2024-01-10'),
    k AS (SELECT *, row_number() OVER (PARTITION BY series_id, ts ORDER BY batch DESC) AS rn FROM b WHERE open IS NOT NULL OR close IS NOT NULL),
    t AS (SELECT series_id, ts, open, close FROM k WHERE rn = 1)""",
)
def _(spark, sf):
    bars = bars_4h(spark, sf)
    n = F.col("trades")
    new = bars.filter(F.col("ts") >= F.lit("2024-01-10").cast("timestamp")).select(
        "series_id",
        "ts",
        F.when(n % 3 != 0, F.col("open")).alias("open"),
        F.when((n % 3 != 0) & (n % 5 != 0), F.col("close")).alias("close"),
    )
    return U.upsert(bars.select(*new.columns), new, ["series_id", "ts"], drop_all_null=["open", "close"])


@query(
    "outer_merge",
    "series_id ts volume:4 value:4 cnt:2",
    f"""{BARS_1D_SQL}, {SLOW_1D_SQL}, a AS (SELECT series_id, ts, volume FROM bars),
    b AS (SELECT series_id, ts, close AS value FROM bars),
    c AS (SELECT series_id, ts, trades AS cnt FROM bars),
    t AS (SELECT series_id, ts, a.volume, b.value, c.cnt FROM a FULL JOIN b USING (series_id, ts) FULL JOIN c USING (series_id, ts))""",
)
def _(spark, sf):
    bars = bars_1d(spark, sf)
    return U.outer_merge(
        [
            bars.select("series_id", "ts", "volume"),
            bars.select("series_id", "ts", F.col("close").alias("value")),
            bars.select("series_id", "ts", F.col("trades").alias("cnt")),
        ],
        ["series_id", "ts"],
    )


@query(
    "novelty_filter",
    "id:i title_hash",
    f"""{NEWS_SQL}, h AS (SELECT id, sha1(trim(regexp_replace(lower(title), '[^a-z0-9 ]', '', 'g'))) AS title_hash, published_at FROM news),
    t AS (SELECT id, title_hash FROM h n WHERE n.id % 2 = 1
      AND NOT EXISTS (SELECT 1 FROM h o WHERE o.id % 2 = 0 AND o.title_hash = n.title_hash))""",
)
def _(spark, sf):
    from barline.functions.text import title_hash

    n = news(spark, sf).select("id", title_hash("title").alias("title_hash"))
    return U.anti_new(n.filter(F.col("id") % 2 == 1), n.filter(F.col("id") % 2 == 0), ["title_hash"])


@query(
    "retention",
    "id:i published_at:t",
    f"{NEWS_SQL}, t AS (SELECT id, published_at FROM news WHERE published_at >= TIMESTAMP '2024-01-30 03:00:00' - INTERVAL 29 DAY)",
)
def _(spark, sf):
    return U.retain(news(spark, sf), "published_at", "2024-01-30 03:00:00", 29)


@query(
    "closed_bars",
    "series_id ts close:4",
    f"{BARS_1H_SQL}, t AS (SELECT * FROM bars WHERE ts < TIMESTAMP '2024-01-20 13:00:00')",
)
def _(spark, sf):
    return U.closed_bars(bars_1h(spark, sf), "ts", "2024-01-20 13:47:11", 3600)


@query(
    "infer_frequency",
    "series_id rows:i median_gap:4 frequency",
    f"""{BARS_1D_SQL}, s AS (SELECT series_id, ts FROM bars
      UNION ALL SELECT series_id || '/weekly', ts FROM (SELECT DISTINCT series_id, date_trunc('week', ts) AS ts FROM bars)
      UNION ALL SELECT series_id || '/monthly', ts FROM (SELECT DISTINCT series_id, date_trunc('month', ts) AS ts FROM bars)),
    g AS (SELECT series_id, date_diff('day', lag(ts) OVER (PARTITION BY series_id ORDER BY ts), ts) AS gap FROM s),
    m AS (SELECT series_id, count(*) AS rows, median(gap) AS median_gap FROM g GROUP BY 1),
    t AS (SELECT *, CASE WHEN rows < 3 OR median_gap <= 2 THEN 'daily' WHEN median_gap BETWEEN 5 AND 10 THEN 'weekly' ELSE 'monthly' END AS frequency FROM m)""",
)
def _(spark, sf):
    bars = bars_1d(spark, sf).select("series_id", "ts")

    def coarser(unit: str, name: str):
        return bars.select(F.concat("series_id", F.lit(name)).alias("series_id"), F.date_trunc(unit, "ts").alias("ts")).distinct()

    return U.infer_frequency(U.concat([bars, coarser("week", "/weekly"), coarser("month", "/monthly")]), BARS_1D)


@query(
    "temporal_contract",
    "series_id rows:i modal_gap:i ok:i",
    f"""{BARS_1D_SQL}, s AS (SELECT series_id, ts FROM bars WHERE ts >= TIMESTAMP '1996-01-01'),
    g AS (SELECT series_id, date_diff('day', lag(ts) OVER (PARTITION BY series_id ORDER BY ts), ts) AS gap FROM s),
    c AS (SELECT series_id, gap, count(*) AS n FROM g GROUP BY 1, 2),
    t AS (SELECT series_id, sum(n) AS rows, first(gap ORDER BY gap IS NULL, n DESC, gap) AS modal_gap,
      (first(gap ORDER BY gap IS NULL, n DESC, gap) = 1)::INT AS ok FROM c GROUP BY 1)""",
)
def _(spark, sf):
    return U.temporal_contract(bars_1d(spark, sf), BARS_1D, "1996-01-01")


@query(
    "coalesce_case_columns",
    "series_id ts close:4 volume:4",
    f"""{BARS_1D_SQL}, t AS (SELECT series_id, ts, coalesce(CASE WHEN trades % 2 = 0 THEN close END, open) AS close, high AS volume FROM bars)""",
)
def _(spark, sf):
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        df = bars_1d(spark, sf).select(
            "series_id",
            "ts",
            F.when(F.col("trades") % 2 == 0, F.col("close")).alias("close"),
            F.col("open").alias("Close"),
            F.col("high").alias("Volume"),
        )
        return shaping.coalesce_case(df, ["close", "volume"])
    finally:
        spark.conf.set("spark.sql.caseSensitive", "false")


BAD_QUOTES = "CASE WHEN trades % 3 = 0 THEN 0.0 WHEN trades % 5 = 0 THEN NULL WHEN trades % 7 = 0 THEN -close ELSE close END"


@query(
    "repair_quotes",
    "series_id ts forward:4 filled:4",
    f"""{BARS_1D_SQL}, q AS (SELECT series_id, ts, {BAD_QUOTES} AS q FROM bars),
    g AS (SELECT *, CASE WHEN q > 0 THEN q END AS good FROM q),
    f AS (SELECT *, last_value(good IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts) AS forward FROM g),
    t AS (SELECT series_id, ts, forward, coalesce(forward, first_value(forward IGNORE NULLS) OVER
      (PARTITION BY series_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM f)""",
)
def _(spark, sf):
    df = bars_1d(spark, sf).withColumn("forward", F.expr(BAD_QUOTES)).withColumn("filled", F.expr(BAD_QUOTES))
    return repair_quotes(repair_quotes(df, BARS_1D, ["forward"]), BARS_1D, ["filled"], backfill=True)


@query(
    "daily_snap",
    "series_id ts value:4 user_id:i",
    """t AS (SELECT event_type AS series_id, date_trunc('day', ts::TIMESTAMP) AS ts, last(value ORDER BY ts, event_id) AS value,
      last(user_id ORDER BY ts, event_id) AS user_id FROM events GROUP BY 1, date_trunc('day', ts::TIMESTAMP))""",
)
def _(spark, sf):
    return daily_snap(ticks(spark, sf), "ts", ["value", "user_id"], tie="event_id")


@query(
    "dedupe_keep_last",
    "series_id user_id:i ts event_id:i value:4",
    """k AS (SELECT event_type AS series_id, user_id, ts::TIMESTAMP AS ts, event_id, value,
      row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events),
    t AS (SELECT * FROM k WHERE rn = 1)""",
)
def _(spark, sf):
    return U.dedupe_last(ticks(spark, sf), ["series_id", "user_id"], ["ts", "event_id"])


@query(
    "tail_rows",
    "series_id ts close:4",
    f"""{BARS_1H_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts DESC) AS rn FROM bars),
    t AS (SELECT * FROM k WHERE rn <= 180 AND ts >= TIMESTAMP '2024-01-24')""",
)
def _(spark, sf):
    return U.tail_n(bars_1h(spark, sf), BARS_1H, 180, "2024-01-24")


@query(
    "concat_by_name",
    "series_id ts close:6 extra:6",
    f"""{BARS_1D_SQL}, {SLOW_1D_SQL}, t AS (SELECT series_id, ts, close, NULL::DOUBLE AS extra FROM bars
      UNION ALL SELECT 'slow', ts, value, cnt::DOUBLE FROM slow)""",
)
def _(spark, sf):
    s = slow_1d(spark, sf).select(
        F.col("cnt").cast("double").alias("extra"), F.col("value").alias("close"), "ts", F.lit("slow").alias("series_id")
    )
    return U.concat([bars_1d(spark, sf).select("series_id", "ts", "close"), s])


@query(
    "missing_keys",
    "l_partkey:i l_suppkey:i",
    """t AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem a WHERE NOT EXISTS
      (SELECT 1 FROM lineitem b WHERE b.l_returnflag = 'R' AND a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey))""",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    return U.missing(li, li.filter(F.col("l_returnflag") == "R"), ["l_partkey", "l_suppkey"])


