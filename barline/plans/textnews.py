"""Queries over titles, sources and news metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.functions import text as T
from barline.operators import news as N
from barline.plans.adapters import BARS_1D_SQL, NEWS_SQL, bars_1d, news, table
from barline.plans.registry import query

ASOF = "2024-01-01 02:30:00"
GROUPS = ["en", "de", "fr", "es", "zz"]

NORM = "trim(regexp_replace(lower({c}), '[^a-z0-9 ]', '', 'g'))"
WEIGHT_SQL = "CASE " + " ".join(f"WHEN contains(lower(source), '{k}') THEN {w}" for k, w in T.SOURCE_WEIGHTS.items()) + " ELSE 0.5 END"


@query(
    "title_normalisation",
    "id:i norm title_hash relevant:i",
    f"""{NEWS_SQL}, t AS (SELECT id, {NORM.format(c='title')} AS norm, sha1({NORM.format(c='title')}) AS title_hash,
      ({' OR '.join(f"contains(lower(title), '{k}')" for k in T.RELEVANCE_KEYWORDS)})::INT AS relevant FROM news)""",
)
def _(spark, sf):
    return news(spark, sf).select(
        "id", T.norm_title("title").alias("norm"), T.title_hash("title").alias("title_hash"), T.matches_any("title").alias("relevant")
    )


OUTLETS = ["Reuters US", "Bloomberg", "The Wall Street Journal", "Microsoft blog", "Yahoo Finance", "Yahoo", "CoinDesk", "local paper", "CNN"]


def with_outlet(df):
    names = F.array(*map(F.lit, OUTLETS))
    return df.withColumn("source", F.element_at(names, (F.col("id") % len(OUTLETS) + 1).cast("int")))


OUTLET_SQL = f"{NEWS_SQL}, nw AS (SELECT * REPLACE ([{', '.join(repr(o) for o in OUTLETS)}][id % {len(OUTLETS)} + 1] AS source) FROM news)"


@query(
    "source_weights",
    "source weight:3 n:i",
    f"{OUTLET_SQL}, t AS (SELECT source, {WEIGHT_SQL} AS weight, count(*) AS n FROM nw GROUP BY 1, 2)",
)
def _(spark, sf):
    df = with_outlet(news(spark, sf)).withColumn("weight", T.source_weight("source"))
    return df.groupBy("source", "weight").agg(F.count(F.lit(1)).alias("n"))


@query(
    "key_functions",
    "c_custkey:i asset part short:i starts:i",
    """c AS (SELECT c_custkey, ' ' || upper(substring(c_mktsegment, 1, 3)) || 'USDT ' AS raw, c_mktsegment || '_r' || (c_custkey % 3)::VARCHAR AS k FROM customer),
    t AS (SELECT c_custkey, regexp_replace(trim(lower(raw)), 'usdt$', '') AS asset, split_part(k, '_', -1) AS part, length(substring(k, 1, 5)) AS short, starts_with(k, 'BUILD')::INT AS starts FROM c)""",
)
def _(spark, sf):
    from barline.operators.contracts import norm_asset

    c = table(spark, sf, "customer").select(
        "c_custkey",
        F.concat(F.lit(" "), F.upper(F.substring("c_mktsegment", 1, 3)), F.lit("USDT ")).alias("raw"),
        F.concat("c_mktsegment", F.lit("_r"), (F.col("c_custkey") % 3).cast("string")).alias("k"),
    )
    return c.select(
        "c_custkey",
        norm_asset("raw").alias("asset"),
        T.suffix("k").alias("part"),
        F.length(F.substring("k", 1, 5)).alias("short"),
        F.startswith(F.col("k"), F.lit("BUILD")).alias("starts"),
    )


@query(
    "date_and_math_functions",
    "series_id ts dow:i month:i day:i period next_day:t age:i l2:6 l1p:6 root:6 sgn:1 arc:6",
    f"""{BARS_1D_SQL}, t AS (SELECT series_id, ts, isodow(ts) - 1 AS dow, month(ts) AS month, day(ts) AS day, strftime(ts, '%Y-%m') AS period, ts + INTERVAL 1 DAY AS next_day,
      date_diff('day', ts, TIMESTAMP '2002-01-01') AS age, log2(close) AS l2, ln(1 + close) AS l1p, sqrt(close) AS root, sign(close - open) AS sgn, atanh(least(low / high, 0.999)) AS arc FROM bars)""",
)
def _(spark, sf):
    t, c = F.col("ts"), F.col("close")
    return bars_1d(spark, sf).select(
        "series_id",
        "ts",
        F.weekday(t).alias("dow"),
        F.month(t).alias("month"),
        F.dayofmonth(t).alias("day"),
        F.date_format(t, "yyyy-MM").alias("period"),
        (t + F.expr("INTERVAL 1 DAY")).alias("next_day"),
        F.datediff(F.lit("2002-01-01"), t).alias("age"),
        F.log2(c).alias("l2"),
        F.log1p(c).alias("l1p"),
        F.sqrt(c).alias("root"),
        F.signum(c - F.col("open")).alias("sgn"),
        F.atanh(F.least(F.col("low") / F.col("high"), F.lit(0.999))).alias("arc"),
    )


@query(
    "row_functions",
    "series_id ts total:4 strict:4 top:4 missing:i filled:4",
    f"""{BARS_1D_SQL}, x AS (SELECT series_id, ts, CASE WHEN trades % 2 = 0 THEN open END AS a, CASE WHEN trades % 3 = 0 THEN close END AS b FROM bars),
    t AS (SELECT series_id, ts, coalesce(a, 0) + coalesce(b, 0) AS total, CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN coalesce(a, 0) + coalesce(b, 0) END AS strict,
      greatest(a, b) AS top, (a IS NULL OR b IS NULL)::INT AS missing, coalesce(a, -1) AS filled FROM x)""",
)
def _(spark, sf):
    from barline.functions.mathx import any_null, row_max, row_sum

    x = bars_1d(spark, sf).select(
        "series_id",
        "ts",
        F.when(F.col("trades") % 2 == 0, F.col("open")).alias("a"),
        F.when(F.col("trades") % 3 == 0, F.col("close")).alias("b"),
    )
    return x.withColumns(
        {
            "total": row_sum(["a", "b"]),
            "strict": row_sum(["a", "b"], need_any=True),
            "top": row_max(["a", "b"]),
            "missing": any_null(["a", "b"]),
            "filled": F.coalesce("a", F.lit(-1.0)),
        }
    )


@query(
    "json_maps",
    "event_id k:1 back:1",
    """t AS (SELECT event_id, json_extract(props, '$.k')::DOUBLE AS k, json_extract(props, '$.k')::DOUBLE * 2 AS back FROM events)""",
)
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.from_json("props", "map<string,double>").alias("m"))
    doubled = F.to_json(F.transform_values("m", lambda k, v: v * 2))
    return e.select("event_id", F.col("m")["k"].alias("k"), F.from_json(doubled, "map<string,double>")["k"].alias("back"))


def metrics_sql(h: int) -> str:
    return f"""SELECT {h} AS hours, count(*) AS news_count, coalesce(100.0 * sum((sentiment = 'POSITIVE')::INT) / nullif(count(*), 0), 0) AS positive_pct,
      coalesce(100.0 * sum((sentiment = 'NEGATIVE')::INT) / nullif(count(*), 0), 0) AS negative_pct, coalesce(100.0 * sum((sentiment = 'NEUTRAL')::INT) / nullif(count(*), 0), 0) AS neutral_pct,
      coalesce(sum(sg) / nullif(count(*), 0), 0) AS sentiment_score, coalesce(sum(sg * (1 + upvotes)) / nullif(count(*), 0), 0) AS weighted_sentiment, coalesce(sum(score), 0) AS total_score
      FROM s WHERE published_at BETWEEN TIMESTAMP '{ASOF}' - INTERVAL {h} HOUR AND TIMESTAMP '{ASOF}'"""


@query(
    "news_metrics",
    "hours:i news_count:i positive_pct:4 negative_pct:4 neutral_pct:4 sentiment_score:6 weighted_sentiment:6 total_score:4",
    f"""{NEWS_SQL}, s AS (SELECT *, CASE sentiment WHEN 'POSITIVE' THEN 1 WHEN 'NEGATIVE' THEN -1 ELSE 0 END AS sg FROM news),
    t AS ({' UNION ALL '.join(metrics_sql(h) for h in (1, 4, 24))})""",
)
def _(spark, sf):
    return N.news_metrics(news(spark, sf), ASOF, [1, 4, 24])


HOURLY_SQL = f"""{NEWS_SQL}, h AS (SELECT search_group, date_trunc('hour', published_at) AS ts, count(*) AS n FROM news WHERE published_at <= TIMESTAMP '{{END}}' GROUP BY 1, 2),
    c AS (SELECT search_group, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM h GROUP BY 1),
    f AS (SELECT c.search_group, c.ts, coalesce(n, 0) AS n FROM c LEFT JOIN h USING (search_group, ts)),
    z AS (SELECT *, CASE WHEN count(*) OVER w >= 2 THEN (n - avg(n) OVER w) / nullif(stddev_samp(n) OVER w, 0) END AS z FROM f
      WINDOW w AS (PARTITION BY search_group ORDER BY ts ROWS 23 PRECEDING))"""


@query("news_count_zscores", "search_group ts n:i z:6", HOURLY_SQL.format(END="2100-01-01") + ", t AS (SELECT * FROM z)")
def _(spark, sf):
    return N.count_zscores(news(spark, sf), ["search_group"])


@query(
    "news_count_zscore_now",
    "search_group z:6 count_1h:i hourly_mean:6 poisson:6",
    f"""{HOURLY_SQL.format(END=ASOF)}, l AS (SELECT search_group, coalesce(last(z ORDER BY ts), 0) AS z FROM z GROUP BY 1),
    p AS (SELECT search_group, sum((published_at BETWEEN TIMESTAMP '{ASOF}' - INTERVAL 1 HOUR AND TIMESTAMP '{ASOF}')::INT) AS count_1h, sum((published_at BETWEEN TIMESTAMP '{ASOF}' - INTERVAL 24 HOUR AND TIMESTAMP '{ASOF}')::INT) / 24.0 AS hourly_mean
      FROM news GROUP BY 1),
    t AS (SELECT *, (count_1h - hourly_mean) / greatest(sqrt(hourly_mean), 1) AS poisson FROM l JOIN p USING (search_group))""",
)
def _(spark, sf):
    n = news(spark, sf)
    return N.count_zscore(n, ASOF, ["search_group"]).join(
        N.poisson_zscore(n, ASOF, ["search_group"]).withColumnRenamed("z", "poisson"), "search_group"
    )


@query(
    "news_stress",
    "search_group z:6 sentiment_score:6 high_stress:i",
    f"""{HOURLY_SQL.format(END=ASOF)}, l AS (SELECT search_group, coalesce(last(z ORDER BY ts), 0) AS z FROM z GROUP BY 1),
    o AS (SELECT search_group, count(*) FILTER (WHERE sentiment = 'POSITIVE') AS pos, count(*) FILTER (WHERE sentiment = 'NEGATIVE') AS neg, count(*) AS n
      FROM news WHERE published_at BETWEEN TIMESTAMP '{ASOF}' - INTERVAL 1 HOUR AND TIMESTAMP '{ASOF}' GROUP BY 1),
    s AS (SELECT l.search_group, z, coalesce((pos - neg) / n, 0) AS sentiment_score FROM l LEFT JOIN o USING (search_group)),
    t AS (SELECT *, (z > 2.0 AND sentiment_score < -0.3)::INT AS high_stress FROM s)""",
)
def _(spark, sf):
    return N.stress(news(spark, sf), ASOF, ["search_group"])


RECENT_SQL = f"{OUTLET_SQL}, rc AS (SELECT *, score * ({WEIGHT_SQL}) AS weighted FROM nw WHERE published_at BETWEEN TIMESTAMP '{ASOF}' - INTERVAL 4 HOUR AND TIMESTAMP '{ASOF}')"


@query(
    "news_impact",
    "search_group news_count:i score:6 high_impact:i escalations:i deescalations:i dominant_topic dominant_event_type",
    f"""{RECENT_SQL}, a AS (SELECT search_group, count(*) AS news_count, avg(weighted) AS score, sum((impact = 'HIGH')::INT) AS high_impact,
      sum((event_type = 'ESCALATION')::INT) AS escalations, sum((event_type = 'DEESCALATION')::INT) AS deescalations FROM rc GROUP BY 1),
    b AS (SELECT search_group, first(topic ORDER BY n DESC, topic) AS dominant_topic FROM (SELECT search_group, topic, count(*) AS n FROM rc GROUP BY 1, 2) GROUP BY 1),
    c AS (SELECT search_group, first(event_type ORDER BY n DESC, event_type) AS dominant_event_type FROM (SELECT search_group, event_type, count(*) AS n FROM rc GROUP BY 1, 2) GROUP BY 1),
    t AS (SELECT * FROM a JOIN b USING (search_group) JOIN c USING (search_group))""",
)
def _(spark, sf):
    return N.impact(with_outlet(news(spark, sf)), ASOF, 4, ["search_group"])


@query(
    "news_impact_by_group",
    "search_group news_count:i score:6 dominant:i",
    f"""{RECENT_SQL}, g AS (SELECT unnest([{', '.join(repr(g) for g in GROUPS)}]) AS search_group),
    s AS (SELECT g.search_group, count(rc.id) AS news_count, coalesce(avg(weighted), 0) AS score FROM g LEFT JOIN rc USING (search_group) GROUP BY 1),
    t AS (SELECT *, (row_number() OVER (ORDER BY (news_count > 0) DESC, abs(score) DESC, search_group) = 1 AND news_count > 0)::INT AS dominant FROM s)""",
)
def _(spark, sf):
    return N.impact_by_group(with_outlet(news(spark, sf)), ASOF, 4, GROUPS)


@query(
    "news_combined_score",
    "search_group combined_score:6 regime dominant_driver high_stress:i",
    f"""{RECENT_SQL}, s AS (SELECT search_group, 3 * avg(weighted) FILTER (WHERE id % 2 = 0) AS m, 3 * avg(weighted) FILTER (WHERE id % 2 = 1) AS c FROM rc GROUP BY 1),
    k AS (SELECT *, m * 0.6 + c * 0.4 AS combined_score FROM s),
    t AS (SELECT *, CASE WHEN combined_score >= 3 THEN 'BULL' WHEN combined_score <= -3 THEN 'BEAR' ELSE 'SIDEWAYS' END AS regime,
      CASE WHEN abs(m) > abs(c) THEN 'macro' ELSE 'crypto' END AS dominant_driver, (combined_score < -3 OR (m < -4 AND c < -0.3))::INT AS high_stress FROM k)""",
)
def _(spark, sf):
    rows = N._recent(with_outlet(news(spark, sf)), ASOF, 4, "published_at")
    even = F.col("id") % 2 == 0
    per = rows.groupBy("search_group").agg(
        (3 * F.avg(F.when(even, F.col("weighted")))).alias("macro_score"), (3 * F.avg(F.when(~even, F.col("weighted")))).alias("crypto_score")
    )
    return N.combine(per)


@query(
    "top_stories",
    "id:i title weighted:4",
    f"{RECENT_SQL}, t AS (SELECT id, substring(title, 1, 120) AS title, weighted FROM rc ORDER BY abs(score) DESC, id LIMIT 5)",
)
def _(spark, sf):
    return N.top_stories(with_outlet(news(spark, sf)), ASOF, 4)
