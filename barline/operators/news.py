"""News feed metrics at a given instant; ``asof`` is always a parameter, never the wall clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.mathx import safe_div
from barline.functions.text import source_weight
from barline.grid import HOUR, Grid, over_series
from barline.operators import rolling as R
from barline.operators.resample import bucket_start


def _now(asof: str) -> Column:
    return F.lit(asof).cast("timestamp")


def in_window(time: str, asof: str, hours: int) -> Column:
    """The ``hours`` up to ``asof``, both ends included; nothing later is seen."""
    return F.col(time).between(_now(asof) - F.expr(f"INTERVAL {hours} HOURS"), _now(asof))


def news_metrics(df: DataFrame, asof: str, hours: list[int], time: str = "published_at") -> DataFrame:
    """Counts, shares, sentiment and score sums per trailing horizon, all horizons in one pass; zeros when empty."""
    sign = F.when(F.col("sentiment") == "POSITIVE", 1).when(F.col("sentiment") == "NEGATIVE", -1).otherwise(0)
    parts = []
    for h in hours:
        inside = in_window(time, asof, h)
        n = F.count_if(inside)
        pos = F.count_if(inside & (F.col("sentiment") == "POSITIVE"))
        neg = F.count_if(inside & (F.col("sentiment") == "NEGATIVE"))

        def per(x: Column) -> Column:
            return F.coalesce(safe_div(x, n), F.lit(0.0))

        parts.append(
            F.struct(
                F.lit(h).alias("hours"),
                n.alias("news_count"),
                (per(pos) * 100).alias("positive_pct"),
                (per(neg) * 100).alias("negative_pct"),
                (per(n - pos - neg) * 100).alias("neutral_pct"),
                per(pos - neg).alias("sentiment_score"),
                per(F.sum(F.when(inside, sign * (1 + F.col("upvotes"))))).alias("weighted_sentiment"),
                F.coalesce(F.sum(F.when(inside, F.col("score"))), F.lit(0.0)).alias("total_score"),
            ).alias(f"h{h}")
        )
    wide = df.filter(in_window(time, asof, max(hours))).agg(*parts)
    return wide.select(F.inline(F.array(*[f"h{h}" for h in hours])))


def count_zscores(df: DataFrame, by: list[str], time: str = "published_at", n: int = 24) -> DataFrame:
    """Hourly counts per group, empty hours included, with their rolling z score (at least 2 hours)."""
    hourly = df.groupBy(*by, bucket_start(time, HOUR).alias("ts")).agg(F.count(F.lit(1)).alias("n"))
    span = hourly.groupBy(*by).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    hours = span.select(*by, F.explode(F.expr("sequence(a, b, interval 1 hour)")).alias("ts"))
    filled = hours.join(hourly, [*by, "ts"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return over_series(filled, Grid(tuple(by), "ts", HOUR), {"z": R.zscore("n", n, 2)})


def count_zscore(df: DataFrame, asof: str, by: list[str], time: str = "published_at", n: int = 24) -> DataFrame:
    """z score of the last hour with rows up to ``asof`` per group, 0 where undefined."""
    return count_zscores(df.filter(F.col(time) <= _now(asof)), by, time, n).groupBy(*by).agg(F.coalesce(F.max_by("z", "ts"), F.lit(0.0)).alias("z"))


def poisson_zscore(df: DataFrame, asof: str, by: list[str], time: str = "published_at") -> DataFrame:
    """(count in the last hour - hourly mean of the last day) / max(sqrt(mean), 1)."""
    c1 = F.count_if(in_window(time, asof, 1))
    mean = F.count_if(in_window(time, asof, 24)) / 24.0
    return df.groupBy(*by).agg(
        c1.alias("count_1h"), mean.alias("hourly_mean"), ((c1 - mean) / F.greatest(F.sqrt(mean), F.lit(1.0))).alias("z")
    )


def stress(df: DataFrame, asof: str, by: list[str], time: str = "published_at", z: float = 2.0, sentiment: float = -0.3) -> DataFrame:
    """Per group, whether news comes unusually often (z of the last hour above ``z``) and is bad (sentiment of the last hour below ``sentiment``)."""
    inside = in_window(time, asof, 1)
    count = lambda kind: F.count_if(inside & (F.col("sentiment") == kind))
    balance = F.coalesce(safe_div(count("POSITIVE") - count("NEGATIVE"), F.count_if(inside)), F.lit(0.0))
    out = count_zscore(df, asof, by, time).join(df.groupBy(*by).agg(balance.alias("sentiment_score")), by)
    return out.withColumn("high_stress", (F.col("z") > z) & (F.col("sentiment_score") < sentiment))


def _recent(df: DataFrame, asof: str, hours: int, time: str) -> DataFrame:
    rows = df.filter(in_window(time, asof, hours))
    return rows.withColumn("weighted", F.col("score") * source_weight("source"))


def _most_common(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    counts = rows.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.struct(-F.col("_n"), F.col(column).alias("value")))
    return counts.groupBy(*by).agg(best["value"].alias(f"dominant_{column}"))


def impact(df: DataFrame, asof: str, hours: int, by: list[str], time: str = "published_at") -> DataFrame:
    """Source-weighted impact per group: mean, high-impact and escalation counts, dominant topic and type."""
    rows = _recent(df, asof, hours, time)
    out = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("news_count"),
        F.avg("weighted").alias("score"),
        F.count_if(F.col("impact") == "HIGH").alias("high_impact"),
        F.count_if(F.col("event_type") == "ESCALATION").alias("escalations"),
        F.count_if(F.col("event_type") == "DEESCALATION").alias("deescalations"),
    )
    for column in ("topic", "event_type"):
        out = out.join(_most_common(rows, column, by), by, "left")
    return out


def impact_by_group(df: DataFrame, asof: str, hours: int, groups: list[str], time: str = "published_at") -> DataFrame:
    """Count and weighted score per search group, empty groups included, and which group dominates."""
    rows = _recent(df, asof, hours, time)
    per = [
        F.struct(
            F.lit(g).alias("search_group"),
            F.count_if(F.col("search_group") == g).alias("news_count"),
            F.coalesce(F.avg(F.when(F.col("search_group") == g, F.col("weighted"))), F.lit(0.0)).alias("score"),
        ).alias(f"g{i}")
        for i, g in enumerate(groups)
    ]
    out = rows.agg(*per).select(F.inline(F.array(*[f"g{i}" for i in range(len(groups))])))
    live = Window.partitionBy(F.lit(0)).orderBy((F.col("news_count") > 0).desc(), F.abs("score").desc(), "search_group")
    return out.withColumn("dominant", (F.row_number().over(live) == 1) & (F.col("news_count") > 0))


def regime_from_score(score: str) -> Column:
    s = F.col(score)
    return F.when(s >= 3, "BULL").when(s <= -3, "BEAR").otherwise("SIDEWAYS")


def combine(df: DataFrame, macro: str = "macro_score", crypto: str = "crypto_score", macro_weight=0.60, crypto_weight=0.40) -> DataFrame:
    """Weighted total, regime, dominant driver and the high-stress flag."""
    m, c = F.col(macro), F.col(crypto)
    out = df.withColumn("combined_score", m * macro_weight + c * crypto_weight)
    return out.withColumns(
        {
            "regime": regime_from_score("combined_score"),
            "dominant_driver": F.when(F.abs(m) > F.abs(c), "macro").otherwise("crypto"),
            "high_stress": (F.col("combined_score") < -3.0) | ((m < -4.0) & (c < -0.3)),
        }
    )


def top_stories(df: DataFrame, asof: str, hours: int, n: int = 5, time: str = "published_at") -> DataFrame:
    """Largest absolute scores (not weighted by source); titles cut to 120 characters."""
    rows = _recent(df, asof, hours, time)
    return rows.orderBy(F.abs("score").desc(), "id").limit(n).withColumn("title", F.substring("title", 1, 120))
