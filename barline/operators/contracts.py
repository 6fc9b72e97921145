"""Data contracts: violations as tables, repairs, freshness, coverage, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions.mathx import all_of, any_null, any_of, corr_of
from barline.grid import Grid, numbered, over_series
from barline.operators import rolling as R
from barline.sources.shaping import coerce_double
from barline.sources.upsert import dedupe_last, tail_n

OHLC = ["open", "high", "low", "close"]
PRICED = [*OHLC]
SIZES = ["volume", "quote_volume", "trades", "taker_buy_base_volume", "taker_buy_quote_volume"]


def unpivot_counts(wide: DataFrame, keys: list[str], names: list[str], label: str, value: str) -> DataFrame:
    return wide.unpivot(keys, names, label, value)


def count_rules(df: DataFrame, keys: list[str], rules: dict[str, Column]) -> DataFrame:
    """Rows per (key, rule) that break a rule; an unknown comparison is not a break. One pass."""
    wide = df.groupBy(*keys).agg(
        *[F.sum(F.coalesce(c, F.lit(False)).cast("long")).alias(name) for name, c in rules.items()]
    )
    return unpivot_counts(wide, keys, list(rules), "rule", "violations")


def bar_rules(time: str = "ts") -> dict[str, Column]:
    c = F.col
    return {
        "null_value": any_null([*OHLC, *SIZES]),
        "close_before_open_time": c("close_time") < c(time),
        "high_below_body": c("high") < F.greatest("open", "close"),
        "low_above_body": c("low") > F.least("open", "close"),
        "high_below_low": c("high") < c("low"),
        "price_not_positive": any_of([c(x) <= 0 for x in PRICED]),
        "size_negative": any_of([c(x) < 0 for x in SIZES]),
        "taker_above_total": (c("taker_buy_base_volume") > c("volume"))
        | (c("taker_buy_quote_volume") > c("quote_volume")),
    }


def check_bars(df: DataFrame, grid: Grid) -> DataFrame:
    """(series, rule, violations) for bars, including duplicate times and gaps other than ``grid.step``."""
    rows = over_series(df, grid, {"_before": R.lagged(grid.time)})
    gap = F.unix_seconds(F.col(grid.time)) - F.unix_seconds(F.col("_before"))
    rules = bar_rules(grid.time) | {"duplicate_time": gap == 0, "gap": (gap != 0) & (gap != grid.step)}
    return count_rules(rows, list(grid.key), rules)


def require(violations: DataFrame, allow: tuple[str, ...] = ()) -> None:
    """Raise when a rule outside ``allow`` is broken (one row per rule reaches the driver)."""
    broken = violations.filter((F.col("violations") > 0) & ~F.col("rule").isin(*allow, "")).groupBy("rule").agg(F.sum("violations").alias("violations")).collect()
    if broken:
        raise ValueError("contract broken: " + "; ".join(str(r.asDict()) for r in broken))


def gaps(df: DataFrame, grid: Grid) -> DataFrame:
    """Rows whose distance to the row before is not the grid step."""
    rows = over_series(df.select(*grid.key, *grid.order), grid, {"previous": R.lagged(grid.time)})
    seconds = F.unix_seconds(F.col(grid.time)) - F.unix_seconds(F.col("previous"))
    return rows.withColumn("gap_seconds", seconds).filter(F.col("gap_seconds") != grid.step)


def repair_bars(df: DataFrame) -> DataFrame:
    """Stretch high/low to cover the body; drop rows with a null price; note what was changed.

    ``fixed_high`` / ``fixed_low`` are 1 on changed rows, for the correction counts.
    """
    body_hi = F.when(F.col("open").isNotNull() & F.col("close").isNotNull(), F.greatest("open", "close"))
    body_lo = F.when(F.col("open").isNotNull() & F.col("close").isNotNull(), F.least("open", "close"))
    low_high = F.coalesce(F.col("high") < body_hi, F.lit(False))
    high_low = F.coalesce(F.col("low") > body_lo, F.lit(False))
    out = df.withColumns(
        {
            "fixed_high": low_high.cast("int"),
            "fixed_low": high_low.cast("int"),
            "_high": F.when(low_high, body_hi).otherwise(F.col("high")),
            "_low": F.when(high_low, body_lo).otherwise(F.col("low")),
        }
    )
    inverted = F.coalesce(F.col("_high") < F.col("_low"), F.lit(False))
    return (
        out.withColumns({"high": F.when(inverted, F.col("_low")).otherwise(F.col("_high")), "low": F.col("_low")})
        .drop("_high", "_low")
        .na.drop("any", subset=OHLC)
    )


def repair_counts(repaired: DataFrame, keys: list[str]) -> DataFrame:
    return repaired.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("fixed_high").alias("fixed_high"), F.sum("fixed_low").alias("fixed_low")
    )


def clean_bars(df: DataFrame, grid: Grid, start: str | None = None, n: int | None = None, order: str | None = None) -> DataFrame:
    """Numeric bars, last copy per time, from ``start``, the latest ``n`` rows."""
    numbers = [c for c in [*OHLC, *SIZES] if c in df.columns]
    out = dedupe_last(coerce_double(df, numbers), [*grid.key, grid.time], [order or "close_time"])
    return tail_n(out, grid, n, start) if n else out


DERIVATIVE_NAMES = {
    "oi__close": "oi_binance",
    "oi_agg__close": "oi_aggregated",
    "funding__close": "funding_binance",
    "funding_oi__close": "funding_oi_weighted",
    "funding_vol__close": "funding_vol_weighted",
}


def clean_derivatives(df: DataFrame, grid: Grid, order: str, names: dict[str, str] | None = None) -> DataFrame:
    """The close columns of each endpoint under their own names, last copy per time."""
    names = names or DERIVATIVE_NAMES
    kept = df.select(*grid.key, grid.time, order, *[F.col(a).alias(b) for a, b in names.items()])
    return dedupe_last(coerce_double(kept, list(names.values())), [*grid.key, grid.time], [order]).drop(order)


BOOK = ["bids_usd", "bids_quantity", "asks_usd", "asks_quantity"]


def check_orderbook(df: DataFrame, grid: Grid) -> DataFrame:
    """(series, rule, violations): duplicate times, negative sides, nulls per column."""
    rows = coerce_double(df, BOOK)
    dup = rows.groupBy(*grid.key, grid.time).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum((F.col(c) < 0).cast("long")).alias(f"_neg_{c}") for c in BOOK],
        *[F.sum(F.col(c).isNull().cast("long")).alias(f"_null_{c}") for c in BOOK],
    )
    wide = dup.groupBy(*grid.key).agg(
        F.sum((F.col("_n") > 1).cast("long")).alias("duplicate_time"),
        *[F.coalesce(F.sum(f"_neg_{c}"), F.lit(0)).alias(f"negative_{c}") for c in BOOK],
        *[F.sum(f"_null_{c}").alias(f"null_{c}") for c in BOOK],
    )
    names = ["duplicate_time", *[f"negative_{c}" for c in BOOK], *[f"null_{c}" for c in BOOK]]
    return unpivot_counts(wide, list(grid.key), names, "rule", "violations")


def clean_index(df: DataFrame, grid: Grid, order: str, value: str = "value") -> DataFrame:
    return dedupe_last(coerce_double(df, [value]), [*grid.key, grid.time], [order])


def clean_macro(df: DataFrame, values: list[str], time: str = "date") -> DataFrame:
    """Rename the date, coerce the values, drop rows in which every value is null."""
    out = df.withColumnRenamed(time, "ts") if time != "ts" else df
    return coerce_double(out, values).na.drop("all", subset=values)


def check_macro(df: DataFrame, grid: Grid, values: list[str], forbid_all_null: bool = False) -> DataFrame:
    """Duplicate times per series and, on request, columns that are null throughout."""
    per_time = df.groupBy(*grid.key, grid.time).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(f"_c_{c}") for c in values]
    )
    aggs = [F.sum((F.col("_n") > 1).cast("long")).alias("duplicate_time")]
    names = ["duplicate_time"]
    if forbid_all_null:
        aggs += [(F.sum(f"_c_{c}") == 0).cast("long").alias(f"all_null_{c}") for c in values]
        names += [f"all_null_{c}" for c in values]
    return unpivot_counts(per_time.groupBy(*grid.key).agg(*aggs), list(grid.key), names, "rule", "violations")


def reconcile(a: DataFrame, b: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    """One row: matched and one-sided keys, summed absolute difference per column, verdict."""
    left = a.select(*on, *[F.col(c).alias(f"_a_{c}") for c in columns], F.lit(1).alias("_in_a"))
    right = b.select(*on, *[F.col(c).alias(f"_b_{c}") for c in columns], F.lit(1).alias("_in_b"))
    both = left.join(right, on, "full")
    out = both.agg(
        F.count_if(F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()).alias("matched"),
        F.count_if(F.col("_in_b").isNull()).alias("only_a"),
        F.count_if(F.col("_in_a").isNull()).alias("only_b"),
        *[F.coalesce(F.sum(F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}"))), F.lit(0.0)).alias(f"diff_{c}") for c in columns],
    )
    equal = all_of([F.col(f"diff_{c}") == 0 for c in columns] + [F.col("only_a") == 0, F.col("only_b") == 0])
    return out.withColumn("verdict", F.when(equal, "identical").otherwise("different"))


def freshness(df: DataFrame, expected: DataFrame, asof: str, value: str, grid: Grid, recent: int = 5) -> DataFrame:
    """Per expected (series, max_days): last row, age in days, status, nulls in the last rows."""
    now = F.lit(asof).cast("timestamp")
    last = numbered(df.select(*grid.key, *grid.order, value), grid, "_no", descending=True)
    seen = last.groupBy(*grid.key).agg(
        F.max(grid.time).alias("last_ts"),
        F.sum(((F.col("_no") <= recent) & F.col(value).isNull()).cast("long")).alias("recent_nulls"),
    )
    out = expected.join(seen, list(grid.key), "left").withColumn("days_ago", F.datediff(now, F.col("last_ts")))
    status = (
        F.when(F.col("last_ts").isNull(), "MISSING")
        .when(F.col("days_ago") <= F.col("max_days"), "FRESH")
        .otherwise("STALE")
    )
    return out.withColumn("status", status)


def coverage(df: DataFrame, targets: DataFrame, target_start: str, grid: Grid) -> DataFrame:
    """Start, end and rows per series; how late it starts after the later of target and natural start."""
    spans = df.groupBy(*grid.key).agg(
        F.min(grid.time).alias("start"), F.max(grid.time).alias("until"), F.count(F.lit(1)).alias("rows")
    )
    due = F.greatest(F.lit(target_start).cast("timestamp"), F.col("natural_start"))
    out = spans.join(targets, list(grid.key), "left").withColumn("late_days", F.datediff(F.col("start"), due))
    verdict = F.when(F.col("late_days") <= 5, "ok").when(F.col("late_days") <= 90, "warn").otherwise("bad")
    return out.withColumn("verdict", verdict)


def completeness(df: DataFrame, columns: list[str], keys: list[str], low: float = 0.95) -> DataFrame:
    """Non-null count and share per column, and a flag for low coverage."""
    wide = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *[F.count(c).alias(c) for c in columns])
    long = wide.unpivot([*keys, "rows"], columns, "feature", "non_null")
    return long.withColumn("share", F.col("non_null") / F.col("rows")).withColumn("low", F.col("share") < low)


def drop_burnin(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop("any", subset=columns)


def slice_time(df: DataFrame, time: str, start: str | None, end: str | None) -> DataFrame:
    """Rows from start to end, both included."""
    if start:
        df = df.filter(F.col(time) >= F.lit(start).cast("timestamp"))
    return df.filter(F.col(time) <= F.lit(end).cast("timestamp")) if end else df


def check_probs(df: DataFrame, probabilities: list[str], entropy: str, keys: list[str]) -> DataFrame:
    """Entropy range and nulls, and its correlation with the leading probability (should be negative)."""
    import math

    top = F.greatest(*probabilities)
    cap = math.log2(len(probabilities))
    e = F.col(entropy)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(e.isNull()).alias("null_entropy"),
        F.count_if((e < -1e-9) | (e > cap + 1e-9)).alias("out_of_range"),
        corr_of(e, top).alias("corr_with_top"),
    )


def max_abs_difference(a: DataFrame, b: DataFrame, on: list[str], columns: list[str]) -> DataFrame:
    joined = a.join(b.select(*on, *[F.col(c).alias(f"_b_{c}") for c in columns]), on, "left")
    return joined.agg(*[F.max(F.abs(F.col(c) - F.col(f"_b_{c}"))).alias(c) for c in columns])


# ---- configuration-driven projections ----------------------------------------------------------


def norm_asset(c: str | Column) -> Column:
    """Lower case, trimmed, without the quote-currency suffix."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.trim(F.lower(c)), "usdt$", "")


def select_features(df: DataFrame, config: dict[str, dict[str, list[str]]], asset: str) -> DataFrame:
    """Columns configured for an asset, looked up among assets and then among indices."""
    name = asset.strip().lower().removesuffix("usdt")
    for section in ("assets", "indices"):
        wanted = config.get(section, {}).get(name)
        if wanted is not None:
            absent = [c for c in wanted if c not in df.columns]
            if absent:
                raise ValueError(f"{asset}: missing features {absent}")
            return df.select("series_id", "ts", *wanted)
    raise KeyError(f"unknown asset {asset}")


def allowed_features(long: DataFrame, config: dict[str, dict[str, list[str]]]) -> DataFrame:
    """Long (series_id, feature, ...) rows allowed by the configuration; unknown assets are marked.

    The configuration is a literal in the plan: assets win over indices.
    """
    merged = {**config.get("indices", {}), **config.get("assets", {})}
    pairs = [x for k, v in merged.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    allowed = F.create_map(*pairs)[norm_asset("series_id")]
    return long.withColumns(
        {"known_asset": allowed.isNotNull(), "_ok": F.coalesce(F.array_contains(allowed, F.col("feature")), F.lit(False))}
    ).filter(~F.col("known_asset") | F.col("_ok")).drop("_ok")


def resolve_family(assets: DataFrame, families: list[dict]) -> DataFrame:
    """Family of each (source, category) with its flattened features; must match exactly one.

    ``families``: name, source, categories, features (groups of lists). ``matches`` other than 1
    is an error the caller can filter for.
    """
    rows = [
        F.struct(
            F.lit(f["name"]).alias("family"),
            F.lit(f["source"]).alias("source"),
            F.array(*map(F.lit, f["categories"])).alias("categories"),
            F.array(*[F.lit(x) for group in f["features"].values() for x in group]).alias("features"),
        )
        for f in families
    ]
    hits = F.filter(
        F.array(*rows),
        lambda f: (f.source == F.col("source")) & F.array_contains(f.categories, F.col("category")),
    )
    return assets.withColumn("_hits", hits).select(
        *assets.columns,
        F.size("_hits").alias("matches"),
        F.when(F.size("_hits") == 1, F.col("_hits")[0].family).alias("family"),
        F.when(F.size("_hits") == 1, F.col("_hits")[0].features).alias("features"),
    )
