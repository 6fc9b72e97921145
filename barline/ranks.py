"""Exact ranks, distribution functions and quantiles without a global sort in one task.

Values are first collapsed to (group, value, weight) rows, then spread over value ranges whose
bounds come from an approximate quantile sketch, and ranks are carried from range to range.
Any bounds give the exact answer; good bounds only balance the work.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE = "_range"


def value_bounds(df: DataFrame, value: Column, ranges: int = 64) -> list[float]:
    """At most ``ranges`` increasing cut points (the only data that reaches the driver)."""
    probs = [i / ranges for i in range(1, ranges)]
    row = df.select(F.percentile_approx(value.cast("double"), probs, 10_000).alias("b")).first()
    return sorted({float(b) for b in (row.b or []) if b == b})


def ranged(df: DataFrame, value: Column, bounds: list[float], name: str) -> DataFrame:
    """Add the index of each value's range: how many cut points are at or below it (binary search)."""
    cuts = sorted({b for b in bounds if math.isfinite(b)})
    if not cuts:
        return df.withColumn(name, F.lit(0))
    search = Bucketizer(
        splits=[-math.inf, *cuts, math.inf], inputCol="_value", outputCol="_slot", handleInvalid="keep"
    )
    found = search.transform(df.withColumn("_value", value.cast("double")))
    return found.withColumn(name, F.col("_slot").cast("int")).drop("_value", "_slot")


def value_cdf(
    df: DataFrame,
    value: str,
    by: list[str] | None = None,
    weights: dict[str, Column] | None = None,
    bounds: list[float] | None = None,
) -> DataFrame:
    """One row per (group, distinct value) with weight sums and the sums over smaller values.

    Columns: ``by``, ``value``, and for every weight ``w`` the columns ``w`` (at this value),
    ``w_below`` (strictly smaller values) and ``w_total`` (whole group). Null values are left out.
    """
    by = by or []
    weights = weights or {"n": F.lit(1).cast("long")}
    rows = df.filter(F.col(value).isNotNull())
    if bounds is None:
        bounds = value_bounds(rows, F.col(value))
    distinct = rows.groupBy(*by, value).agg(*[F.sum(c).alias(n) for n, c in weights.items()])
    distinct = ranged(distinct, F.col(value), bounds, RANGE)
    parts = distinct.groupBy(*by, RANGE).agg(*[F.sum(n).alias(f"_p_{n}") for n in weights])
    # One row per group and range: at most len(bounds)+1 rows share a window partition.
    over_ranges = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    parts = parts.select(
        *by,
        RANGE,
        *[
            F.coalesce(
                F.sum(f"_p_{n}").over(over_ranges.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ).alias(f"_c_{n}")
            for n in weights
        ],
        *[F.sum(f"_p_{n}").over(over_ranges).alias(f"{n}_total") for n in weights],
    )
    inside = Window.partitionBy(*by, RANGE).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    joined = distinct.join(parts, [*by, RANGE])
    return joined.select(
        *by,
        value,
        *weights,
        *[
            (F.col(f"_c_{n}") + F.coalesce(F.sum(n).over(inside), F.lit(0))).alias(f"{n}_below")
            for n in weights
        ],
        *[f"{n}_total" for n in weights],
    )


def quantiles(
    df: DataFrame,
    value: str,
    probs: dict[str, float],
    by: list[str] | None = None,
    bounds: list[float] | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column per entry of ``probs``."""
    by = by or []
    cdf = value_cdf(df, value, by, bounds=bounds)
    aggs = []
    for name, p in probs.items():
        h = (F.col("n_total") - 1) * F.lit(p)
        lo, hi = F.floor(h), F.ceil(h)

        def at(k: Column) -> Column:
            held = (F.col("n_below") <= k) & (k < F.col("n_below") + F.col("n"))
            return F.max(F.when(held, F.col(value).cast("double")))

        frac = F.max(h - lo)
        aggs.append((at(lo) + (at(hi) - at(lo)) * frac).alias(name))
    return cdf.groupBy(*by).agg(*aggs)


def average_ranks(df: DataFrame, value: str, by: list[str] | None = None, name: str = "rank") -> DataFrame:
    """Join the tie-averaged rank (1-based) of every distinct value back to the rows.

    ``df`` is read more than once and has to give the same values each time: store float sums before (``materialize``).
    """
    by = by or []
    ranks = value_cdf(df, value, by).select(
        *by, value, (F.col("n_below") + (F.col("n") + 1) / 2.0).alias(name)
    )
    return df.join(ranks, [*by, value], "left")


def auc(
    df: DataFrame,
    score: str,
    label: str,
    by: list[str] | None = None,
    bounds: list[float] | None = None,
) -> DataFrame:
    """ROC area per group with ties counted half; null when only one class is present."""
    by = by or []
    rows = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    positive = F.when(F.col(label) == 1, 1).otherwise(0).cast("long")
    cdf = value_cdf(rows, score, by, {"pos": positive, "neg": (1 - positive)}, bounds)
    won = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0))
    return cdf.groupBy(*by).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n"),
        F.try_divide(won, F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("auc"),
    )
