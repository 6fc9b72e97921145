"""Signal rules: projections over feature, regime and news columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.mathx import clip, col, flag, safe_div
from barline.operators.joins import asof_shared
from barline.ranks import quantiles, value_bounds, value_cdf
from barline.grid import Grid


def scaled(x: str, center: float, width: float) -> Column:
    """(x - center) / width."""
    return (col(x) - center) / width


def rebase(x: str, first: str, start: float = 1.0) -> Column:
    """A curve restated to begin at ``start``."""
    return safe_div(x, first) * start


def basis(a: str, b: str) -> Column:
    return col(a) - col(b)


# ---- gates -----------------------------------------------------------------------------------


def regime_gate(
    df: DataFrame, p_bull="p_bull", entropy="entropy", allocation="allocation", min_prob=0.30, max_entropy=0.85, enabled=True
) -> DataFrame:
    """Passes with enough bull probability and little entropy; missing values block."""
    ok = (F.coalesce(F.col(p_bull), F.lit(0.0)) >= min_prob) & (F.coalesce(F.col(entropy), F.lit(1.0)) <= max_entropy)
    ok = ok if enabled else F.lit(True)
    return df.withColumn("regime_gate", ok).withColumn(
        "allocation_after_regime", F.when(F.col("regime_gate"), F.col(allocation)).otherwise(F.lit(0.0))
    )


def timing_score(rsi="rsi", bb="bb", volume_z="volume_z", rsi_t=40.0, bb_t=0.30, weights=(0.4, 0.3, 0.3), sign_volume=False) -> Column:
    """Weighted score of low RSI, low band position and high volume; ``sign_volume`` counts any z > 0 as 1."""
    r = F.greatest(F.lit(0.0), (rsi_t - F.coalesce(F.col(rsi), F.lit(rsi_t))) / rsi_t)
    b = F.greatest(F.lit(0.0), (bb_t - F.coalesce(F.col(bb), F.lit(bb_t))) / bb_t)
    z = F.coalesce(F.col(volume_z), F.lit(0.0))
    v = flag(z > 0) if sign_volume else clip(z / 2.0, 0.0, 1.0)
    return weights[0] * r + weights[1] * b + weights[2] * v


def timing_gate(df: DataFrame, allocation="allocation_after_regime", min_score=0.30, enabled=True, **kw) -> DataFrame:
    score = timing_score(**kw) if enabled else F.lit(1.0)
    ok = F.col("timing_score") >= min_score if enabled else F.lit(True)
    final = F.coalesce(F.when(F.col("timing_gate"), F.col(allocation)).otherwise(F.lit(0.0)), F.lit(0.0))
    return df.withColumn("timing_score", score).withColumn("timing_gate", ok).withColumn("allocation_final", final)


def regime_gate3(
    regime="regime", p_bull="p_bull", p_bear="p_bear", entropy="entropy", allocation="allocation", position="position",
    min_bull=0.30, max_bear=0.60, max_entropy=0.85,
) -> Column:
    """Three-state gate as a struct (allocation, triggered, label).

    Skipped while in position; missing indicators, high entropy, bear and weak bull block;
    sideways passes unchanged.
    """

    def out(a: Column, hit: bool, label: str) -> Column:
        return F.struct(a.cast("double").alias("allocation"), F.lit(hit).alias("triggered"), F.lit(label).alias("label"))

    a, none = F.col(allocation), F.lit(0.0)
    bear = (F.col(regime) == "Bear") | (F.col(p_bear) > max_bear)
    return (
        F.when(F.col(position) > 1e-6, out(a, False, ""))
        .when(F.col(p_bull).isNull() | F.col(entropy).isNull(), out(none, True, ""))
        .when(F.col(entropy) > max_entropy, out(none, True, ""))
        .when(bear, out(none, True, "bear"))
        .when(F.col(regime) == "Sideways", out(a, False, "sideways"))
        .when(F.col(p_bull) < min_bull, out(none, True, ""))
        .otherwise(out(a, False, "bull"))
    )


def technical_gate(rsi="rsi", bb="bb", allocation="allocation") -> Column:
    """Block stretched prices, boost oversold ones, trim the upper zone; struct (allocation, blocked, zone)."""
    r, b, a = F.col(rsi), F.col(bb), F.col(allocation)

    def out(v: Column, blocked: bool, zone: str) -> Column:
        return F.struct(v.cast("double").alias("allocation"), F.lit(blocked).alias("blocked"), F.lit(zone).alias("zone"))

    return (
        F.when((r > 65) | (b > 0.75), out(F.lit(0.0), True, "overbought"))
        .when((r < 30) & (b < 0.15), out(F.least(a * 1.3, F.lit(1.0)), False, "strong_oversold"))
        .when((r < 35) & (b < 0.25), out(F.least(a * 1.2, F.lit(1.0)), False, "oversold"))
        .when((r > 50) & (b > 0.50), out(a * 0.7, False, "high_zone"))
        .otherwise(out(a, False, "neutral"))
    )


def news_gate(
    df: DataFrame, news: DataFrame, grid: Grid, allocation="allocation", stale_hours: float = 2.0
) -> DataFrame:
    """Apply the latest news regime and score to each row; stale or absent news passes.

    ``news`` has (time, news_regime, news_score) and serves every series.
    """
    t = grid.time
    feed = news.select(t, F.col(t).alias("news_ts"), "news_regime", "news_score")
    out = asof_shared(df, feed, grid, ["news_ts", "news_regime", "news_score"], lag=None)
    age = (F.unix_seconds(F.col(t)) - F.unix_seconds(F.col("news_ts"))) / 3600.0
    fresh = F.coalesce(age <= stale_hours, F.lit(False))
    r, s, a = F.col("news_regime"), F.col("news_score"), F.col(allocation)
    gated = (
        F.when(~fresh, a)
        .when((r == "BEAR") & (s < -3), F.lit(0.0))
        .when(r == "BEAR", a * 0.5)
        .when((r == "BULL") & (s > 3), F.least(a * 1.15, F.lit(1.0)))
        .otherwise(a)
    )
    blocked = fresh & (r == "BEAR") & (s < -3)
    return out.withColumns({"allocation_after_news": gated, "news_blocked": F.coalesce(blocked, F.lit(False))})


def macro_gate(stress: str, allocation: str, lo: float, hi: float, max_cut: float) -> Column:
    """Allocation multiplier 1 - stress * (1 - allocation) * max_cut, all parts within 0..1."""
    s = clip((F.col(stress) - lo) / (hi - lo), 0.0, 1.0)
    return clip(1.0 - s * clip(1.0 - F.col(allocation), 0.0, 1.0) * max_cut, 0.0, 1.0)


def derivatives_gate(funding_z: str, oi_div: str, z_limit: float, div_limit: float, max_cut: float) -> Column:
    hit = (F.col(funding_z) >= z_limit) & (F.col(oi_div) >= div_limit)
    return F.when(hit, F.lit(1.0 - max_cut)).otherwise(F.lit(1.0))


# ---- scores and signals ----------------------------------------------------------------------


def entry_score(
    df: DataFrame, bb="bb", rsi="rsi", allocation="allocation", news_regime="news_regime", news_score="news_score",
    regime="regime", min_score=2.5,
) -> DataFrame:
    """Sum of band, RSI, allocation and news points; bear regimes never enter (score -99)."""
    b, r = F.coalesce(F.col(bb), F.lit(0.5)), F.coalesce(F.col(rsi), F.lit(50.0))
    a, nr, ns = F.col(allocation), F.col(news_regime), F.coalesce(F.col(news_score), F.lit(0.0))
    bb_pts = F.when(b > 0.80, -2.0).when(b < 0.20, 3.0).when(b < 0.30, 2.0).when(b < 0.40, 0.5).otherwise(0.0)
    rsi_pts = F.when(r < 35, 1.0).when(r < 45, 0.5).when(r > 60, -1.0).otherwise(0.0)
    alloc_pts = F.when(a.between(0.50, 0.54), 0.5).when((a >= 0.48) & (a < 0.50), 0.25).otherwise(0.0)
    news_pts = (
        F.when((nr == "BULL") & (ns > 3), 1.0)
        .when(nr == "BULL", 0.5)
        .when((nr == "BEAR") & (ns < -3), -1.5)
        .when(nr == "BEAR", -0.5)
        .otherwise(0.0)
    )
    bear = F.coalesce(F.lower(regime) == "bear", F.lit(False))
    total = F.when(bear, F.lit(-99.0)).otherwise(bb_pts + rsi_pts + alloc_pts + news_pts)
    return df.withColumn("entry_score", total).withColumn("enter", F.col("entry_score") >= min_score)


def score_v1(bb="bb", rsi="rsi") -> Column:
    b, r = F.col(bb), F.col(rsi)
    return F.when(b < 0.20, 2.0).when(b < 0.30, 1.5).when(b < 0.40, 0.5).otherwise(0.0) + F.when(r < 35, 1.0).when(
        r < 45, 0.5
    ).when(r > 60, -1.0).otherwise(0.0)


def daily_signal(
    state="state", p="p", p_bull="p_bull", long=0.55, short=0.45, strong=0.60, strong_bull=0.80, strong_bear=0.20
) -> Column:
    s, x, b = F.col(state), F.col(p), F.col(p_bull)
    return (
        F.when(x.isNull(), "NO_DATA")
        .when((s == 1) & (x > strong) & (b > strong_bull), "LONG_STRONG")
        .when((s == 1) & (x > long), "LONG")
        .when((s == 0) & (x < 1 - strong) & (b < strong_bear), "SHORT_STRONG")
        .when((s == 0) & (x < short), "SHORT")
        .otherwise("NEUTRAL")
    )


def label_binary(fwd: str, threshold: float = 0.0) -> Column:
    return F.when(F.col(fwd).isNotNull(), (F.col(fwd) > threshold).cast("int"))


def label_ternary(fwd: str, bull: float, bear: float) -> Column:
    """2 above ``bull``, 0 below ``-bear``, else 1."""
    x = F.col(fwd)
    return F.when(x.isNull(), None).when(x > bull, 2).when(x < -bear, 0).otherwise(1)


def label_vol_scaled(fwd: str, vol: str) -> Column:
    return safe_div(fwd, vol)


def pct_signal(df: DataFrame, train: DataFrame, value: str, by: list[str], hi: float = 0.70, lo: float = 0.30) -> DataFrame:
    """1 above the training 70th percentile, -1 below the 30th; thresholds are exact."""
    cuts = quantiles(train, value, {"_hi": hi, "_lo": lo}, by)
    out = df.join(cuts, by, "left")
    v = F.col(value)
    return out.withColumn("pct_signal", F.when(v > F.col("_hi"), 1).when(v < F.col("_lo"), -1).otherwise(0)).drop("_hi", "_lo")


def rank_norm(df: DataFrame, train: DataFrame, value: str, by: list[str], name: str = "rank_norm") -> DataFrame:
    """Share of training values at or below each value.

    Worked out once per distinct value and joined back, so a value shared by very many rows is
    one row while ranks are carried.
    """
    known = [F.col(value).isNotNull()]
    both = df.filter(*known).select(*by, value, F.lit(0).alias("_train")).unionByName(
        train.filter(*known).select(*by, value, F.lit(1).alias("_train"))
    )
    cdf = value_cdf(both, value, by, {"_k": F.col("_train").cast("long")}, value_bounds(train, F.col(value)))
    share = safe_div(F.col("_k_below") + F.col("_k"), "_k_total")
    return df.join(cdf.select(*by, value, share.alias(name)), [*by, value], "left").select(*df.columns, name)


def ensemble(df: DataFrame, rule: str, p="p", pred_signal="pct_signal", rank="rank_norm") -> Column:
    """A: both agree. B: the first model unless the second contradicts. C: weighted score."""
    prob = F.when(F.col(p) > 0.60, 1).when(F.col(p) < 0.40, -1).otherwise(0)
    s = F.col(pred_signal)
    if rule == "A":
        return F.when((prob == 1) & (s == 1), 1).when((prob == -1) & (s == -1), -1).otherwise(0)
    if rule == "B":
        return F.when((prob == 1) & (s != -1), 1).when((prob == -1) & (s != 1), -1).otherwise(0)
    score = 0.6 * F.col(p) + 0.4 * F.col(rank)
    return F.when(score > 0.70, 1).when(score < 0.30, -1).otherwise(0)


# ---- regimes ---------------------------------------------------------------------------------


def vol_regime(ratio: str) -> Column:
    r = F.col(ratio)
    return F.when(r > 1.2, "expanding").when(r < 0.8, "compressing").otherwise("neutral")


def liquidity_regime(amplitude: str, q70: str, q30: str, volume_z: str) -> Column:
    a, z = F.col(amplitude), F.col(volume_z)
    return (
        F.when((a > F.col(q70)) & (z < -0.5), "fragile").when((a < F.col(q30)) & (z > 0.5), "accumulation").otherwise("neutral")
    )


def trend_regime(drawdown: str, ret21: str) -> Column:
    """Bull first, then bear, else sideways."""
    d, r = F.col(drawdown), F.col(ret21)
    return F.when((d > -0.10) & (r > 0), "Bull").when((d < -0.15) | (r < -0.05), "Bear").otherwise("Sideways")


def return_regime(ret: str, limit: float = 0.05) -> Column:
    return F.when(F.col(ret) > limit, "Bull").when(F.col(ret) < -limit, "Bear").otherwise("Sideways")


def extreme_flag(z: str, limit: float = 1.5) -> Column:
    return (flag(F.col(z) > limit) - flag(F.col(z) < -limit)).cast("int")


def size_position(kind: str, state: str, vol: str | None = None, p: str | None = None, fraction=0.5, target=0.4, floor=None) -> Column:
    """Position size while the state is 1: fixed fraction, volatility target, or confidence."""
    if kind == "fixed":
        size = F.lit(float(fraction))
    elif kind == "vol_target":
        size = F.when(F.col(vol) > 0, clip(F.lit(float(target)) / F.col(vol), 0.0, 1.0)).otherwise(F.lit(0.0))
    else:
        size = F.col(p) if floor is None else F.greatest(F.col(p), F.lit(float(floor)))
    return F.when(F.col(state) == 1, size).otherwise(F.lit(0.0))


def order_states(means: DataFrame, raw: str, column: str, by: list[str] | None = None, descending: bool = False) -> DataFrame:
    """Label raw states 0..n-1 by a column mean; by default the lowest mean is 0 (bear)."""
    c = F.col(column)
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(c.desc() if descending else c.asc(), raw)
    return means.withColumn("state", F.row_number().over(w) - 1)
