"""Feature sets. None of them looks ahead."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions.mathx import clip, flag, safe_div
from barline.grid import Grid, over_series
from barline.operators import rolling as R
from barline.operators.fill import padded
from barline.operators.resample import resample_mixed
from barline.operators.smoothing import macd


@dataclass(frozen=True)
class DailyParams:
    ret_short: int = 7
    ret_long: int = 30
    vol_short: int = 7
    vol_long: int = 30
    drawdown: int = 90
    ma: int = 30
    volume: int = 30
    skew: int = 30
    kurt: int = 30
    hurst: int = 30
    er: int = 10
    ma_fast: int = 50
    ma_slow: int = 200
    year: int = 252
    slope: int = 21
    bb: int = 20
    rsi_short: int = 14
    rsi_long: int = 30
    macd: tuple[int, int, int] = (12, 26, 9)
    atr: int = 14
    range: int = 30


MODEL_INPUT = [
    "log_return", "ret_short", "ret_long", "vol_short", "vol_long", "vol_ratio", "drawdown", "dist_to_ma",
    "range_rel", "volume_z", "skew_30d", "kurt_30d", "hurst_30d", "er_10d",
]


def _merge(*stages: dict) -> dict:
    out: dict = {}
    for s in stages:
        out |= s
    return out


def daily_features(df: DataFrame, grid: Grid, p: DailyParams = DailyParams(), drop_burnin: bool = True) -> DataFrame:
    """The daily columns: all window stages share one shuffle and one sort."""
    er = R.efficiency_ratio("close", p.er)
    rsi_move, rsi_s = R.rsi("close", p.rsi_short)
    rsi_l = R.rsi("close", p.rsi_long)[1]
    first = _merge(
        rsi_move,
        er[0],
        {
            "log_return": R.log_return("close"),
            "ret_short": R.ret("close", p.ret_short),
            "ret_long": R.ret("close", p.ret_long),
            "drawdown": R.drawdown("close", p.drawdown, 1),
            "dist_to_ma": R.dist_to_ma("close", p.ma),
            "range_rel": R.range_rel(),
            "volume_z": R.zscore("volume", p.volume),
            "dist_to_ma_200d": R.dist_to_ma("close", p.ma_slow),
            "ma_50_200_ratio": R.ma_ratio("close", p.ma_fast, p.ma_slow),
            "high_52w_dist": R.dist_to_high("close", p.year),
            "slope_21d": R.roll_slope("close", p.slope, "last"),
            "bb_width_20d": R.bb_width("close", p.bb),
            "bb_position": R.bb_position("close", p.bb),
            "roc_5": R.ret("close", 5),
            "roc_10": R.ret("close", 10),
            "roc_21": R.ret("close", 21),
            "price_vs_high_30d": R.dist_to_high("close", p.range),
            "price_vs_low_30d": R.dist_to_low("close", "close", p.range),
            "range_position_30d": R.range_position("close", "close", "close", p.range),
            "_tr": R.true_range(),
        },
    )
    second = _merge(
        er[1],
        rsi_s,
        rsi_l,
        {
            "vol_short": R.roll_std("log_return", p.vol_short),
            "vol_long": R.roll_std("log_return", p.vol_long),
            "skew_30d": R.roll_skew("log_return", p.skew),
            "kurt_30d": R.roll_kurt("log_return", p.kurt),
            "atr_14_norm": R.atr("_tr", "close", p.atr),
        },
    )
    third = {
        "er_10d": er[2]["er"],
        "vol_ratio": R.vol_ratio("vol_short", "vol_long"),
        "rsi_14_z": (F.col(f"rsi_{p.rsi_short}") - 50) / 20,
    }
    hurst = [{}, *R.hurst_stages("log_return", p.hurst, "hurst_30d")]
    out = over_series(macd(df, grid, "close", *p.macd), grid, *R.merged([first, second, third], hurst), counted=df)
    out = out.drop(*[c for c in out.columns if c.startswith("_")], "ema_fast", "ema_slow")
    return out.na.drop("any", subset=MODEL_INPUT) if drop_burnin else out


def with_positioning(features: DataFrame, ratios: DataFrame, grid: Grid) -> DataFrame:
    """Left join of every value column whose name mentions a ratio."""
    wanted = [c for c in ratios.columns if "ratio" in c.lower() and c not in features.columns]
    return features.join(ratios.select(*grid.key, grid.time, *wanted), [*grid.key, grid.time], "left")


def intraday_features(df: DataFrame, grid: Grid, vol: int = 6, volume: int = 30) -> DataFrame:
    """Five 4-hour columns; the return pads nulls forward first."""
    out = padded(df, grid, ["close"])
    return over_series(
        out,
        grid,
        {"return_4h": R.pct_change("close_pad"), "volume_zscore": R.zscore("volume", volume)},
        {"volatility_24h": R.roll_std("return_4h", vol)},
        {
            "buy_pressure": R.buy_pressure("taker_buy_quote_volume", "quote_volume"),
            "range_expansion": R.range_rel(),
        },
    ).drop("close_pad")


def derivatives_features(df: DataFrame, grid: Grid, momentum: int = 3, vol: int = 6, pressure: int = 180) -> DataFrame:
    out = padded(df, grid, ["oi_binance"])
    return over_series(
        out,
        grid,
        {
            "oi_momentum_12h": R.pct_change("oi_binance_pad", momentum),
            "_lr": R.log_return("oi_binance"),
            "funding_pressure": R.zscore("funding_oi_weighted", pressure, 1),
        },
        {
            "oi_volatility_24h": R.roll_std("_lr", vol),
            "funding_divergence": F.col("funding_oi_weighted") - F.col("funding_vol_weighted"),
            "leverage_expansion": F.ln(safe_div("oi_aggregated", "oi_binance")),
        },
    ).drop("_lr", "oi_binance_pad")


RANGES = ("r05", "r1", "r2")
SIDES = ("bids_usd", "asks_usd", "bids_quantity", "asks_quantity")


def orderbook_features(df: DataFrame, grid: Grid, n: int = 6) -> DataFrame:
    """Depth table (one row per range) to wide imbalance, ratio and depth columns with rolling statistics.

    The ranges are pivoted with conditional aggregates, so a time present in any range is kept.
    """
    wide = df.groupBy(*grid.key, grid.time).agg(
        *[F.max(F.when(F.col("range") == r, F.col(c))).alias(f"{c}_{r}") for r in RANGES for c in SIDES]
    )
    per_range: dict[str, Column] = {}
    for r in RANGES:
        bid, ask = F.col(f"bids_usd_{r}"), F.col(f"asks_usd_{r}")
        per_range[f"book_imbalance_{r}"] = clip(safe_div(bid - ask, bid + ask), -1.0, 1.0)
        per_range[f"bid_ask_ratio_{r}"] = safe_div(bid, ask)
        per_range[f"book_depth_{r}"] = bid + ask
    wide = wide.withColumns(per_range).withColumns(
        {
            "depth_gradient_near": F.col("book_imbalance_r05") - F.col("book_imbalance_r1"),
            "depth_gradient_far": F.col("book_imbalance_r1") - F.col("book_imbalance_r2"),
            "total_depth": F.col("book_depth_r1") + F.col("book_depth_r2"),
        }
    )
    out = over_series(
        wide,
        grid,
        {
            f"imbalance_ma_{n}": R.roll_mean("book_imbalance_r1", n),
            f"imbalance_std_{n}": R.roll_std("book_imbalance_r1", n),
            "depth_zscore_24h": R.zscore("book_depth_r1", n),
        },
    )
    return out.drop(*[f"{c}_{r}" for r in ("r05", "r2") for c in SIDES])


def index_features(df: DataFrame, grid: Grid, names: list[str], z: int = 30, change: int = 7, ma: int = 30, value: str = "value") -> DataFrame:
    """z-score, change and ratio to the mean per index, pivoted wide on time."""
    out = padded(df, grid, [value])
    out = over_series(
        out,
        grid,
        {
            "zscore": R.zscore(value, z, 1, 2),
            "change": R.pct_change(f"{value}_pad", change),
            "_ma": R.roll_mean(value, ma, 1),
        },
        {"ma_ratio": safe_div(value, "_ma")},
    )
    key = F.col(grid.key[0])
    columns = {f"zscore_{z}d": "zscore", f"change_{change}d": "change", "ma_ratio": "ma_ratio"}
    return out.groupBy(grid.time).agg(
        *[F.max(F.when(key == n, F.col(src))).alias(f"{n}_{label}") for n in names for label, src in columns.items()]
    )


@dataclass(frozen=True)
class BusinessDayParams:
    ret_short: int = 7
    ret_long: int = 30
    vol_short: int = 7
    vol_long: int = 30
    drawdown: int = 90
    ma: int = 30
    volume: int = 30
    log_returns: bool = True
    vol_ratio: bool = True
    use_drawdown: bool = True
    volume_z: bool = True
    range_rel: bool = True


def bday_features(df: DataFrame, grid: Grid, p: BusinessDayParams = BusinessDayParams()) -> DataFrame:
    """Business-day set with switches; rows missing any new column are dropped."""
    first: dict = {"log_return": R.log_return("close"), "dist_to_ma": R.dist_to_ma("close", p.ma)}
    second: dict = {"vol_short": R.roll_std("log_return", p.vol_short), "vol_long": R.roll_std("log_return", p.vol_long)}
    if p.log_returns:
        second |= {"ret_short": R.roll_sum("log_return", p.ret_short), "ret_long": R.roll_sum("log_return", p.ret_long)}
    else:
        first |= {"ret_short": R.ret("close", p.ret_short), "ret_long": R.ret("close", p.ret_long)}
    if p.use_drawdown:
        first["drawdown"] = R.drawdown("close", p.drawdown, 1)
    if p.range_rel:
        first["range_rel"] = R.range_rel()
    if p.volume_z:
        first["volume_z"] = R.zscore("volume", p.volume)
    third: dict = {"vol_ratio": R.vol_ratio("vol_short", "vol_long")} if p.vol_ratio else {}
    out = over_series(df, grid, first, second, third)
    return out.na.drop("any", subset=[*first, *second, *third])


def cross_features(
    df: DataFrame, grid: Grid, anchor: str, leader: str, rs: int = 5, beta: int = 30, dd: int = 90
) -> DataFrame:
    """Per time of the anchor series: relative strength, dispersion, mean beta and mean relative drawdown.

    Other series are taken at the anchor's times; a series without a row that day is left out of
    that day's means, and the day stays.
    """
    key, t = grid.key[0], grid.time
    base = over_series(
        df.filter(F.col(key) == anchor).select(key, t, "close"),
        grid,
        {"_ra": R.log_return("close"), "_dda": R.drawdown("close", dd, 1)},
    ).select(t, "_ra", "_dda")
    others = df.filter(F.col(key) != anchor).select(key, t, "close").join(base, t)
    out = over_series(
        others,
        grid,
        {"_r": R.log_return("close"), "_r5": R.log_return("close", rs), "_dd": R.drawdown("close", dd, 1)},
        {"_sum": R.roll_sum("_r", rs), "_suma": R.roll_sum("_ra", rs), "_beta": R.roll_beta("_r", "_ra", beta)},
    )
    per_time = out.groupBy(t).agg(
        F.max(F.when(F.col(key) == leader, F.col("_sum") - F.col("_suma"))).alias("relative_strength"),
        F.stddev_samp("_r5").alias("dispersion"),
        F.avg("_beta").alias("mean_beta"),
        F.avg("_dd").alias("_mean_dd"),
    )
    return base.join(per_time, t, "left").select(
        t,
        "relative_strength",
        "dispersion",
        "mean_beta",
        (F.col("_mean_dd") - F.col("_dda")).alias("mean_relative_drawdown"),
    )


def liquidity_signals(df: DataFrame, grid: Grid, balance: str = "balance", money: str = "money") -> DataFrame:
    """Balance-sheet and money-supply signals on a filled daily grid."""
    out = padded(df, grid, [balance, money])
    b, m = f"{balance}_pad", f"{money}_pad"
    return over_series(
        out,
        grid,
        {
            "change_4w": R.pct_change(b, 20),
            "change_12w": R.pct_change(b, 60),
            "zscore_52w": R.zscore(balance, 260),
            "trend_8w": R.roll_slope(balance, 40),
            "money_3m": R.pct_change(m, 63),
            "money_yoy": R.pct_change(m, 252),
        },
        {
            "money_impulse": R.diff("money_3m"),
            "_mz": R.zscore("money_yoy", 260),
            "liquidity_regime": F.when(F.col("change_12w") > 0.01, 1).when(F.col("change_12w") < -0.01, -1).otherwise(0),
        },
        {"liquidity_score": F.col("zscore_52w") * 0.6 + F.col("_mz") * 0.4},
    ).drop("_mz", b, m)


def macro_signals(df: DataFrame, grid: Grid) -> DataFrame:
    """Rate expectation, curve, surprise, volatility z, index returns and inflation against 2 %.

    Columns: rate_3m, policy_rate, rate_10y, rate_2y, vix, dxy, equity, cpi.
    """
    out = padded(df, grid, ["dxy", "equity", "cpi"])
    out = out.withColumns(
        {
            "rate_expectation": F.col("rate_3m") - F.col("policy_rate"),
            "yield_curve_2y10y": F.col("rate_10y") - F.col("rate_2y"),
        }
    )
    return over_series(
        out,
        grid,
        {
            "rate_expectation_ch30": R.diff("rate_expectation", 30),
            "rate_2y_change": R.diff("rate_2y"),
            "vix_zscore_30d": R.zscore("vix", 30),
            "dxy_return_5d": R.pct_change("dxy_pad", 5),
            "equity_return_5d": R.pct_change("equity_pad", 5),
            "_yoy": R.pct_change("cpi_pad", 252),
        },
        {"cpi_yoy": F.col("_yoy") * 100, "cpi_vs_target": F.col("_yoy") * 100 - 2.0},
    ).drop("_yoy", "dxy_pad", "equity_pad", "cpi_pad")


def positioning_signals(df: DataFrame, grid: Grid) -> DataFrame:
    """Open-interest and funding signals. Columns: close, oi_agg, oi_binance, funding_oi, funding_vol."""
    out = padded(df, grid, ["oi_agg", "oi_binance", "close"])
    out = out.withColumns({"oi_price_ratio": safe_div("oi_agg", "close"), "oi_log": F.ln("oi_agg")})
    z14 = F.col("funding_zscore_14d")
    return over_series(
        out,
        grid,
        {
            **{f"oi_change_{k}d": R.pct_change("oi_agg_pad", k) for k in (1, 3, 7, 14)},
            "oi_price_ratio_z": R.zscore("oi_price_ratio", 30),
            "oi_log_diff_3d": R.diff("oi_log", 3),
            "oi_zscore_14d": R.zscore("oi_agg", 14),
            "oi_zscore_30d": R.zscore("oi_agg", 30),
            "price_change_3d": R.pct_change("close_pad", 3),
            "_binance_3d": R.pct_change("oi_binance_pad", 3),
            "funding_zscore_14d": R.zscore("funding_oi", 14),
            "funding_zscore_30d": R.zscore("funding_oi", 30),
            "funding_trend_7d": R.diff("funding_oi", 7),
            "_s5": R.roll_std("oi_agg", 5),
            "_s30": R.roll_std("oi_agg", 30),
        },
        {
            "oi_momentum": R.diff("oi_change_3d", 3),
            "price_oi_div": F.col("price_change_3d") - F.col("oi_change_3d"),
            "oi_exchange_div": F.col("_binance_3d") - F.col("oi_change_3d"),
            "leverage_stress": F.col("oi_change_3d") * z14,
            "leverage_expansion": F.col("oi_change_3d") * flag(F.col("funding_oi") > 0),
            "oi_vol_ratio": safe_div("_s5", "_s30"),
            "oi_extreme": (flag(F.col("oi_zscore_30d") > 1.5) - flag(F.col("oi_zscore_30d") < -1.5)).cast("int"),
            "funding_extreme_long": flag(z14 > 2.0).cast("int"),
            "funding_extreme_short": flag(z14 < -2.0).cast("int"),
            "funding_divergence": F.col("funding_oi") - F.col("funding_vol"),
        },
    ).drop("_binance_3d", "_s5", "_s30", "oi_agg_pad", "oi_binance_pad", "close_pad")


def liquidation_signals(df: DataFrame, grid: Grid, long: str = "liq_long", short: str = "liq_short") -> DataFrame:
    out = over_series(df, grid, {"liq_long_zscore": R.zscore(long, 14), "liq_short_zscore": R.zscore(short, 14)})
    return out.withColumns(
        {
            "liq_intensity": F.col(long) / (F.col(long) + F.col(short) + 1),
            "liq_cascade_risk": flag(F.col("liq_long_zscore") > 2.0).cast("int"),
        }
    )


def spec_features(df: DataFrame, grid: Grid) -> DataFrame:
    """The per-asset set of the feature specification: 7/21/63-row statistics of bars."""
    h, lo, o, c = (F.col(x) for x in ("high", "low", "open", "close"))
    out = df.withColumns(
        {
            "candle_body_ratio": safe_div(F.abs(c - o), h - lo),
            "upper_shadow_ratio": safe_div(h - F.greatest(o, c), h - lo),
            "lower_shadow_ratio": safe_div(F.least(o, c) - lo, h - lo),
            "_pressure": safe_div("taker_buy_quote_volume", "quote_volume"),
            "_trades": F.col("trades").cast("double"),
        }
    ).withColumn("_shadow", F.col("upper_shadow_ratio") + F.col("lower_shadow_ratio"))
    first: dict = {"log_return_1d": R.log_return("close"), "volume_change_7d": R.ret("volume", 7)}
    for n in (7, 21, 63):
        first |= {
            f"log_return_{n}d": R.log_return("close", n),
            f"price_ma_{n}d": R.roll_mean("close", n),
            f"price_slope_{n}d": R.roll_slope("close", n),
        }
    for n in (7, 21):
        first |= {
            f"_hi_{n}": R.roll_max("high", n),
            f"_lo_{n}": R.roll_min("low", n),
            f"volume_ma_{n}d": R.roll_mean("volume", n),
            f"volume_zscore_{n}d": R.zscore("volume", n),
            f"quote_volume_ma_{n}d": R.roll_mean("quote_volume", n),
            f"trades_ma_{n}d": R.roll_mean("_trades", n),
            f"buy_pressure_{n}d": R.roll_mean("_pressure", n),
            f"candle_body_ratio_{n}d": R.roll_mean("candle_body_ratio", n),
            f"shadow_ratio_{n}d": R.roll_mean("_shadow", n),
        }
    first["trades_zscore_7d"] = R.zscore("_trades", 7)
    r = "log_return_1d"
    second: dict = {"_abs": F.abs(r), "_lag1": R.lagged(r, 1), "_lag7": R.lagged(r, 7)}
    second |= {f"volatility_{n}d": R.roll_std(r, n) for n in (7, 21, 63)}
    for n in (7, 21):
        hi, low = F.col(f"_hi_{n}"), F.col(f"_lo_{n}")
        second |= {
            f"price_range_{n}d": safe_div(hi - low, f"price_ma_{n}d"),
            f"price_position_{n}d": safe_div(c - low, hi - low),
            f"high_low_ratio_{n}d": safe_div(hi, low),
        }
    third: dict = {f"realized_volatility_{n}d": R.roll_sum("_abs", n) for n in (7, 21)}
    third |= {"autocorr_return_1d": R.roll_corr(r, "_lag1", 21), "autocorr_return_7d": R.roll_corr(r, "_lag7", 63)}
    hurst = [[{}, *R.hurst_stages(r, n, f"hurst_exponent_{n}d")] for n in (21, 63)]
    out = over_series(out, grid, *R.merged([first, second, third], *hurst))
    return out.drop(*[x for x in out.columns if x.startswith("_")])


def macro_state(df: DataFrame, grid: Grid, value: str = "close") -> DataFrame:
    """Cross-asset state per time from series vix, sp500, dxy, gold, rate_10y, rate_2y, cpi, growth.

    Missing series give null columns.
    """
    key, t = F.col(grid.key[0]), grid.time
    out = over_series(
        df.select(*grid.key, t, value),
        grid,
        {
            "_z63": R.zscore(value, 63),
            "_z252": R.zscore(value, 252),
            "_r21": R.ret(value, 21),
            "_s63": R.roll_std(value, 63),
        },
    )

    def of(name: str, column: str) -> Column:
        return F.max(F.when(key == name, F.col(column)))

    wide = out.groupBy(t).agg(
        of("vix", value).alias("vix_level"),
        of("vix", "_z63").alias("vix_zscore_63"),
        of("sp500", "_r21").alias("_eq21"),
        of("sp500", "_z63").alias("_eqz"),
        of("sp500", "_s63").alias("equity_vol_63"),
        of("sp500", value).alias("_eq"),
        of("dxy", "_z252").alias("dxy_zscore_252"),
        of("rate_10y", value).alias("_long"),
        of("rate_2y", value).alias("_short"),
        of("cpi", "_z252").alias("_cpi"),
        of("growth", "_z252").alias("_growth"),
        of("gold", value).alias("_gold"),
    )
    return wide.select(
        t,
        "vix_level",
        "vix_zscore_63",
        (F.col("vix_zscore_63") - F.col("_eq21")).alias("equity_vol_risk_index"),
        "dxy_zscore_252",
        (F.col("_long") - F.col("_cpi")).alias("real_rate_proxy"),
        (F.col("_long") - F.col("_short")).alias("yield_curve_slope"),
        (F.col("_growth") - F.col("_cpi")).alias("growth_vs_inflation_score"),
        safe_div("_gold", "_eq").alias("gold_vs_equity_ratio"),
        "equity_vol_63",
        (F.col("_eqz") > 1.5).alias("vol_regime_flag"),
    )


def stress_context(df: DataFrame, grid: Grid, n: int = 30) -> DataFrame:
    """Daily derivatives context: stress flags against rolling quantiles, score, volatility rank and its trend.

    Input is the derivatives feature table on the fine grid; comparisons with missing values give 0.
    """
    rules = {
        "oi_momentum_mean": ("oi_momentum_12h", "mean"),
        "oi_momentum_max": ("oi_momentum_12h", "max"),
        "oi_volatility_mean": ("oi_volatility_24h", "mean"),
        "funding_divergence_mean": ("funding_divergence", "mean"),
        "funding_divergence_max": ("funding_divergence", "max"),
        "leverage_mean": ("leverage_expansion", "mean"),
        "leverage_max": ("leverage_expansion", "max"),
    }
    daily = resample_mixed(df, rules, "day", grid.key, grid.time)
    return over_series(
        daily,
        grid,
        {
            "_oi": R.roll_quantile("oi_momentum_mean", n, 0.10, 2),
            "_fund": R.roll_quantile("funding_divergence_mean", n, 0.90, 2),
            "_lev": R.roll_quantile("leverage_mean", n, 0.90, 2),
            "vol_percentile": R.roll_pct_rank("oi_volatility_mean", n),
        },
        {
            "oi_stress": flag(F.col("oi_momentum_mean") < F.col("_oi")),
            "funding_stress": flag(F.col("funding_divergence_mean") > F.col("_fund")),
            "leverage_stress": flag(F.col("leverage_mean") > F.col("_lev")),
            "vol_trend": R.diff("vol_percentile", 5),
        },
        {"stress_score": F.col("oi_stress") + F.col("funding_stress") + F.col("leverage_stress")},
    ).drop("_oi", "_fund", "_lev")


