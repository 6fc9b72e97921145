"""Queries over whole feature sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.functions.mathx import safe_div
from barline.grid import over_series
from barline.operators import features as X
from barline.operators import rolling as R
from barline.plans.adapters import (
    BARS_1D,
    BARS_1D_SQL,
    BARS_4H,
    BARS_4H_SQL,
    DEPTH_SQL,
    DERIVATIVES_SQL,
    bars_1d,
    bars_1d_sql,
    bars_4h,
    depth,
    derivatives,
    frame,
    lag,
    roll,
)
from barline.plans.registry import query
from barline.plans.windows import rsi_sql


def z_sql(x: str, n: int, least: int | None = None, std_least: int | None = None) -> str:
    s = std_least or (max(2, least) if least else n)
    return f"({x} - {roll(f'avg({x})', x, n, least)}) / nullif({roll(f'stddev_samp({x})', x, n, s)}, 0)"


DAILY_COLS = (
    "log_return ret_short ret_long vol_short vol_long vol_ratio drawdown dist_to_ma range_rel volume_z er_10d "
    "dist_to_ma_200d ma_50_200_ratio high_52w_dist slope_21d bb_width_20d rsi_14_z rsi_30 roc_5 roc_10 roc_21 "
    "price_vs_high_30d price_vs_low_30d range_position_30d bb_position atr_14_norm macd_hist_norm"
).split()


@query(
    "daily_features",
    "series_id ts skew_30d:5 kurt_30d:5 hurst_30d:6 " + " ".join(f"{c}:6" for c in DAILY_COLS),
    f"""{BARS_1D_SQL}, a AS (SELECT *, ln(close / {lag('close')}) AS log_return, close - {lag('close')} AS mv, {lag('close')} AS pc,
      abs(close - {lag('close', 10)}) AS er_m, abs(close - {lag('close')}) AS er_s, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS n,
      list(close) OVER {frame(-600)} AS hist FROM bars),
    b AS (SELECT *, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr, {roll('sum(er_s)', 'er_s', 10)} AS er_p,
      {roll('stddev_samp(log_return)', 'log_return', 7)} AS vol_short, {roll('stddev_samp(log_return)', 'log_return', 30)} AS vol_long,
      {roll('max(close)', 'close', 30)} AS hi, {roll('min(close)', 'close', 30)} AS lo, {roll('avg(close)', 'close', 20)} AS m20, {roll('stddev_samp(close)', 'close', 20)} AS s20,
      list_reduce(hist, lambda a, v: a * (1 - 2.0::DOUBLE / 13) + v * (2.0::DOUBLE / 13)) - list_reduce(hist, lambda a, v: a * (1 - 2.0::DOUBLE / 27) + v * (2.0::DOUBLE / 27)) AS macd,
      list(log_return) FILTER (WHERE log_return IS NOT NULL) OVER {frame(-29)} AS rl FROM a),
    c AS (SELECT *, list(macd) OVER {frame(-600)} AS mh FROM b),
    h0 AS (SELECT series_id, ts, list_avg(rl) AS m, list_stddev_pop(rl) AS s, unnest(rl) AS v, generate_subscripts(rl, 1) AS i FROM b WHERE len(rl) >= 30),
    h1 AS (SELECT series_id, ts, s, sum(v - m) OVER (PARTITION BY series_id, ts ORDER BY i) AS c FROM h0),
    h2 AS (SELECT series_id, ts, ln((max(c) - min(c)) / any_value(s)) / ln(30) AS hurst_30d FROM h1 GROUP BY 1, 2),
    d AS (SELECT c.*, h2.hurst_30d, close / {lag('close', 7)} - 1 AS ret_short, close / {lag('close', 30)} - 1 AS ret_long, vol_short / vol_long AS vol_ratio,
      close / {roll('max(close)', 'close', 90, 1)} - 1 AS drawdown, close / {roll('avg(close)', 'close', 30)} - 1 AS dist_to_ma, (high - low) / close AS range_rel,
      {z_sql('volume', 30)} AS volume_z, {roll('skewness(log_return)', 'log_return', 30)} AS skew_30d, {roll('kurtosis(log_return)', 'log_return', 30)} AS kurt_30d,
      CASE WHEN er_p > 0 THEN er_m / er_p ELSE 0 END AS er_10d, close / {roll('avg(close)', 'close', 200)} - 1 AS dist_to_ma_200d,
      {roll('avg(close)', 'close', 50)} / {roll('avg(close)', 'close', 200)} - 1 AS ma_50_200_ratio, close / {roll('max(close)', 'close', 252)} - 1 AS high_52w_dist,
      {roll('regr_slope(close, n)', 'close', 21)} / close AS slope_21d, 4 * s20 / m20 AS bb_width_20d, ({rsi_sql(14)} - 50) / 20 AS rsi_14_z, {rsi_sql(30)} AS rsi_30,
      close / {lag('close', 5)} - 1 AS roc_5, close / {lag('close', 10)} - 1 AS roc_10, close / {lag('close', 21)} - 1 AS roc_21,
      (close - hi) / hi AS price_vs_high_30d, (close - lo) / lo AS price_vs_low_30d, (close - lo) / (hi - lo) AS range_position_30d,
      (close - (m20 - 2 * s20)) / (4 * s20) AS bb_position, {roll('avg(tr)', 'tr', 14)} / close AS atr_14_norm,
      (macd - list_reduce(mh, lambda a, v: a * 0.8::DOUBLE + v * 0.2::DOUBLE)) / close AS macd_hist_norm FROM c LEFT JOIN h2 USING (series_id, ts)),
    t AS (SELECT * FROM d WHERE ret_long IS NOT NULL AND vol_long IS NOT NULL AND hurst_30d IS NOT NULL AND skew_30d IS NOT NULL)""",
)
def _(spark, sf):
    return X.daily_features(bars_1d(spark, sf), BARS_1D)


@query(
    "daily_positioning",
    "series_id ts ret_short:6 buy_ratio:6 size_ratio:6",
    f"""{BARS_1D_SQL}, a AS (SELECT series_id, ts, close / {lag('close', 7)} - 1 AS ret_short, volume FROM bars),
    p AS (SELECT series_id, ts, taker_buy_quote_volume / quote_volume AS buy_ratio, volume / trades / close AS size_ratio FROM bars WHERE isodow(ts) <= 5),
    t AS (SELECT series_id, ts, ret_short, buy_ratio, size_ratio FROM a LEFT JOIN p USING (series_id, ts))""",
)
def _(spark, sf):
    """Daily features with the ratios of the positioning table; its other columns stay out."""
    bars = bars_1d(spark, sf)
    daily = over_series(bars, BARS_1D, {"ret_short": R.ret("close", 7)}).select("series_id", "ts", "ret_short", "volume")
    size = safe_div(F.col("volume") / F.col("trades"), "close")
    ratios = bars.filter(F.weekday("ts") < 5).select("series_id", "ts", "volume", "trades", safe_div("taker_buy_quote_volume", "quote_volume").alias("buy_ratio"), size.alias("size_ratio"))
    return X.with_positioning(daily, ratios, BARS_1D)


@query(
    "intraday_features",
    "series_id ts return_4h:6 volatility_24h:6 volume_zscore:6 buy_pressure:6 range_expansion:6",
    f"""{BARS_4H_SQL}, a AS (SELECT *, close / {lag('close')} - 1 AS return_4h FROM bars),
    t AS (SELECT series_id, ts, return_4h, {roll('stddev_samp(return_4h)', 'return_4h', 6)} AS volatility_24h, {z_sql('volume', 30)} AS volume_zscore,
      least(greatest(taker_buy_quote_volume / nullif(quote_volume, 0), 0), 1) AS buy_pressure, CASE WHEN close > 0 THEN (high - low) / close END AS range_expansion FROM a)""",
)
def _(spark, sf):
    return X.intraday_features(bars_4h(spark, sf), BARS_4H)


DERIV_F_SQL = f"""{DERIVATIVES_SQL}, dp AS (SELECT *, last_value(oi_binance IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts) AS oip,
      ln(oi_binance / nullif({lag('oi_binance')}, 0)) AS lr FROM deriv),
    df AS (SELECT series_id, ts, oip / nullif({lag('oip', 3)}, 0) - 1 AS oi_momentum_12h, {roll('stddev_samp(lr)', 'lr', 6)} AS oi_volatility_24h,
      {z_sql('funding_oi_weighted', 180, 1)} AS funding_pressure, funding_oi_weighted - funding_vol_weighted AS funding_divergence,
      ln(oi_aggregated / nullif(oi_binance, 0)) AS leverage_expansion FROM dp)"""


@query(
    "derivatives_features",
    "series_id ts oi_momentum_12h:6 oi_volatility_24h:6 funding_pressure:6 funding_divergence:6 leverage_expansion:6",
    f"{DERIV_F_SQL}, t AS (SELECT * FROM df)",
)
def _(spark, sf):
    return X.derivatives_features(derivatives(spark, sf), BARS_1D)


def q_sql(x: str, q: float) -> str:
    return roll(f"quantile_cont({x}, {q})", x, 30, 2)


@query(
    "stress_context",
    "series_id ts oi_stress:1 funding_stress:1 leverage_stress:1 stress_score:1 vol_percentile:6 vol_trend:6",
    f"""{DERIV_F_SQL}, d AS (SELECT series_id, date_trunc('week', ts) AS ts, avg(oi_momentum_12h) AS om, avg(funding_divergence) AS fd, avg(leverage_expansion) AS le,
      avg(oi_volatility_24h) AS ov FROM df GROUP BY 1, date_trunc('week', ts)),
    s AS (SELECT *, coalesce((om < {q_sql('om', 0.1)})::INT, 0) AS oi_stress, coalesce((fd > {q_sql('fd', 0.9)})::INT, 0) AS funding_stress,
      coalesce((le > {q_sql('le', 0.9)})::INT, 0) AS leverage_stress, list(ov) OVER {frame(-29, -1)} AS before, count(*) OVER {frame(-29, -1)} AS n, count(ov) OVER {frame(-29)} AS seen FROM d),
    v AS (SELECT *, oi_stress + funding_stress + leverage_stress AS stress_score,
      CASE WHEN seen >= 2 AND n > 0 THEN CASE WHEN ov IS NULL THEN 0.0 ELSE len(list_filter(before, lambda v: v < ov)) / n END END AS vol_percentile FROM s),
    t AS (SELECT *, vol_percentile - {lag('vol_percentile', 5)} AS vol_trend FROM v)""",
)
def _(spark, sf):
    fine = X.derivatives_features(derivatives(spark, sf), BARS_1D)
    weekly = fine.withColumn("ts", F.date_trunc("week", "ts"))
    return X.stress_context(weekly, BARS_1D)


BOOK_COLS = [
    *[f"{a}_{r}" for r in X.RANGES for a in ("book_imbalance", "bid_ask_ratio")],
    "depth_gradient_near", "depth_gradient_far", "imbalance_ma_6", "imbalance_std_6", "depth_zscore_24h",
]


@query(
    "orderbook_features",
    "series_id ts total_depth:2 " + " ".join(f"{c}:6" for c in BOOK_COLS),
    f"""{DEPTH_SQL}, w AS (SELECT series_id, ts, {', '.join(f"max(bids_usd) FILTER (WHERE range = '{r}') AS b_{r}, max(asks_usd) FILTER (WHERE range = '{r}') AS a_{r}" for r in X.RANGES)} FROM depth GROUP BY 1, 2),
    f AS (SELECT *, {', '.join(f"(b_{r} - a_{r}) / nullif(b_{r} + a_{r}, 0) AS book_imbalance_{r}, b_{r} / nullif(a_{r}, 0) AS bid_ask_ratio_{r}, b_{r} + a_{r} AS d_{r}" for r in X.RANGES)} FROM w),
    t AS (SELECT *, d_r1 + d_r2 AS total_depth, book_imbalance_r05 - book_imbalance_r1 AS depth_gradient_near, book_imbalance_r1 - book_imbalance_r2 AS depth_gradient_far,
      {roll('avg(book_imbalance_r1)', 'book_imbalance_r1', 6)} AS imbalance_ma_6, {roll('stddev_samp(book_imbalance_r1)', 'book_imbalance_r1', 6)} AS imbalance_std_6,
      {z_sql('d_r1', 6)} AS depth_zscore_24h FROM f)""",
)
def _(spark, sf):
    return X.orderbook_features(depth(spark, sf), BARS_1D)


INDICES = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "unspecified", "5-LOW": "low"}
INDEX_LABELS = {"zscore_30d": "z", "change_7d": "change", "ma_ratio": "ma"}


@query(
    "index_features",
    "ts " + " ".join(f"{n}_{label}:6" for n in INDICES.values() for label in INDEX_LABELS.values()),
    f"""{BARS_1D_SQL}, a AS (SELECT series_id, ts, {z_sql('close', 30, 1)} AS z, close / {lag('close', 7)} - 1 AS change, close / {roll('avg(close)', 'close', 30, 1)} AS ma FROM bars),
    t AS (SELECT ts, {', '.join(f"max({c}) FILTER (WHERE series_id = '{s}') AS {n}_{c}" for s, n in INDICES.items() for c in INDEX_LABELS.values())} FROM a GROUP BY 1)""",
)
def _(spark, sf):
    bars = bars_1d(spark, sf).select("series_id", "ts", F.col("close").alias("value"))
    out = X.index_features(bars, BARS_1D, list(INDICES))
    return out.withColumnsRenamed({f"{s}_{a}": f"{n}_{b}" for s, n in INDICES.items() for a, b in INDEX_LABELS.items()})


@query(
    "business_day_features",
    "series_id ts log_return:6 ret_short:6 ret_long:6 vol_short:6 vol_long:6 vol_ratio:6 drawdown:6 dist_to_ma:6 range_rel:6 volume_z:6",
    f"""{BARS_1D_SQL}, wk AS (SELECT * FROM bars WHERE isodow(ts) <= 5), a AS (SELECT *, ln(close / {lag('close')}) AS log_return FROM wk),
    b AS (SELECT *, {roll('sum(log_return)', 'log_return', 7)} AS ret_short, {roll('sum(log_return)', 'log_return', 30)} AS ret_long,
      {roll('stddev_samp(log_return)', 'log_return', 7)} AS vol_short, {roll('stddev_samp(log_return)', 'log_return', 30)} AS vol_long,
      close / {roll('max(close)', 'close', 90, 1)} - 1 AS drawdown, close / {roll('avg(close)', 'close', 30)} - 1 AS dist_to_ma, (high - low) / close AS range_rel, {z_sql('volume', 30)} AS volume_z FROM a),
    t AS (SELECT *, vol_short / vol_long AS vol_ratio FROM b WHERE ret_long IS NOT NULL)""",
)
def _(spark, sf):
    return X.bday_features(bars_1d(spark, sf).filter(F.weekday("ts") < 5), BARS_1D)


@query(
    "cross_series_features",
    "ts relative_strength:6 dispersion:6 mean_beta:6 mean_relative_drawdown:6",
    f"""{BARS_1D_SQL}, an AS (SELECT ts, ln(close / lag(close) OVER (ORDER BY ts)) AS ra, close / max(close) OVER (ORDER BY ts ROWS 89 PRECEDING) - 1 AS dda FROM bars WHERE series_id = '1-URGENT'),
    o AS (SELECT b.series_id, b.ts, close, ra FROM bars b JOIN an USING (ts) WHERE series_id <> '1-URGENT'),
    p AS (SELECT *, ln(close / {lag('close')}) AS r, ln(close / {lag('close', 5)}) AS r5, close / {roll('max(close)', 'close', 90, 1)} - 1 AS dd FROM o),
    q AS (SELECT *, {roll('sum(r)', 'r', 5)} - {roll('sum(ra)', 'ra', 5)} AS rs,
      CASE WHEN {roll('var_samp(ra)', 'ra', 30)} > 0 AND count(r + ra) OVER {frame(-29)} >= 30 THEN covar_samp(r, ra) OVER {frame(-29)} / var_samp(ra) OVER {frame(-29)} END AS beta FROM p),
    g AS (SELECT ts, max(rs) FILTER (WHERE series_id = '2-HIGH') AS relative_strength, stddev_samp(r5) AS dispersion, avg(beta) AS mean_beta, avg(dd) AS mdd FROM q GROUP BY 1),
    t AS (SELECT an.ts, relative_strength, dispersion, mean_beta, mdd - dda AS mean_relative_drawdown FROM an LEFT JOIN g USING (ts))""",
)
def _(spark, sf):
    return X.cross_features(bars_1d(spark, sf), BARS_1D, "1-URGENT", "2-HIGH")


LIQ = "change_4w change_12w zscore_52w money_3m money_yoy money_impulse liquidity_score"


@query(
    "liquidity_signals",
    "series_id ts trend_8w:4 liquidity_regime:i " + " ".join(f"{c}:6" for c in LIQ.split()),
    f"""{BARS_1D_SQL}, a AS (SELECT series_id, ts, close AS balance, volume AS money, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS n FROM bars),
    b AS (SELECT *, balance / {lag('balance', 20)} - 1 AS change_4w, balance / {lag('balance', 60)} - 1 AS change_12w, {z_sql('balance', 260)} AS zscore_52w,
      {roll('regr_slope(balance, n)', 'balance', 40)} AS trend_8w, money / {lag('money', 63)} - 1 AS money_3m, money / {lag('money', 252)} - 1 AS money_yoy FROM a),
    t AS (SELECT *, money_3m - {lag('money_3m')} AS money_impulse, CASE WHEN change_12w > 0.01 THEN 1 WHEN change_12w < -0.01 THEN -1 ELSE 0 END AS liquidity_regime,
      zscore_52w * 0.6 + ({z_sql('money_yoy', 260)}) * 0.4 AS liquidity_score FROM b)""",
)
def _(spark, sf):
    bars = bars_1d(spark, sf).select("series_id", "ts", F.col("close").alias("balance"), F.col("volume").alias("money"))
    return X.liquidity_signals(bars, BARS_1D)


@query(
    "macro_signals",
    "series_id ts rate_expectation:4 rate_expectation_ch30:4 yield_curve_2y10y:4 rate_2y_change:4 vix_zscore_30d:6 dxy_return_5d:6 equity_return_5d:6 cpi_yoy:6 cpi_vs_target:6",
    f"""{BARS_1D_SQL}, a AS (SELECT *, close - open AS rate_expectation FROM bars),
    b AS (SELECT *, rate_expectation - {lag('rate_expectation', 30)} AS rate_expectation_ch30, high - low AS yield_curve_2y10y, low - {lag('low')} AS rate_2y_change,
      {z_sql('close', 30)} AS vix_zscore_30d, open / {lag('open', 5)} - 1 AS dxy_return_5d, high / {lag('high', 5)} - 1 AS equity_return_5d, (volume / {lag('volume', 252)} - 1) * 100 AS cpi_yoy FROM a),
    t AS (SELECT *, cpi_yoy - 2 AS cpi_vs_target FROM b)""",
)
def _(spark, sf):
    names = {"rate_3m": "close", "policy_rate": "open", "rate_10y": "high", "rate_2y": "low", "vix": "close", "dxy": "open", "equity": "high", "cpi": "volume"}
    bars = bars_1d(spark, sf).select("series_id", "ts", *[F.col(v).alias(k) for k, v in names.items()])
    return X.macro_signals(bars, BARS_1D)


POS6 = "oi_change_1d oi_change_3d oi_change_14d oi_price_ratio_z oi_log_diff_3d oi_zscore_14d oi_zscore_30d oi_momentum price_oi_div oi_exchange_div funding_zscore_14d funding_trend_7d leverage_stress leverage_expansion oi_vol_ratio funding_divergence"


@query(
    "positioning_signals",
    "series_id ts oi_extreme:i funding_extreme_long:i funding_extreme_short:i " + " ".join(f"{c}:6" for c in POS6.split()),
    f"""{BARS_1D_SQL}, a AS (SELECT series_id, ts, close, volume AS oi, taker_buy_base_volume + 1 AS ob, close - open AS fo, high - low AS fv FROM bars),
    b AS (SELECT *, oi / close AS pr, oi / {lag('oi')} - 1 AS oi_change_1d, oi / {lag('oi', 3)} - 1 AS oi_change_3d, oi / {lag('oi', 14)} - 1 AS oi_change_14d,
      ln(oi) - {lag('ln(oi)', 3)} AS oi_log_diff_3d, {z_sql('oi', 14)} AS oi_zscore_14d, {z_sql('oi', 30)} AS oi_zscore_30d, {z_sql('fo', 14)} AS funding_zscore_14d,
      fo - {lag('fo', 7)} AS funding_trend_7d, {roll('stddev_samp(oi)', 'oi', 5)} / nullif({roll('stddev_samp(oi)', 'oi', 30)}, 0) AS oi_vol_ratio, fo - fv AS funding_divergence,
      close / {lag('close', 3)} - 1 AS pc3, ob / {lag('ob', 3)} - 1 AS ob3 FROM a),
    t AS (SELECT *, {z_sql('pr', 30)} AS oi_price_ratio_z, oi_change_3d - {lag('oi_change_3d', 3)} AS oi_momentum, pc3 - oi_change_3d AS price_oi_div, ob3 - oi_change_3d AS oi_exchange_div,
      oi_change_3d * funding_zscore_14d AS leverage_stress, oi_change_3d * (fo > 0)::INT AS leverage_expansion,
      coalesce((oi_zscore_30d > 1.5)::INT, 0) - coalesce((oi_zscore_30d < -1.5)::INT, 0) AS oi_extreme,
      coalesce((funding_zscore_14d > 2)::INT, 0) AS funding_extreme_long, coalesce((funding_zscore_14d < -2)::INT, 0) AS funding_extreme_short FROM b)""",
)
def _(spark, sf):
    bars = bars_1d(spark, sf).select(
        "series_id", "ts", "close", F.col("volume").alias("oi_agg"), (F.col("taker_buy_base_volume") + 1).alias("oi_binance"),
        (F.col("close") - F.col("open")).alias("funding_oi"), (F.col("high") - F.col("low")).alias("funding_vol"),
    )
    return X.positioning_signals(bars, BARS_1D)


@query(
    "liquidation_signals",
    "series_id ts liq_long_zscore:6 liq_intensity:6 liq_cascade_risk:i",
    f"""{BARS_4H_SQL}, a AS (SELECT series_id, ts, taker_buy_base_volume AS l, volume - taker_buy_base_volume AS s FROM bars),
    b AS (SELECT *, {z_sql('l', 14)} AS liq_long_zscore FROM a),
    t AS (SELECT *, l / (l + s + 1) AS liq_intensity, coalesce((liq_long_zscore > 2)::INT, 0) AS liq_cascade_risk FROM b)""",
)
def _(spark, sf):
    bars = bars_4h(spark, sf).select(
        "series_id", "ts", F.col("taker_buy_base_volume").alias("liq_long"),
        (F.col("volume") - F.col("taker_buy_base_volume")).alias("liq_short"),
    )
    return X.liquidation_signals(bars, BARS_4H)


SPEC6 = (
    "log_return_1d log_return_21d volatility_21d volatility_63d price_range_21d realized_volatility_7d volume_zscore_21d volume_change_7d trades_zscore_7d "
    "buy_pressure_7d price_position_21d candle_body_ratio candle_body_ratio_7d shadow_ratio_7d high_low_ratio_7d autocorr_return_1d autocorr_return_7d"
)


@query(
    "specified_features",
    "series_id ts price_ma_63d:4 price_slope_63d:2 " + " ".join(f"{c}:6" for c in SPEC6.split()),
    f"""{BARS_1D_SQL}, a AS (SELECT *, ln(close / {lag('close')}) AS log_return_1d, abs(close - open) / nullif(high - low, 0) AS candle_body_ratio,
      (high - greatest(open, close)) / nullif(high - low, 0) + (least(open, close) - low) / nullif(high - low, 0) AS shadow, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS n,
      taker_buy_quote_volume / nullif(quote_volume, 0) AS bp, trades::DOUBLE AS tr FROM bars),
    b AS (SELECT *, {lag('log_return_1d')} AS l1, {lag('log_return_1d', 7)} AS l7, {roll('max(high)', 'high', 7)} AS h7, {roll('min(low)', 'low', 7)} AS w7,
      {roll('max(high)', 'high', 21)} AS h21, {roll('min(low)', 'low', 21)} AS w21, abs(log_return_1d) AS ab FROM a),
    t AS (SELECT *, ln(close / {lag('close', 21)}) AS log_return_21d, {roll('stddev_samp(log_return_1d)', 'log_return_1d', 21)} AS volatility_21d, {roll('stddev_samp(log_return_1d)', 'log_return_1d', 63)} AS volatility_63d,
      (h21 - w21) / {roll('avg(close)', 'close', 21)} AS price_range_21d, {roll('sum(ab)', 'ab', 7)} AS realized_volatility_7d, {z_sql('volume', 21)} AS volume_zscore_21d,
      volume / {lag('volume', 7)} - 1 AS volume_change_7d, {z_sql('tr', 7)} AS trades_zscore_7d, {roll('avg(bp)', 'bp', 7)} AS buy_pressure_7d, {roll('avg(close)', 'close', 63)} AS price_ma_63d,
      {roll('regr_slope(close, n)', 'close', 63)} AS price_slope_63d, (close - w21) / nullif(h21 - w21, 0) AS price_position_21d, {roll('avg(candle_body_ratio)', 'candle_body_ratio', 7)} AS candle_body_ratio_7d,
      {roll('avg(shadow)', 'shadow', 7)} AS shadow_ratio_7d, h7 / w7 AS high_low_ratio_7d,
      CASE WHEN count(log_return_1d + l1) OVER {frame(-20)} >= 21 THEN corr(log_return_1d, l1) OVER {frame(-20)} END AS autocorr_return_1d,
      CASE WHEN count(log_return_1d + l7) OVER {frame(-62)} >= 63 THEN corr(log_return_1d, l7) OVER {frame(-62)} END AS autocorr_return_7d FROM b)""",
)
def _(spark, sf):
    return X.spec_features(bars_1d(spark, sf), BARS_1D)


MAP = {"1-URGENT": "vix", "2-HIGH": "sp500", "3-MEDIUM": "dxy", "4-NOT SPECIFIED": "gold", "5-LOW": "rate_10y"}


@query(
    "macro_state",
    "ts vix_level:4 vix_zscore_63:6 equity_vol_risk_index:6 dxy_zscore_252:6 real_rate_proxy:4 yield_curve_slope:4 gold_vs_equity_ratio:6 equity_vol_63:4 regime_flag:1",
    f"""{BARS_1D_SQL}, st AS (SELECT * FROM (SELECT series_id, ts, close FROM bars UNION ALL SELECT 'cpi', ts, close FROM ({bars_1d_sql('o_orderstatus', 'x').split('AS (', 1)[1].rsplit(')', 1)[0]}) WHERE series_id = 'F')),
    a AS (SELECT *, {z_sql('close', 63)} AS z63, {z_sql('close', 252)} AS z252, close / {lag('close', 21)} - 1 AS r21, {roll('stddev_samp(close)', 'close', 63)} AS s63 FROM st),
    t AS (SELECT ts, max(close) FILTER (WHERE series_id = '1-URGENT') AS vix_level, max(z63) FILTER (WHERE series_id = '1-URGENT') AS vix_zscore_63,
      max(z63) FILTER (WHERE series_id = '1-URGENT') - max(r21) FILTER (WHERE series_id = '2-HIGH') AS equity_vol_risk_index, max(z252) FILTER (WHERE series_id = '3-MEDIUM') AS dxy_zscore_252,
      max(close) FILTER (WHERE series_id = '5-LOW') - max(z252) FILTER (WHERE series_id = 'cpi') AS real_rate_proxy, NULL::DOUBLE AS yield_curve_slope,
      max(close) FILTER (WHERE series_id = '4-NOT SPECIFIED') / max(close) FILTER (WHERE series_id = '2-HIGH') AS gold_vs_equity_ratio, max(s63) FILTER (WHERE series_id = '2-HIGH') AS equity_vol_63,
      (max(z63) FILTER (WHERE series_id = '2-HIGH') > 1.5)::INT AS regime_flag FROM a GROUP BY 1)""",
)
def _(spark, sf):
    name = F.create_map(*[F.lit(x) for kv in MAP.items() for x in kv])
    bars = bars_1d(spark, sf).select(name[F.col("series_id")].alias("series_id"), "ts", "close")
    cpi = bars_1d(spark, sf, "o_orderstatus").filter(F.col("series_id") == "F").select(F.lit("cpi").alias("series_id"), "ts", "close")
    return X.macro_state(bars.unionByName(cpi), BARS_1D).withColumn("regime_flag", F.col("vol_regime_flag").cast("double"))
