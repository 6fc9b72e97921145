"""Queries over rolling, running and forward-looking windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.functions.mathx import entropy2, entropy_n, flag, safe_div
from barline.grid import HOUR, first_of, max_of, over_series, running, sum_of
from barline.operators import labels as L
from barline.operators import rolling as R
from barline.operators import rules
from barline.operators.fill import cusum, padded
from barline.operators.runs import regime_age, run_durations
from barline.operators.smoothing import macd
from barline.plans.adapters import (
    BARS_1D,
    BARS_1D_SQL,
    BARS_1H,
    BARS_1H_SQL,
    BARS_4H,
    BARS_4H_SQL,
    bars_1d,
    bars_1h,
    bars_4h,
    frame,
    lag,
    lead,
    roll,
)
from barline.plans.registry import query

LR = f"ln(close / {lag('close')}) AS r"
RETURNS = f"{BARS_1D_SQL}, r1 AS (SELECT *, {LR} FROM bars)"


def returns_1d(spark, sf):
    return over_series(bars_1d(spark, sf), BARS_1D, {"r": R.log_return("close")}, keep_chunk=False)


@query(
    "rolling_returns",
    "series_id ts log_return:6 ret_7:6 ret_30:6 roc_5:6 roc_21:6",
    f"""{BARS_1D_SQL}, t AS (SELECT series_id, ts, ln(close / {lag('close')}) AS log_return,
    close / {lag('close', 7)} - 1 AS ret_7, close / {lag('close', 30)} - 1 AS ret_30,
    close / {lag('close', 5)} - 1 AS roc_5, close / {lag('close', 21)} - 1 AS roc_21 FROM bars)""",
)
def _(spark, sf):
    return over_series(
        bars_1d(spark, sf),
        BARS_1D,
        {
            "log_return": R.log_return("close"),
            "ret_7": R.ret("close", 7),
            "ret_30": R.ret("close", 30),
            "roc_5": R.ret("close", 5),
            "roc_21": R.ret("close", 21),
        },
    )


GAPPY = "CASE WHEN trades % 4 <> 0 THEN close END AS x"


@query(
    "pct_change_padded",
    "series_id ts pad:6 nopad:6 r5:6",
    f"""{BARS_1D_SQL}, g AS (SELECT *, {GAPPY} FROM bars),
    p AS (SELECT *, last_value(x IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY ts) AS xp FROM g),
    t AS (SELECT series_id, ts, xp / {lag('xp')} - 1 AS pad, x / {lag('x')} - 1 AS nopad,
          xp / {lag('xp', 5)} - 1 AS r5 FROM p)""",
)
def _(spark, sf):
    df = bars_1d(spark, sf).withColumn("x", F.when(F.col("trades") % 4 != 0, F.col("close")))
    df = padded(df, BARS_1D, ["x"])
    return over_series(
        df, BARS_1D, {"pad": R.pct_change("x_pad"), "nopad": R.ret("x"), "r5": R.pct_change("x_pad", 5)}
    )


@query(
    "rolling_volatility",
    "series_id ts sum_7:6 vol_7:6 vol_30:6 vol_ratio:6 vol_of_vol:6",
    f"""{RETURNS}, v AS (SELECT *, {roll('sum(r)', 'r', 7)} AS sum_7, {roll('stddev_samp(r)', 'r', 7)} AS vol_7,
      {roll('stddev_samp(r)', 'r', 30)} AS vol_30 FROM r1),
    t AS (SELECT *, CASE WHEN vol_30 > 0 THEN vol_7 / vol_30 END AS vol_ratio,
      {roll('stddev_samp(vol_7)', 'vol_7', 14)} AS vol_of_vol FROM v)""",
)
def _(spark, sf):
    return over_series(
        bars_1d(spark, sf),
        BARS_1D,
        {"r": R.log_return("close")},
        {"sum_7": R.roll_sum("r", 7), "vol_7": R.roll_std("r", 7), "vol_30": R.roll_std("r", 30)},
        {"vol_ratio": R.vol_ratio("vol_7", "vol_30"), "vol_of_vol": R.roll_std("vol_7", 14)},
    )


@query(
    "drawdowns",
    "series_id ts dd_90:6 dd_63_strict:6 dd_running:6",
    f"""{BARS_1D_SQL}, t AS (SELECT series_id, ts, close / {roll('max(close)', 'close', 90, 1)} - 1 AS dd_90,
      close / {roll('max(close)', 'close', 63)} - 1 AS dd_63_strict,
      close / max(close) OVER (PARTITION BY series_id ORDER BY ts) - 1 AS dd_running FROM bars)""",
)
def _(spark, sf):
    df = over_series(
        bars_1d(spark, sf),
        BARS_1D,
        {"dd_90": R.drawdown("close", 90, 1), "dd_63_strict": R.drawdown("close", 63)},
        keep_chunk=True,
    )
    df = running(df, BARS_1D, {"_top": max_of("close")})
    return df.withColumn("dd_running", safe_div("close", "_top") - 1.0)


@query(
    "moving_average_distance",
    "series_id ts dist_30:6 ma_ratio:6 crossed:i trend:6 high_52w:6",
    f"""{BARS_1D_SQL}, m AS (SELECT *, {roll('avg(close)', 'close', 30)} AS m30, {roll('avg(close)', 'close', 50)} AS m50,
      {roll('avg(close)', 'close', 200)} AS m200, {roll('max(close)', 'close', 252)} AS h252 FROM bars),
    t AS (SELECT series_id, ts, CASE WHEN m30 > 0 THEN close / m30 - 1 END AS dist_30, m50 / m200 - 1 AS ma_ratio,
      coalesce((m50 > m200 AND NOT lag(m50 > m200) OVER (PARTITION BY series_id ORDER BY ts))::INT, 0) AS crossed,
      abs(m50 / m200 - 1) AS trend, close / h252 - 1 AS high_52w FROM m)""",
)
def _(spark, sf):
    return over_series(
        bars_1d(spark, sf),
        BARS_1D,
        {
            "dist_30": R.dist_to_ma("close", 30),
            "m50": R.roll_mean("close", 50),
            "m200": R.roll_mean("close", 200),
            "ma_ratio": R.ma_ratio("close", 50, 200),
            "high_52w": R.dist_to_high("close", 252),
        },
        {"crossed": R.cross_up("m50", "m200"), "trend": F.abs("ma_ratio")},
    )


@query(
    "rolling_zscore",
    "series_id ts range_rel:6 z_30:6 z_180_loose:6 z_mixed:6",
    f"""{BARS_1D_SQL}, t AS (SELECT series_id, ts, CASE WHEN close > 0 THEN (high - low) / close END AS range_rel,
      (volume - {roll('avg(volume)', 'volume', 30)}) / nullif({roll('stddev_samp(volume)', 'volume', 30)}, 0) AS z_30,
      (close - {roll('avg(close)', 'close', 180, 1)}) / nullif({roll('stddev_samp(close)', 'close', 180, 2)}, 0) AS z_180_loose,
      (close - {roll('avg(close)', 'close', 30, 15)}) / nullif({roll('stddev_samp(close)', 'close', 30, 15)}, 0) AS z_mixed
      FROM bars)""",
)
def _(spark, sf):
    return over_series(
        bars_1d(spark, sf),
        BARS_1D,
        {
            "range_rel": R.range_rel(),
            "z_30": R.zscore("volume", 30),
            "z_180_loose": R.zscore("close", 180, 1),
            "z_mixed": R.zscore("close", 30, 15),
        },
    )


@query(
    "rolling_skew_kurtosis",
    "series_id ts skew_30:5 kurt_30:5",
    f"""{RETURNS}, t AS (SELECT series_id, ts, {roll('skewness(r)', 'r', 30)} AS skew_30,
      {roll('kurtosis(r)', 'r', 30)} AS kurt_30 FROM r1)""",
)
def _(spark, sf):
    return over_series(
        bars_1d(spark, sf),
        BARS_1D,
        {"r": R.log_return("close")},
        {"skew_30": R.roll_skew("r", 30), "kurt_30": R.roll_kurt("r", 30)},
    )


HURST_SQL = """(CASE WHEN len(l) >= {n} THEN (SELECT CASE WHEN mx = mn OR s = 0 THEN 0.5 ELSE ln((mx - mn) / s) / ln({n}) END
   FROM (SELECT max(c) AS mx, min(c) AS mn, any_value(sd) AS s FROM (
     SELECT sum(v - list_avg(l)) OVER (ORDER BY i) AS c, list_stddev_pop(l) AS sd
     FROM (SELECT unnest(l) AS v, generate_subscripts(l, 1) AS i)))) END)"""


@query(
    "hurst_exponent",
    "series_id ts hurst_30:6",
    f"""{RETURNS}, l AS (SELECT series_id, ts, list(r) FILTER (WHERE r IS NOT NULL) OVER {frame(-29)} AS l FROM r1),
    u AS (SELECT series_id, ts, list_avg(l) AS m, list_stddev_pop(l) AS s, unnest(l) AS v, generate_subscripts(l, 1) AS i
          FROM l WHERE len(l) >= 30),
    c AS (SELECT series_id, ts, s, sum(v - m) OVER (PARTITION BY series_id, ts ORDER BY i) AS c FROM u),
    g AS (SELECT series_id, ts, CASE WHEN max(c) = min(c) OR any_value(s) = 0 THEN 0.5
          ELSE ln((max(c) - min(c)) / any_value(s)) / ln(30) END AS hurst_30 FROM c GROUP BY 1, 2),
    t AS (SELECT b.series_id, b.ts, g.hurst_30 FROM r1 b LEFT JOIN g USING (series_id, ts))""",
)
def _(spark, sf):
    return over_series(bars_1d(spark, sf), BARS_1D, {"r": R.log_return("close")}, *R.hurst_stages("r", 30, "hurst_30"))


@query(
    "efficiency_and_slope",
    "series_id ts er:6 slope_21:6 slope_50_mean:6 slope_40:4",
    f"""{BARS_1D_SQL}, s AS (SELECT *, abs(close - {lag('close')}) AS step, abs(close - {lag('close', 10)}) AS mv,
      row_number() OVER (PARTITION BY series_id ORDER BY ts) AS n FROM bars),
    p AS (SELECT *, {roll('sum(step)', 'step', 10)} AS path FROM s),
    t AS (SELECT series_id, ts, CASE WHEN path > 0 THEN mv / path ELSE 0.0 END AS er,
      {roll('regr_slope(close, n)', 'close', 21)} / close AS slope_21,
      {roll('regr_slope(close, n)', 'close', 50)} / {roll('avg(close)', 'close', 50)} AS slope_50_mean,
      {roll('regr_slope(close, n)', 'close', 40)} AS slope_40 FROM p)""",
)
def _(spark, sf):
    er = R.efficiency_ratio("close", 10)
    er[0] |= {
        "slope_21": R.roll_slope("close", 21, "last"),
        "slope_50_mean": R.roll_slope("close", 50, "mean"),
        "slope_40": R.roll_slope("close", 40),
    }
    return over_series(bars_1d(spark, sf), BARS_1D, *er)


@query(
    "bollinger_bands",
    "series_id ts width:6 pos:6 pos_pop:6",
    f"""{BARS_1D_SQL}, m AS (SELECT *, {roll('avg(close)', 'close', 20)} AS m, {roll('stddev_samp(close)', 'close', 20)} AS s,
      {roll('stddev_pop(close)', 'close', 20)} AS sp FROM bars),
    t AS (SELECT series_id, ts, 4 * s / m AS width, CASE WHEN s > 0 THEN (close - (m - 2 * s)) / (4 * s) END AS pos,
      CASE WHEN sp > 0 THEN (close - (m - 2 * sp)) / (4 * sp) WHEN sp = 0 THEN 0.5 END AS pos_pop FROM m)""",
)
def _(spark, sf):
    return over_series(
        bars_1d(spark, sf),
        BARS_1D,
        {
            "width": R.bb_width("close", 20),
            "pos": R.bb_position("close", 20),
            "pos_pop": R.bb_position("close", 20, population=True, flat=0.5),
        },
    )


def rsi_sql(n: int, zero: str = "NULL", move: str = "mv") -> str:
    g = roll(f"avg(greatest({move}, 0.0))", move, n)
    loss = roll(f"avg(greatest(-{move}, 0.0))", move, n)
    return f"CASE WHEN {loss} = 0 THEN {zero} ELSE 100 - 100 / (1 + {g} / {loss}) END"


@query(
    "relative_strength_index",
    "series_id ts rsi_14:6 rsi_30:6 rsi_14_full:6 rsi_14_z:6",
    f"""{BARS_1D_SQL}, d AS (SELECT *, close - {lag('close')} AS mv FROM bars),
    q AS (SELECT series_id, ts, {rsi_sql(14)} AS rsi_14, {rsi_sql(30)} AS rsi_30, {rsi_sql(14, '100')} AS rsi_14_full FROM d),
    t AS (SELECT *, (rsi_14 - 50) / 20 AS rsi_14_z FROM q)""",
)
def _(spark, sf):
    move, r14 = R.rsi("close", 14)
    full = {"rsi_14_full": R.rsi("close", 14, 100.0)[1]["rsi_14"]}
    return over_series(
        bars_1d(spark, sf),
        BARS_1D,
        move,
        r14 | R.rsi("close", 30)[1] | full,
        {"rsi_14_z": rules.scaled("rsi_14", 50.0, 20.0)},
    )


@query(
    "ewm_macd",
    "series_id ts ema_12:4 macd_hist_norm:6",
    f"""{BARS_1D_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS n FROM bars),
    e AS (SELECT series_id, ts, n, close,
      list(close) OVER (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 600 PRECEDING AND CURRENT ROW) AS l FROM n),
    f AS (SELECT series_id, ts, close,
      list_reduce(l, lambda a, v: a * (1 - 2.0::DOUBLE / 13) + v * (2.0::DOUBLE / 13)) AS ema_12,
      list_reduce(l, lambda a, v: a * (1 - 2.0::DOUBLE / 27) + v * (2.0::DOUBLE / 27)) AS ema_26 FROM e),
    g AS (SELECT *, ema_12 - ema_26 AS macd, list(ema_12 - ema_26) OVER (PARTITION BY series_id ORDER BY ts
      ROWS BETWEEN 600 PRECEDING AND CURRENT ROW) AS l FROM f),
    t AS (SELECT series_id, ts, ema_12,
      (macd - list_reduce(l, lambda a, v: a * 0.8::DOUBLE + v * 0.2::DOUBLE)) / close AS macd_hist_norm FROM g)""",
)
def _(spark, sf):
    return macd(bars_1d(spark, sf), BARS_1D, "close").withColumnRenamed("ema_fast", "ema_12")


@query(
    "range_structure_atr",
    "series_id ts vs_high:6 vs_low:6 pos_30:6 atr_14:6",
    f"""{BARS_1D_SQL}, b AS (SELECT *, {lag('close')} AS pc, {roll('max(close)', 'close', 30)} AS hi,
      {roll('min(close)', 'close', 30)} AS lo FROM bars),
    c AS (SELECT *, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) AS tr FROM b),
    t AS (SELECT series_id, ts, (close - hi) / hi AS vs_high, (close - lo) / lo AS vs_low,
      CASE WHEN hi - lo > 0 THEN (close - lo) / (hi - lo) END AS pos_30, {roll('avg(tr)', 'tr', 14)} / close AS atr_14 FROM c)""",
)
def _(spark, sf):
    return over_series(
        bars_1d(spark, sf),
        BARS_1D,
        {
            "tr": R.true_range(),
            "vs_high": R.dist_to_high("close", 30),
            "vs_low": R.dist_to_low("close", "close", 30),
            "pos_30": R.range_position("close", "close", "close", 30),
        },
        {"atr_14": R.atr("tr", "close", 14)},
    )


@query(
    "buy_pressure_cvd",
    "series_id ts pressure:6 delta:4 cvd:4",
    f"""{BARS_4H_SQL}, t AS (SELECT series_id, ts,
      least(greatest(taker_buy_quote_volume / nullif(quote_volume, 0), 0), 1) AS pressure,
      2 * taker_buy_base_volume - volume AS delta,
      sum(2 * taker_buy_base_volume - volume) OVER (PARTITION BY series_id ORDER BY ts) AS cvd FROM bars)""",
)
def _(spark, sf):
    df = bars_4h(spark, sf).withColumns(
        {
            "pressure": R.buy_pressure("taker_buy_quote_volume", "quote_volume"),
            "delta": 2 * F.col("taker_buy_base_volume") - F.col("volume"),
        }
    )
    return running(df, BARS_4H, {"cvd": sum_of("delta")})


@query(
    "rolling_beta_correlation",
    "series_id ts beta_30:6 corr_30:6 corr_90:6",
    f"""{BARS_1D_SQL}, a AS (SELECT ts, ln(close / lag(close) OVER (ORDER BY ts)) AS x FROM bars WHERE series_id = '1-URGENT'),
    j AS (SELECT b.series_id, ts, b.r, a.x FROM (SELECT *, {LR} FROM bars) b JOIN a USING (ts)),
    t AS (SELECT series_id, ts,
      CASE WHEN {roll('var_samp(x)', 'x', 30)} > 0 AND count(r + x) OVER {frame(-29)} >= 30
           THEN covar_samp(r, x) OVER {frame(-29)} / var_samp(x) OVER {frame(-29)} END AS beta_30,
      CASE WHEN count(r + x) OVER {frame(-29)} >= 30 THEN corr(r, x) OVER {frame(-29)} END AS corr_30,
      CASE WHEN count(r + x) OVER {frame(-89)} >= 90 THEN corr(r, x) OVER {frame(-89)} END AS corr_90 FROM j)""",
)
def _(spark, sf):
    rets = returns_1d(spark, sf)
    anchor = rets.filter(F.col("series_id") == "1-URGENT").select("ts", F.col("r").alias("x"))
    return over_series(
        rets.join(anchor, "ts"),
        BARS_1D,
        {"beta_30": R.roll_beta("r", "x", 30), "corr_30": R.roll_corr("r", "x", 30), "corr_90": R.roll_corr("r", "x", 90)},
    )


@query(
    "rolling_correlation_summary",
    "series_id n:i mean:6 std:6 share_strong:6 share_positive:6 flips:i pre:6 post:6",
    f"""{RETURNS}, c AS (SELECT series_id, ts, CASE WHEN count(r + volume) OVER {frame(-29)} >= 30
      THEN corr(r, volume) OVER {frame(-29)} END AS c FROM r1),
    f AS (SELECT * , {lag('c')} AS pc FROM c),
    t AS (SELECT series_id, count(c) AS n, avg(c) AS mean, stddev_samp(c) AS std,
      avg((abs(c) > 0.2)::INT) AS share_strong, avg((c > 0)::INT) AS share_positive,
      coalesce(sum((sign(c) <> sign(pc))::INT), 0) AS flips, avg(c) FILTER (WHERE ts < TIMESTAMP '1998-01-01') AS pre,
      avg(c) FILTER (WHERE ts >= TIMESTAMP '1998-01-01') AS post FROM f GROUP BY 1)""",
)
def _(spark, sf):
    from barline.operators.stats import corr_summary

    df = over_series(
        bars_1d(spark, sf), BARS_1D, {"r": R.log_return("close")}, {"c": R.roll_corr("r", "volume", 30)}, {"_prev": R.lagged("c")}
    )
    return corr_summary(df, "c", "_prev", ["series_id"], "ts", "1998-01-01")


@query(
    "rolling_quantiles",
    "series_id ts q10:6 q90:6 q30_strict:6",
    f"""{BARS_1D_SQL}, t AS (SELECT series_id, ts, {roll('quantile_cont(close, 0.1)', 'close', 30, 2)} AS q10,
      {roll('quantile_cont(close, 0.9)', 'close', 30, 2)} AS q90, {roll('quantile_cont(close, 0.3)', 'close', 30)} AS q30_strict
      FROM bars)""",
)
def _(spark, sf):
    return over_series(
        bars_1d(spark, sf),
        BARS_1D,
        {
            "q10": R.roll_quantile("close", 30, 0.1, 2),
            "q90": R.roll_quantile("close", 30, 0.9, 2),
            "q30_strict": R.roll_quantile("close", 30, 0.3),
        },
    )


@query(
    "rolling_percentile_rank",
    "series_id ts pr:6",
    f"""{BARS_1D_SQL}, g AS (SELECT *, {GAPPY} FROM bars),
    l AS (SELECT series_id, ts, x, list(x) OVER {frame(-29, -1)} AS before, count(*) OVER {frame(-29, -1)} AS n,
      count(x) OVER {frame(-29)} AS seen FROM g),
    t AS (SELECT series_id, ts, CASE WHEN seen >= 2 AND n > 0 THEN
      CASE WHEN x IS NULL THEN 0.0 ELSE len(list_filter(before, lambda v: v < x)) / n END END AS pr FROM l)""",
)
def _(spark, sf):
    df = bars_1d(spark, sf).withColumn("x", F.when(F.col("trades") % 4 != 0, F.col("close")))
    return over_series(df, BARS_1D, {"pr": R.roll_pct_rank("x", 30)})


STATE = """CASE WHEN trades % 7 = 0 THEN NULL WHEN close > open THEN 1 ELSE 0 END AS state"""
STATE_SQL = f"{BARS_1D_SQL}, s AS (SELECT series_id, ts, close, {STATE} FROM bars)"
RUNS_SQL = f"""{STATE_SQL},
    c AS (SELECT *, (state IS NOT NULL AND state IS DISTINCT FROM {lag('state')})::INT AS starts FROM s),
    i AS (SELECT *, sum(starts) OVER (PARTITION BY series_id ORDER BY ts) AS run FROM c),
    a AS (SELECT *, CASE WHEN state IS NOT NULL THEN row_number() OVER (PARTITION BY series_id, run, state IS NULL ORDER BY ts) END AS age FROM i)"""


def states_1d(spark, sf):
    up = F.when(F.col("trades") % 7 == 0, None).when(F.col("close") > F.col("open"), 1).otherwise(0)
    return bars_1d(spark, sf).withColumn("state", up)


@query(
    "regime_age",
    "series_id ts age:1 age_log:6 is_new:1",
    f"""{RUNS_SQL}, t AS (SELECT series_id, ts, age, ln(age + 1) AS age_log,
      CASE WHEN age IS NOT NULL THEN (age <= 2)::INT END AS is_new FROM a)""",
)
def _(spark, sf):
    return regime_age(states_1d(spark, sf), BARS_1D, "state")


@query(
    "run_durations",
    "series_id state:i runs:i mean_duration:6",
    f"""{RUNS_SQL}, d AS (SELECT series_id, run, state, count(*) AS n FROM a WHERE state IS NOT NULL GROUP BY 1, 2, 3),
    t AS (SELECT series_id, state, count(*) AS runs, avg(n) AS mean_duration FROM d GROUP BY 1, 2)""",
)
def _(spark, sf):
    return run_durations(states_1d(spark, sf), BARS_1D, "state")


@query(
    "momentum_differences",
    "series_id ts d3:4 d7:4 momentum:4 prev:4",
    f"""{BARS_1D_SQL}, d AS (SELECT series_id, ts, close - {lag('close', 3)} AS d3, close - {lag('close', 7)} AS d7,
      {lag('close')} AS prev FROM bars), t AS (SELECT *, d3 - {lag('d3', 3)} AS momentum FROM d)""",
)
def _(spark, sf):
    return over_series(
        bars_1d(spark, sf),
        BARS_1D,
        {"d3": R.diff("close", 3), "d7": R.diff("close", 7), "prev": R.lagged("close")},
        {"momentum": R.diff("d3", 3)},
    )


def ahead(agg: str, x: str, h: int) -> str:
    return f"CASE WHEN count({x}) OVER {frame(1, h)} >= {h} THEN {agg} OVER {frame(1, h)} END"


@query(
    "forward_outcomes",
    "series_id ts ret_1:6 ret_5:6 ret_63:6 sum_5:6 vol_20:6 up_6:6 down_6:6 min_dd_3:6",
    f"""{RETURNS}, t AS (SELECT series_id, ts, {lead('close')} / close - 1 AS ret_1, {lead('close', 5)} / close - 1 AS ret_5,
      {lead('close', 63)} / close - 1 AS ret_63, {ahead('sum(r)', 'r', 5)} AS sum_5,
      {ahead('stddev_samp(r)', 'r', 20)} * sqrt(252) AS vol_20, {ahead('max(high)', 'high', 6)} / close - 1 AS up_6,
      {ahead('min(low)', 'low', 6)} / close - 1 AS down_6, {ahead('min(close)', 'close', 3)} / close - 1 AS min_dd_3 FROM r1)""",
)
def _(spark, sf):
    return over_series(
        bars_1d(spark, sf),
        BARS_1D,
        {"r": R.log_return("close")},
        {
            "ret_1": L.fwd_return("close", 1),
            "ret_5": L.fwd_return("close", 5),
            "ret_63": L.fwd_return("close", 63),
            "sum_5": L.fwd_sum("r", 5),
            "vol_20": L.fwd_vol("r", 20),
            "up_6": L.fwd_up("high", "close", 6),
            "down_6": L.fwd_down("low", "close", 6),
            "min_dd_3": L.fwd_min_dd("close", 3),
        },
    )


TOUCH_SQL = f"""{BARS_1H_SQL}, l AS (SELECT series_id, ts, close,
      list({{'t': ts, 'h': high, 'l': low}}) OVER {frame(1, 96)} AS f FROM bars),
    q AS (SELECT series_id, ts, list_filter(f, lambda e: e.h >= close * 1.02)[1].t AS up_at,
      list_filter(f, lambda e: e.l <= close * 0.98)[1].t AS down_at FROM l),
    touch AS (SELECT series_id, ts, date_diff('second', ts, up_at) / 60.0 AS up_minutes,
      date_diff('second', ts, down_at) / 60.0 AS down_minutes FROM q)"""


def touches(spark, sf):
    return over_series(
        bars_1h(spark, sf),
        BARS_1H,
        {
            "up_minutes": L.first_touch(F.col("close") * 1.02, "high", "ts", 96, True),
            "down_minutes": L.first_touch(F.col("close") * 0.98, "low", "ts", 96, False),
        },
    )


@query(
    "first_touch",
    "series_id ts up_minutes:2 down_minutes:2 up_hit:i down_hit:i",
    f"""{TOUCH_SQL}, t AS (SELECT *, (up_minutes IS NOT NULL)::INT AS up_hit, (down_minutes IS NOT NULL)::INT AS down_hit FROM touch)""",
)
def _(spark, sf):
    df = touches(spark, sf)
    return df.withColumns(
        {"up_hit": flag(F.col("up_minutes").isNotNull()), "down_hit": flag(F.col("down_minutes").isNotNull())}
    )


@query(
    "cumulative_price_proxy",
    "series_id ts cusum:6 proxy:6 rebased:6",
    f"""{RETURNS}, c AS (SELECT *, sum(r) OVER (PARTITION BY series_id ORDER BY ts) AS cusum FROM r1),
    t AS (SELECT series_id, ts, cusum, exp(cusum) AS proxy,
      close / first_value(close) OVER (PARTITION BY series_id ORDER BY ts) * 1000 AS rebased FROM c)""",
)
def _(spark, sf):
    df = over_series(bars_1d(spark, sf), BARS_1D, {"r": R.log_return("close")}, keep_chunk=True)
    df = running(df, BARS_1D, {"cusum": sum_of("r"), "_base": first_of("close")})
    return df.withColumns({"proxy": F.exp("cusum"), "rebased": rules.rebase("close", "_base", 1000.0)})


@query(
    "rolling_sharpe",
    "series_id ts mean_90:6 std_90:6 sharpe_90:6 skew_90:5",
    f"""{RETURNS}, t AS (SELECT series_id, ts, {roll('avg(r)', 'r', 90)} AS mean_90, {roll('stddev_samp(r)', 'r', 90)} AS std_90,
      {roll('avg(r)', 'r', 90)} / {roll('stddev_samp(r)', 'r', 90)} * sqrt(252) AS sharpe_90,
      {roll('skewness(r)', 'r', 90)} AS skew_90 FROM r1)""",
)
def _(spark, sf):
    return over_series(
        bars_1d(spark, sf),
        BARS_1D,
        {"r": R.log_return("close")},
        {
            "mean_90": R.roll_mean("r", 90),
            "std_90": R.roll_std("r", 90),
            "sharpe_90": R.roll_sharpe("r", 90),
            "skew_90": R.roll_skew("r", 90),
        },
    )


@query(
    "state_entropy",
    "series_id ts p:6 e2:6 e3:6",
    f"""{BARS_4H_SQL}, p AS (SELECT series_id, ts, taker_buy_quote_volume / quote_volume AS p FROM bars),
    k AS (SELECT *, greatest(least(p, 1 - 1e-10), 1e-10) AS a, greatest(least(1 - p, 1 - 1e-10), 1e-10) AS b FROM p),
    t AS (SELECT series_id, ts, p, -(a * log2(a) + b * log2(b)) AS e2,
      -(p / 2 * log2(p / 2 + 1e-9) * 2 + (1 - p) * log2(1 - p + 1e-9)) AS e3 FROM k)""",
)
def _(spark, sf):
    p = F.col("p")
    return (
        bars_4h(spark, sf)
        .withColumn("p", R.buy_pressure("taker_buy_quote_volume", "quote_volume"))
        .withColumns({"e2": entropy2(p, 1 - p), "e3": entropy_n([p / 2, p / 2, 1 - p])})
    )


@query(
    "basis_and_illiquidity",
    "series_id ts basis:4 elr:2 elr_corr:5",
    f"""{BARS_1H_SQL}, r AS (SELECT *, {LR} FROM bars),
    v AS (SELECT *, {roll('stddev_samp(r)', 'r', 24)} AS vol, {roll('sum(volume)', 'volume', 24)} AS vs FROM r),
    e AS (SELECT *, vs / nullif(vol, 0) AS elr FROM v),
    t AS (SELECT series_id, ts, close - open AS basis, elr,
      CASE WHEN count(elr + vol) OVER {frame(-167)} >= 168 THEN corr(elr, vol) OVER {frame(-167)} END AS elr_corr FROM e)""",
)
def _(spark, sf):
    return over_series(
        bars_1h(spark, sf),
        BARS_1H,
        {"r": R.log_return("close"), "basis": rules.basis("close", "open")},
        {"vol": R.roll_std("r", 24), "_vs": R.roll_sum("volume", 24)},
        {"elr": safe_div("_vs", "vol")},
        {"elr_corr": R.roll_corr("elr", "vol", 168)},
    )


@query(
    "rolling_custom_function",
    "series_id ts mad_10:6",
    f"""{BARS_1D_SQL}, l AS (SELECT series_id, ts, list(close) OVER {frame(-9)} AS l FROM bars),
    t AS (SELECT series_id, ts, CASE WHEN len(l) >= 10 THEN list_avg(list_transform(l, lambda v: abs(v - list_avg(l)))) END AS mad_10 FROM l)""",
)
def _(spark, sf):
    def mean(a):
        return F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)

    mad = R.rolling_expr("close", 10, lambda a: mean(F.transform(a, lambda v: F.abs(v - mean(a)))))
    return over_series(bars_1d(spark, sf), BARS_1D, {"mad_10": mad})


@query(
    "rolling_pandas_function",
    "series_id ts med_24:6",
    f"""{BARS_1H_SQL}, t AS (SELECT series_id, ts, {roll('median(close)', 'close', 24)} AS med_24 FROM bars)""",
)
def _(spark, sf):
    from barline.operators.pandas_roll import rolling_pandas

    return rolling_pandas(bars_1h(spark, sf), BARS_1H, "close", 24, lambda a: float(__import__("numpy").median(a)), "med_24")
