"""Queries over gates, entry scores, labels, ensembles and regimes."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.grid import over_series
from barline.operators import labels as L
from barline.operators import rolling as R
from barline.operators import rules as X
from barline.operators.evaluation import gate_summary
from barline.plans.adapters import (
    BARS_1D,
    BARS_1D_SQL,
    BARS_4H,
    BARS_4H_SQL,
    SCORES_SQL,
    bars_1d,
    bars_4h,
    lag,
    lead,
    roll,
    scores,
)
from barline.plans.registry import query
from barline.plans.windows import rsi_sql

IND_SQL = f"""{BARS_4H_SQL}, i0 AS (SELECT *, close - {lag('close')} AS mv, ln(close / {lag('close')}) AS r FROM bars),
    ind AS (SELECT *, {rsi_sql(14)} AS rsi,
      CASE WHEN {roll('stddev_samp(close)', 'close', 20)} > 0 THEN (close - {roll('avg(close)', 'close', 20)} + 2 * {roll('stddev_samp(close)', 'close', 20)}) / (4 * {roll('stddev_samp(close)', 'close', 20)}) END AS bb,
      (volume - {roll('avg(volume)', 'volume', 30)}) / nullif({roll('stddev_samp(volume)', 'volume', 30)}, 0) AS volume_z,
      {roll('stddev_samp(r)', 'r', 6)} AS vol, taker_buy_quote_volume / quote_volume AS p FROM i0),
    g AS (SELECT *, p AS p_bull, 1 - p AS p_bear, p AS allocation,
      -(greatest(p, 1e-10) * log2(greatest(p, 1e-10)) + greatest(1 - p, 1e-10) * log2(greatest(1 - p, 1e-10))) AS entropy,
      CASE WHEN trades % 3 = 0 THEN 'Sideways' WHEN close > open THEN 'Bull' ELSE 'Bear' END AS regime, CASE WHEN trades % 10 = 0 THEN 0.5 ELSE 0.0 END AS position FROM ind)"""


def indicators(spark, sf):
    move, strength = R.rsi("close", 14)
    df = over_series(
        bars_4h(spark, sf),
        BARS_4H,
        move | {"bb": R.bb_position("close", 20), "volume_z": R.zscore("volume", 30), "r": R.log_return("close")},
        strength | {"vol": R.roll_std("r", 6)},
    ).withColumnRenamed("rsi_14", "rsi")
    p = F.try_divide("taker_buy_quote_volume", "quote_volume")
    df = df.withColumn("p", p)
    a, b = F.greatest("p", F.lit(1e-10)), F.greatest(1 - F.col("p"), F.lit(1e-10))
    return df.withColumns(
        {
            "p_bull": F.col("p"),
            "p_bear": 1 - F.col("p"),
            "allocation": F.col("p"),
            "entropy": -(a * F.log2(a) + b * F.log2(b)),
            "regime": F.when(F.col("trades") % 3 == 0, "Sideways").when(F.col("close") > F.col("open"), "Bull").otherwise("Bear"),
            "position": F.when(F.col("trades") % 10 == 0, 0.5).otherwise(0.0),
        }
    )


TIMING_SQL = """0.4 * greatest(0, (40 - coalesce(rsi, 40)) / 40) + 0.3 * greatest(0, (0.3 - coalesce(bb, 0.3)) / 0.3)"""
VOL_SQL = "0.3 * least(greatest(coalesce(volume_z, 0) / 2, 0), 1)"


@query(
    "entry_timing",
    "series_id ts close:4 log_return:6 vol:6 volume_z:6 bb:6 rsi:6 timing_score:6",
    f"{IND_SQL}, t AS (SELECT *, r AS log_return, {TIMING_SQL} + {VOL_SQL} AS timing_score FROM g)",
)
def _(spark, sf):
    return indicators(spark, sf).withColumn("timing_score", X.timing_score()).withColumnRenamed("r", "log_return")


@query(
    "regime_and_timing_gates",
    "series_id ts regime_gate:i allocation_after_regime:6 timing_score:6 timing_gate:i allocation_final:6 variant:6",
    f"""{IND_SQL}, a AS (SELECT *, (p_bull >= 0.3 AND entropy <= 0.85)::INT AS regime_gate, {TIMING_SQL} + {VOL_SQL} AS timing_score,
      {TIMING_SQL} + 0.3 * coalesce((volume_z > 0)::INT, 0) AS variant FROM g),
    b AS (SELECT *, CASE WHEN regime_gate = 1 THEN allocation ELSE 0 END AS allocation_after_regime, (timing_score >= 0.3)::INT AS timing_gate FROM a),
    t AS (SELECT *, CASE WHEN timing_gate = 1 THEN allocation_after_regime ELSE 0 END AS allocation_final FROM b)""",
)
def _(spark, sf):
    df = X.timing_gate(X.regime_gate(indicators(spark, sf)))
    return df.withColumn("variant", X.timing_score(sign_volume=True))


GATE3_SQL = """CASE WHEN position > 1e-6 THEN {pass_a} WHEN p_bull IS NULL OR entropy IS NULL THEN {block} WHEN entropy > 0.85 THEN {block}
      WHEN regime = 'Bear' OR p_bear > 0.6 THEN {bear} WHEN regime = 'Sideways' THEN {side} WHEN p_bull < 0.3 THEN {block} ELSE {bull} END"""
A3 = GATE3_SQL.format(pass_a="allocation", block="0", bear="0", side="allocation", bull="allocation")
L3 = GATE3_SQL.format(pass_a="''", block="''", bear="'bear'", side="'sideways'", bull="'bull'")
T3 = GATE3_SQL.format(pass_a="0", block="1", bear="1", side="0", bull="0")
TECH_SQL = """CASE WHEN rsi > 65 OR bb > 0.75 THEN {a} WHEN rsi < 30 AND bb < 0.15 THEN {b} WHEN rsi < 35 AND bb < 0.25 THEN {c} WHEN rsi > 50 AND bb > 0.5 THEN {d} ELSE {e} END"""
TA = TECH_SQL.format(a="0", b="least(allocation * 1.3, 1)", c="least(allocation * 1.2, 1)", d="allocation * 0.7", e="allocation")
TZ = TECH_SQL.format(a="'overbought'", b="'strong_oversold'", c="'oversold'", d="'high_zone'", e="'neutral'")


@query(
    "three_state_gate",
    "series_id ts allocation_3:6 triggered:i label",
    f"{IND_SQL}, t AS (SELECT series_id, ts, {A3} AS allocation_3, {T3} AS triggered, {L3} AS label FROM g)",
)
def _(spark, sf):
    df = indicators(spark, sf).withColumn("g", X.regime_gate3())
    return df.select("series_id", "ts", F.col("g.allocation").alias("allocation_3"), "g.triggered", "g.label")


@query(
    "technical_gate",
    "series_id ts allocation_t:6 blocked:i zone",
    f"{IND_SQL}, t AS (SELECT series_id, ts, {TA} AS allocation_t, (({TZ}) = 'overbought')::INT AS blocked, {TZ} AS zone FROM g)",
)
def _(spark, sf):
    df = indicators(spark, sf).withColumn("g", X.technical_gate())
    return df.select("series_id", "ts", F.col("g.allocation").alias("allocation_t"), "g.blocked", "g.zone")


@query(
    "gate_history",
    "series_id gate reason blocked:i",
    f"""{IND_SQL}, x AS (SELECT series_id, {L3} AS l, {T3} AS tr, {TZ} AS z FROM g),
    t AS (SELECT series_id, 'regime' AS gate, l AS reason, count(*) AS blocked FROM x WHERE tr = 1 GROUP BY 1, 3
      UNION ALL SELECT series_id, 'technical', z, count(*) FROM x WHERE z = 'overbought' GROUP BY 1, 3)""",
)
def _(spark, sf):
    df = indicators(spark, sf).withColumns({"a": X.regime_gate3(), "b": X.technical_gate()})
    df = df.select("series_id", F.col("a.triggered"), F.col("a.label"), F.col("b.blocked").alias("tb"), F.col("b.zone"))
    return gate_summary(df, {"regime": ("triggered", "label"), "technical": ("tb", "zone")}, ["series_id"])


FEED_SQL = """feed AS (SELECT time_bucket(INTERVAL 3 HOUR, ts) + INTERVAL 1 HOUR AS news_ts, (avg(value) - 50) / 2 AS news_score FROM events GROUP BY 1),
    nf AS (SELECT news_ts, news_score, CASE WHEN news_score >= 1 THEN 'BULL' WHEN news_score <= -1 THEN 'BEAR' ELSE 'SIDEWAYS' END AS news_regime FROM feed)"""


def news_feed(spark, sf):
    from barline.operators.resample import bucket_start
    from barline.plans.adapters import ticks

    e = ticks(spark, sf)
    s = F.col("news_score")
    return (
        e.groupBy((bucket_start("ts", 3 * 3600) + F.expr("INTERVAL 1 HOUR")).alias("ts"))
        .agg(((F.avg("value") - 50) / 2).alias("news_score"))
        .withColumn("news_regime", F.when(s >= 1, "BULL").when(s <= -1, "BEAR").otherwise("SIDEWAYS"))
    )


@query(
    "news_gate",
    "series_id ts allocation_after_news:6 news_blocked:i",
    f"""{IND_SQL}, {FEED_SQL}, j AS (SELECT g.*, news_ts, news_score, news_regime FROM g ASOF LEFT JOIN nf ON g.ts >= nf.news_ts),
    k AS (SELECT *, coalesce(date_diff('second', news_ts, ts) / 3600.0 <= 2, false) AS fresh FROM j),
    t AS (SELECT *, CASE WHEN NOT fresh THEN allocation WHEN news_regime = 'BEAR' AND news_score < -3 THEN 0 WHEN news_regime = 'BEAR' THEN allocation * 0.5
      WHEN news_regime = 'BULL' AND news_score > 3 THEN least(allocation * 1.15, 1) ELSE allocation END AS allocation_after_news,
      (fresh AND news_regime = 'BEAR' AND news_score < -3)::INT AS news_blocked FROM k)""",
)
def _(spark, sf):
    return X.news_gate(indicators(spark, sf), news_feed(spark, sf), BARS_4H)


@query(
    "entry_score",
    "series_id ts entry_score:3 enter:i score_v1:3",
    f"""{IND_SQL}, {FEED_SQL}, j AS (SELECT g.*, news_score, news_regime FROM g ASOF LEFT JOIN nf ON g.ts >= nf.news_ts),
    s AS (SELECT *, CASE WHEN lower(regime) = 'bear' THEN -99.0 ELSE
      (CASE WHEN coalesce(bb, 0.5) > 0.8 THEN -2 WHEN coalesce(bb, 0.5) < 0.2 THEN 3 WHEN coalesce(bb, 0.5) < 0.3 THEN 2 WHEN coalesce(bb, 0.5) < 0.4 THEN 0.5 ELSE 0 END)
      + (CASE WHEN coalesce(rsi, 50) < 35 THEN 1 WHEN coalesce(rsi, 50) < 45 THEN 0.5 WHEN coalesce(rsi, 50) > 60 THEN -1 ELSE 0 END)
      + (CASE WHEN allocation BETWEEN 0.5 AND 0.54 THEN 0.5 WHEN allocation >= 0.48 AND allocation < 0.5 THEN 0.25 ELSE 0 END)
      + (CASE WHEN news_regime = 'BULL' AND news_score > 3 THEN 1 WHEN news_regime = 'BULL' THEN 0.5 WHEN news_regime = 'BEAR' AND news_score < -3 THEN -1.5 WHEN news_regime = 'BEAR' THEN -0.5 ELSE 0 END) END AS entry_score FROM j),
    t AS (SELECT *, (entry_score >= 2.5)::INT AS enter,
      (CASE WHEN bb < 0.2 THEN 2 WHEN bb < 0.3 THEN 1.5 WHEN bb < 0.4 THEN 0.5 ELSE 0 END) + (CASE WHEN rsi < 35 THEN 1 WHEN rsi < 45 THEN 0.5 WHEN rsi > 60 THEN -1 ELSE 0 END) AS score_v1 FROM s)""",
)
def _(spark, sf):
    from barline.operators.joins import asof_shared

    df = asof_shared(indicators(spark, sf), news_feed(spark, sf), BARS_4H, ["news_score", "news_regime"], lag=None)
    return X.entry_score(df).withColumn("score_v1", X.score_v1())


@query(
    "macro_and_derivatives_gates",
    "series_id ts macro_multiplier:6 deriv_multiplier:6",
    f"""{IND_SQL}, t AS (SELECT series_id, ts, least(greatest(1 - least(greatest((rsi - 40) / 20, 0), 1) * least(greatest(1 - allocation, 0), 1) * 0.5, 0), 1) * (CASE WHEN rsi IS NULL THEN NULL ELSE 1 END) AS macro_multiplier,
      CASE WHEN volume_z >= 1 AND vol >= 0.5 THEN 0.7 ELSE 1.0 END AS deriv_multiplier FROM g)""",
)
def _(spark, sf):
    return indicators(spark, sf).withColumns(
        {
            "macro_multiplier": X.macro_gate("rsi", "allocation", 40.0, 60.0, 0.5),
            "deriv_multiplier": X.derivatives_gate("volume_z", "vol", 1.0, 0.5, 0.3),
        }
    )


@query(
    "daily_signal",
    "series_id ts signal",
    f"""{IND_SQL}, x AS (SELECT series_id, ts, (close > open)::INT AS state, CASE WHEN trades % 9 <> 0 THEN p END AS q, bb AS b FROM g),
    t AS (SELECT series_id, ts, CASE WHEN q IS NULL THEN 'NO_DATA' WHEN state = 1 AND q > 0.6 AND b > 0.8 THEN 'LONG_STRONG' WHEN state = 1 AND q > 0.55 THEN 'LONG'
      WHEN state = 0 AND q < 0.4 AND b < 0.2 THEN 'SHORT_STRONG' WHEN state = 0 AND q < 0.45 THEN 'SHORT' ELSE 'NEUTRAL' END AS signal FROM x)""",
)
def _(spark, sf):
    df = indicators(spark, sf).withColumns(
        {"state": (F.col("close") > F.col("open")).cast("int"), "q": F.when(F.col("trades") % 9 != 0, F.col("p"))}
    )
    return df.withColumn("signal", X.daily_signal("state", "q", "bb"))


@query(
    "outcome_labels",
    "series_id ts up:1 big:1 ternary:1 scaled:6 direction:1",
    f"""{BARS_1D_SQL}, x AS (SELECT *, {lead('close', 5)} / close - 1 AS f5, {lead('close', 2)} / close - 1 AS f2, {lead('close', 6)} AS c6, ln(close / {lag('close')}) AS r FROM bars),
    y AS (SELECT *, {roll('stddev_samp(r)', 'r', 7)} AS v FROM x),
    t AS (SELECT series_id, ts, (f5 > 0)::INT AS up, (f5 > 0.02)::INT AS big, CASE WHEN f2 IS NULL THEN NULL WHEN f2 > 0.01 THEN 2 WHEN f2 < -0.007 THEN 0 ELSE 1 END AS ternary,
      f5 / nullif(v, 0) AS scaled, (c6 / close - 1 > 0)::INT AS direction FROM y)""",
)
def _(spark, sf):
    df = over_series(
        bars_1d(spark, sf),
        BARS_1D,
        {"f5": L.fwd_return("close", 5), "f2": L.fwd_return("close", 2), "f6": L.fwd_return("close", 6), "r": R.log_return("close")},
        {"v": R.roll_std("r", 7)},
    )
    return df.withColumns(
        {
            "up": X.label_binary("f5"),
            "big": X.label_binary("f5", 0.02),
            "ternary": X.label_ternary("f2", 0.010, 0.007),
            "scaled": X.label_vol_scaled("f5", "v"),
            "direction": X.label_binary("f6"),
        }
    )


ENS_SQL = f"""{SCORES_SQL}, tr AS (SELECT * FROM scores WHERE split = 's1' AND r IS NOT NULL), te AS (SELECT * FROM scores WHERE split <> 's1'),
    c AS (SELECT series_id, quantile_cont(r, 0.7) AS hi, quantile_cont(r, 0.3) AS lo, list(r) AS l FROM tr GROUP BY 1),
    e AS (SELECT te.*, CASE WHEN r > hi THEN 1 WHEN r < lo THEN -1 ELSE 0 END AS ps, CASE WHEN p > 0.6 THEN 1 WHEN p < 0.4 THEN -1 ELSE 0 END AS pr,
      len(list_filter(l, lambda v: v <= r)) / len(l) AS rn FROM te JOIN c USING (series_id))"""


@query(
    "ensemble_signals",
    "series_id ts pct_signal:i rank_norm:6 rule_a:i rule_b:i rule_c:i",
    f"""{ENS_SQL}, t AS (SELECT series_id, ts, ps AS pct_signal, rn AS rank_norm, CASE WHEN pr = 1 AND ps = 1 THEN 1 WHEN pr = -1 AND ps = -1 THEN -1 ELSE 0 END AS rule_a,
      CASE WHEN pr = 1 AND ps <> -1 THEN 1 WHEN pr = -1 AND ps <> 1 THEN -1 ELSE 0 END AS rule_b,
      CASE WHEN 0.6 * p + 0.4 * rn > 0.7 THEN 1 WHEN 0.6 * p + 0.4 * rn < 0.3 THEN -1 ELSE 0 END AS rule_c FROM e)""",
)
def _(spark, sf):
    sc = scores(spark, sf)
    train, test = sc.filter(F.col("split") == "s1"), sc.filter(F.col("split") != "s1")
    df = X.pct_signal(X.rank_norm(test, train, "r", ["series_id"]), train, "r", ["series_id"])
    return df.withColumns({"rule_a": X.ensemble(df, "A"), "rule_b": X.ensemble(df, "B"), "rule_c": X.ensemble(df, "C")})


@query(
    "rule_regimes",
    "series_id ts vol_regime liq_regime trend return_rule extreme:i",
    f"""{BARS_1D_SQL}, a AS (SELECT *, ln(close / {lag('close')}) AS r, close / {roll('max(close)', 'close', 90, 1)} - 1 AS dd, close / {lag('close', 21)} - 1 AS r21, (high - low) / close AS rg,
      (volume - {roll('avg(volume)', 'volume', 30)}) / nullif({roll('stddev_samp(volume)', 'volume', 30)}, 0) AS vz FROM bars),
    b AS (SELECT *, {roll('stddev_samp(r)', 'r', 7)} / nullif({roll('stddev_samp(r)', 'r', 30)}, 0) AS vr, {roll('avg(rg)', 'rg', 7)} AS am, {roll('sum(r)', 'r', 21)} AS s21 FROM a),
    c AS (SELECT *, {roll('quantile_cont(am, 0.7)', 'am', 30)} AS q70, {roll('quantile_cont(am, 0.3)', 'am', 30)} AS q30 FROM b),
    t AS (SELECT series_id, ts, CASE WHEN vr > 1.2 THEN 'expanding' WHEN vr < 0.8 THEN 'compressing' ELSE 'neutral' END AS vol_regime,
      CASE WHEN am > q70 AND vz < -0.5 THEN 'fragile' WHEN am < q30 AND vz > 0.5 THEN 'accumulation' ELSE 'neutral' END AS liq_regime,
      CASE WHEN dd > -0.1 AND s21 > 0 THEN 'Bull' WHEN dd < -0.15 OR s21 < -0.05 THEN 'Bear' ELSE 'Sideways' END AS trend,
      CASE WHEN r21 > 0.05 THEN 'Bull' WHEN r21 < -0.05 THEN 'Bear' ELSE 'Sideways' END AS return_rule,
      coalesce((vz > 1.5)::INT, 0) - coalesce((vz < -1.5)::INT, 0) AS extreme FROM c)""",
)
def _(spark, sf):
    df = over_series(
        bars_1d(spark, sf),
        BARS_1D,
        {"r": R.log_return("close"), "dd": R.drawdown("close", 90, 1), "r21": R.ret("close", 21), "rg": R.range_rel(), "vz": R.zscore("volume", 30)},
        {"s7": R.roll_std("r", 7), "s30": R.roll_std("r", 30), "am": R.roll_mean("rg", 7), "s21": R.roll_sum("r", 21)},
        {"vr": R.vol_ratio("s7", "s30"), "q70": R.roll_quantile("am", 30, 0.7), "q30": R.roll_quantile("am", 30, 0.3)},
    )
    return df.withColumns(
        {
            "vol_regime": X.vol_regime("vr"),
            "liq_regime": X.liquidity_regime("am", "q70", "q30", "vz"),
            "trend": X.trend_regime("dd", "s21"),
            "return_rule": X.return_regime("r21"),
            "extreme": X.extreme_flag("vz"),
        }
    )


@query(
    "position_sizes",
    "series_id ts fixed:4 vol_target:6 confidence:6 floored:6 rsi_scaled:6 bb_scaled:6",
    f"""{IND_SQL}, x AS (SELECT *, (close > open)::INT AS state FROM g),
    t AS (SELECT series_id, ts, CASE WHEN state = 1 THEN 0.5 ELSE 0 END AS fixed, CASE WHEN state = 1 AND vol > 0 THEN least(greatest(0.4 / vol, 0), 1) ELSE 0 END AS vol_target,
      CASE WHEN state = 1 THEN p ELSE 0 END AS confidence, CASE WHEN state = 1 THEN greatest(p, 0.3) ELSE 0 END AS floored, (rsi - 50) / 20 AS rsi_scaled, (bb - 0.5) / 0.25 AS bb_scaled FROM x)""",
)
def _(spark, sf):
    df = indicators(spark, sf).withColumn("state", (F.col("close") > F.col("open")).cast("int"))
    return df.withColumns(
        {
            "fixed": X.size_position("fixed", "state"),
            "vol_target": X.size_position("vol_target", "state", vol="vol"),
            "confidence": X.size_position("confidence", "state", p="p"),
            "floored": X.size_position("confidence", "state", p="p", floor=0.3),
            "rsi_scaled": X.scaled("rsi", 50.0, 20.0),
            "bb_scaled": X.scaled("bb", 0.5, 0.25),
        }
    )


@query(
    "state_ordering",
    "series_id mean:6 state:i reversed:i",
    f"""{BARS_1D_SQL}, d AS (SELECT series_id, close / {roll('max(close)', 'close', 90, 1)} - 1 AS dd FROM bars), m AS (SELECT series_id, avg(dd) AS mean FROM d GROUP BY 1),
    t AS (SELECT *, row_number() OVER (ORDER BY mean, series_id) - 1 AS state, row_number() OVER (ORDER BY mean DESC, series_id) - 1 AS reversed FROM m)""",
)
def _(spark, sf):
    means = over_series(bars_1d(spark, sf), BARS_1D, {"dd": R.drawdown("close", 90, 1)}).groupBy("series_id").agg(F.avg("dd").alias("mean"))
    down = X.order_states(means, "series_id", "mean", descending=True).select("series_id", F.col("state").alias("reversed"))
    return X.order_states(means, "series_id", "mean").join(down, "series_id")


