"""Queries over distribution, correlation and test statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.grid import over_series
from barline.operators import labels as L
from barline.operators import resample
from barline.operators import rolling as R
from barline.operators import stats as S
from barline.operators.joins import asof_forward
from barline.plans.adapters import (
    BARS_1D,
    BARS_1D_SQL,
    BARS_1H,
    BARS_1H_SQL,
    BARS_4H,
    BARS_4H_SQL,
    SCORES_SQL,
    bars_1d,
    bars_1h,
    bars_4h,
    frame,
    lag,
    lead,
    norm_tail_sql,
    roll,
    scores,
    t_tail_sql,
    ticks,
)
from barline.plans.registry import query
from barline.plans.windows import TOUCH_SQL, ahead, rsi_sql, touches


@query(
    "bars_from_ticks",
    "series_id ts close_time open:4 high:4 low:4 close:4 volume:4 trades:i taker_buy_quote_volume:4",
    f"{BARS_4H_SQL}, t AS (SELECT * FROM bars)",
)
def _(spark, sf):
    return bars_4h(spark, sf)


@query(
    "resample_bars",
    "series_id ts open:4 high:4 low:4 close:4 volume:4 trades:i",
    f"""{BARS_1H_SQL}, t AS (SELECT series_id, time_bucket(INTERVAL 4 HOUR, ts) AS ts, first(open ORDER BY ts) AS open, max(high) AS high,
      min(low) AS low, last(close ORDER BY ts) AS close, sum(volume) AS volume, sum(trades) AS trades
      FROM bars GROUP BY series_id, time_bucket(INTERVAL 4 HOUR, ts))""",
)
def _(spark, sf):
    return resample.resample_bars(bars_1h(spark, sf), 4 * 3600)


@query(
    "daily_context",
    "series_id ts mean_volume:4 max_volume:4",
    f"""{BARS_4H_SQL}, t AS (SELECT series_id, date_trunc('day', ts) AS ts, avg(volume) AS mean_volume, max(volume) AS max_volume
      FROM bars GROUP BY series_id, date_trunc('day', ts))""",
)
def _(spark, sf):
    return resample.resample_mixed(
        bars_4h(spark, sf), {"mean_volume": ("volume", "mean"), "max_volume": ("volume", "max")}
    )


@query(
    "resample_mixed_rules",
    "series_id ts last_value:4 mean_value:6 total:4 n:i",
    """t AS (SELECT event_type AS series_id, date_trunc('day', ts::TIMESTAMP) AS ts, last(value ORDER BY ts, event_id) AS last_value,
      avg(value) AS mean_value, sum(value) AS total, count(value) AS n FROM events GROUP BY 1, date_trunc('day', ts::TIMESTAMP))""",
)
def _(spark, sf):
    rules = {
        "last_value": ("value", "last"),
        "mean_value": ("value", "mean"),
        "total": ("value", "sum"),
        "n": ("value", "count"),
    }
    return resample.resample_mixed(ticks(spark, sf), rules, tie="event_id")


@query(
    "daily_summary",
    "series_id ts first_price:4 last_price:4 mean_price:6 volume:2",
    f"""{BARS_1H_SQL}, t AS (SELECT series_id, date_trunc('day', ts) AS ts, first(open ORDER BY ts) AS first_price,
      last(close ORDER BY ts) AS last_price, avg(close) AS mean_price, sum(volume) AS volume FROM bars GROUP BY series_id, date_trunc('day', ts))""",
)
def _(spark, sf):
    rules = {
        "first_price": ("open", "first"),
        "last_price": ("close", "last"),
        "mean_price": ("close", "mean"),
        "volume": ("volume", "sum"),
    }
    return resample.resample_mixed(bars_1h(spark, sf), rules)


OUT = "count({y}) AS n, avg({y}) AS mean, stddev_samp({y}) AS std, avg(({y} > 0)::INT) AS hit"


@query(
    "state_statistics",
    "series_id regime rows:i n:i mean:6 std:6 hit:6 share:6 annual_vol:6",
    f"""{SCORES_SQL}, g AS (SELECT series_id, regime, count(*) AS rows, {OUT.format(y='ret')} FROM scores GROUP BY 1, 2),
    t AS (SELECT *, rows / sum(rows) OVER (PARTITION BY series_id) AS share, std * sqrt(252) AS annual_vol FROM g)""",
)
def _(spark, sf):
    return S.by_state(scores(spark, sf), "regime", "ret", ["series_id"])


QCUT_SQL = f"""{SCORES_SQL}, e AS (SELECT series_id, list_distinct([quantile_cont(p, 0), quantile_cont(p, 0.2), quantile_cont(p, 0.4),
      quantile_cont(p, 0.6), quantile_cont(p, 0.8), quantile_cont(p, 1)]) AS e FROM scores GROUP BY 1),
    es AS (SELECT series_id, list_sort(e) AS e FROM e),
    b AS (SELECT s.*, len(list_filter(e[2:len(e) - 1], lambda v: v < p)) AS bucket FROM scores s JOIN es USING (series_id))"""


@query(
    "quantile_bucket_statistics",
    "series_id bucket:i n:i mean:6 std:6 hit:6 median:6",
    f"""{QCUT_SQL}, t AS (SELECT series_id, bucket, {OUT.format(y='ret')}, median(ret) AS median FROM b GROUP BY 1, 2)""",
)
def _(spark, sf):
    return S.qcut_stats(scores(spark, sf), "p", "ret", 5, ["series_id"])


@query(
    "quartile_group_test",
    "series_id part n:i mean:6 std:6 hit:6 t:5 p:6",
    f"""{SCORES_SQL}, q AS (SELECT series_id, quantile_cont(r, 0.25) AS lo, quantile_cont(r, 0.75) AS hi FROM scores GROUP BY 1),
    g AS (SELECT series_id, CASE WHEN r < lo THEN 'low' WHEN r > hi THEN 'high' ELSE 'mid' END AS part, {OUT.format(y='ret')}
      FROM scores JOIN q USING (series_id) WHERE r IS NOT NULL GROUP BY 1, 2),
    u AS (SELECT *, mean / (std / sqrt(n)) AS t FROM g WHERE n >= 5),
    t AS (SELECT *, {t_tail_sql('t', '(n - 1)')} AS p FROM u)""",
)
def _(spark, sf):
    return S.quartile_stats(scores(spark, sf), "r", "ret", ["series_id"])


EDGES = [(0.0, 0.2), (0.2, 0.4), (0.4, 0.5), (0.5, 0.6), (0.6, 0.8), (0.8, 1.1)]
EDGE_CASE = "CASE " + " ".join(f"WHEN p >= {lo} AND p < {hi} THEN {i}" for i, (lo, hi) in enumerate(EDGES)) + " END"


@query(
    "fixed_bin_statistics",
    "series_id bin:i lo:2 hi:2 n:i mean_ret:6 win_ret:6 mean_r:6 win_r:6 mean_dd:6",
    f"""{SCORES_SQL}, s AS (SELECT *, {EDGE_CASE} AS bin FROM scores),
    l AS (SELECT * FROM (VALUES {', '.join(f'({i}, {lo}, {hi})' for i, (lo, hi) in enumerate(EDGES))}) v(bin, lo, hi)),
    t AS (SELECT series_id, s.bin, any_value(lo) AS lo, any_value(hi) AS hi, count(*) AS n, avg(ret) AS mean_ret, avg((ret > 0)::INT) AS win_ret,
      avg(r) AS mean_r, avg((r > 0)::INT) AS win_r, avg(CASE WHEN r IS NOT NULL THEN least(r, 0) END) AS mean_dd FROM s JOIN l USING (bin) GROUP BY 1, 2)""",
)
def _(spark, sf):
    df = scores(spark, sf).withColumn("dd", F.when(F.col("r").isNotNull(), F.least("r", F.lit(0.0))))
    return S.bin_stats(df, "p", EDGES, ["ret", "r"], ["series_id"], "dd")


@query(
    "predicate_combo_statistics",
    "series_id combo n:i mean_ret:6 win_ret:6",
    f"""{SCORES_SQL}, u AS (SELECT *, 'always' AS combo FROM scores UNION ALL SELECT *, 'high_p' FROM scores WHERE p > 0.55
      UNION ALL SELECT *, 'high_p_up' FROM scores WHERE p > 0.55 AND state = 1 UNION ALL SELECT *, 'down' FROM scores WHERE regime = 'down'),
    t AS (SELECT series_id, combo, count(*) AS n, avg(ret) AS mean_ret, avg((ret > 0)::INT) AS win_ret FROM u GROUP BY 1, 2)""",
)
def _(spark, sf):
    preds = {
        "always": F.lit(True),
        "high_p": F.col("p") > 0.55,
        "high_p_up": (F.col("p") > 0.55) & (F.col("state") == 1),
        "down": F.col("regime") == "down",
    }
    return S.combo_stats(scores(spark, sf), preds, ["ret"], ["series_id"])


@query(
    "scenario_ranking",
    "series_id combo n:i mean_ret:6 share:6 place:i",
    f"""{SCORES_SQL}, l AS (SELECT *, {lag('r')} AS pr, {lag('p')} AS pp FROM scores),
    u AS (SELECT *, 'buy_and_hold' AS combo FROM l UNION ALL SELECT *, 'previous_up' FROM l WHERE pr > 0
      UNION ALL SELECT *, 'rising_p' FROM l WHERE p > pp AND p < 0.5),
    g AS (SELECT series_id, combo, count(*) AS n, avg(ret) AS mean_ret FROM u GROUP BY 1, 2),
    t AS (SELECT *, n / max(n) OVER (PARTITION BY series_id) AS share, row_number() OVER (PARTITION BY series_id ORDER BY mean_ret DESC, combo) AS place FROM g)""",
)
def _(spark, sf):
    df = over_series(scores(spark, sf), BARS_4H, {"pr": R.lagged("r"), "pp": R.lagged("p")})
    preds = {
        "buy_and_hold": F.lit(True),
        "previous_up": F.col("pr") > 0,
        "rising_p": (F.col("p") > F.col("pp")) & (F.col("p") < 0.5),
    }
    return S.rank_scenarios(df, preds, "ret", ["series_id"])


QUAD_SQL = """CASE WHEN pc > 0 AND oc BETWEEN -0.02 AND 0.05 THEN 'trend' WHEN pc > 0 AND oc < -0.02 THEN 'short_squeeze'
      WHEN pc > 0 AND oc > 0.05 THEN 'possible_top' WHEN pc < 0 AND oc > -0.02 THEN 'new_low' WHEN pc < 0 AND oc < -0.02 THEN 'capitulation' END"""


@query(
    "price_oi_quadrants",
    "series_id quadrant rows:i n:i mean:6 std:6 hit:6 share:6 annual_vol:6",
    f"""{BARS_1D_SQL}, c AS (SELECT series_id, ts, close / {lag('close', 5)} - 1 AS pc, volume / {lag('volume', 5)} - 1 AS oc,
      {lead('close', 5)} / close - 1 AS y FROM bars), q AS (SELECT *, {QUAD_SQL} AS quadrant FROM c),
    g AS (SELECT series_id, quadrant, count(*) AS rows, {OUT.format(y='y')} FROM q GROUP BY 1, 2),
    t AS (SELECT *, rows / sum(rows) OVER (PARTITION BY series_id) AS share, std * sqrt(252) AS annual_vol FROM g)""",
)
def _(spark, sf):
    df = over_series(
        bars_1d(spark, sf),
        BARS_1D,
        {"pc": R.ret("close", 5), "oc": R.ret("volume", 5), "y": L.fwd_return("close", 5)},
    )
    return S.by_state(df.withColumn("quadrant", S.quadrant("pc", "oc")), "quadrant", "y", ["series_id"])


R1D_SQL = f"{BARS_1D_SQL}, x AS (SELECT *, ln(close / {lag('close')}) AS r FROM bars)"


def r1d(spark, sf):
    return over_series(bars_1d(spark, sf), BARS_1D, {"r": R.log_return("close")})


@query(
    "calendar_effects",
    "kind slot:i n:i mean:6 std:6 hit:6",
    f"""{R1D_SQL}, t AS (SELECT 'dow' AS kind, isodow(ts) - 1 AS slot, {OUT.format(y='r')} FROM x GROUP BY 2
      UNION ALL SELECT 'month', month(ts), {OUT.format(y='r')} FROM x GROUP BY 2
      UNION ALL SELECT 'eom', (day(ts) >= 26)::INT, {OUT.format(y='r')} FROM x GROUP BY 2)""",
)
def _(spark, sf):
    return S.calendar_effects(r1d(spark, sf), "ts", "r")


@query(
    "period_stability",
    "unit period n:i mean:6 std:6 hit:6",
    f"""{R1D_SQL}, t AS (SELECT 'quarter' AS unit, year(ts)::VARCHAR || 'Q' || quarter(ts)::VARCHAR AS period, {OUT.format(y='r')} FROM x GROUP BY 2
      UNION ALL SELECT 'half', year(ts)::VARCHAR || 'H' || ((quarter(ts) + 1) // 2)::VARCHAR, {OUT.format(y='r')} FROM x GROUP BY 2)""",
)
def _(spark, sf):
    x = r1d(spark, sf)
    quarters = S.period_stats(x, "ts", "r").withColumn("unit", F.lit("quarter"))
    return quarters.unionByName(S.period_stats(x, "ts", "r", "half").withColumn("unit", F.lit("half")))


RANGES = [("early", "1995-01-01", "1997-12-31"), ("middle", "1997-01-01", "1999-12-31"), ("late", "1999-06-01", "2002-01-01")]


@query(
    "date_range_statistics",
    "series_id period n:i mean:6 vol:6 sharpe:6 skew:5",
    f"""{R1D_SQL}, p AS (SELECT * FROM (VALUES {', '.join(f"('{n}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for n, a, b in RANGES)}) v(period, a, b)),
    t AS (SELECT series_id, period, count(r) AS n, avg(r) AS mean, stddev_samp(r) AS vol, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe,
      skewness(r) AS skew FROM x JOIN p ON ts BETWEEN a AND b GROUP BY 1, 2)""",
)
def _(spark, sf):
    return S.range_stats(r1d(spark, sf), "ts", "r", RANGES, ["series_id"])


@query(
    "correlation_test",
    "series_id n:i r:6 t:5 p:6",
    f"""{SCORES_SQL}, g AS (SELECT series_id, count(least(greatest(p, 0.2), 0.8) + ret) AS n, corr(least(greatest(p, 0.2), 0.8), ret) AS r FROM scores GROUP BY 1),
    u AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM g), t AS (SELECT *, {t_tail_sql('t', '(n - 2)')} AS p FROM u)""",
)
def _(spark, sf):
    return S.with_pearson_p(S.corr_test(scores(spark, sf), "p", "ret", ["series_id"], bounds=(0.2, 0.8)))


@query(
    "correlation_by_period",
    "split n:i r:6 t:5 p:6",
    f"""{SCORES_SQL}, g AS (SELECT split, count(p + ret) AS n, corr(p, ret) FILTER (WHERE ret IS NOT NULL) AS r FROM scores GROUP BY 1),
    u AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM g), t AS (SELECT *, {t_tail_sql('t', '(n - 2)')} AS p FROM u)""",
)
def _(spark, sf):
    return S.with_pearson_p(S.corr_test(scores(spark, sf), "p", "ret", ["split"], least=20))


@query(
    "correlation_matrix",
    "series_id x y r:6",
    f"""{BARS_1D_SQL}, t AS (SELECT series_id, 'open' AS x, 'close' AS y, corr(open, close) AS r FROM bars GROUP BY 1
      UNION ALL SELECT series_id, 'open', 'volume', corr(open, volume) FROM bars GROUP BY 1
      UNION ALL SELECT series_id, 'open', 'trades', corr(open, trades) FROM bars GROUP BY 1
      UNION ALL SELECT series_id, 'close', 'volume', corr(close, volume) FROM bars GROUP BY 1
      UNION ALL SELECT series_id, 'close', 'trades', corr(close, trades) FROM bars GROUP BY 1
      UNION ALL SELECT series_id, 'volume', 'trades', corr(volume, trades) FROM bars GROUP BY 1)""",
)
def _(spark, sf):
    return S.corr_matrix(bars_1d(spark, sf), ["open", "close", "volume", "trades"], ["series_id"])


@query(
    "spearman_correlation",
    "series_id n:i rho:6",
    f"""{BARS_1D_SQL}, k AS (SELECT series_id, rank() OVER a + (count(*) OVER (PARTITION BY series_id, trades) - 1) / 2.0 AS rx,
      rank() OVER b + (count(*) OVER (PARTITION BY series_id, volume) - 1) / 2.0 AS ry FROM bars
      WINDOW a AS (PARTITION BY series_id ORDER BY trades), b AS (PARTITION BY series_id ORDER BY volume)),
    t AS (SELECT series_id, count(*) AS n, corr(rx, ry) AS rho FROM k GROUP BY 1)""",
)
def _(spark, sf):
    return S.spearman(bars_1d(spark, sf, exact=True), "trades", "volume", ["series_id"])


@query(
    "two_sample_tests",
    "kind series_id n1:i n2:i m1:6 m2:6 t:5 dof:3 p:6",
    f"""{SCORES_SQL}, m AS (SELECT series_id, count(ret) FILTER (WHERE state = 1) AS n1, avg(ret) FILTER (WHERE state = 1) AS m1,
      var_samp(ret) FILTER (WHERE state = 1) AS v1, count(ret) FILTER (WHERE state <> 1) AS n2, avg(ret) FILTER (WHERE state <> 1) AS m2,
      var_samp(ret) FILTER (WHERE state <> 1) AS v2 FROM scores GROUP BY 1),
    u AS (SELECT 'welch' AS kind, *, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t,
      pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS dof FROM m
      UNION ALL SELECT 'student', *, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)), n1 + n2 - 2 FROM m),
    t AS (SELECT *, {t_tail_sql('t', 'dof')} AS p FROM u)""",
)
def _(spark, sf):
    sc = scores(spark, sf)
    tests = [S.ttest(sc, F.col("state") == 1, "ret", ["series_id"], k).withColumn("kind", F.lit(k)) for k in ("welch", "student")]
    return tests[0].unionByName(tests[1])


LAGS = list(range(-10, 11))
LAG_COLS = ", ".join(
    f"{lead('r', k) if k >= 0 else lag('r', -k)} AS y{i}" for i, k in enumerate(LAGS)
)
SCAN_SQL = f"""{R1D_SQL}, l AS (SELECT series_id, volume, {LAG_COLS} FROM x),
    scan AS ({' UNION ALL '.join(f"SELECT series_id, {k} AS lag, count(volume + y{i}) AS n, corr(volume, y{i}) AS r FROM l GROUP BY 1" for i, k in enumerate(LAGS))})"""


@query("lead_lag_scan", "series_id lag:i n:i r:6", f"{SCAN_SQL}, t AS (SELECT * FROM scan)")
def _(spark, sf):
    return S.lead_lag(r1d(spark, sf), BARS_1D, "volume", "r", LAGS, ["series_id"])


@query(
    "lead_lag_best",
    "series_id best_lag:i best_r:6 direction",
    f"""{SCAN_SQL}, b AS (SELECT series_id, first(lag ORDER BY abs(r) DESC, lag) AS best_lag, first(r ORDER BY abs(r) DESC, lag) AS best_r FROM scan GROUP BY 1),
    t AS (SELECT *, CASE WHEN best_lag > 0 THEN 'signal leads by ' || best_lag::VARCHAR WHEN best_lag < 0 THEN 'target leads by ' || (-best_lag)::VARCHAR
      ELSE 'contemporaneous' END AS direction FROM b)""",
)
def _(spark, sf):
    return S.best_lag(S.lead_lag(r1d(spark, sf), BARS_1D, "volume", "r", LAGS, ["series_id"]), ["series_id"])


@query(
    "lag_profile",
    "target series_id lag:i n:i r:6",
    f"""{R1D_SQL}, d AS (SELECT *, abs(r) AS a FROM x),
    l AS (SELECT series_id, volume, {', '.join(f"{lead('r', k)} AS d{k}, {lead('a', k)} AS a{k}" for k in range(91))} FROM d),
    t AS ({' UNION ALL '.join(f"SELECT '{nm}' AS target, series_id, {k} AS lag, count(volume + {c}{k}) AS n, corr(volume, {c}{k}) AS r FROM l GROUP BY 2" for k in range(91) for nm, c in (('direction', 'd'), ('magnitude', 'a')))})""",
)
def _(spark, sf):
    x = r1d(spark, sf).withColumn("a", F.abs("r"))
    lags = list(range(91))
    parts = [
        S.lead_lag(x, BARS_1D, "volume", y, lags, ["series_id"]).withColumn("target", F.lit(name))
        for name, y in (("direction", "r"), ("magnitude", "a"))
    ]
    return parts[0].unionByName(parts[1])


@query(
    "correlation_change_test",
    "series_id n_pre:i n_post:i r_pre:6 r_post:6 z:5 p:6",
    f"""{R1D_SQL}, g AS (SELECT series_id, count(r + volume) FILTER (WHERE ts < TIMESTAMP '1997-01-01') AS n_pre,
      count(r + volume) FILTER (WHERE ts >= TIMESTAMP '1997-01-01') AS n_post,
      corr(r, volume) FILTER (WHERE ts < TIMESTAMP '1997-01-01') AS r_pre, corr(r, volume) FILTER (WHERE ts >= TIMESTAMP '1997-01-01') AS r_post FROM x GROUP BY 1),
    u AS (SELECT *, (atanh(r_pre) - atanh(r_post)) / sqrt(1.0 / (n_pre - 3) + 1.0 / (n_post - 3)) AS z FROM g),
    t AS (SELECT *, {norm_tail_sql('z')} AS p FROM u)""",
)
def _(spark, sf):
    return S.corr_change(r1d(spark, sf), "r", "volume", "ts", "1997-01-01", ["series_id"])


CHOW_DATES = ["1996-06-01", "1998-06-01", "2000-06-01", "2030-01-01"]


def _rss(cond: str) -> str:
    f = f"FILTER (WHERE {cond})"
    return f"(regr_syy(close, i) {f} - pow(regr_sxy(close, i) {f}, 2) / regr_sxx(close, i) {f})"


@query(
    "trend_break_test",
    "series_id date:t n_left:i n_right:i f:4 p:6",
    f"""{BARS_1D_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts)::DOUBLE AS i FROM bars),
    d AS (SELECT unnest([{', '.join(f"TIMESTAMP '{d}'" for d in CHOW_DATES)}]) AS date),
    g AS (SELECT series_id, date, count(*) FILTER (WHERE ts < date) AS n_left, count(*) FILTER (WHERE ts >= date) AS n_right,
      {_rss('true')} AS a, {_rss('ts < date')} AS l, {_rss('ts >= date')} AS r FROM n, d GROUP BY 1, 2),
    u AS (SELECT *, ((a - l - r) / 2) / ((l + r) / (n_left + n_right - 4)) AS f FROM g WHERE n_left >= 30 AND n_right >= 30),
    t AS (SELECT *, pow(1 + 2 * f / (n_left + n_right - 4), -(n_left + n_right - 4) / 2.0) AS p FROM u)""",
)
def _(spark, sf):
    return S.chow(bars_1d(spark, sf), BARS_1D, "close", CHOW_DATES, ["series_id"])


@query(
    "signal_separation",
    "series_id signal mean_up:6 mean_down:6 mean_else:6 std:6 separation:6 place:i",
    f"""{SCORES_SQL}, u AS (SELECT series_id, regime, 'p' AS signal, p AS v FROM scores UNION ALL SELECT series_id, regime, 'ret', ret FROM scores
      UNION ALL SELECT series_id, regime, 'close', close FROM scores),
    g AS (SELECT series_id, signal, avg(v) FILTER (WHERE regime = 'up') AS mean_up, avg(v) FILTER (WHERE regime = 'down') AS mean_down,
      avg(v) FILTER (WHERE regime = 'flat') AS mean_else, stddev_samp(v) AS std FROM u GROUP BY 1, 2),
    s AS (SELECT *, abs(mean_up - mean_down) / std AS separation FROM g),
    t AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY coalesce(separation, 0) DESC, signal) AS place FROM s)""",
)
def _(spark, sf):
    return S.separation(scores(spark, sf), "regime", ["p", "ret", "close"], "up", "down", ["series_id"])


@query(
    "reversal_statistics",
    "series_id signal n1:i n2:i m1:6 m2:6 t:5 p:6",
    f"""{SCORES_SQL}, f AS (SELECT *, NOT coalesce(sign(ret) = sign({lag('ret', 5)}), false) AS flip FROM scores),
    u AS (SELECT series_id, flip, 'p' AS signal, p AS v FROM f UNION ALL SELECT series_id, flip, 'r', r FROM f),
    m AS (SELECT series_id, signal, count(v) FILTER (WHERE flip) AS n1, avg(v) FILTER (WHERE flip) AS m1, var_samp(v) FILTER (WHERE flip) AS v1,
      count(v) FILTER (WHERE NOT flip) AS n2, avg(v) FILTER (WHERE NOT flip) AS m2, var_samp(v) FILTER (WHERE NOT flip) AS v2 FROM u GROUP BY 1, 2),
    w AS (SELECT *, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t,
      pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS dof FROM m),
    t AS (SELECT *, {t_tail_sql('t', 'dof')} AS p FROM w)""",
)
def _(spark, sf):
    return S.reversal(scores(spark, sf), BARS_4H, "ret", ["p", "r"], ["series_id"])


@query(
    "event_study",
    "series_id class n:i mean_r1:6 mean_r5:6 hit:6",
    f"""{BARS_1D_SQL}, y AS (SELECT series_id, ts, close / {lag('close')} - 1 AS surprise, {lead('close')} / close - 1 AS r1, {lead('close', 5)} / close - 1 AS r5 FROM bars),
    d AS (SELECT DISTINCT date_trunc('month', ts) + INTERVAL 14 DAY AS d, series_id FROM bars),
    o AS (SELECT d.series_id, d.d, b.ts FROM d ASOF JOIN bars b ON d.series_id = b.series_id AND d.d <= b.ts),
    e AS (SELECT y.*, CASE WHEN surprise IS NULL THEN 'unknown' WHEN surprise > 0.2 THEN 'hawkish' WHEN surprise < -0.2 THEN 'dovish' ELSE 'neutral' END AS class
      FROM o JOIN y USING (series_id, ts)),
    t AS (SELECT series_id, class, count(*) AS n, avg(r1) AS mean_r1, avg(r5) AS mean_r5,
      avg((CASE WHEN class = 'dovish' THEN r5 > 0 ELSE r5 < 0 END)::INT) AS hit FROM e WHERE class <> 'unknown' GROUP BY 1, 2)""",
)
def _(spark, sf):
    bars = bars_1d(spark, sf)
    dates = bars.select(
        "series_id", (F.date_trunc("month", "ts") + F.expr("INTERVAL 14 DAYS")).alias("ts")
    ).distinct()
    y = over_series(
        bars, BARS_1D, {"surprise": R.ret("close"), "r1": L.fwd_return("close", 1), "r5": L.fwd_return("close", 5)}
    )
    on_grid = asof_forward(dates, bars, BARS_1D, name="obs").filter(F.col("obs").isNotNull())
    events = on_grid.select("series_id", F.col("obs").alias("ts")).join(y, ["series_id", "ts"])
    return S.event_study(events, "surprise", ["r1", "r5"], ["series_id"], 0.2)


@query(
    "extreme_events",
    "series_id type n:i mean:6 std:6 hit:6",
    f"""{BARS_1D_SQL}, z AS (SELECT series_id, ts, (volume - {roll('avg(volume)', 'volume', 14)}) / nullif({roll('stddev_samp(volume)', 'volume', 14)}, 0) AS z,
      {lead('close', 5)} / close - 1 AS y FROM bars), e AS (SELECT *, CASE WHEN z > 0 THEN 'EXTREME_LONG' ELSE 'EXTREME_SHORT' END AS type FROM z WHERE abs(z) >= 2),
    t AS (SELECT series_id, type, {OUT.format(y='y')} FROM e GROUP BY 1, 2)""",
)
def _(spark, sf):
    df = over_series(bars_1d(spark, sf), BARS_1D, {"z": R.zscore("volume", 14), "y": L.fwd_return("close", 5)})
    return S.extremes(df, "z").groupBy("series_id", "type").agg(*S.outcome("y"))


@query(
    "latest_extremes",
    "series_id ts z:5 type",
    f"""{BARS_1D_SQL}, z AS (SELECT series_id, ts, (volume - {roll('avg(volume)', 'volume', 14)}) / nullif({roll('stddev_samp(volume)', 'volume', 14)}, 0) AS z FROM bars),
    t AS (SELECT *, CASE WHEN z > 0 THEN 'EXTREME_LONG' ELSE 'EXTREME_SHORT' END AS type FROM z WHERE abs(z) >= 2 ORDER BY ts DESC, series_id LIMIT 20)""",
)
def _(spark, sf):
    df = over_series(bars_1d(spark, sf), BARS_1D, {"z": R.zscore("volume", 14)})
    return S.top_n(S.extremes(df, "z"), "ts", 20, "series_id")


@query(
    "tail_probabilities",
    "series_id regime n:i mean:6 std:6 hit:6 p_fall:6 p_rise:6",
    f"""{SCORES_SQL}, t AS (SELECT series_id, regime, {OUT.format(y='ret')}, avg((ret < -0.05)::INT) AS p_fall, avg((ret > 0.05)::INT) AS p_rise FROM scores GROUP BY 1, 2)""",
)
def _(spark, sf):
    return S.tail_probs(scores(spark, sf), "regime", "ret", ["series_id"])


@query(
    "feature_scoring",
    "series_id feature n:i r:6 r_std:6 spread:6 power:i stability:i relevance:i total:i include:i",
    f"""{SCORES_SQL}, w AS (SELECT *, CASE WHEN count(p + ret) OVER {frame(-89)} >= 90 THEN corr(p, ret) OVER {frame(-89)} END AS c_p,
      CASE WHEN count(r + ret) OVER {frame(-89)} >= 90 THEN corr(r, ret) OVER {frame(-89)} END AS c_r FROM scores),
    g AS (SELECT series_id, 'p' AS feature, count(p + ret) AS n, corr(p, ret) AS r, stddev_samp(c_p) AS r_std, stddev_samp(p) AS std FROM w GROUP BY 1
      UNION ALL SELECT series_id, 'r', count(r + ret), corr(r, ret), stddev_samp(c_r), stddev_samp(r) FROM w GROUP BY 1),
    m AS (SELECT series_id, regime, avg(p) AS p, avg(r) AS r FROM scores WHERE regime IS NOT NULL GROUP BY 1, 2),
    s AS (SELECT series_id, 'p' AS feature, max(p) - min(p) AS spread FROM m GROUP BY 1 UNION ALL SELECT series_id, 'r', max(r) - min(r) FROM m GROUP BY 1),
    j AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS tt FROM g JOIN s USING (series_id, feature)),
    k AS (SELECT *, {t_tail_sql('tt', '(n - 2)')} AS pv FROM j),
    q AS (SELECT *, CASE WHEN abs(r) > 0.1 AND pv < 0.05 THEN 3 WHEN abs(r) > 0.05 AND pv < 0.1 THEN 2 WHEN abs(r) > 0.02 THEN 1 ELSE 0 END AS power,
      CASE WHEN r_std < 0.1 THEN 3 WHEN r_std < 0.2 THEN 2 ELSE 1 END AS stability,
      CASE WHEN spread / std > 0.5 THEN 3 WHEN spread / std > 0.2 THEN 2 ELSE 1 END AS relevance FROM k),
    t AS (SELECT *, power + stability + relevance AS total, (power + stability + relevance >= 5)::INT AS include FROM q)""",
)
def _(spark, sf):
    return S.score_features(scores(spark, sf), BARS_4H, ["p", "r"], "ret", "regime", ["series_id"])


@query(
    "touch_time_statistics",
    "series_id rows:i hit_rate:6 p10:4 p25:4 median:4 p75:4",
    f"""{TOUCH_SQL}, t AS (SELECT series_id, count(*) AS rows, count(up_minutes) / count(*) AS hit_rate, quantile_cont(up_minutes::DOUBLE, 0.1) AS p10,
      quantile_cont(up_minutes::DOUBLE, 0.25) AS p25, quantile_cont(up_minutes::DOUBLE, 0.5) AS median, quantile_cont(up_minutes::DOUBLE, 0.75) AS p75 FROM touch GROUP BY 1)""",
)
def _(spark, sf):
    return S.touch_stats(touches(spark, sf), "up_minutes", ["series_id"])


@query(
    "entry_statistics",
    "series_id target:4 n:i hit_rate:6 stop_rate:6 ratio:6",
    f"""{BARS_1H_SQL}, d AS (SELECT *, close - {lag('close')} AS mv FROM bars),
    e AS (SELECT *, {rsi_sql(14)} AS rsi, {ahead('max(high)', 'high', 24)} / close - 1 AS up, {ahead('min(low)', 'low', 24)} / close - 1 AS down FROM d),
    f AS (SELECT * FROM e, (VALUES (0.5), (1.0), (5.0)) v(target) WHERE rsi < 45 AND up IS NOT NULL AND down IS NOT NULL),
    t AS (SELECT series_id, target, count(*) AS n, avg((up >= target)::INT) AS hit_rate, avg((down <= -0.9)::INT) AS stop_rate,
      avg((up >= target)::INT) / greatest(avg((down <= -0.9)::INT), 0.01) AS ratio FROM f GROUP BY 1, 2)""",
)
def _(spark, sf):
    move, strength = R.rsi("close", 14)
    df = over_series(
        bars_1h(spark, sf),
        BARS_1H,
        move | {"up": L.fwd_up("high", "close", 24), "down": L.fwd_down("low", "close", 24)},
        strength,
    )
    return S.entry_stats(df, F.col("rsi_14") < 45, "up", "down", [0.5, 1.0, 5.0], 0.9, ["series_id"])


TRANS_SQL = f"""{SCORES_SQL}, l AS (SELECT series_id, regime AS from_state, {lead('regime')} AS to_state FROM scores),
    c AS (SELECT series_id, from_state, to_state, count(*) AS n FROM l WHERE from_state IS NOT NULL AND to_state IS NOT NULL GROUP BY 1, 2, 3),
    tr AS (SELECT *, n / sum(n) OVER (PARTITION BY series_id, from_state) AS p FROM c)"""


@query("state_transitions", "series_id from_state to_state n:i p:6", f"{TRANS_SQL}, t AS (SELECT * FROM tr)")
def _(spark, sf):
    return S.transitions(scores(spark, sf), BARS_4H, "regime", ["series_id"])


@query(
    "state_persistence",
    "series_id mean_diagonal:6",
    f"{TRANS_SQL}, t AS (SELECT series_id, sum(CASE WHEN from_state = to_state THEN p ELSE 0 END) / count(DISTINCT from_state) AS mean_diagonal FROM tr GROUP BY 1)",
)
def _(spark, sf):
    return S.persistence(S.transitions(scores(spark, sf), BARS_4H, "regime", ["series_id"]), ["series_id"])


@query(
    "value_shares",
    "series_id regime n:i share:6",
    f"{SCORES_SQL}, c AS (SELECT series_id, regime, count(*) AS n FROM scores GROUP BY 1, 2), t AS (SELECT *, n / sum(n) OVER (PARTITION BY series_id) AS share FROM c)",
)
def _(spark, sf):
    return S.value_shares(scores(spark, sf), "regime", ["series_id"])


@query(
    "dominant_value",
    "series_id regime n:i",
    f"""{SCORES_SQL}, c AS (SELECT series_id, regime, count(*) AS n FROM scores WHERE regime IS NOT NULL GROUP BY 1, 2),
    t AS (SELECT series_id, first(regime ORDER BY n DESC, regime) AS regime, max(n) AS n FROM c GROUP BY 1)""",
)
def _(spark, sf):
    return S.dominant(scores(spark, sf), "regime", ["series_id"])


@query(
    "part_of_total_check",
    "series_id rows:i mean_share:6 violations:i",
    f"""{BARS_4H_SQL}, b AS (SELECT *, volume * (CASE WHEN trades % 6 = 0 THEN 0.3 ELSE 1 END) AS whole FROM bars),
    t AS (SELECT series_id, count(*) AS rows, avg(taker_buy_base_volume / nullif(whole, 0)) AS mean_share, sum((whole < taker_buy_base_volume)::INT) AS violations FROM b GROUP BY 1)""",
)
def _(spark, sf):
    bars = bars_4h(spark, sf)
    whole = bars.withColumn("whole", F.when(F.col("trades") % 6 == 0, F.col("volume") * 0.3).otherwise(F.col("volume")))
    return S.share_check(bars, whole, ["series_id", "ts"], "taker_buy_base_volume", "whole", ["series_id"])


@query(
    "distribution_overlap",
    "series_id n_a:i n_b:i overlap:6",
    f"""{R1D_SQL}, k AS (SELECT *, CASE WHEN close > open THEN 'up' ELSE 'down' END AS state FROM x WHERE r IS NOT NULL),
    s AS (SELECT series_id, min(r) AS lo, max(r) AS hi, sum((state = 'up')::INT) AS n_a, sum((state = 'down')::INT) AS n_b FROM k GROUP BY 1),
    h AS (SELECT k.series_id, n_a, n_b, least(floor((r - lo) / ((hi - lo) / 60)), 59) AS bin, sum((state = 'up')::INT) AS ca, sum((state = 'down')::INT) AS cb
      FROM k JOIN s USING (series_id) GROUP BY 1, 2, 3, 4),
    t AS (SELECT series_id, n_a, n_b, sum(least(ca / n_a, cb / n_b)) AS overlap FROM h GROUP BY 1, 2, 3)""",
)
def _(spark, sf):
    df = r1d(spark, sf).withColumn("state", F.when(F.col("close") > F.col("open"), "up").otherwise("down"))
    return S.overlap(df, "state", "up", "down", "r", ["series_id"])


@query(
    "training_start",
    "series_id start:t",
    f"""{BARS_1D_SQL}, b AS (SELECT series_id, ts, trades % 3 = 0 AS confirmed FROM bars WHERE day(ts) = 1),
    t AS (SELECT series_id, coalesce(max(ts) FILTER (WHERE confirmed AND date_diff('day', ts, TIMESTAMP '1998-08-01') >= 365), TIMESTAMP '1992-01-01') AS start FROM b GROUP BY 1)""",
)
def _(spark, sf):
    breaks = bars_1d(spark, sf).filter(F.dayofmonth("ts") == 1).withColumn("confirmed", F.col("trades") % 3 == 0)
    return S.choose_start(breaks, "ts", "1998-08-01", ["series_id"], "1992-01-01")


DESC = "count({v}) AS count, avg({v}) AS mean, stddev_samp({v}) AS std, min({v}) AS min, max({v}) AS max, sum(({v} > 0)::INT) AS positive, sum(({v} < 0)::INT) AS negative, quantile_cont({v}, 0.25) AS q25, quantile_cont({v}, 0.5) AS q50, quantile_cont({v}, 0.75) AS q75, arg_max(ts, {v}) AS max_at, arg_min(ts, {v}) AS min_at"


@query(
    "column_summary",
    "series_id feature count:i mean:6 std:6 min:6 max:6 positive:i negative:i q25:6 q50:6 q75:6 max_at:t min_at:t",
    f"""{R1D_SQL}, t AS (SELECT series_id, 'r' AS feature, {DESC.format(v='r')} FROM x GROUP BY 1
      UNION ALL SELECT series_id, 'close', {DESC.format(v='close')} FROM x GROUP BY 1)""",
)
def _(spark, sf):
    return S.describe(r1d(spark, sf), ["r", "close"], "ts", ["series_id"])


@query(
    "largest_and_smallest",
    "side series_id ts r:6",
    f"""{R1D_SQL}, t AS (SELECT * FROM (SELECT 'top' AS side, series_id, ts, r FROM x WHERE r IS NOT NULL ORDER BY r DESC, ts LIMIT 10)
      UNION ALL SELECT * FROM (SELECT 'bottom', series_id, ts, r FROM x WHERE r IS NOT NULL ORDER BY r, ts LIMIT 10)
      UNION ALL SELECT * FROM (SELECT 'absolute', series_id, ts, r FROM x WHERE r IS NOT NULL ORDER BY abs(r) DESC, ts LIMIT 10))""",
)
def _(spark, sf):
    x = r1d(spark, sf).filter(F.col("r").isNotNull())
    top = S.top_n(x, "r", 10, "ts").withColumn("side", F.lit("top"))
    low = S.top_n(x, "r", 10, "ts", largest=False).withColumn("side", F.lit("bottom"))
    absolute = S.top_n(x, F.abs("r"), 10, "ts").withColumn("side", F.lit("absolute"))
    return top.unionByName(low).unionByName(absolute)


@query(
    "best_row",
    "series_id ts close:4",
    f"{BARS_1D_SQL}, t AS (SELECT series_id, first(ts ORDER BY close DESC, ts) AS ts, max(close) AS close FROM bars GROUP BY 1)",
)
def _(spark, sf):
    return S.best(bars_1d(spark, sf), "close", ["series_id"], "ts")


@query(
    "sorted_within_series",
    "series_id ts row_no:i close:4",
    f"{BARS_4H_SQL}, t AS (SELECT series_id, ts, close, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS row_no FROM bars)",
)
def _(spark, sf):
    from barline.grid import numbered

    return numbered(bars_4h(spark, sf), BARS_4H)


