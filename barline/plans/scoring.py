"""Queries over classifier scores, signals and strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from barline.operators import evaluation as E
from barline.operators import permutation as P
from barline.plans.adapters import BARS_4H, SCORES_SQL, lag, scores
from barline.plans.registry import query

BM = """count(*) AS n, sum((y = 1 AND {c})::INT) AS tp, sum((y = 0 AND {c})::INT) AS fp, sum((y = 1 AND NOT ({c}))::INT) AS fn, sum((y = 0 AND NOT ({c}))::INT) AS tn"""


@query(
    "binary_metrics",
    "series_id n:i accuracy:6 precision:6 recall:6 f1:6 balance:6",
    f"""{SCORES_SQL}, c AS (SELECT series_id, {BM.format(c='p >= 0.5')} FROM scores WHERE y IS NOT NULL GROUP BY 1),
    t AS (SELECT *, (tp + tn) / n AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
      coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, (tp + fn) / n AS balance FROM c)""",
)
def _(spark, sf):
    return E.binary_metrics(scores(spark, sf), "y", F.col("p") >= 0.5, ["series_id"])


def auc_sql(rows: str, by: str) -> str:
    return f"""(SELECT {by}, count(*) AS n, (sum(CASE WHEN y = 1 THEN rk END) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0) AS auc
      FROM (SELECT {by}, y, rank() OVER (PARTITION BY {by} ORDER BY p) + (count(*) OVER (PARTITION BY {by}, p) - 1) / 2.0 AS rk FROM {rows}) GROUP BY 1)"""


@query(
    "roc_auc",
    "regime n_all:i auc_all:6 n_sure:i auc_sure:6 baseline:2",
    f"""{SCORES_SQL}, s AS (SELECT * FROM scores WHERE y IS NOT NULL AND regime IS NOT NULL), c AS (SELECT * FROM s WHERE abs(p - 0.5) > 0.1),
    a AS {auc_sql('s', 'regime')}, b AS {auc_sql('c', 'regime')},
    t AS (SELECT a.regime, a.n AS n_all, CASE WHEN a.n >= 10 THEN a.auc END AS auc_all, coalesce(b.n, 0) AS n_sure,
      CASE WHEN b.n >= 10 THEN b.auc END AS auc_sure, 0.5 AS baseline FROM a LEFT JOIN b USING (regime))""",
)
def _(spark, sf):
    return E.auc_report(scores(spark, sf).filter(F.col("regime").isNotNull()), "y", "p", ["regime"])


SWEEP_SQL = f"""{SCORES_SQL}, th AS (SELECT unnest([0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70])::DOUBLE AS threshold),
    c AS (SELECT series_id, threshold, {BM.format(c='p >= threshold')} FROM scores, th WHERE y IS NOT NULL GROUP BY 1, 2),
    sw AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
      coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, (tp + fp) / n AS coverage FROM c)"""


@query(
    "threshold_sweep",
    "series_id threshold:2 n:i precision:6 recall:6 f1:6 coverage:6",
    f"{SWEEP_SQL}, t AS (SELECT * FROM sw)",
)
def _(spark, sf):
    return E.threshold_sweep(scores(spark, sf), "y", "p", ["series_id"])


@query(
    "threshold_choice",
    "series_id threshold:2 f1:6",
    f"""{SWEEP_SQL}, t AS (SELECT series_id, coalesce(first(threshold ORDER BY f1 DESC, threshold) FILTER (WHERE coverage >= 0.2), 0.5) AS threshold, max(f1) FILTER (WHERE coverage >= 0.2) AS f1 FROM sw GROUP BY 1)""",
)
def _(spark, sf):
    return E.recommend_threshold(E.threshold_sweep(scores(spark, sf), "y", "p", ["series_id"]), ["series_id"])


@query(
    "score_confidence",
    "series_id n:i mean_confidence:6 confident_share:6 entry_share:6",
    f"""{SCORES_SQL}, t AS (SELECT series_id, count(p) AS n, avg(abs(p - 0.5)) AS mean_confidence, avg((abs(p - 0.5) > 0.1)::INT) AS confident_share,
      avg((p > 0.6 AND abs(p - 0.5) > 0.1)::INT) AS entry_share FROM scores GROUP BY 1)""",
)
def _(spark, sf):
    return E.confidence(scores(spark, sf), "p", ["series_id"])


@query(
    "metrics_by_split",
    "series_id s1:6 s2:6 s3:6 mean:6 std:6 baseline:2 lift:6 stable:i",
    f"""{SCORES_SQL}, g AS (SELECT series_id, split, avg(y) AS m FROM scores GROUP BY 1, 2),
    t AS (SELECT series_id, max(m) FILTER (WHERE split = 's1') AS s1, max(m) FILTER (WHERE split = 's2') AS s2, max(m) FILTER (WHERE split = 's3') AS s3,
      avg(m) AS mean, stddev_samp(m) AS std, 0.5 AS baseline, avg(m) - 0.5 AS lift, (stddev_samp(m) <= 0.02)::INT AS stable FROM g GROUP BY 1)""",
)
def _(spark, sf):
    m = scores(spark, sf).groupBy("series_id", "split").agg(F.avg("y").alias("m"))
    return E.metrics_pivot(m, "series_id", "split", "m", ["s1", "s2", "s3"])


@query(
    "importance_summary",
    "feature importance:6 splits:i place:i",
    """e AS (SELECT event_type AS feature, day(ts) AS d, avg(value) / 100 AS v FROM events GROUP BY 1, 2),
    g AS (SELECT feature, avg(round(v, 8)) AS importance, count(*) AS splits FROM e GROUP BY 1),
    t AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY importance DESC, feature) AS place FROM g) WHERE place <= 3)""",
)
def _(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").groupBy(F.dayofmonth("ts").alias("split"), "event_type").agg(
        F.round(F.avg("value") / 100, 8).alias("v")
    )
    maps = e.groupBy("split").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("event_type", "v")))).alias("importances"))
    return E.importance_summary(maps, "importances", [], 3)


@query(
    "regime_metrics",
    "split n:i e_up:6 e_down:6 delta:6 precision_up:6 precision_down:6 share_up:6 duration_up:6 duration_down:6",
    f"""{SCORES_SQL}, s AS (SELECT * FROM scores WHERE ret IS NOT NULL),
    c AS (SELECT *, (state IS DISTINCT FROM {lag('state', 1, 'series_id, split')})::INT AS b FROM s),
    d AS (SELECT split, count(*) FILTER (WHERE state = 1) / sum(b) FILTER (WHERE state = 1) AS duration_up,
      count(*) FILTER (WHERE state = 0) / sum(b) FILTER (WHERE state = 0) AS duration_down FROM c GROUP BY 1),
    g AS (SELECT split, count(*) AS n, avg(ret) FILTER (WHERE state = 1) AS e_up, avg(ret) FILTER (WHERE state = 0) AS e_down,
      avg(ret) FILTER (WHERE state = 1) - avg(ret) FILTER (WHERE state = 0) AS delta, avg((ret > 0)::INT) FILTER (WHERE state = 1) AS precision_up,
      avg((ret < 0)::INT) FILTER (WHERE state = 0) AS precision_down, avg(state) AS share_up FROM s GROUP BY 1),
    t AS (SELECT * FROM g JOIN d USING (split))""",
)
def _(spark, sf):
    return E.regime_metrics(scores(spark, sf), "split", "state", "ret", BARS_4H)


@query(
    "signal_evaluation",
    "split delta:6 sharpe:5 pct_long:6 pct_short:6 pct_neutral:6 n_long:i n_short:i",
    f"""{SCORES_SQL}, s AS (SELECT *, CASE WHEN signal = 1 THEN ret WHEN signal = -1 THEN -ret ELSE 0 END AS sr FROM scores WHERE ret IS NOT NULL),
    t AS (SELECT split, avg(ret) FILTER (WHERE signal = 1) - avg(ret) FILTER (WHERE signal = -1) AS delta,
      avg(sr) / (stddev_pop(sr) + 1e-8) * sqrt(252.0 / 5) AS sharpe, avg((signal = 1)::INT) AS pct_long, avg((signal = -1)::INT) AS pct_short,
      avg((signal = 0)::INT) AS pct_neutral, sum((signal = 1)::INT) AS n_long, sum((signal = -1)::INT) AS n_short FROM s GROUP BY 1)""",
)
def _(spark, sf):
    return E.evaluate_signals(scores(spark, sf), "signal", "ret", ["split"])


def perf_sql(part: str, cost: str = "0.001", held: str = "signal", charge: str = "abs(turnover)", scale: str = "0.01", source: str = "scores") -> str:
    """The strategy summary as SQL over (part, ts) rows; equity is a running product."""
    w = f"(PARTITION BY {part} ORDER BY ts)"
    return f"""pf0 AS (SELECT {part}, ts, ret * {scale} AS rr, {held} AS held{', cost' if cost == 'cost' else ''} FROM {source} WHERE ret IS NOT NULL),
    pf1 AS (SELECT *, held - coalesce(lag(held) OVER {w}, 0) AS turnover FROM pf0),
    pf2 AS (SELECT *, held * rr - {cost} * {charge} AS net FROM pf1),
    pf3 AS (SELECT *, product(1 + net) OVER {w} AS equity FROM pf2),
    pf4 AS (SELECT *, equity / max(equity) OVER {w} - 1 AS dd FROM pf3),
    pf5 AS (SELECT {part}, count(*) AS n, last(equity ORDER BY ts) AS equity, min(dd) AS max_drawdown, avg(net) / (stddev_pop(net) + 1e-10) * sqrt(252) AS sharpe,
      avg(CASE WHEN net <> 0 THEN (net > 0)::INT END) AS hit_rate, sum(net) FILTER (WHERE net > 0) / abs(sum(net) FILTER (WHERE net < 0)) AS profit_factor,
      sum((turnover <> 0)::INT) AS trades, sum(net) AS total_net FROM pf4 GROUP BY {', '.join(part.split(', '))}),
    perf AS (SELECT *, CASE WHEN equity > 0 THEN pow(equity, 252.0 / n) - 1 END AS cagr FROM pf5)"""


PERF_COLS = "n:i equity:6 max_drawdown:6 sharpe:5 hit_rate:6 profit_factor:6 trades:i total_net:6 cagr:5"


def scaled_scores(spark, sf):
    return scores(spark, sf).withColumn("ret", F.col("ret") * 0.01)


@query("strategy_performance", f"series_id {PERF_COLS}", f"{SCORES_SQL}, {perf_sql('series_id')}, t AS (SELECT * FROM perf)")
def _(spark, sf):
    return E.performance(scaled_scores(spark, sf), BARS_4H, "signal", "ret", 0.001)


@query(
    "equity_curve",
    "series_id ts net:6 equity:6 drawdown:6",
    f"{SCORES_SQL}, {perf_sql('series_id', charge='(turnover <> 0)::INT')}, t AS (SELECT series_id, ts, net, equity, dd AS drawdown FROM pf4)",
)
def _(spark, sf):
    return E.equity_curve(scaled_scores(spark, sf), BARS_4H, "signal", "ret", 0.001, cost_on="change")


@query(
    "performance_by_regime",
    f"series_id regime {PERF_COLS}",
    f"{SCORES_SQL}, s AS (SELECT * FROM scores WHERE regime IS NOT NULL), {perf_sql('series_id, regime', source='s')}, t AS (SELECT * FROM perf)",
)
def _(spark, sf):
    df = scaled_scores(spark, sf).filter(F.col("regime").isNotNull())
    return E.performance(df, BARS_4H.by("regime"), "signal", "ret", 0.001)


@query("buy_and_hold", f"series_id {PERF_COLS}", f"{SCORES_SQL}, {perf_sql('series_id', '0', '1')}, t AS (SELECT * FROM perf)")
def _(spark, sf):
    return E.performance(scaled_scores(spark, sf).withColumn("one", F.lit(1)), BARS_4H, "one", "ret")


@query(
    "cost_stress",
    f"series_id cost:6 {PERF_COLS}",
    f"{SCORES_SQL}, s AS (SELECT * FROM scores, (VALUES (0.0), (0.0005), (0.002)) v(cost)), {perf_sql('series_id, cost', 'cost', source='s').replace('AS held, cost', 'AS held')}, t AS (SELECT * FROM perf)",
)
def _(spark, sf):
    return E.cost_stress(scaled_scores(spark, sf), BARS_4H, "signal", "ret", [0.0, 0.0005, 0.002])


@query(
    "performance_next_row_entry",
    f"series_id {PERF_COLS}",
    f"""{SCORES_SQL}, s AS (SELECT *, coalesce({lag('signal')}, 0) AS s1 FROM scores WHERE ret IS NOT NULL), {perf_sql('series_id', held='s1', source='s')}, t AS (SELECT * FROM perf)""",
)
def _(spark, sf):
    return E.performance(scaled_scores(spark, sf), BARS_4H, "signal", "ret", 0.001, entry_lag=1)


@query(
    "live_curve_metrics",
    "series_id n_days:i sharpe:5 max_drawdown:6 hit_rate:6 n_trades:i cagr:5 sharpe_vs_target:5",
    f"""{SCORES_SQL}, v AS (SELECT *, exp(sum(ln(1 + coalesce(r, 0) * 0.01)) OVER w) * 1000 AS value, p - lag(p) OVER w AS turn, r * 0.01 AS dr
      FROM scores WINDOW w AS (PARTITION BY series_id ORDER BY ts)),
    m AS (SELECT *, value / max(value) OVER (PARTITION BY series_id ORDER BY ts) - 1 AS dd FROM v),
    t AS (SELECT series_id, count(*) AS n_days, avg(dr) / (stddev_samp(dr) + 1e-10) * sqrt(252) AS sharpe, min(dd) AS max_drawdown,
      avg(CASE WHEN p > 0 THEN coalesce(dr > 0, false)::INT END) AS hit_rate, sum((abs(turn) > 0.05)::INT) AS n_trades,
      pow(last(value ORDER BY ts) / first(value ORDER BY ts), 252.0 / count(*)) - 1 AS cagr,
      avg(dr) / (stddev_samp(dr) + 1e-10) * sqrt(252) - 0.775 AS sharpe_vs_target FROM m GROUP BY 1)""",
)
def _(spark, sf):
    from barline.grid import running, sum_of

    df = scores(spark, sf).withColumn("dr", F.col("r") * 0.01)
    df = running(df, BARS_4H, {"_g": sum_of(F.ln(1 + F.coalesce("dr", F.lit(0.0))))})
    df = df.withColumn("value", F.exp("_g") * 1000)
    return E.curve_metrics(df, BARS_4H, "value", "p", "dr", targets={"sharpe": 0.775})


PERMUTATION_COLS = "series_id statistic real:6 runs:i mean:6 std:6 p:6 z:4 significant:i outlier_share:6 outlier:i"
#: Permutations of the registered queries, as many as the reference takes.
RUNS = 5000


def hashed_sql(x: str, a: str, b: str) -> str:
    t = f"((({x}) + {a}) * {b} % {P.PRIME})"
    t = f"(({t} * {t} + {a}) % {P.PRIME})"
    return f"(({t} * {b} + {x}) % {P.PRIME})"


def bijection_sql(source: str) -> str:
    """``v`` of the rows of ``source`` moved once by the keyed bijection of four rounds."""
    sql = f"SELECT *, v >> wd AS l, v & ((1::BIGINT << wd) - 1) AS r FROM {source}"
    for j in range(4):
        f = hashed_sql("r", f"k{j}", f"k{(j + 1) % 4}")
        sql = f"SELECT * EXCLUDE (l, r), r AS l, xor(l, ({f} >> 8) & ((1::BIGINT << wd) - 1)) AS r FROM ({sql})"
    return f"SELECT series_id, run, i, size, held, wd, k0, k1, k2, k3, (l << wd) | r AS v FROM ({sql})"


#: Per kind, (series_id, run, i, pos): the position at row i of each run.
PERMUTED_SQL = {
    "shuffle": f"""w AS ({bijection_sql('x')} UNION ALL {bijection_sql('(SELECT * FROM w WHERE v >= size)')}),
    d AS (SELECT series_id, run, i, (v < held)::INT AS pos FROM w WHERE v < size)""",
    "shift": """k AS (SELECT *, ((i - 1 - k0 % greatest(1, size - 1)) % size + size) % size AS src FROM x),
    d AS (SELECT k.series_id, k.run, k.i, n.lng AS pos FROM k JOIN n ON n.series_id = k.series_id AND n.i = k.src)""",
    "bootstrap": f"""k0 AS (SELECT *, CASE WHEN i = 0 OR {hashed_sql('i', 'k0', 'k1')} * 21 < {P.PRIME} THEN {hashed_sql('i', 'k2', 'k3')} % size - i END AS shift FROM x),
    k AS (SELECT *, last_value(shift IGNORE NULLS) OVER (PARTITION BY series_id, run ORDER BY i) AS moved FROM k0),
    d AS (SELECT k.series_id, k.run, k.i, n.lng AS pos FROM k JOIN n ON n.series_id = k.series_id AND n.i = ((k.i + k.moved) % k.size + k.size) % k.size)""",
}


def permutation_sql(kind: str) -> str:
    keys = ", ".join(f"1 + ('0x' || substr(h, {8 * j + 1}, 8))::BIGINT % {P.PRIME - 1} AS k{j}" for j in range(4))
    return f"""RECURSIVE {SCORES_SQL}, n AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i, (signal = 1)::INT AS lng, ret * 0.01 AS ret
      FROM scores WHERE ret IS NOT NULL AND signal IS NOT NULL),
    z0 AS (SELECT series_id, count(*) AS size, sum(lng) AS held FROM n GROUP BY 1),
    y AS (SELECT series_id, size, held, run, greatest(1, (length(bin(greatest(size - 1, 1))) + 1) // 2) AS wd, md5('42|' || series_id || '|' || run) AS h FROM z0, range(1, {RUNS + 1}) v(run)),
    u AS (SELECT * EXCLUDE (h), {keys} FROM y),
    x AS (SELECT series_id, run, i, size, held, wd, k0, k1, k2, k3, i AS v FROM u JOIN n USING (series_id)), {PERMUTED_SQL[kind]},
    a AS (SELECT series_id, 0 AS run, i, lng AS pos FROM n UNION ALL SELECT series_id, run, i, pos FROM d),
    b AS (SELECT a.series_id, run, a.i, pos, n.ret FROM a JOIN n USING (series_id, i)),
    c AS (SELECT *, pos * ret - 0.0012 * abs(pos - coalesce(lag(pos) OVER (PARTITION BY series_id, run ORDER BY i), 0)) AS net FROM b),
    e AS (SELECT series_id, run, avg(net) / (stddev_pop(net) + 1e-10) * sqrt(252) AS sharpe,
      CASE WHEN product(1 + net) >= 0 THEN pow(product(1 + net), 252.0 / count(*)) - 1 END AS cagr,
      sum(greatest(net, 0)) / nullif(-sum(least(net, 0)), 0) AS profit_factor FROM c GROUP BY 1, 2),
    l AS (SELECT series_id, run, 'sharpe' AS statistic, sharpe AS value FROM e UNION ALL SELECT series_id, run, 'cagr', cagr FROM e
      UNION ALL SELECT series_id, run, 'profit_factor', profit_factor FROM e),
    z AS (SELECT l.series_id, l.statistic, r.value AS real, coalesce(l.value, 0) AS value FROM l JOIN l r ON r.series_id = l.series_id AND r.statistic = l.statistic AND r.run = 0 WHERE l.run > 0),
    t0 AS (SELECT series_id, statistic, real, count(*) AS runs, avg(value) AS mean, stddev_pop(value) AS std, avg(coalesce(value >= real - abs(real) * 1e-9, false)::INT) AS p,
      avg(CASE WHEN real > 0 THEN (value >= 1.5 * real - abs(real) * 1e-9)::INT END) AS outlier_share FROM z GROUP BY 1, 2, 3),
    t AS (SELECT *, (real - mean) / (std + 1e-10) AS z, (p < 0.05)::INT AS significant, coalesce((outlier_share > 0)::INT, 0) AS outlier FROM t0)"""


def permutation(kind: str):
    @query(f"permutation_{kind}", PERMUTATION_COLS, permutation_sql(kind))
    def _(spark, sf):
        return P.permutation_test(scaled_scores(spark, sf), BARS_4H, "signal", "ret", kind, RUNS)


for _kind in PERMUTED_SQL:
    permutation(_kind)


@query(
    "pareto_frontier",
    "o_custkey:i mean_price:6 orders:i",
    """c AS (SELECT o_custkey, avg(o_totalprice) AS mean_price, count(*) AS orders FROM orders GROUP BY 1),
    t AS (SELECT * FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.orders >= a.orders AND b.mean_price >= a.mean_price
      AND (b.orders > a.orders OR b.mean_price > a.mean_price)))""",
)
def _(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    c = o.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("mean_price"), F.count(F.lit(1)).alias("orders"))
    return E.pareto(c, "orders", "mean_price")


@query(
    "pareto_targets",
    "o_custkey:i mean_price:6 orders:i largest:4",
    """c AS (SELECT o_custkey, avg(o_totalprice) AS mean_price, count(*) AS orders, max(o_totalprice) AS largest FROM orders GROUP BY 1),
    f AS (SELECT * FROM c WHERE mean_price > 100000 AND orders > 2 AND largest > 150000),
    t AS (SELECT * FROM f a WHERE NOT EXISTS (SELECT 1 FROM f b WHERE b.orders >= a.orders AND b.mean_price >= a.mean_price
      AND (b.orders > a.orders OR b.mean_price > a.mean_price)))""",
)
def _(spark, sf):
    """The front of the rows that meet all targets."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    c = o.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("mean_price"), F.count(F.lit(1)).alias("orders"), F.max("o_totalprice").alias("largest"))
    return E.pareto(E.meets(c, {"mean_price": 100_000, "orders": 2, "largest": 150_000}), "orders", "mean_price")


@query(
    "regime_agreement",
    "series_id n:i both_up:6 both_down:6 disagree:6",
    f"""{SCORES_SQL}, a AS (SELECT ts, state AS s FROM scores WHERE series_id = 'view'), j AS (SELECT series_id, state, s FROM scores JOIN a USING (ts) WHERE series_id <> 'view'),
    t AS (SELECT series_id, count(*) AS n, avg((state = 1 AND s = 1)::INT) AS both_up, avg((state = 0 AND s = 0)::INT) AS both_down, avg((state <> s)::INT) AS disagree FROM j GROUP BY 1)""",
)
def _(spark, sf):
    sc = scores(spark, sf)
    return E.agreement(sc.filter(F.col("series_id") != "view"), sc.filter(F.col("series_id") == "view"), ["ts"], "state", ["series_id"])


@query(
    "config_ranking",
    "series_id mean:6 splits:i place:i",
    f"""{SCORES_SQL}, d AS (SELECT series_id, split, avg(ret) FILTER (WHERE signal = 1) - avg(ret) FILTER (WHERE signal = -1) AS delta FROM scores GROUP BY 1, 2),
    g AS (SELECT series_id, avg(delta) AS mean, count(delta) AS splits FROM d GROUP BY 1),
    t AS (SELECT *, row_number() OVER (ORDER BY mean DESC NULLS LAST, series_id) AS place FROM g)""",
)
def _(spark, sf):
    per_split = E.evaluate_signals(scores(spark, sf), "signal", "ret", ["series_id", "split"])
    return E.rank_configs(per_split, "series_id", "delta")


@query(
    "conviction_matrix",
    "state:i band n:i mean:6",
    f"""{SCORES_SQL}, b AS (SELECT *, CASE WHEN p < 0.4 THEN 'low' WHEN p < 0.6 THEN 'neutral' ELSE 'high' END AS band FROM scores),
    t AS (SELECT state, band, count(*) AS n, CASE WHEN count(*) >= 3 THEN avg(ret) END AS mean FROM b GROUP BY 1, 2)""",
)
def _(spark, sf):
    return E.conviction_matrix(scores(spark, sf), "state", "p", "ret", [])


@query(
    "conviction_summary",
    "state:i n:i delta:6 edge:6 neutral_share:6 p25:6 p50:6 p75:6",
    f"""{SCORES_SQL}, t AS (SELECT state, count(*) AS n, avg(ret) FILTER (WHERE p >= 0.5) - avg(ret) FILTER (WHERE p < 0.5) AS delta,
      avg(ret) FILTER (WHERE p > 0.6) - avg(ret) FILTER (WHERE p < 0.4) AS edge, avg((p BETWEEN 0.4 AND 0.6)::INT) AS neutral_share,
      quantile_cont(p, 0.25) AS p25, quantile_cont(p, 0.5) AS p50, quantile_cont(p, 0.75) AS p75 FROM scores GROUP BY 1)""",
)
def _(spark, sf):
    return E.conviction_summary(scores(spark, sf), "state", "p", "ret", [])


@query(
    "confidence_edge",
    "split n_high:i share_high:6 high:6 low:6 edge:6",
    f"""{SCORES_SQL}, t AS (SELECT split, sum((p >= 0.55)::INT) AS n_high, avg((p >= 0.55)::INT) AS share_high, avg(ret) FILTER (WHERE p >= 0.55) AS high,
      avg(ret) FILTER (WHERE p < 0.55) AS low, avg(ret) FILTER (WHERE p >= 0.55) - avg(ret) FILTER (WHERE p < 0.55) AS edge FROM scores WHERE ret IS NOT NULL GROUP BY 1)""",
)
def _(spark, sf):
    return E.edge(scores(spark, sf), "p", "ret", 0.55, ["split"])


