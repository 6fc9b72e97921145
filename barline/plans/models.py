"""Queries over splits, learners and regime models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.functions.mathx import safe_div
from barline.grid import over_series
from barline.modelling import learners as M
from barline.modelling import persistence as H
from barline.modelling import regimes as G
from barline.modelling import splits as S
from barline.operators import labels as L
from barline.operators import rolling as R
from barline.operators.evaluation import auc_report, evaluate_signals, rank_configs, regime_metrics
from barline.operators.stats import transitions
from barline.plans.adapters import BARS_1D, BARS_1D_SQL, bars_1d, lag, lead, roll, table
from barline.plans.registry import query
from barline.ranks import quantiles
from barline.session import materialize

FEATURES = ["r", "vol_short", "vol_ratio", "drawdown", "volume_z"]
FEATURES_SQL = f"""{BARS_1D_SQL}, f0 AS (SELECT *, ln(close / {lag('close')}) AS r, close / {roll('max(close)', 'close', 90, 1)} - 1 AS drawdown,
      (volume - {roll('avg(volume)', 'volume', 30)}) / nullif({roll('stddev_samp(volume)', 'volume', 30)}, 0) AS volume_z, {lead('close', 5)} / close - 1 AS fwd FROM bars),
    f1 AS (SELECT *, {roll('stddev_samp(r)', 'r', 7)} AS vol_short, {roll('stddev_samp(r)', 'r', 30)} AS vol_long FROM f0),
    feat AS (SELECT series_id, ts, r, vol_short, vol_short / nullif(vol_long, 0) AS vol_ratio, drawdown, volume_z, fwd, (fwd > 0)::INT AS y FROM f1)"""


def features(spark, sf):
    df = over_series(
        bars_1d(spark, sf),
        BARS_1D,
        {"r": R.log_return("close"), "drawdown": R.drawdown("close", 90, 1), "volume_z": R.zscore("volume", 30), "fwd": L.fwd_return("close", 5)},
        {"vol_short": R.roll_std("r", 7), "vol_long": R.roll_std("r", 30)},
    )
    return df.select(
        "series_id", "ts", "r", "vol_short", safe_div("vol_short", "vol_long").alias("vol_ratio"), "drawdown", "volume_z", "fwd",
        F.when(F.col("fwd").isNotNull(), (F.col("fwd") > 0).cast("int")).alias("y"),
    )


SPLITS = [
    {"name": "w1", "train_start": "1995-01-01", "train_end": "1997-12-31", "test_start": "1998-01-01", "test_end": "1998-12-31"},
    {"name": "w2", "train_start": "1995-01-01", "train_end": "1998-12-28", "test_start": "1999-01-01", "test_end": "1999-12-31"},
    {"name": "w3", "train_start": "1995-01-01", "train_end": "1999-12-31", "test_start": "2000-01-01", "test_end": None},
    {"name": "empty", "train_start": "1960-01-01", "train_end": "1961-12-31", "test_start": "1962-01-01", "test_end": "1962-12-31"},
]


def split_sql(s: dict) -> str:
    upper = f" AND ts <= TIMESTAMP '{s['test_end']}'" if s["test_end"] else ""
    return f"""SELECT *, '{s['name']}' AS split, 'train' AS role FROM feat WHERE ts >= TIMESTAMP '{s['train_start']}' AND ts <= least(TIMESTAMP '{s['train_end']}', TIMESTAMP '{s['test_start']}' - INTERVAL 7 DAY)
      UNION ALL SELECT *, '{s['name']}', 'test' FROM feat WHERE ts >= TIMESTAMP '{s['test_start']}'{upper}"""


TAGGED_SQL = f"""{FEATURES_SQL}, tg0 AS ({' UNION ALL '.join(split_sql(s) for s in SPLITS)}),
    big AS (SELECT split FROM tg0 GROUP BY 1 HAVING sum((role = 'train')::INT) >= 30 AND sum((role = 'test')::INT) >= 5),
    tg AS (SELECT * FROM tg0 WHERE split IN (SELECT split FROM big))"""


@query("walk_forward_splits", "series_id ts split role r:6", f"{TAGGED_SQL}, t AS (SELECT * FROM tg)")
def _(spark, sf):
    return S.walk_forward(features(spark, sf), SPLITS)


@query(
    "standardised_features",
    "series_id ts split role " + " ".join(f"{c}:6" for c in FEATURES),
    f"""{TAGGED_SQL}, st AS (SELECT split, {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in FEATURES)} FROM tg WHERE role = 'train' GROUP BY 1),
    t AS (SELECT series_id, ts, split, role, {', '.join(f'({c} - m_{c}) / s_{c} AS {c}' for c in FEATURES)} FROM tg JOIN st USING (split))""",
)
def _(spark, sf):
    tagged = S.walk_forward(features(spark, sf), SPLITS)
    return S.standardize(tagged.filter("role = 'train'"), tagged, FEATURES, ["split"])


POSITIONS = [("p1", 400, 406, 600), ("p2", 500, 506, 750), ("p3", 650, 656, 850), ("p4", 800, 806, 1000), ("late", 99000, 99006, 99900)]


@query(
    "positional_splits",
    "series_id split role rows:i first_ts:t last_ts:t",
    f"""{FEATURES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1 AS i FROM feat WHERE r IS NOT NULL AND vol_ratio IS NOT NULL AND volume_z IS NOT NULL),
    g AS ({' UNION ALL '.join(f"SELECT series_id, ts, '{a}' AS split, 'train' AS role FROM n WHERE i < {b} UNION ALL SELECT series_id, ts, '{a}', 'test' FROM n WHERE i >= {c} AND i < {d}" for a, b, c, d in POSITIONS)}),
    t AS (SELECT series_id, split, role, count(*) AS rows, min(ts) AS first_ts, max(ts) AS last_ts FROM g WHERE split <> 'late' GROUP BY 1, 2, 3)""",
)
def _(spark, sf):
    rows = S.positional_splits(features(spark, sf), BARS_1D, POSITIONS, ["r", "vol_ratio", "volume_z"])
    return rows.groupBy("series_id", "split", "role").agg(
        F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


@query(
    "model_input",
    "series_id ts r:6 vol_ratio:6 p:6 regime_strength:6",
    f"""{FEATURES_SQL}, s AS (SELECT series_id, ts, taker_buy_quote_volume / quote_volume AS p FROM bars),
    t AS (SELECT *, abs(p - 0.5) AS regime_strength FROM feat JOIN s USING (series_id, ts) WHERE r IS NOT NULL AND vol_ratio IS NOT NULL AND p IS NOT NULL)""",
)
def _(spark, sf):
    states = bars_1d(spark, sf).select("series_id", "ts", F.try_divide("taker_buy_quote_volume", "quote_volume").alias("p"))
    return S.model_input(features(spark, sf), states, ["series_id", "ts"], "p", ["r", "vol_ratio"])


@query(
    "class_weights",
    "split series_id n_pos:i n_neg:i pos_weight:6 balanced_pos:6 balanced_neg:6",
    f"""{TAGGED_SQL}, c AS (SELECT split, series_id, sum((y = 1)::INT) AS n_pos, sum((y = 0)::INT) AS n_neg FROM tg WHERE role = 'train' GROUP BY 1, 2),
    t AS (SELECT *, n_neg / nullif(n_pos, 0) AS pos_weight, (n_pos + n_neg) / (2 * n_pos) AS balanced_pos, (n_pos + n_neg) / (2 * n_neg) AS balanced_neg FROM c)""",
)
def _(spark, sf):
    tagged = S.walk_forward(features(spark, sf), SPLITS)
    return S.class_weights(tagged.filter("role = 'train'"), "y", ["split", "series_id"])


def prepared(spark, sf):
    """Tagged rows without gaps, written once because every fit reads them several times."""
    tagged = S.walk_forward(features(spark, sf).na.drop("any", subset=FEATURES), SPLITS)
    return materialize(tagged, "model_rows")


#: The splits that have rows.
WALKS = ["w1", "w2", "w3"]


def per_split(rows, fit):
    """``fit`` on the rows of each split; its results with their split."""
    return M.in_parallel({(s,): lambda s=s: fit(rows.filter(F.col("split") == s)) for s in WALKS}, ["split"])


@query("boosted_classifier", "series_id ts split y:i p:6")
def _(spark, sf):
    rows = prepared(spark, sf).filter("y IS NOT NULL")
    train = rows.filter("role = 'train'")
    weights = S.class_weights(train, "y", ["split"])
    models = M.per_split({"y": {"features": FEATURES, "label": "y", "weight": "weight"}}, WALKS)
    return M.boost(S.weighted(rows, weights, "y", ["split"]), models)[1].withColumn("p", F.col("score"))


@query("classifier_importances", "split feature importance:6")
def _(spark, sf):
    rows = prepared(spark, sf)
    fitted = M.fit(rows.filter("role = 'train'"), M.per_split({"y": {"features": FEATURES, "label": "y"}}, WALKS), "split")
    return M.importances(fitted, rows).withColumn("split", F.substring_index("model", "/", -1))


@query("multiclass_forest", "series_id ts split label:i p_bear:6 p_neutral:6 p_bull:6 predicted:i")
def _(spark, sf):
    from barline.operators.rules import label_ternary

    rows = prepared(spark, sf).withColumn("label", label_ternary("fwd", 0.015, 0.010))

    def fit(part):
        model = M.fit_multiclass(part.filter("role = 'train'"), FEATURES, "label")
        return M.predict_classes(model, part.filter("role = 'test' AND label IS NOT NULL"), FEATURES, ["bear", "neutral", "bull"])

    return per_split(rows, fit)


@query("boosted_regressor", "series_id ts split target:6 pred:6")
def _(spark, sf):
    rows = prepared(spark, sf).withColumn("target", safe_div("fwd", "vol_short"))
    models = M.per_split({"target": {"features": FEATURES, "label": "target", "squared": True}}, WALKS)
    return M.boost(rows, models)[1].filter("target IS NOT NULL").withColumn("pred", F.col("score"))


@query("linear_baselines", "series_id ts split p:6 pred:6")
def _(spark, sf):
    def fit(part):
        train, test = part.filter("role = 'train'"), part.filter("role = 'test'")
        logistic = M.fit_linear(train, FEATURES, "y", "logistic", reg=0.01)
        elastic = M.fit_linear(train, FEATURES, "fwd", "elastic", reg=0.01, elastic=0.5)
        return M.predict_value(elastic, M.predict_probability(logistic, test, FEATURES), FEATURES)

    return per_split(prepared(spark, sf).filter("fwd IS NOT NULL"), fit)


@query("feature_set_ablation", "feature_set split n_all:i auc_all:6 n_sure:i auc_sure:6 baseline:2")
def _(spark, sf):
    rows = prepared(spark, sf).filter("y IS NOT NULL")
    sets = {"A": FEATURES[:2], "B": FEATURES[:4], "C": FEATURES}
    scored = M.ablate(rows, sets, WALKS, "y", ["series_id", "ts"])
    return auc_report(materialize(scored, "ablation"), "y", "p", ["feature_set", "split"])


@query("ablation_ranking", "feature_set mean:6 splits:i place:i")
def _(spark, sf):
    rows = prepared(spark, sf).filter("y IS NOT NULL")
    scored = M.ablate(rows, {"A": FEATURES[:2], "C": FEATURES}, WALKS, "y", ["series_id", "ts", "fwd"])
    sig = F.when(F.col("p") > 0.5, 1).otherwise(-1)
    per = evaluate_signals(scored.withColumn("signal", sig), "signal", "fwd", ["feature_set", "split"])
    return rank_configs(per, "feature_set", "delta")


@query("state_conditioned_models", "series_id ts split state:i y:i p:6")
def _(spark, sf):
    rows = prepared(spark, sf).filter("fwd IS NOT NULL")
    rows = rows.withColumns({"state": (F.col("drawdown") > -0.1).cast("int"), "down": (F.col("fwd") < -0.02).cast("int")})
    return M.fit_conditioned(rows, "state", {1: "y", 0: "down"}, FEATURES, WALKS, ["series_id", "ts"])


HORIZONS = [3, 5, 7]


def horizon_rows(spark, sf):
    """Tagged rows with the return over each horizon, and that return per unit of short volatility."""
    df = over_series(
        bars_1d(spark, sf),
        BARS_1D,
        {"r": R.log_return("close"), "drawdown": R.drawdown("close", 90, 1), "volume_z": R.zscore("volume", 30)}
        | {f"return_{h}": L.fwd_return("close", h) for h in HORIZONS},
        {"vol_short": R.roll_std("r", 7), "vol_long": R.roll_std("r", 30)},
    )
    df = df.withColumns({"vol_ratio": safe_div("vol_short", "vol_long")} | {f"target_{h}": safe_div(f"return_{h}", "vol_short") for h in HORIZONS})
    kept = ["series_id", "ts", *FEATURES, *[f"{k}_{h}" for h in HORIZONS for k in ("return", "target")]]
    tagged = S.walk_forward(df.select(*kept).na.drop("any", subset=FEATURES), SPLITS, horizon=max(HORIZONS))
    return materialize(tagged, "horizon_rows")


def ranked_signals(rows, fitted, ret, horizon):
    """Each setting's and split's signal measures: long above the 70th percentile of the training scores, short below the 30th."""
    scored = materialize(M.named_scores(rows, fitted), "scores")
    limits = quantiles(scored.filter("role = 'train'"), "score", {"low": 0.3, "high": 0.7}, ["setting", "split"])
    test = scored.filter("role = 'test'").join(limits, ["setting", "split"])
    signal = F.when(F.col("score") > F.col("high"), 1).when(F.col("score") < F.col("low"), -1).otherwise(0)
    return evaluate_signals(test.withColumn("signal", signal), "signal", ret, ["setting", "split"], horizon)


@query("horizon_ablation", "horizon:i split delta:6 sharpe:6 pct_long:6 pct_short:6 pct_neutral:6 n_long:i n_short:i")
def _(spark, sf):
    rows = horizon_rows(spark, sf)
    models = M.per_split({str(h): {"features": FEATURES, "label": f"target_{h}", "squared": True} for h in HORIZONS}, WALKS)
    fitted = M.fit(rows.filter("role = 'train'"), models, "split")
    parts = [
        ranked_signals(rows.filter(f"target_{h} IS NOT NULL"), [f for f in fitted if f.model.name.startswith(f"{h}/")], f"return_{h}", h).withColumn("horizon", F.lit(h))
        for h in HORIZONS
    ]
    return reduce(DataFrame.unionByName, parts)


@query("pruned_features", "feature_set features split delta:6 sharpe:6 n_long:i n_short:i")
def _(spark, sf):
    rows = prepared(spark, sf).withColumn("target", safe_div("fwd", "vol_short")).filter("target IS NOT NULL")
    train = rows.filter("role = 'train'")
    full = M.fit(train, M.per_split({"all": {"features": FEATURES, "label": "target", "squared": True}}, WALKS), "split")
    sets = {f"top{n}": M.prune(full[-1], n) for n in (3, 2)}
    models = M.per_split({k: {"features": v, "label": "target", "squared": True} for k, v in sets.items()}, WALKS)
    fitted = full + M.fit(train, models, "split")
    names = F.create_map(*[F.lit(x) for k, v in ({"all": FEATURES} | sets).items() for x in (k, ",".join(v))])
    return ranked_signals(rows, fitted, "fwd", 5).withColumns({"feature_set": F.col("setting"), "features": names[F.col("setting")]})


def swept(spark, sf, then=lambda sweep: sweep):
    rows = prepared(spark, sf).filter("role = 'train'")
    return per_split(S.standardize(rows, rows, FEATURES, ["split"]), lambda part: then(G.cluster_sweep(part, FEATURES, [2, 3, 4, 5, 6])))


@query("cluster_sweep", "split k:i inertia:4 silhouette:6 davies_bouldin:6 log_likelihood:4 aic:4 bic:4")
def _(spark, sf):
    return swept(spark, sf)


CLUSTER_SQL = f"{FEATURES_SQL}, cl AS (SELECT *, CASE WHEN drawdown > -0.1 THEN 2 WHEN r > 0 THEN 1 ELSE 0 END AS cluster FROM feat WHERE r IS NOT NULL)"


def clustered(spark, sf):
    c = F.when(F.col("drawdown") > -0.1, 2).when(F.col("r") > 0, 1).otherwise(0)
    return features(spark, sf).filter(F.col("r").isNotNull()).withColumn("cluster", c)


@query(
    "cluster_profiles",
    "series_id cluster:i n:i fwd_mean:6 mean_r:6 mean_drawdown:6 label:i",
    f"""{CLUSTER_SQL}, g AS (SELECT series_id, cluster, count(*) AS n, avg(fwd) AS fwd_mean, avg(r) AS mean_r, avg(drawdown) AS mean_drawdown FROM cl GROUP BY 1, 2),
    t AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY fwd_mean, cluster) - 1 AS label FROM g)""",
)
def _(spark, sf):
    return G.profiles(clustered(spark, sf), "cluster", ["r", "drawdown"], "fwd", ["series_id"])


@query(
    "cluster_stability",
    "series_id cluster:i feature years:i stability:6",
    f"""{CLUSTER_SQL}, u AS (SELECT series_id, cluster, year(ts) AS yr, 'r' AS feature, r AS v FROM cl UNION ALL SELECT series_id, cluster, year(ts), 'volume_z', volume_z FROM cl),
    w AS (SELECT series_id, cluster, feature, sign(avg(v)) AS s FROM u GROUP BY 1, 2, 3), y AS (SELECT series_id, cluster, feature, yr, sign(avg(v)) AS ys FROM u GROUP BY 1, 2, 3, 4),
    t AS (SELECT series_id, cluster, feature, count(*) AS years, avg((ys = s)::INT) AS stability FROM y JOIN w USING (series_id, cluster, feature) GROUP BY 1, 2, 3)""",
)
def _(spark, sf):
    return G.temporal_stability(clustered(spark, sf), "cluster", ["r", "volume_z"], "ts", ["series_id"])


@query("principal_components", "component:i explained:6 feature loading:6 driver_rank:i")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    wide = e.select(*[F.col("embedding")[i].cast("double").alias(f"d{i:02d}") for i in range(64)])
    return G.pca(wide, wide.columns, 2)


@query("regime_states", "series_id ts split role state:i p_bull:6")
def _(spark, sf):
    rows = prepared(spark, sf)
    scaled = materialize(S.standardize(rows.filter("role = 'train'"), rows, FEATURES, ["split"]), "scaled")
    return per_split(scaled, lambda part: G.fit_regimes(part, FEATURES, 2, train="role = 'train'"))


REGIME_PARAMS = {
    "center": [0.0, 0.5, 0.0],
    "scale": [0.5, 0.2, 1.0],
    "means": [[-0.2, 0.5, 0.3], [0.2, -0.5, -0.3]],
    "variances": [[1.5, 1.0, 1.2], [0.8, 0.9, 1.0]],
    "start": [0.5, 0.5],
    "transition": [[0.95, 0.05], [0.08, 0.92]],
}


def regime_sql(columns: list[str], q: dict) -> str:
    """``rs``: state and probability of the upper state from the ten-row context, for two states."""
    (a00, a01), (a10, a11) = q["transition"]
    density = [
        " + ".join(f"-0.5 * (ln(2 * pi() * {v}) + pow(({c} - {m}) / {w} - {mu}, 2) / {v})" for c, mu, v, m, w in zip(columns, mean, var, q["center"], q["scale"]))
        for mean, var in zip(q["means"], q["variances"])
    ]
    e = [f"exp(v[{j}] - greatest(v[1], v[2]))" for j in (1, 2)]
    up = f"((acc[1] * {a01} + acc[2] * {a11}) * {e[1]})"
    down = f"((acc[1] * {a00} + acc[2] * {a10}) * {e[0]})"
    first = f"{q['start'][1]} * exp(l[1][2] - greatest(l[1][1], l[1][2])) / ({q['start'][0]} * exp(l[1][1] - greatest(l[1][1], l[1][2])) + {q['start'][1]} * exp(l[1][2] - greatest(l[1][1], l[1][2])))"
    known = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    return f"""rs0 AS (SELECT series_id, ts, CASE WHEN {known} THEN [({density[0]})::DOUBLE, ({density[1]})::DOUBLE] END AS ll FROM feat),
    rs1 AS (SELECT *, list_filter(list(ll) OVER (PARTITION BY series_id ORDER BY ts ROWS 9 PRECEDING), lambda x: x IS NOT NULL) AS l FROM rs0),
    rs2 AS (SELECT series_id, ts, ll,
      list_reduce(list_concat([[(1 - {first})::DOUBLE, ({first})::DOUBLE]], l[2:]), lambda acc, v: [({down} / ({down} + {up}))::DOUBLE, ({up} / ({down} + {up}))::DOUBLE]) AS post,
      list_reduce(list_concat([[ln({q['start'][0]}) + l[1][1], ln({q['start'][1]}) + l[1][2]]], l[2:]), lambda acc, v:
        [greatest(acc[1] + ln({a00}), acc[2] + ln({a10})) + v[1], greatest(acc[1] + ln({a01}), acc[2] + ln({a11})) + v[2]]) AS path FROM rs1 WHERE ll IS NOT NULL),
    rs AS (SELECT series_id, ts, CASE WHEN path[1] >= path[2] THEN 0 ELSE 1 END AS state, post[2] AS p_up FROM rs0 LEFT JOIN rs2 USING (series_id, ts)),
    rsn AS (SELECT series_id, ts, CASE WHEN ll IS NOT NULL THEN state END AS state, p_up FROM rs JOIN rs0 USING (series_id, ts))"""


REGIME_COLUMNS = ["r", "vol_short", "volume_z"]
REGIME_SQL = f"{FEATURES_SQL}, {regime_sql(REGIME_COLUMNS, REGIME_PARAMS)}"


@query("regime_scores", "series_id ts state:1 p_up:6", f"{REGIME_SQL}, t AS (SELECT * FROM rsn)")
def _(spark, sf):
    df = G.score_regimes(features(spark, sf), BARS_1D, REGIME_COLUMNS, REGIME_PARAMS)
    return df.withColumn("p_up", F.col("posterior")[1])


@query(
    "regime_transitions",
    "series_id from_state:i to_state:i n:i p:6",
    f"""{REGIME_SQL}, nx AS (SELECT series_id, state AS from_state, lead(state) OVER (PARTITION BY series_id ORDER BY ts) AS to_state FROM rsn),
    c AS (SELECT series_id, from_state, to_state, count(*) AS n FROM nx WHERE from_state IS NOT NULL AND to_state IS NOT NULL GROUP BY 1, 2, 3),
    t AS (SELECT *, n / sum(n) OVER (PARTITION BY series_id, from_state) AS p FROM c)""",
)
def _(spark, sf):
    df = G.score_regimes(features(spark, sf), BARS_1D, REGIME_COLUMNS, REGIME_PARAMS)
    return transitions(df, BARS_1D, "state", ["series_id"])


def smoothing_sql(columns: list[str], q: dict) -> str:
    """Forward and backward recursions over whole series, for two states."""
    (a00, a01), (a10, a11) = q["transition"]
    d0, d1 = (
        " + ".join(f"-0.5 * (ln(2 * pi() * {v}) + pow(({c} - {m}) / {w} - {mu}, 2) / {v})" for c, mu, v, m, w in zip(columns, mean, var, q["center"], q["scale"]))
        for mean, var in zip(q["means"], q["variances"])
    )
    s0, s1 = q["start"]
    known = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    return f"""RECURSIVE {FEATURES_SQL}, o0 AS (SELECT series_id, ts, {d0} AS d0, {d1} AS d1 FROM feat WHERE {known}),
    o AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS n, count(*) OVER (PARTITION BY series_id) AS m,
      exp(d0 - greatest(d0, d1)) AS e0, exp(d1 - greatest(d0, d1)) AS e1 FROM o0),
    fw AS (SELECT series_id, n, {s1} * e1 / ({s0} * e0 + {s1} * e1) AS up, ln({s0}) + d0 AS b0, ln({s1}) + d1 AS b1 FROM o WHERE n = 1
      UNION ALL SELECT o.series_id, o.n, ((1 - up) * {a01} + up * {a11}) * e1 / (((1 - up) * {a00} + up * {a10}) * e0 + ((1 - up) * {a01} + up * {a11}) * e1),
        greatest(b0 + ln({a00}), b1 + ln({a10})) + d0, greatest(b0 + ln({a01}), b1 + ln({a11})) + d1 FROM fw JOIN o ON o.series_id = fw.series_id AND o.n = fw.n + 1),
    bw AS (SELECT series_id, n, 0.5::DOUBLE AS u0, 0.5::DOUBLE AS u1, 0::DOUBLE AS c0, 0::DOUBLE AS c1 FROM o WHERE n = m
      UNION ALL SELECT o.series_id, o.n - 1, ({a00} * e0 * u0 + {a01} * e1 * u1) / ({a00 + a10} * e0 * u0 + {a01 + a11} * e1 * u1), ({a10} * e0 * u0 + {a11} * e1 * u1) / ({a00 + a10} * e0 * u0 + {a01 + a11} * e1 * u1),
        greatest(ln({a00}) + d0 + c0, ln({a01}) + d1 + c1), greatest(ln({a10}) + d0 + c0, ln({a11}) + d1 + c1) FROM bw JOIN o ON o.series_id = bw.series_id AND o.n = bw.n WHERE bw.n > 1),
    t AS (SELECT o.series_id, ts, CASE WHEN b0 + c0 >= b1 + c1 THEN 0 ELSE 1 END AS state, up * u1 / ((1 - up) * u0 + up * u1) AS p_up
      FROM o JOIN fw ON fw.series_id = o.series_id AND fw.n = o.n JOIN bw ON bw.series_id = o.series_id AND bw.n = o.n)"""


@query("regime_smoothing", "series_id ts state:i p_up:6", smoothing_sql(REGIME_COLUMNS, REGIME_PARAMS))
def _(spark, sf):
    """States and probabilities from the whole series under given parameters."""
    q = REGIME_PARAMS
    scaled = [((F.col(c) - m) / w).alias(c) for c, m, w in zip(REGIME_COLUMNS, q["center"], q["scale"])]
    rows = features(spark, sf).select("series_id", "ts", *scaled)
    pairs = lambda m: tuple(tuple(map(float, r)) for r in m)
    chain = H.Chain(tuple(q["start"]), pairs(q["transition"]), pairs(q["means"]), pairs(q["variances"]))
    return H.smooth(H.chunked(rows, BARS_1D, REGIME_COLUMNS), BARS_1D, chain).withColumn("p_up", F.col("posterior")[1])


def persistent(spark, sf):
    """The chain fitted on all rows from the first training day on, with its chunks and rounds."""
    rows = features(spark, sf).filter(F.col("ts") >= F.lit(min(s["train_start"] for s in SPLITS if s["name"] in WALKS)).cast("timestamp"))
    rows = rows.withColumn("_all", F.lit(1))
    scaled = materialize(S.standardize(rows, rows, FEATURES, ["_all"]), "scaled")
    chunks = H.chunked(scaled, BARS_1D, FEATURES)
    chain, rounds = H.fit(chunks, BARS_1D, H.initial(scaled, FEATURES))
    return chunks, H.sorted_by(chain, FEATURES.index("drawdown")), rounds


@query("regime_persistence", "series_id ts state:i p_bull:6")
def _(spark, sf):
    chunks, chain, _ = persistent(spark, sf)
    return H.smooth(chunks, BARS_1D, chain).withColumn("p_bull", F.element_at("posterior", -1))


@query("regime_persistence_matrix", "from_state:i to_state:i p:6 mean_duration:4 rounds:i")
def _(spark, sf):
    _, chain, rounds = persistent(spark, sf)
    rows = [(i, j, p, 1.0 / max(1e-12, 1.0 - own[i]), rounds) for i, own in enumerate(chain.transition) for j, p in enumerate(own)]
    return spark.createDataFrame(rows, "from_state int, to_state int, p double, mean_duration double, rounds int")


@query("consensus_k", "split k_silhouette:i k_davies_bouldin:i k_aic:i k:i")
def _(spark, sf):
    return swept(spark, sf, G.consensus_k)


@query("walk_forward_regimes", "split n:i e_up:6 e_down:6 delta:6 precision_up:6 precision_down:6 share_up:6 duration_up:4 duration_down:4")
def _(spark, sf):
    rows = prepared(spark, sf)
    scaled = materialize(S.standardize(rows.filter("role = 'train'"), rows, FEATURES, ["split"]), "scaled")
    states = G.walk_forward_regimes(scaled, FEATURES, WALKS, ["series_id", "ts", "fwd"])
    return regime_metrics(states, "split", "state", "fwd", BARS_1D)
