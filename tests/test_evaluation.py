"""Performance, permutations, statistics, gates, regime scoring, p-values."""

import math

import numpy as np
import pandas as pd
import pytest
from conftest import close_to
from pyspark.sql import functions as F

from barline.functions import mathx
from barline.grid import Grid
from barline.modelling import regimes as G
from barline.modelling import splits as S
from barline.operators import evaluation as E
from barline.operators import rules as X
from barline.operators import stats as ST

GRID = Grid(chunk_rows=16, block_rows=4)


@pytest.fixture(scope="module")
def trades(spark):
    rng = np.random.default_rng(11)
    n = 120
    pdf = pd.DataFrame(
        {
            "series_id": "a",
            "ts": pd.date_range("2024-01-01", periods=n),
            "pos": rng.choice([-1, 0, 1], n).astype(float),
            "ret": rng.normal(0.002, 0.05, n),
        }
    )
    pdf.loc[60, "ret"] = -1.5  # with a long position this loses more than everything
    pdf.loc[60, "pos"] = 1.0
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("lag,on", [(0, "turnover"), (1, "turnover"), (0, "change")])
def test_performance(trades, lag, on):
    pdf, df = trades
    pos = pdf.pos.shift(lag).fillna(0)
    turn = pos.diff().fillna(pos.iloc[0])
    net = pos * pdf.ret - 0.001 * (turn.abs() if on == "turnover" else (turn != 0))
    eq = (1 + net).cumprod()
    got = E.performance(df, GRID, "pos", "ret", 0.001, entry_lag=lag, cost_on=on).toPandas().iloc[0]
    assert got.n == len(pdf)
    close_to(got.equity, eq.iloc[-1], 1e-9)
    close_to(got.max_drawdown, (eq / eq.cummax() - 1).min(), 1e-9)
    close_to(got.sharpe, net.mean() / (net.std(ddof=0) + 1e-10) * math.sqrt(252), 1e-9)
    active = net[net != 0]
    close_to(got.hit_rate, (active > 0).mean())
    close_to(got.profit_factor, active[active > 0].sum() / -active[active < 0].sum())
    assert got.trades == (turn != 0).sum()


def test_p_values():
    assert abs(mathx.t_tail(2.0, 10) - 0.07338803) < 1e-8
    assert abs(mathx.t_tail(1.0, 1) - 0.5) < 1e-12
    assert abs(mathx.f_tail(4.0, 2, 20) - (1 + 2 * 4 / 20) ** -10) < 1e-12
    assert abs(mathx.t_tail(3.0, 7) - mathx.f_tail(9.0, 1, 7)) < 1e-12
    assert mathx.t_tail(0.0, 5) == 1.0 and math.isnan(mathx.t_tail(1.0, 0))


def test_qcut_merges_equal_edges(spark):
    x = [0.0] * 50 + list(np.linspace(1, 2, 20))
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "x": x}))
    got = ST.qcut(df, "x", 5, ["g"]).toPandas().sort_values("x")
    want = pd.qcut(pd.Series(x), 5, duplicates="drop").cat.codes
    assert got.bucket.tolist() == want.tolist() and set(got.buckets) == {want.max() + 1}


def test_constant_columns_do_not_fail(spark):
    df = spark.createDataFrame(pd.DataFrame({"g": 1, "ts": pd.date_range("2024-01-01", periods=40), "a": 1.0, "b": np.arange(40.0)}))
    assert ST.corr_test(df, "a", "b", ["g"]).first().r is None
    assert ST.corr_matrix(df, ["a", "b"], ["g"]).first().r is None
    assert ST.ttest(df, F.col("b") > 10, "a", ["g"]).first().t is None


def test_pareto_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    pts = rng.integers(0, 12, (80, 2)).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"id": range(80), "a": pts[:, 0], "b": pts[:, 1]}))
    got = {r.id for r in E.pareto(df, "a", "b").collect()}
    want = {i for i, p in enumerate(pts) if not any((q >= p).all() and (q > p).any() for q in pts)}
    assert got == want


PARAMS = {
    "center": [0.1, -0.2],
    "scale": [2.0, 0.5],
    "means": [[-0.5, 0.4], [0.6, -0.3], [0.0, 1.0]],
    "variances": [[1.0, 0.5], [0.7, 1.2], [0.9, 0.9]],
    "start": [0.5, 0.3, 0.2],
    "transition": [[0.9, 0.05, 0.05], [0.1, 0.8, 0.1], [0.2, 0.2, 0.6]],
}


def test_regime_scores_match_forward_recursion(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(50, 2))
    x[[7, 20, 21]] = np.nan
    pdf = pd.DataFrame({"series_id": "a", "ts": pd.date_range("2024-01-01", periods=50), "f": x[:, 0], "g": x[:, 1]})
    df = spark.createDataFrame(pdf).withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("f", "g")})
    got = G.score_regimes(df, GRID, ["f", "g"], PARAMS).orderBy("ts").toPandas()
    z = (x - PARAMS["center"]) / PARAMS["scale"]
    a = np.array(PARAMS["transition"])
    for i in range(50):
        if np.isnan(x[i]).any():
            assert got.posterior[i] is None and np.isnan(got.state[i])
            continue
        rows = [r for r in z[max(0, i - 9) : i + 1] if not np.isnan(r).any()]
        ll = np.array([[-0.5 * sum(np.log(2 * np.pi * v) + (r - m) ** 2 / v for r, m, v in zip(row, ms, vs)) for ms, vs in zip(PARAMS["means"], PARAMS["variances"])] for row in rows])
        alpha = np.array(PARAMS["start"]) * np.exp(ll[0])
        best = np.log(PARAMS["start"]) + ll[0]
        for row in ll[1:]:
            alpha = (alpha @ a) * np.exp(row)
            best = (best[:, None] + np.log(a)).max(axis=0) + row
        close_to(got.posterior[i], alpha / alpha.sum(), 1e-9)
        assert got.state[i] == best.argmax()


def test_gates_hold_at_their_limits(spark):
    rows = [(70.0, 0.2, 0.6), (20.0, 0.1, 0.9), (34.0, 0.2, 0.5), (55.0, 0.6, 0.5), (40.0, 0.4, 0.5), (None, None, 0.5)]
    df = spark.createDataFrame(rows, "rsi double, bb double, allocation double").withColumn("g", X.technical_gate())
    got = [(round(r.g.allocation, 6), r.g.zone) for r in df.collect()]
    assert got == [(0.0, "overbought"), (1.0, "strong_oversold"), (0.6, "oversold"), (0.35, "high_zone"), (0.5, "neutral"), (0.5, "neutral")]


def test_walk_forward_purge_and_skip(spark):
    days = pd.date_range("2024-01-01", periods=200)
    df = spark.createDataFrame(pd.DataFrame({"ts": days, "x": np.arange(200.0)}))
    splits = [
        {"name": "a", "train_start": "2024-01-01", "train_end": "2024-05-31", "test_start": "2024-05-15", "test_end": "2024-05-31"},
        {"name": "tiny", "train_start": "2024-01-01", "train_end": "2024-01-10", "test_start": "2024-06-01", "test_end": None},
    ]
    got = S.walk_forward(df, splits).toPandas()
    assert set(got.split) == {"a"}
    assert got[got.role == "train"].ts.max() == pd.Timestamp("2024-05-08")
    assert (got[got.role == "test"].ts.min(), got[got.role == "test"].ts.max()) == (pd.Timestamp("2024-05-15"), pd.Timestamp("2024-05-31"))
    scaled = S.standardize(got_train := S.walk_forward(df, splits[:1]).filter("role = 'train'"), got_train, ["x"], ["split"]).toPandas()
    close_to([scaled.x.mean(), scaled.x.std(ddof=0)], [0, 1])
