"""Chained scans against plain forward-backward, Viterbi and Baum-Welch, row by row."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barline.grid import DAY, Grid
from barline.modelling import persistence as H

GRID = Grid(step=DAY)
CHAIN = H.Chain((0.6, 0.3, 0.1), ((0.9, 0.07, 0.03), (0.1, 0.8, 0.1), (0.02, 0.08, 0.9)), ((-1.0, 0.5), (0.0, 0.0), (1.0, -0.5)), ((0.5, 1.0), (1.0, 0.4), (0.7, 0.9)))


def plain(chain, x):
    """Posteriors, best path and expected transitions, one row after the other."""
    a, ll = np.array(chain.transition), chain.log_density(x)
    n, k = ll.shape
    e = np.exp(ll - ll.max(axis=1, keepdims=True))
    forward, behind = np.zeros((n, k)), np.ones((n, k))
    best, back = np.zeros((n, k)), np.zeros((n, k), int)
    forward[0], best[0] = np.array(chain.start) * e[0], np.log(chain.start) + ll[0]
    for t in range(n):
        if t:
            forward[t] = forward[t - 1] @ a * e[t]
            steps = best[t - 1][:, None] + np.log(a)
            best[t], back[t] = steps.max(axis=0) + ll[t], steps.argmax(axis=0)
        forward[t] /= forward[t].sum()
    for t in range(n - 2, -1, -1):
        behind[t] = a @ (e[t + 1] * behind[t + 1])
        behind[t] /= behind[t].sum()
    posterior = forward * behind
    posterior /= posterior.sum(axis=1, keepdims=True)
    path = [int(best[-1].argmax())]
    for t in range(n - 1, 0, -1):
        path.append(int(back[t][path[-1]]))
    moves = np.zeros((k, k))
    for t in range(1, n):
        m = forward[t - 1][:, None] * a * (e[t] * behind[t])[None]
        moves += m / m.sum()
    return posterior, np.array(path[::-1]), moves


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(12)
    frames = []
    for name, n in (("long", 700), ("short", 3), ("one", 1)):
        state, x = 0, []
        for _ in range(n):
            state = rng.choice(3, p=CHAIN.transition[state])
            x.append(rng.normal(CHAIN.means[state], np.sqrt(CHAIN.variances[state])))
        frames.append(pd.DataFrame(x, columns=["u", "v"]).assign(series_id=name, ts=pd.Timestamp("2020-01-01") + pd.to_timedelta(np.arange(n), "D")))
    df = pd.concat(frames, ignore_index=True)
    df.loc[df.index % 41 == 5, "v"] = np.nan
    return df


@pytest.fixture(scope="module")
def chunks(spark, series):
    df = spark.createDataFrame(series).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    out = H.chunked(df, GRID, ["u", "v"], chunk_rows=250)
    assert out.filter("series_id = 'long'").count() == 3
    return out


def test_posterior_and_path_over_three_chunks(chunks, series):
    got = H.smooth(chunks, GRID, CHAIN).toPandas().sort_values("ts")
    for name, part in series.dropna().groupby("series_id"):
        posterior, path, _ = plain(CHAIN, part[["u", "v"]].to_numpy())
        own = got[got.series_id == name]
        assert own.ts.tolist() == part.ts.tolist()
        np.testing.assert_allclose(np.stack(own.posterior), posterior, atol=1e-9)
        assert own.state.tolist() == path.tolist()


def test_one_round_of_estimation(chunks, series):
    sums = [np.zeros(3), np.zeros((3, 3)), np.zeros(3), np.zeros((3, 2)), np.zeros((3, 2))]
    for _, part in series.dropna().groupby("series_id"):
        x = part[["u", "v"]].to_numpy()
        p, _, moves = plain(CHAIN, x)
        for s, v in zip(sums, (p[0], moves, p.sum(axis=0), p.T @ x, p.T @ x**2)):
            s += v
    got = H.improve(chunks, GRID, CHAIN)
    np.testing.assert_allclose(got.start, sums[0] / sums[0].sum(), atol=1e-9)
    np.testing.assert_allclose(got.transition, sums[1] / sums[1].sum(axis=1, keepdims=True), atol=1e-9)
    means = sums[3] / sums[2][:, None]
    np.testing.assert_allclose(got.means, means, atol=1e-9)
    np.testing.assert_allclose(got.variances, sums[4] / sums[2][:, None] - means**2, atol=1e-9)


def test_fit_finds_persistence(chunks):
    first = H.Chain((1 / 3,) * 3, ((0.6, 0.2, 0.2), (0.2, 0.6, 0.2), (0.2, 0.2, 0.6)), ((-0.5, 0.2), (0.0, 0.0), (0.5, -0.2)), ((1.0, 1.0),) * 3)
    chain, rounds = H.fit(chunks, GRID, first, rounds=12)
    chain = H.sorted_by(chain, 0)
    assert 1 <= rounds <= 12 and abs(sum(chain.start) - 1) < 1e-9
    assert all(abs(sum(r) - 1) < 1e-9 for r in chain.transition) and min(chain.transition[i][i] for i in (0, 2)) > 0.75
    assert chain.means[0][0] < -0.6 and chain.means[2][0] > 0.6


def test_products_in_either_direction():
    rng = np.random.default_rng(1)
    steps = rng.random((13, 2, 2))
    ahead, back = H.products(steps, np.matmul), H.products(steps, np.matmul, backwards=True)
    want = np.eye(2)
    for i in range(13):
        want = want @ steps[i]
        np.testing.assert_allclose(ahead[i], want)
    np.testing.assert_allclose(back[0], want)


def test_empty(spark):
    none = spark.createDataFrame([], "series_id string, ts timestamp, u double, v double")
    chunks = H.chunked(none, GRID, ["u", "v"])
    assert H.smooth(chunks, GRID, CHAIN).count() == 0 and H.improve(chunks, GRID, CHAIN) == CHAIN
