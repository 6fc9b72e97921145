"""Permutation tests: bijections, sources of every kind, sums, and the path for long series."""

import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry
from barline.grid import DAY, Grid
from barline.operators import permutation as P
from barline.plans import scoring

GRID = Grid(step=DAY)


@pytest.mark.parametrize("size", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_every_run_is_a_permutation(size):
    keys = P.run_keys(7, "s", range(1, 40))
    got = P.bijection(np.arange(size), keys, size)
    assert all(np.array_equal(np.sort(row), np.arange(size)) for row in got)
    assert size < 60 or len({tuple(row) for row in got.tolist()}) == 39


def test_places_are_spread_evenly():
    """Over many runs, each place is held about as often as any other."""
    held = (P.bijection(np.arange(50), P.run_keys(1, "x", range(1, 4001)), 50) < 20).mean(axis=0)
    assert abs(held - 0.4).max() < 0.04


def plain_sources(kind, size, key, mean_block):
    k0, k1, k2, k3 = (int(v) for v in key)
    if kind == "shift":
        return [(i - 1 - k0 % max(1, size - 1)) % size for i in range(size)]
    out, begin = [], 0
    for i in range(size):
        if i == 0 or int(P.hashed(i, k0, k1)) * mean_block < P.PRIME:
            begin = i
        out.append((int(P.hashed(begin, k2, k3)) % size + i - begin) % size)
    return out


@pytest.mark.parametrize("kind", ["shift", "bootstrap"])
def test_sources_of_any_part(kind):
    keys = P.run_keys(3, "a|b", range(1, 12))
    for first, last in ((0, 900), (500, 640), (899, 900)):
        got = P._sources(kind, np.arange(first, last), keys, 900, 300)
        assert got.tolist() == [plain_sources(kind, 900, k, 300)[first:last] for k in keys]


@pytest.fixture(scope="module")
def trades(spark):
    rng = np.random.default_rng(2)
    parts = [pd.DataFrame({"series_id": s, "ts": pd.Timestamp("2020-01-01") + pd.to_timedelta(np.arange(n), "D"), "pos": rng.integers(-1, 2, n), "ret": rng.normal(0, 0.02, n)}) for s, n in (("a", 300), ("b", 1))]
    df = pd.concat(parts, ignore_index=True)
    df.loc[17, "ret"] = -1.0
    return df, spark.createDataFrame(df)


@pytest.mark.parametrize("kind", ["shuffle", "shift", "bootstrap"])
def test_sums_of_chunks(trades, kind, monkeypatch):
    pdf, df = trades
    rows = P.ordered(df, GRID, "pos", "ret")
    got = P.permuted_sums(rows, kind, 70, mean_block=9).toPandas().set_index([P.KEY, "run"]).sort_index()
    assert len(got) == 140
    for s, part in pdf.groupby("series_id"):
        on, ret, n = (part.pos == 1).to_numpy().astype(float), part.ret.to_numpy(), len(part)
        for run in (1, 2, 64, 65, 70):
            key = P.run_keys(42, s, range(run, run + 1))
            if kind == "shuffle":
                placed = (P.bijection(np.arange(n), key, n)[0] < on.sum()).astype(float)
            else:
                placed = on[plain_sources(kind, n, key[0], 9)]
            net = placed * ret - 0.0012 * np.abs(np.diff(np.concatenate([[0.0], placed])))
            np.testing.assert_allclose(got.loc[(s, run)], [float(v) for v in P.net_sums(net)], atol=1e-12)
    if kind != "shuffle":
        joined = P.permuted_sums(rows, kind, 70, mean_block=9, bitmap_bytes=0).toPandas().set_index([P.KEY, "run"]).sort_index()
        np.testing.assert_allclose(joined[P.SUMS], got[P.SUMS], atol=1e-12)


def test_statistics_against_real(trades):
    pdf, df = trades
    got = P.permutation_test(df, GRID, "pos", "ret", "shuffle", 80).toPandas().set_index(["series_id", "statistic"])
    part = pdf[pdf.series_id == "a"]
    held = (part.pos == 1).astype(float)
    net = held * part.ret - 0.0012 * (held - held.shift(1).fillna(0)).abs()
    assert abs(got.real["a", "sharpe"] - net.mean() / (net.std(ddof=0) + 1e-10) * 252**0.5) < 1e-8
    growth = (1 + net).prod()
    assert got.real["a", "cagr"] is None or np.isnan(got.real["a", "cagr"]) or abs(got.real["a", "cagr"] - (growth ** (252 / len(net)) - 1)) < 1e-8
    assert abs(got.real["a", "profit_factor"] - net[net > 0].sum() / -net[net < 0].sum()) < 1e-8
    assert (got.runs == 80).all() and got.p.between(0, 1).all()
    # One row can be arranged in one way only, so every run reaches the real value.
    alone = got.loc["b"].dropna(subset=["real"])
    assert (alone.p == 1).all()


def test_runs():
    assert scoring.RUNS == 5000 and all("range(1, 5001)" in entry.oracle_sql()[f"permutation_{k}"] for k in ("shuffle", "shift", "bootstrap"))
