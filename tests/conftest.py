import os
import sys

import numpy as np
import pandas as pd
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from barline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(cpus=4, shuffle_partitions=4, memory="4g")


@pytest.fixture(scope="session")
def series() -> pd.DataFrame:
    """Three gappy daily series with null runs, constants, ties and a rising stretch."""
    rng = np.random.default_rng(7)
    frames = []
    for s, n in (("a", 300), ("b", 300), ("c", 40)):
        day = np.cumsum(rng.integers(1, 4, n)) + (400 if s == "b" else 0)
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.03, n)))
        if s == "a":
            close[50:75] = close[50]
            close[120:150] = np.linspace(90, 130, 30)
        x = close.copy()
        x[rng.random(n) < 0.1] = np.nan
        x[200:206] = np.nan
        frames.append(
            pd.DataFrame(
                {
                    "series_id": s,
                    "ts": pd.Timestamp("2020-01-01") + pd.to_timedelta(day, "D"),
                    "open": close * (1 + rng.normal(0, 0.01, n)),
                    "close": close,
                    "x": x,
                    "volume": rng.integers(1, 9, n).astype(float),
                    "state": rng.integers(0, 2, n).astype(float),
                }
            )
        )
    df = pd.concat(frames, ignore_index=True)
    df["high"] = df[["open", "close"]].max(axis=1) * 1.01
    df["low"] = df[["open", "close"]].min(axis=1) * 0.99
    df.loc[df.index % 17 == 0, "state"] = np.nan
    return df


@pytest.fixture(scope="session")
def table(spark, series):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(series)
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("x", "state")})


def by_key(df, columns) -> pd.DataFrame:
    """A Spark result as pandas, ordered by series and time."""
    return df.toPandas().sort_values(["series_id", "ts"]).reset_index(drop=True)[columns]


def per_series(pdf: pd.DataFrame, fn) -> pd.Series:
    ordered = pdf.sort_values(["series_id", "ts"])
    return pd.concat([fn(g) for _, g in ordered.groupby("series_id")]).reset_index(drop=True)


def close_to(got, want, tol=1e-9):
    np.testing.assert_allclose(np.asarray(got, dtype=float), np.asarray(want, dtype=float), rtol=tol, atol=tol, equal_nan=True)
