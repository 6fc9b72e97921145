"""As-of joins, distributed ranks and quantiles, event windows, upserts."""

import numpy as np
import pandas as pd
import pytest
from conftest import by_key, close_to
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from barline import ranks
from barline.grid import Grid
from barline.operators import joins as J
from barline.operators import news as N
from barline.operators import rules as X
from barline.operators.fill import ffill
from barline.sources import upsert as U

SMALL = Grid(step=3600, chunk_rows=8, block_rows=2)


@pytest.fixture(scope="module")
def sides(spark):
    fast = pd.DataFrame({"series_id": "a", "ts": pd.date_range("2024-01-03", periods=60, freq="4h")})
    slow = pd.DataFrame(
        {
            "series_id": "a",
            "ts": pd.date_range("2024-01-03", periods=9, freq="D"),
            "u": [1.0, np.nan, 3, np.nan, 5, 6, 7, 8, 9],
            "v": [np.nan, 20, np.nan, np.nan, 50, 60, 70, 80, 90],
        }
    )
    s = spark.createDataFrame(slow)
    return fast, slow, spark.createDataFrame(fast), s.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("u", "v")})


def reference(fast, slow, column, lag, strict=False):
    out = []
    for t in fast.ts:
        at = slow.ts + lag
        seen = slow[(at < t) if strict else (at <= t)][column].dropna()
        out.append(seen.iloc[-1] if len(seen) else np.nan)
    return out


def test_lagged_fill_is_per_column_and_never_early(sides):
    fast, slow, f, s = sides
    got = by_key(J.asof_ffill(f, s, SMALL, ["u", "v"]), ["u", "v"])
    for c in ("u", "v"):
        close_to(got[c], reference(fast, slow, c, pd.Timedelta("1D")))
    got = by_key(J.asof_ffill(f, s, SMALL, ["u"], lag=None, strict=True), ["u"])
    close_to(got.u, reference(fast, slow, "u", pd.Timedelta(0), strict=True))
    shared = by_key(J.asof_shared(f, s.drop("series_id"), SMALL, ["v"], lag=None), ["v"])
    close_to(shared.v, reference(fast, slow, "v", pd.Timedelta(0)))


def test_previous_day_and_forward(sides):
    fast, slow, f, s = sides
    got = by_key(J.asof_before(f, s, SMALL, ["u"]), ["u"])
    want = [slow[slow.ts < t.normalize()].u.dropna().iloc[-1] if (slow.ts < t.normalize()).any() else np.nan for t in fast.ts]
    close_to(got.u, want)
    nxt = by_key(J.asof_forward(f, s, SMALL), ["next_ts"]).next_ts
    want = [slow.ts[slow.ts >= t].min() for t in fast.ts]
    assert nxt.tolist()[:48] == want[:48]


def test_range_aggregate(spark, sides):
    fast, _, f, _ = sides
    rng = np.random.default_rng(3)
    ev = pd.DataFrame({"series_id": "a", "ts": pd.Timestamp("2024-01-03") + pd.to_timedelta(rng.integers(0, 9 * 86400, 40), "s"), "id": range(40)})
    series = f.withColumn("v", F.unix_seconds("ts").cast("double"))
    got = J.range_agg(spark.createDataFrame(ev), series, SMALL, 10 * 3600, [F.count("v").alias("n"), F.min("v").alias("lo")], ["id"]).toPandas().set_index("id")
    for _, e in ev.iterrows():
        inside = fast[(fast.ts >= e.ts) & (fast.ts < e.ts + pd.Timedelta("10h"))]
        if len(inside):
            assert got.n[e.id] == len(inside) and got.lo[e.id] == inside.ts.min().timestamp()
        else:
            assert e.id not in got.index


def test_event_distance(spark):
    days = pd.date_range("2024-01-01", periods=50)
    df = spark.createDataFrame(pd.DataFrame({"series_id": "a", "ts": days}))
    events = [days[10], days[31]]
    out = by_key(J.days_to_next(df, spark.createDataFrame(pd.DataFrame({"ts": events})), SMALL), ["days_to_next"]).days_to_next.tolist()
    want = [min([(e - d).days for e in events if e > d], default=30) for d in days]
    assert out == want


values = st.lists(st.one_of(st.integers(-5, 5).map(float), st.floats(-100, 100, allow_nan=False)), min_size=1, max_size=60)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(values)
def test_quantiles_and_ranks_match_pandas(spark, v):
    df = spark.createDataFrame(pd.DataFrame({"g": [i % 2 for i in range(len(v))], "x": v}))
    bounds = sorted(set(np.quantile(v, [0.2, 0.5, 0.9]).tolist()))
    q = ranks.quantiles(df, "x", {"a": 0.1, "b": 0.5, "c": 0.77}, ["g"], bounds=bounds).toPandas().set_index("g")
    pdf = df.toPandas()
    for g, part in pdf.groupby("g"):
        close_to(q.loc[g, ["a", "b", "c"]], part.x.quantile([0.1, 0.5, 0.77]))
    got = ranks.average_ranks(df, "x", ["g"]).toPandas()
    want = pdf.assign(rank=pdf.groupby("g").x.rank()).sort_values(["g", "x"])["rank"]
    close_to(got.sort_values(["g", "x"])["rank"], want)


def test_hot_value_and_auc(spark):
    rng = np.random.default_rng(5)
    p = np.where(rng.random(600) < 0.4, 0.5, rng.random(600).round(2))
    y = (rng.random(600) < p).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"p": p, "y": y}))
    pos, neg = p[y == 1], p[y == 0]
    want = np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :]))
    got = ranks.auc(df, "p", "y").first()
    assert got.n == 600 and abs(got.auc - want) < 1e-12
    one = ranks.auc(df.filter("y = 1"), "p", "y").first()
    assert one.auc is None


def test_rank_norm(spark):
    rng = np.random.default_rng(6)
    train, test = rng.integers(0, 30, 300) / 3.0, rng.integers(-5, 40, 100) / 3.0
    out = X.rank_norm(
        spark.createDataFrame(pd.DataFrame({"g": 1, "i": range(100), "v": test})), spark.createDataFrame(pd.DataFrame({"g": 1, "v": train})), "v", ["g"]
    ).orderBy("i").toPandas()
    close_to(out.rank_norm, np.searchsorted(np.sort(train), test, side="right") / 300)


def test_upsert_is_idempotent_and_new_wins(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, s string, v double")
    new = spark.createDataFrame([(2, None, 5.0), (3, "c", None)], "k int, s string, v double")
    once = U.upsert(old, new, ["k"])
    twice = U.upsert(once, new, ["k"])
    want = {(1, "a", 1.0), (2, None, 5.0), (3, "c", None)}
    assert {tuple(r) for r in once.collect()} == {tuple(r) for r in twice.collect()} == want
    assert U.upsert(old, new, ["k"], drop_null=["v"]).count() == 2


def test_filled_hours_and_small_parts(spark):
    ts = pd.to_datetime(["2024-01-01 00:10", "2024-01-01 03:10", "2024-01-01 03:40"])
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "published_at": ts}))
    got = N.count_zscores(df, ["g"]).orderBy("ts").toPandas()
    n = pd.Series([1, 0, 0, 2])
    close_to(got.n, n)
    close_to(got.z, (n - n.rolling(24, min_periods=2).mean()) / n.rolling(24, min_periods=2).std())
    assert ffill(df, Grid(("g",), "published_at"), ["g"]).count() == 3


def test_range_fold_equals_pairs(spark):
    """Random events and rows with equal times, gaps and slot borders, against every pair."""
    from pyspark.sql import functions as F

    from barline.grid import max_of, min_of, sum_of

    rng = np.random.default_rng(4)
    start = pd.Timestamp("2020-01-01")
    rows = pd.DataFrame({"series_id": rng.choice(["a", "b"], 800), "ts": start + pd.to_timedelta(rng.integers(0, 400, 800) * 900, "s"), "v": rng.normal(size=800)})
    rows = rows[(rows.ts < start + pd.Timedelta("1D")) | (rows.ts > start + pd.Timedelta("2D"))]
    ev = pd.DataFrame({"series_id": rng.choice(["a", "b", "none"], 300), "ts": start + pd.to_timedelta(rng.integers(-9, 420, 300) * 900, "s"), "id": np.arange(300)})
    folds = {"lo": min_of("v"), "hi": max_of("v"), "n": sum_of(F.col("v").isNotNull().cast("int"))}
    got = J.range_fold(spark.createDataFrame(ev), spark.createDataFrame(rows), SMALL, 7200, folds, ["id"]).toPandas().set_index("id")
    assert len(got) == 300
    for r in ev.itertuples():
        inside = rows[(rows.series_id == r.series_id) & (rows.ts >= r.ts) & (rows.ts < r.ts + pd.Timedelta(hours=2))].v
        own = got.loc[r.id]
        assert own.ts == r.ts and (own.n if own.n == own.n else 0) == len(inside)
        if len(inside):
            assert own.lo == inside.min() and own.hi == inside.max()


def test_range_fold_has_no_pairs(spark):
    """Many events and rows in one slot: two rows per event and one per row of the series are handed on."""
    from pyspark.sql import functions as F

    from barline.grid import min_of

    at = F.timestamp_seconds(F.lit(1_577_836_800) + F.col("id") % 3600)
    series = spark.range(20_000).select(F.lit("a").alias("series_id"), at.alias("ts"), F.col("id").cast("double").alias("v"))
    events = spark.range(1_000).select(F.lit("a").alias("series_id"), at.alias("ts"), F.col("id").alias("event"))
    out = J.range_fold(events, series, SMALL, 4 * 3600, {"lo": min_of("v")}, ["event"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # Every join is between rows and the one row per chunk of their own series.
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and all("_chunk" in line and "_slot" in line for line in joins)
    got = {r.event: r.lo for r in out.collect()}
    assert got == {i: float(i) for i in range(1_000)}
