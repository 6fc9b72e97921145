"""Cases that earlier versions got wrong."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from barline.functions.mathx import exact_sum
from barline.grid import Grid
from barline.modelling import regimes
from barline.operators import evaluation, joins, news, stats
from barline.session import shared_dir
from barline.sources.upsert import upsert


def feed(spark, rows):
    columns = ["id", "published_at", "score", "source", "sentiment", "upvotes", "search_group", "impact", "event_type", "topic", "title"]
    pdf = pd.DataFrame([(i, pd.Timestamp(t), s, "x", "POSITIVE", 1, "en", "HIGH", "OTHER", "t", "title") for i, t, s in rows], columns=columns)
    return spark.createDataFrame(pdf)


def test_later_stories_change_nothing(spark):
    asof = "2024-01-01 10:30:00"
    now = [(1, "2024-01-01 10:00:00", 2.0), (2, "2024-01-01 09:45:00", -5.0)]
    a, b = feed(spark, now), feed(spark, [*now, (3, "2024-01-05 00:00:00", 9.0)])
    for f in (
        lambda d: news.news_metrics(d, asof, [1, 4, 24]),
        lambda d: news.poisson_zscore(d, asof, ["search_group"]),
        lambda d: news.count_zscore(d, asof, ["search_group"]),
        lambda d: news.impact(d, asof, 4, ["search_group"]),
        lambda d: news.impact_by_group(d, asof, 4, ["en", "de"]),
        lambda d: news.top_stories(d, asof, 4).select("id", "score"),
    ):
        assert sorted(f(a).collect()) == sorted(f(b).collect())
    assert [r.id for r in news.top_stories(b, asof, 4).collect()] == [2, 1]


def test_null_never_replaces_a_value(spark):
    old = spark.createDataFrame([("a", 1, 2.0)], "k string, t int, v double")
    new = spark.createDataFrame([("a", 1, None), ("a", 2, None)], "k string, t int, v double")
    assert [tuple(r) for r in upsert(old, new, ["k", "t"], drop_null=["v"]).collect()] == [("a", 1, 2.0)]


def test_every_event_is_kept(spark):
    ts = lambda h: pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h)
    events = spark.createDataFrame(pd.DataFrame({"series_id": ["a", "a"], "event_id": [1, 2], "ts": [ts(0), ts(99)]}))
    bars = spark.createDataFrame(pd.DataFrame({"series_id": ["a", "a"], "ts": [ts(1), ts(3)], "low": [5.0, 4.0]}))
    got = joins.range_agg(events, bars, Grid(step=3600), 4 * 3600, [F.min("low").alias("low")], ["event_id"])
    assert {r.event_id: r.low for r in got.collect()} == {1: 4.0, 2: None}


def test_threshold_without_coverage(spark):
    sweep = spark.createDataFrame([("a", 0.3, 0.1, 0.9), ("b", 0.3, 0.5, 0.9)], "k string, threshold double, coverage double, f1 double")
    assert {r.k: r.threshold for r in evaluation.recommend_threshold(sweep, ["k"]).collect()} == {"a": 0.5, "b": 0.3}


def test_best_row_and_dominant_value(spark):
    df = spark.createDataFrame([("a", 1.0, 2), ("a", 3.0, 9), ("a", 3.0, 4), ("b", None, 1)], "k string, x double, t int")
    assert sorted(tuple(r) for r in stats.best(df, "x", ["k"], "t").collect()) == [("a", 3.0, 4), ("b", None, 1)]
    assert [tuple(r) for r in stats.dominant(df, "x", ["k"]).collect()] == [("a", 3.0, 2)]


def test_chunks_of_series_at_different_times(spark):
    a = spark.range(4000).select(F.lit("a").alias("series_id"), F.timestamp_seconds("id").alias("ts"))
    b = spark.range(3900).select(F.lit("b").alias("series_id"), F.timestamp_seconds(F.col("id") + 1_000_000).alias("ts"))
    df = a.union(b)
    grid = Grid().fit(df, target_rows=500)
    sizes = grid.with_chunk(df).groupBy("series_id", "_chunk").count().collect()
    assert max(r["count"] for r in sizes) <= 1000


def test_shared_folder_is_required_on_a_cluster():
    class Conf:
        def __init__(self, master):
            self.values = {"spark.master": master}

        def get(self, key, default=None):
            return self.values.get(key, default)

        def set(self, key, value):
            self.values[key] = value

    class Session:
        def __init__(self, master):
            self.conf = Conf(master)

    for master in ("yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            shared_dir(Session(master), "x")
    assert "/x-" in shared_dir(Session("local[2]"), "x")


def test_regimes_learn_from_training_rows_only(spark):
    train = [(i, "s", "train", float(i % 2) * 4 + 0.1 * (i % 5), 1.0) for i in range(60)]
    held = [(100 + i, "s", "test", v, 1.0) for i, v in enumerate((0.1, 4.2, 0.3, 4.0))]
    names = ["id", "split", "role", "drawdown", "fwd"]

    def states(test_rows):
        # The fit starts from sampled rows, so the partitions of the training rows must not move.
        df = spark.createDataFrame(train, names).union(spark.createDataFrame(test_rows, names))
        rows = regimes.walk_forward_regimes(df, ["drawdown"], ["s"], ["id"])
        return {r.id: (r.state, round(r.p_bull, 9)) for r in rows.collect()}

    alone = states(held)
    assert [alone[i][0] for i in range(100, 104)] == [0, 1, 0, 1]
    more = states(held + [(200 + i, "s", "test", 50.0, 1.0) for i in range(40)])
    assert all(more[k] == v for k, v in alone.items())


def test_consensus_takes_the_lowest_bic(spark):
    sweep = spark.createDataFrame([(2, 0.7, 0.5, 9.0, 8.0), (3, 0.6, 0.4, 5.0, 7.0)], ["k", "silhouette", "davies_bouldin", "aic", "bic"])
    assert tuple(regimes.consensus_k(sweep).first()) == (2, 3, 3, 3)


def test_spearman_of_values_that_differ_on_every_pass(spark):
    """Float sums over a shuffle come out with other last bits each time they are computed."""

    @F.udf("double")
    def summed(v):
        return math.nextafter(v, math.inf, steps=random.SystemRandom().randrange(1_000_000))

    rows = spark.createDataFrame([(g, float(i // 2), float(i + 1)) for g in "ab" for i in range(200)], "k string, x double, v double")
    got = stats.spearman(rows.select("k", "x", summed.asNondeterministic()("v").alias("y")), "x", "y", ["k"]).collect()
    # y rises with the row; x has ties of two, so rho is that of ranks 1.5, 1.5, 3.5, 3.5, ... against 1, 2, 3, 4, ...
    want = np.corrcoef(np.arange(200) // 2 * 2 + 1.5, np.arange(200) + 1)[0, 1]
    assert sorted((r.k, r.n) for r in got) == [("a", 200), ("b", 200)]
    assert [r.rho for r in got] == pytest.approx([want, want], abs=1e-12)


def test_equal_volumes_are_ties_of_spearman(spark, tmp_path):
    prices = [[0.1, 0.2, 0.3], [0.3, 0.2, 0.1, 0.0], [5.0], [7.0, 1.0]]
    assert 0.1 + 0.2 + 0.3 != 0.3 + 0.2 + 0.1
    day = [(d, p) for d, ps in enumerate(prices) for p in ps]
    orders = pd.DataFrame(
        {
            "o_orderkey": range(len(day)),
            "o_orderstatus": "F",
            "o_totalprice": [p for _, p in day],
            "o_orderdate": [pd.Timestamp("2024-01-01") + pd.Timedelta(days=d) for d, _ in day],
            "o_orderpriority": "a",
        }
    )
    orders.to_parquet(tmp_path / "orders.parquet", coerce_timestamps="us")
    got = entry.queries()["spearman_correlation"](spark, str(tmp_path)).collect()
    want = np.corrcoef([3, 4, 1, 2], [1.5, 1.5, 3, 4])[0, 1]
    assert [tuple(r) for r in got] == [("a", 4, pytest.approx(want, abs=1e-6))]


def test_exact_sum_keeps_every_value(spark):
    groups = {
        "cents": ([0.1, 0.2, 0.3, None], 0.6),
        "fine": ([1e-13, 2e-13], 1e-13 + 2e-13),
        "huge": ([1e300, 1.0], 1e300),
        "endless": ([math.inf, 1.0], math.inf),
        "none": ([None], None),
    }
    df = spark.createDataFrame([(k, v) for k, (vs, _) in groups.items() for v in vs], "k string, v double")
    assert {r.k: r.s for r in df.groupBy("k").agg(exact_sum("v").alias("s")).collect()} == {k: s for k, (_, s) in groups.items()}
    nan = spark.createDataFrame([(1.0,), (math.nan,)], "v double")
    assert math.isnan(nan.agg(exact_sum("v")).first()[0])
