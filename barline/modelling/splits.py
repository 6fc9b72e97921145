"""Train/test membership, scaling and weights for walk-forward work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.functions.mathx import safe_div
from barline.grid import Grid, numbered
from barline.operators.joins import join_inner


def standardize(train: DataFrame, rows: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Columns centred and scaled by the training mean and population deviation of their group.

    A constant training column is only centred. The statistics are one row per group.
    """
    stats = train.groupBy(*by).agg(
        *[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns]
    )
    out = rows.join(stats, by)
    scaled = {
        c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") == 0, F.lit(1.0)).otherwise(F.col(f"_s_{c}")) for c in columns
    }
    return out.withColumns(scaled).drop(*[f"_{k}_{c}" for c in columns for k in "ms"])


def _tagged(df: DataFrame, roles: list[tuple[str, str, Column]]) -> DataFrame:
    """Repeat each row for every (split, role) whose condition holds; both become columns."""
    hits = F.array(
        *[F.when(c, F.struct(F.lit(s).alias("split"), F.lit(r).alias("role"))) for s, r, c in roles]
    )
    return df.withColumn("_hit", F.explode(F.filter(hits, lambda h: h.isNotNull()))).select(*df.columns, "_hit.*")


def _large_enough(tagged: DataFrame, min_train: int, min_test: int, by: list[str]) -> DataFrame:
    sizes = tagged.groupBy(*by, "split").agg(
        F.count_if(F.col("role") == "train").alias("_train"), F.count_if(F.col("role") == "test").alias("_test")
    )
    keep = sizes.filter((F.col("_train") >= min_train) & (F.col("_test") >= min_test))
    return tagged.join(keep.select(*by, "split"), [*by, "split"], "left_semi")


def walk_forward(
    df: DataFrame,
    splits: list[dict],
    horizon: int = 5,
    embargo: int = 2,
    time: str = "ts",
    min_train: int = 30,
    min_test: int = 5,
    by: list[str] | None = None,
) -> DataFrame:
    """Rows tagged (split, role) for date splits, both ends included.

    Training ends at the earlier of its own end and ``horizon + embargo`` days before the test.
    A split without test end runs to the last row. Splits that are too small are dropped.
    """
    t = F.col(time)
    roles = []
    for s in splits:
        start, end = F.lit(s["train_start"]).cast("timestamp"), F.lit(s["train_end"]).cast("timestamp")
        test = F.lit(s["test_start"]).cast("timestamp")
        last = F.least(end, test - F.expr(f"INTERVAL {horizon + embargo} DAYS"))
        roles.append((s["name"], "train", (t >= start) & (t <= last)))
        inside = t >= test
        if s.get("test_end"):
            inside = inside & (t <= F.lit(s["test_end"]).cast("timestamp"))
        roles.append((s["name"], "test", inside))
    return _large_enough(_tagged(df, roles), min_train, min_test, by or [])


def positional_splits(
    df: DataFrame, grid: Grid, splits: list[tuple[str, int, int, int]], columns: list[str], min_train: int = 30, min_test: int = 5
) -> DataFrame:
    """Rows tagged by position after dropping rows with missing features.

    A split (name, train_end, gap_end, test_end) trains on positions [0, train_end) and tests on
    [gap_end, test_end).
    """
    rows = numbered(df.na.drop("any", subset=columns), grid, "_pos")
    i = F.col("_pos") - 1
    roles = []
    for name, train_end, gap_end, test_end in splits:
        roles.append((name, "train", i < train_end))
        roles.append((name, "test", (i >= gap_end) & (i < test_end)))
    return _large_enough(_tagged(rows, roles), min_train, min_test, list(grid.key)).drop("_pos")


def model_input(features: DataFrame, states: DataFrame, on: list[str], p: str, columns: list[str]) -> DataFrame:
    """Features joined with regime states, with regime strength |p - 0.5|; incomplete rows dropped."""
    out = join_inner(features, states, on).withColumn("regime_strength", F.abs(F.col(p) - 0.5))
    return out.na.drop("any", subset=[*columns, p])


def class_weights(train: DataFrame, label: str, by: list[str]) -> DataFrame:
    """Per group: positive weight n_neg/n_pos and the balanced weight of each class (two-class labels)."""
    pos, neg = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    out = train.groupBy(*by).agg(pos.alias("n_pos"), neg.alias("n_neg"))
    n = F.col("n_pos") + F.col("n_neg")
    return out.withColumns(
        {
            "pos_weight": safe_div("n_neg", "n_pos"),
            "balanced_pos": safe_div(n, 2 * F.col("n_pos")),
            "balanced_neg": safe_div(n, 2 * F.col("n_neg")),
        }
    )


def weighted(rows: DataFrame, weights: DataFrame, label: str, by: list[str], name: str = "weight") -> DataFrame:
    """Rows with the balanced weight of their class."""
    w = F.when(F.col(label) == 1, F.col("balanced_pos")).otherwise(F.col("balanced_neg"))
    return rows.join(weights.select(*by, "balanced_pos", "balanced_neg"), by).withColumn(name, w).drop("balanced_pos", "balanced_neg")
