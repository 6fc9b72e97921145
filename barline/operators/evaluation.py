"""Scoring of classifiers, signals and strategies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.mathx import col, safe_div
from barline.grid import Grid, max_of, over_series, running, sum_of
from barline.operators import rolling as R
from barline.operators.joins import cross_grid
from barline.operators.stats import share
from barline.ranks import RANGE, auc, quantiles, ranged, value_bounds


# ---- classification --------------------------------------------------------------------------


def binary_metrics(df: DataFrame, y: str, predicted: Column, by: list[str]) -> DataFrame:
    """Accuracy, precision, recall, F1 (0 where undefined) and class balance; null labels are left out."""
    yes, pos = F.col(y) == 1, predicted
    rows = df.filter(F.col(y).isNotNull())
    c = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(yes & pos).alias("tp"),
        F.count_if(~yes & pos).alias("fp"),
        F.count_if(yes & ~pos).alias("fn"),
        F.count_if(~yes & ~pos).alias("tn"),
    )
    zero = F.lit(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.withColumns(
        {
            "accuracy": safe_div(tp + F.col("tn"), "n"),
            "precision": F.coalesce(safe_div(tp, tp + fp), zero),
            "recall": F.coalesce(safe_div(tp, tp + fn), zero),
            "f1": F.coalesce(safe_div(2 * tp, 2 * tp + fp + fn), zero),
            "balance": safe_div(tp + fn, "n"),
            "coverage": safe_div(tp + fp, "n"),
        }
    )


def auc_report(df: DataFrame, y: str, p: str, by: list[str], confident: float = 0.10, least: int = 10) -> DataFrame:
    """ROC area overall and among confident rows (|p - 0.5| above the limit), each null below ``least`` rows."""
    whole = auc(df, p, y, by).withColumnsRenamed({"n": "n_all", "auc": "auc_all"})
    sure = auc(df.filter(F.abs(F.col(p) - 0.5) > confident), p, y, by).withColumnsRenamed(
        {"n": "n_sure", "auc": "auc_sure"}
    )
    whole, sure = (d.withColumn("_one", F.lit(1)) for d in (whole, sure))
    out = whole.join(sure, [*by, "_one"], "left").drop("_one")
    enough = {f"auc_{k}": F.when(F.col(f"n_{k}") >= least, F.col(f"auc_{k}")) for k in ("all", "sure")}
    return out.withColumns({**enough, "baseline": F.lit(0.5), "n_sure": F.coalesce("n_sure", F.lit(0))})


THRESHOLDS = [0.30, 0.35, 0.40, 0.45, 0.50, 0.55, 0.60, 0.65, 0.70]


def threshold_sweep(df: DataFrame, y: str, p: str, by: list[str], thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """Precision, recall, F1 and coverage at every threshold.

    Rows are first counted per (group, number of thresholds passed), so the sweep multiplies counts, not rows.
    """
    passed = reduce(lambda a, b: a + b, [F.when(F.col(p) >= t, 1).otherwise(0) for t in thresholds])
    counts = (
        df.filter(F.col(y).isNotNull() & F.col(p).isNotNull())
        .groupBy(*by, passed.alias("_passed"))
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(F.when(F.col(y) == 1, 1).otherwise(0)).alias("_pos"))
    )
    ranked = sorted(thresholds)
    swept = counts.withColumn(
        "t", F.explode(F.array(*[F.struct(F.lit(i + 1).alias("k"), F.lit(t).alias("threshold")) for i, t in enumerate(ranked)]))
    ).select("*", "t.*")
    hit = F.col("_passed") >= F.col("k")
    out = swept.groupBy(*by, "threshold").agg(
        F.sum("_n").alias("n"),
        F.coalesce(F.sum(F.when(hit, F.col("_pos"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(hit, F.col("_n"))), F.lit(0)).alias("predicted"),
        F.sum("_pos").alias("positives"),
    )
    zero = F.lit(0.0)
    return out.withColumns(
        {
            "precision": F.coalesce(safe_div("tp", "predicted"), zero),
            "recall": F.coalesce(safe_div("tp", "positives"), zero),
            "f1": F.coalesce(safe_div(2 * F.col("tp"), F.col("predicted") + F.col("positives")), zero),
            "coverage": safe_div("predicted", "n"),
        }
    )


def recommend_threshold(sweep: DataFrame, by: list[str], coverage: float = 0.20) -> DataFrame:
    """Best F1 among thresholds with enough coverage; the lowest threshold wins ties, 0.50 stands in for none."""
    ok = F.when(F.col("coverage") >= coverage, F.struct(F.col("f1"), -F.col("threshold")))
    best = F.coalesce(F.max_by("threshold", ok), F.lit(0.50))
    return sweep.groupBy(*by).agg(best.alias("threshold"), F.max_by("f1", ok).alias("f1"))


def confidence(df: DataFrame, p: str, by: list[str], sure: float = 0.10, entry: float = 0.60) -> DataFrame:
    """Mean |p - 0.5|, share of confident rows and share of confident entries."""
    c = F.abs(F.col(p) - 0.5)
    return df.groupBy(*by).agg(
        F.count(p).alias("n"),
        F.avg(c).alias("mean_confidence"),
        share(c > sure).alias("confident_share"),
        share((F.col(p) > entry) & (c > sure)).alias("entry_share"),
    )


def metrics_pivot(df: DataFrame, row: str, split: str, metric: str, splits: list[str], baseline: float = 0.5, stable: float = 0.02) -> DataFrame:
    """One row per feature set with a column per split, mean, sample deviation, lift and a stability flag."""
    wide = df.groupBy(row).agg(
        *[F.first(F.when(F.col(split) == s, F.col(metric)), ignorenulls=True).alias(s) for s in splits],
        F.avg(metric).alias("mean"),
        F.stddev_samp(metric).alias("std"),
    )
    return wide.withColumns(
        {
            "baseline": F.lit(baseline),
            "lift": F.col("mean") - baseline,
            "stable": F.coalesce(F.col("std") <= stable, F.lit(False)),
        }
    )


def importance_summary(df: DataFrame, importances: str, by: list[str], top: int = 15) -> DataFrame:
    """Mean importance per feature over splits from JSON maps, the highest ``top``."""
    parsed = df.select(*by, F.explode(F.from_json(importances, "map<string,double>")).alias("feature", "importance"))
    means = parsed.groupBy(*by, "feature").agg(F.avg("importance").alias("importance"), F.count(F.lit(1)).alias("splits"))
    order = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(F.col("importance").desc(), "feature")
    return means.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)


def regime_metrics(df: DataFrame, split: str, state: str, fwd: str, grid: Grid | None = None) -> DataFrame:
    """Forward returns in the up (1) and down (0) state per split: means, delta, precision, shares, durations."""
    from barline.operators.runs import run_durations

    y, up, down = F.col(fwd), F.col(state) == 1, F.col(state) == 0
    out = df.filter(y.isNotNull()).groupBy(split).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(up, y)).alias("e_up"),
        F.avg(F.when(down, y)).alias("e_down"),
        (F.avg(F.when(up, y)) - F.avg(F.when(down, y))).alias("delta"),
        F.avg(F.when(up, (y > 0).cast("double"))).alias("precision_up"),
        F.avg(F.when(down, (y < 0).cast("double"))).alias("precision_down"),
        F.avg(up.cast("double")).alias("share_up"),
    )
    if grid is None:
        return out
    runs = run_durations(df.filter(y.isNotNull()), grid.by(split), state).groupBy(split).agg(
        safe_div(F.sum(F.when(up, F.col("runs") * F.col("mean_duration"))), F.sum(F.when(up, F.col("runs")))).alias("duration_up"),
        safe_div(F.sum(F.when(down, F.col("runs") * F.col("mean_duration"))), F.sum(F.when(down, F.col("runs")))).alias("duration_down"),
    )
    return out.join(runs, split)


def evaluate_signals(df: DataFrame, signal: str, ret: str, by: list[str], horizon: int = 5) -> DataFrame:
    """Long minus short mean, Sharpe with population deviation, and counts per side."""
    s, r = F.col(signal), F.col(ret)
    strategy = F.when(s == 1, r).when(s == -1, -r).otherwise(F.lit(0.0))
    scale = F.sqrt(F.lit(252.0 / horizon))
    return df.filter(r.isNotNull()).groupBy(*by).agg(
        (F.avg(F.when(s == 1, r)) - F.avg(F.when(s == -1, r))).alias("delta"),
        (F.avg(strategy) / (F.stddev_pop(strategy) + 1e-8) * scale).alias("sharpe"),
        F.avg((s == 1).cast("double")).alias("pct_long"),
        F.avg((s == -1).cast("double")).alias("pct_short"),
        F.avg((s == 0).cast("double")).alias("pct_neutral"),
        F.count_if(s == 1).alias("n_long"),
        F.count_if(s == -1).alias("n_short"),
    )


# ---- strategies ------------------------------------------------------------------------------


def equity_curve(
    df: DataFrame,
    grid: Grid,
    position: str,
    ret: str,
    cost: str | Column = 0.0,
    entry_lag: int = 0,
    cost_on: str = "turnover",
) -> DataFrame:
    """Net return, equity and drawdown per row.

    ``cost_on``: "turnover" charges |change of position|, "change" charges any change once. The
    first row trades from zero. ``entry_lag`` delays the position by rows, flat before. The product
    of growth factors is kept as log, sign and zero parts, so losses beyond -100 % stay exact.
    """
    cost = F.lit(float(cost)) if isinstance(cost, (int, float)) else col(cost)
    pos = F.col(position).cast("double")
    held = R.Roll(lambda w: F.coalesce(F.lag(pos, entry_lag).over(w.spec), F.lit(0.0)) if entry_lag else pos, back=entry_lag)
    moved = R.Roll(lambda w: F.col("_held") - F.coalesce(F.lag("_held", 1).over(w.spec), F.lit(0.0)), back=1)
    rows = df.filter(F.col(ret).isNotNull())
    out = over_series(rows, grid, {"_held": held}, {"turnover": moved}, keep_chunk=True)
    charge = F.abs("turnover") if cost_on == "turnover" else (F.col("turnover") != 0).cast("double")
    out = out.withColumn("net", F.col("_held") * F.col(ret) - cost * charge)
    g = F.lit(1.0) + F.col("net")
    out = running(
        out,
        grid,
        {
            "_log": sum_of(F.when(g != 0, F.ln(F.abs(g))).otherwise(F.lit(0.0))),
            "_neg": sum_of((g < 0).cast("long")),
            "_zero": sum_of((g == 0).cast("long")),
            "row_no": sum_of(F.lit(1).cast("long")),
        },
        keep_chunk=True,
    )
    sign = F.when(F.col("_zero") > 0, 0.0).when(F.col("_neg") % 2 == 1, -1.0).otherwise(1.0)
    out = out.withColumn("equity", sign * F.exp("_log"))
    out = running(out, grid, {"_peak": max_of("equity")})
    out = out.withColumn("drawdown", safe_div("equity", "_peak") - 1.0)
    return out.drop("_log", "_neg", "_zero", "_peak").withColumnRenamed("_held", "held")


def performance(
    df: DataFrame,
    grid: Grid,
    position: str,
    ret: str,
    cost: str | Column = 0.0,
    periods: int = 252,
    entry_lag: int = 0,
    cost_on: str = "turnover",
) -> DataFrame:
    """Strategy summary per series key (put regime or scenario into the grid's key for subsets)."""
    curve = equity_curve(df, grid, position, ret, cost, entry_lag, cost_on)
    net = F.col("net")
    active = F.when(net != 0, net)
    out = curve.groupBy(*grid.key).agg(
        F.count(F.lit(1)).alias("n"),
        F.max_by("equity", "row_no").alias("equity"),
        F.min("drawdown").alias("max_drawdown"),
        (F.avg(net) / (F.stddev_pop(net) + 1e-10) * F.sqrt(F.lit(float(periods)))).alias("sharpe"),
        share(active > 0).alias("hit_rate"),
        safe_div(F.sum(F.when(net > 0, net)), F.abs(F.sum(F.when(net < 0, net)))).alias("profit_factor"),
        F.count_if(F.col("turnover") != 0).alias("trades"),
        F.sum(net).alias("total_net"),
    )
    years = F.col("n") / F.lit(float(periods))
    return out.withColumn("cagr", F.when(F.col("equity") > 0, F.pow("equity", 1.0 / years) - 1.0))


def cost_stress(df: DataFrame, grid: Grid, position: str, ret: str, costs: list[float], **kw) -> DataFrame:
    """Performance under several cost levels."""
    rows = cross_grid(df, [{"cost": float(c)} for c in costs])
    return performance(rows, grid.by("cost"), position, ret, cost="cost", **kw)


def curve_metrics(
    df: DataFrame, grid: Grid, value: str, position: str, ret: str, periods: int = 252, least: int = 20, targets: dict[str, float] | None = None
) -> DataFrame:
    """Metrics of a recorded portfolio curve, with sample deviation; null below ``least`` rows.

    Trades are position changes above 0.05; hit rate is over rows with a long position.
    """
    rows = over_series(df, grid, {"_turn": R.diff(position)}, keep_chunk=True)
    rows = running(rows, grid, {"_peak": max_of(value), "_no": sum_of(F.lit(1).cast("long"))})
    r = F.col(ret)
    out = rows.groupBy(*grid.key).agg(
        F.count(F.lit(1)).alias("n_days"),
        (F.avg(r) / (F.stddev_samp(r) + 1e-10) * F.sqrt(F.lit(float(periods)))).alias("sharpe"),
        safe_div(F.max_by(value, "_no"), F.min_by(value, "_no")).alias("_growth"),
        F.min(safe_div(value, "_peak") - 1.0).alias("max_drawdown"),
        F.avg(F.when(F.col(position) > 0, (F.coalesce(r > 0, F.lit(False))).cast("double"))).alias("hit_rate"),
        F.count_if(F.abs("_turn") > 0.05).alias("n_trades"),
    )
    out = out.withColumn("cagr", F.pow("_growth", F.lit(float(periods)) / F.col("n_days")) - 1.0).drop("_growth")
    enough = F.col("n_days") >= least
    out = out.withColumns({c: F.when(enough, F.col(c)) for c in ("sharpe", "max_drawdown", "hit_rate", "cagr")})
    for name, target in (targets or {}).items():
        out = out.withColumn(f"{name}_vs_target", F.col(name) - F.lit(target))
    return out


def agreement(a: DataFrame, b: DataFrame, on: list[str], state: str, by: list[str]) -> DataFrame:
    """How often two state series are both up, both down, or disagree."""
    both = a.select(*on, *[c for c in by if c not in on], F.col(state).alias("_a")).join(b.select(*on, F.col(state).alias("_b")), on)
    x, y = F.col("_a"), F.col("_b")
    return both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        share((x == 1) & (y == 1)).alias("both_up"),
        share((x == 0) & (y == 0)).alias("both_down"),
        share(x != y).alias("disagree"),
    )


def pareto(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows no other row beats: at least as good in both measures and better in one.

    Points are collapsed to the best b per a. A point stays when its b exceeds every b at a larger
    a; that maximum is carried over ranges of a, so no task sees all points.
    """
    points = df.groupBy(a).agg(F.max(b).alias("_best"))
    at = F.col(a).cast("double")
    points = ranged(points, at, value_bounds(df, at), RANGE)
    # One row per range of a: at most as many as there are cut points.
    over_ranges = Window.partitionBy(F.lit(0)).orderBy(F.col(RANGE).desc()).rowsBetween(Window.unboundedPreceding, -1)
    carried = points.groupBy(RANGE).agg(F.max("_best").alias("_top")).select(
        RANGE, F.max("_top").over(over_ranges).alias("_carry")
    )
    inside = Window.partitionBy(RANGE).orderBy(F.col(a).desc()).rowsBetween(Window.unboundedPreceding, -1)
    beyond = F.greatest(F.col("_carry"), F.max("_best").over(inside))
    front = points.join(carried, RANGE).withColumn("_beyond", beyond)
    front = front.filter(F.col("_beyond").isNull() | (F.col("_best") > F.col("_beyond"))).select(a, "_best")
    return df.join(front, a).filter(F.col(b) == F.col("_best")).drop("_best")


def meets(df: DataFrame, floors: dict[str, float]) -> DataFrame:
    """Rows above every floor; a missing measure does not meet its floor."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(c) > v for c, v in floors.items()]))


def rank_configs(df: DataFrame, config: str, metric: str) -> DataFrame:
    """Mean metric per configuration over its splits, ranked."""
    means = df.groupBy(config).agg(F.avg(metric).alias("mean"), F.count(metric).alias("splits"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("mean").desc_nulls_last(), config)
    return means.withColumn("place", F.row_number().over(order))


BAND = ("low", "neutral", "high")


def band(p: str, lo: float = 0.40, hi: float = 0.60) -> Column:
    return F.when(F.col(p) < lo, BAND[0]).when(F.col(p) < hi, BAND[1]).when(F.col(p).isNotNull(), BAND[2])


def conviction_matrix(df: DataFrame, state: str, p: str, y: str, by: list[str], least: int = 3) -> DataFrame:
    """Mean outcome and count per (state, probability band); cells below ``least`` rows are hidden."""
    out = df.withColumn("band", band(p)).groupBy(*by, state, "band").agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"))
    return out.withColumn("mean", F.when(F.col("n") >= least, F.col("mean")))


def conviction_summary(df: DataFrame, state: str, p: str, y: str, by: list[str], least: int = 10) -> DataFrame:
    """Per state: delta by predicted side, edge of convinced rows, neutral share and exact quartiles of p."""
    pp, yy = F.col(p), F.col(y)
    out = df.groupBy(*by, state).agg(
        F.count(F.lit(1)).alias("n"),
        (F.avg(F.when(pp >= 0.5, yy)) - F.avg(F.when(pp < 0.5, yy))).alias("delta"),
        (F.avg(F.when(pp > 0.6, yy)) - F.avg(F.when(pp < 0.4, yy))).alias("edge"),
        share(pp.between(0.4, 0.6)).alias("neutral_share"),
    )
    q = quantiles(df, p, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, [*by, state])
    return out.filter(F.col("n") >= least).join(q, [*by, state])


def edge(df: DataFrame, p: str, y: str, threshold: float, by: list[str]) -> DataFrame:
    """Mean outcome at or above the threshold minus below it."""
    sure = F.col(p) >= threshold
    return df.filter(F.col(y).isNotNull()).groupBy(*by).agg(
        F.count_if(sure).alias("n_high"),
        share(sure).alias("share_high"),
        F.avg(F.when(sure, F.col(y))).alias("high"),
        F.avg(F.when(~sure, F.col(y))).alias("low"),
        (F.avg(F.when(sure, F.col(y))) - F.avg(F.when(~sure, F.col(y)))).alias("edge"),
    )


def gate_summary(df: DataFrame, gates: dict[str, tuple[str, str]], by: list[str]) -> DataFrame:
    """Blocked rows per gate and reason; ``gates`` maps a name to its (flag, reason) columns."""
    rows = F.array(
        *[
            F.struct(F.lit(g).alias("gate"), F.col(flag).cast("boolean").alias("blocked"), F.col(reason).alias("reason"))
            for g, (flag, reason) in gates.items()
        ]
    )
    long = df.select(*by, F.inline(F.filter(rows, lambda g: g.blocked)))
    return long.groupBy(*by, "gate", "reason").agg(F.count(F.lit(1)).alias("blocked"))
