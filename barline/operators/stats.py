"""Distribution, correlation and test statistics over series tables.

Every function aggregates with map-side partial sums; only the small result is windowed or sorted.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.functions.mathx import corr_of, p_norm, p_t, p_f, safe_div
from barline.grid import Grid, over_series
from barline.operators import rolling as R
from barline.ranks import average_ranks, quantiles
from barline.session import materialize


def share(condition: Column) -> Column:
    """Share of rows for which the condition is true, among rows where it is known."""
    return F.avg(condition.cast("double"))


def hit(y: str) -> Column:
    return share(F.col(y) > 0)


def corr_summary(df: DataFrame, c: str, before: str, by: list[str], time: str, split: str) -> DataFrame:
    """Level, spread, sign changes and before/after means of a rolling correlation."""
    x, cut = F.col(c), F.lit(split).cast("timestamp")
    flips = F.sum((F.signum(x) != F.signum(F.col(before))).cast("long"))
    return df.groupBy(*by).agg(
        F.count(x).alias("n"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("std"),
        share(F.abs(x) > 0.2).alias("share_strong"),
        share(x > 0).alias("share_positive"),
        F.coalesce(flips, F.lit(0)).alias("flips"),
        F.avg(F.when(F.col(time) < cut, x)).alias("pre"),
        F.avg(F.when(F.col(time) >= cut, x)).alias("post"),
    )


# ---- grouped outcomes ------------------------------------------------------------------------


def outcome(y: str, prefix: str = "") -> list[Column]:
    """n, mean, sample deviation and hit rate of y."""
    return [
        F.count(y).alias(f"{prefix}n"),
        F.avg(y).alias(f"{prefix}mean"),
        F.stddev_samp(y).alias(f"{prefix}std"),
        hit(y).alias(f"{prefix}hit"),
    ]


def by_state(df: DataFrame, state: str, y: str, by: list[str], periods: int = 252) -> DataFrame:
    """Share of time, outcome statistics and annualised volatility per state."""
    out = df.groupBy(*by, state).agg(F.count(F.lit(1)).alias("rows"), *outcome(y))
    whole = Window.partitionBy(*by)
    return out.withColumns(
        {
            "share": F.col("rows") / F.sum("rows").over(whole),
            "annual_vol": F.col("std") * F.sqrt(F.lit(float(periods))),
        }
    )


def qcut(df: DataFrame, x: str, q: int, by: list[str]) -> DataFrame:
    """Quantile bucket of x (from 0) within each group: exact edges, right-closed, lowest included.

    Repeated edges are merged, and ``buckets`` says how many remain.
    """
    names = {f"_q{i}": i / q for i in range(q + 1)}
    edges = quantiles(df, x, names, by).select(*by, F.array_distinct(F.array(*names)).alias("_edges"))
    inner = F.slice(F.col("_edges"), 2, F.greatest(F.size("_edges") - 2, F.lit(0)))
    out = df.filter(F.col(x).isNotNull()).join(edges, by)
    return out.withColumns(
        {
            "bucket": F.size(F.filter(inner, lambda e: e < F.col(x))),
            "buckets": F.greatest(F.size("_edges") - 1, F.lit(1)),
        }
    ).drop("_edges")


def qcut_stats(df: DataFrame, x: str, y: str, q: int, by: list[str]) -> DataFrame:
    """n, mean, deviation and exact median of y per quantile bucket of x."""
    cut = qcut(df, x, q, by)
    stats = cut.groupBy(*by, "bucket").agg(*outcome(y))
    medians = quantiles(cut, y, {"median": 0.5}, [*by, "bucket"])
    return stats.join(medians, [*by, "bucket"], "left")


def quartile_stats(df: DataFrame, x: str, y: str, by: list[str], least: int = 5) -> DataFrame:
    """Outcome below Q25, between, above Q75, with the one-sample test against zero."""
    edges = quantiles(df, x, {"_lo": 0.25, "_hi": 0.75}, by)
    part = F.when(F.col(x) < F.col("_lo"), "low").when(F.col(x) > F.col("_hi"), "high").otherwise("mid")
    grouped = df.filter(F.col(x).isNotNull()).join(edges, by).withColumn("part", part).groupBy(*by, "part").agg(*outcome(y))
    kept = grouped.filter(F.col("n") >= least)
    return kept.withColumns(one_sample("mean", "std", "n"))


def bin_of(x: str, edges: list[tuple[float, float]]) -> Column:
    """Index of the first [lo, hi) bin that holds x; null outside every bin."""
    out = None
    for i, (lo, hi) in enumerate(edges):
        inside = (F.col(x) >= lo) & (F.col(x) < hi)
        out = F.when(inside, F.lit(i)) if out is None else out.when(inside, F.lit(i))
    return out


def bin_stats(df: DataFrame, x: str, edges: list[tuple[float, float]], ys: list[str], by: list[str], dd: str | None = None) -> DataFrame:
    """Per fixed bin: rows, mean and win rate per outcome, mean drawdown."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for y in ys:
        aggs += [F.avg(y).alias(f"mean_{y}"), hit(y).alias(f"win_{y}")]
    if dd:
        aggs.append(F.avg(dd).alias("mean_dd"))
    out = df.withColumn("bin", bin_of(x, edges)).filter(F.col("bin").isNotNull()).groupBy(*by, "bin").agg(*aggs)
    lows = F.array(*[F.lit(float(lo)) for lo, _ in edges])
    highs = F.array(*[F.lit(float(hi)) for _, hi in edges])
    return out.withColumns({"lo": lows[F.col("bin")], "hi": highs[F.col("bin")]})


def combo_stats(df: DataFrame, predicates: dict[str, Column], ys: list[str], by: list[str]) -> DataFrame:
    """Outcomes per named predicate; a row counts for every predicate it meets."""
    named = F.array(*[F.when(p, F.lit(name)) for name, p in predicates.items()])
    rows = df.withColumn("combo", F.explode(F.filter(named, lambda v: v.isNotNull())))
    aggs = [F.count(F.lit(1)).alias("n")]
    for y in ys:
        aggs += [F.avg(y).alias(f"mean_{y}"), hit(y).alias(f"win_{y}")]
    return rows.groupBy(*by, "combo").agg(*aggs)


def rank_scenarios(df: DataFrame, predicates: dict[str, Column], y: str, by: list[str]) -> DataFrame:
    """Scenarios with the share of rows they take, ordered by mean outcome (rank 1 is best)."""
    total = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_all"))
    out = combo_stats(df, predicates, [y], by).join(total, by)
    best = Window.partitionBy(*by).orderBy(F.col(f"mean_{y}").desc(), "combo")
    return out.withColumns({"share": F.col("n") / F.col("_all"), "place": F.row_number().over(best)}).drop("_all")


def quadrant(price: str, oi: str, lo: float = -0.02, hi: float = 0.05) -> Column:
    """Price move against open-interest move, five named cases; null outside all of them."""
    up, down, x = F.col(price) > 0, F.col(price) < 0, F.col(oi)
    return (
        F.when(up & x.between(lo, hi), "trend")
        .when(up & (x < lo), "short_squeeze")
        .when(up & (x > hi), "possible_top")
        .when(down & (x > lo), "new_low")
        .when(down & (x < lo), "capitulation")
    )


def calendar_effects(df: DataFrame, time: str, y: str) -> DataFrame:
    """Outcomes by weekday (Monday 0), by month and by end of month (day 26 on), in one pass."""
    rows = df.select(
        y,
        F.weekday(time).alias("dow"),
        F.month(time).alias("month"),
        (F.dayofmonth(time) >= 26).cast("int").alias("eom"),
    )
    out = rows.groupingSets([["dow"], ["month"], ["eom"]], "dow", "month", "eom").agg(
        F.grouping_id().alias("_gid"), *outcome(y)
    )
    kind = F.when(F.col("_gid") == 3, "dow").when(F.col("_gid") == 5, "month").otherwise("eom")
    return out.select(kind.alias("kind"), F.coalesce("dow", "month", "eom").alias("slot"), "n", "mean", "std", "hit")


def period_stats(df: DataFrame, time: str, y: str, unit: str = "quarter", by: list[str] | None = None) -> DataFrame:
    """Outcomes per calendar quarter or half-year."""
    number = F.quarter(time) if unit == "quarter" else F.ceil(F.quarter(time) / 2)
    letter = "Q" if unit == "quarter" else "H"
    label = F.concat(F.year(time), F.lit(letter), number.cast("string"))
    return df.groupBy(*(by or []), label.alias("period")).agg(*outcome(y))


def range_stats(df: DataFrame, time: str, y: str, ranges: list[tuple[str, str, str]], by: list[str], periods: int = 252) -> DataFrame:
    """Mean, volatility, Sharpe and corrected skew per labelled date range; ranges may overlap."""
    ts = F.col(time)
    inside = {
        name: ts.between(F.lit(a).cast("timestamp"), F.lit(b).cast("timestamp")) for name, a, b in ranges
    }
    named = F.array(*[F.when(c, F.lit(n)) for n, c in inside.items()])
    rows = df.withColumn("period", F.explode(F.filter(named, lambda v: v.isNotNull())))
    n = F.count(y).cast("double")
    skew = F.skewness(y) * F.sqrt(n * (n - 1)) / (n - 2)
    return rows.groupBy(*by, "period").agg(
        F.count(y).alias("n"),
        F.avg(y).alias("mean"),
        F.stddev_samp(y).alias("vol"),
        (safe_div(F.avg(y), F.stddev_samp(y)) * F.sqrt(F.lit(float(periods)))).alias("sharpe"),
        F.when(n > 2, skew).alias("skew"),
    )


def tail_probs(df: DataFrame, bucket: str, y: str, by: list[str], move: float = 0.05) -> DataFrame:
    """Outcomes per bucket with the chance of a fall or rise beyond ``move``."""
    return df.groupBy(*by, bucket).agg(
        *outcome(y), share(F.col(y) < -move).alias("p_fall"), share(F.col(y) > move).alias("p_rise")
    )


def extremes(df: DataFrame, z: str, limit: float = 2.0) -> DataFrame:
    """Rows whose |z| reaches the limit, typed by sign."""
    return df.filter(F.abs(z) >= limit).withColumn(
        "type", F.when(F.col(z) > 0, "EXTREME_LONG").otherwise("EXTREME_SHORT")
    )


def value_shares(df: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """Count and share of each value."""
    by = by or []
    counts = df.groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    keys = by or ["_all"]
    counts = counts if by else counts.withColumn("_all", F.lit(0))
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_total"))
    return counts.join(totals, keys).withColumn("share", F.col("n") / F.col("_total")).drop("_total", "_all")


def dominant(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Most frequent non-null value per group; the smallest wins ties."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct((-F.col("n")).alias("n"), F.col(column).alias("value")))
    return counts.groupBy(*by).agg(first.alias("_m")).select(*by, F.col("_m.value").alias(column), (-F.col("_m.n")).alias("n"))


def transitions(df: DataFrame, grid: Grid, state: str, by: list[str]) -> DataFrame:
    """Markov counts and probabilities between consecutive rows."""
    from barline.grid import Roll

    nxt = Roll(lambda w: F.lead(state, 1).over(w.spec), ahead=1)
    pairs = over_series(df, grid, {"_to": nxt}).filter(F.col(state).isNotNull() & F.col("_to").isNotNull())
    counts = pairs.groupBy(*by, F.col(state).alias("from_state"), F.col("_to").alias("to_state")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*by, "from_state")))


def persistence(trans: DataFrame, by: list[str]) -> DataFrame:
    """Mean of the diagonal of the transition matrix; a state never kept counts as 0."""
    stay = F.sum(F.when(F.col("from_state") == F.col("to_state"), F.col("p")).otherwise(0.0))
    return trans.groupBy(*by).agg((stay / F.count_distinct("from_state")).alias("mean_diagonal"))


def describe(df: DataFrame, columns: list[str], time: str, by: list[str]) -> DataFrame:
    """Count, moments, exact quartiles, days up and down and dates of the extremes, per column."""
    long = df.unpivot([*by, time], columns, "feature", "value")
    keys = [*by, "feature"]
    v, t = F.col("value"), F.col(time)
    base = long.groupBy(*keys).agg(
        F.count(v).alias("count"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.count_if(v > 0).alias("positive"),
        F.count_if(v < 0).alias("negative"),
    )
    at = long.join(base.select(*keys, F.col("min").alias("_lo"), F.col("max").alias("_hi")), keys).groupBy(*keys).agg(
        F.min(F.when(v == F.col("_hi"), t)).alias("max_at"), F.min(F.when(v == F.col("_lo"), t)).alias("min_at")
    )
    quart = quantiles(long, "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, keys)
    return base.join(quart, keys).join(at, keys)


# ---- correlation -----------------------------------------------------------------------------


def _pair_corr(x: Column, y: Column) -> tuple[Column, Column]:
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return corr_of(a, b), F.count(a)


def with_pearson_p(df: DataFrame, r: str = "r", n: str = "n") -> DataFrame:
    """Add the t statistic and two-sided p-value of a correlation."""
    rr, nn = F.col(r), F.col(n).cast("double")
    t = rr * F.sqrt(F.try_divide(nn - 2, 1 - rr * rr))
    return df.withColumn("t", t).withColumn("p", p_t("t", nn - 2))


def corr_test(df: DataFrame, x: str, y: str, by: list[str], least: int = 10, bounds: tuple[float, float] | None = None) -> DataFrame:
    """Pearson r over complete pairs; null below ``least`` pairs; x optionally clipped."""
    from barline.functions.mathx import clip

    xc = clip(x, *bounds) if bounds else F.col(x)
    r, n = _pair_corr(xc, F.col(y))
    return df.groupBy(*by).agg(n.alias("n"), F.when(n >= least, r).alias("r"))


def corr_matrix(df: DataFrame, columns: list[str], by: list[str]) -> DataFrame:
    """Pairwise Pearson correlations, one aggregate for the whole matrix, returned long."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    wide = df.groupBy(*by).agg(*[_pair_corr(F.col(a), F.col(b))[0].alias(f"{a}|{b}") for a, b in pairs])
    long = wide.unpivot(by, [f"{a}|{b}" for a, b in pairs], "pair", "r")
    part = F.split("pair", "\\|")
    return long.select(*by, part[0].alias("x"), part[1].alias("y"), "r")


def spearman(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Correlation of tie-averaged ranks over complete pairs.

    Ranks are joined to the rows by value. The rows are stored first: a float sum computed again for the join can
    differ in its last bits, as its terms arrive in another order, and would then find no rank.
    """
    rows = materialize(df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, x, y), "pairs")
    ranked = average_ranks(average_ranks(rows, x, by, "_rx"), y, by, "_ry")
    return ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), corr_of(F.col("_rx"), F.col("_ry")).alias("rho"))


def lead_lag(df: DataFrame, grid: Grid, x: str, y: str, lags: list[int], by: list[str], least: int = 10) -> DataFrame:
    """Correlation of x with y ``lag`` rows later, for every lag; positive lags mean x leads."""
    from barline.grid import Roll

    def moved(k: int) -> Roll:
        return Roll(
            lambda w: (F.lead(F.col(y), k) if k >= 0 else F.lag(F.col(y), -k)).over(w.spec),
            back=max(0, -k),
            ahead=max(0, k),
        )

    out = over_series(df, grid, {f"_y{i}": moved(k) for i, k in enumerate(lags)})
    # One row per lag before the aggregate: its code stays small and it combines on the map side.
    moves = F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"_y{i}").alias("_y")) for i, k in enumerate(lags)])
    long = out.select(*by, F.col(x).alias("_x"), F.inline(moves))
    r, n = _pair_corr(F.col("_x"), F.col("_y"))
    return long.groupBy(*by, "lag").agg(n.alias("n"), F.when(n >= least, r).alias("r"))


def best_lag(scan: DataFrame, by: list[str]) -> DataFrame:
    """Lag with the largest |r|; the smallest lag wins ties; direction as text."""
    at = F.when(F.col("r").isNotNull(), F.struct(F.abs("r"), -F.col("lag")))
    best = scan.groupBy(*by).agg(F.max_by("lag", at).alias("best_lag"), F.max_by("r", at).alias("best_r"))
    lag = F.col("best_lag")
    text = (
        F.when(lag > 0, F.concat(F.lit("signal leads by "), lag.cast("string")))
        .when(lag < 0, F.concat(F.lit("target leads by "), (-lag).cast("string")))
        .otherwise("contemporaneous")
    )
    return best.withColumn("direction", text)


def corr_change(df: DataFrame, x: str, y: str, time: str, date: str, by: list[str], least: int = 4) -> DataFrame:
    """Fisher z test for a change of correlation at a date."""
    cut = F.lit(date).cast("timestamp")
    out = {}
    for side, rows in (("pre", F.col(time) < cut), ("post", F.col(time) >= cut)):
        r, n = _pair_corr(F.when(rows, F.col(x)), F.when(rows, F.col(y)))
        out[f"r_{side}"], out[f"n_{side}"] = r, n
    wide = df.groupBy(*by).agg(*[c.alias(k) for k, c in out.items()])

    def z(r: str) -> Column:
        return F.atanh(F.greatest(F.least(F.col(r), F.lit(0.9999)), F.lit(-0.9999)))

    ok = (F.col("n_pre") >= least) & (F.col("n_post") >= least)
    spread = F.sqrt(F.try_divide(F.lit(1.0), F.col("n_pre") - 3) + F.try_divide(F.lit(1.0), F.col("n_post") - 3))
    known = F.col("r_pre").isNotNull() & F.col("r_post").isNotNull()
    wide = wide.withColumn("z", F.when(ok & known, (z("r_pre") - z("r_post")) / spread))
    return wide.withColumn("p", p_norm("z"))


# ---- tests -----------------------------------------------------------------------------------


def one_sample(mean: str, std: str, n: str) -> dict[str, Column]:
    """t statistic and p-value of a mean against zero."""
    t = safe_div(F.col(mean), safe_div(std, F.sqrt(F.col(n).cast("double"))))
    return {"t": t, "p": p_t(t, F.col(n) - 1)}


def ttest(df: DataFrame, group: Column, y: str, by: list[str], kind: str = "welch") -> DataFrame:
    """Two-sample test of y where the condition holds against where it does not."""
    yes, no = F.when(group, F.col(y)), F.when(~group, F.col(y))
    m = df.groupBy(*by).agg(
        F.count(yes).alias("n1"), F.avg(yes).alias("m1"), F.var_samp(yes).alias("v1"),
        F.count(no).alias("n2"), F.avg(no).alias("m2"), F.var_samp(no).alias("v2"),
    )
    n1, n2, v1, v2 = F.col("n1"), F.col("n2"), F.col("v1"), F.col("v2")
    if kind == "welch":
        a, b = safe_div(v1, n1), safe_div(v2, n2)
        se = F.sqrt(a + b)
        dof = F.try_divide((a + b) * (a + b), F.try_divide(a * a, n1 - 1.0) + F.try_divide(b * b, n2 - 1.0))
    else:
        dof = (n1 + n2 - 2).cast("double")
        pooled = F.try_divide((n1 - 1) * v1 + (n2 - 1) * v2, dof)
        se = F.sqrt(pooled * (F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)))
    out = m.withColumns({"t": safe_div(F.col("m1") - F.col("m2"), se), "dof": dof})
    return out.withColumn("p", p_t("t", "dof"))


def chow(df: DataFrame, grid: Grid, y: str, dates: list[str], by: list[str], least: int = 30) -> DataFrame:
    """Break test of a linear trend at each date: F with (2, n-4) degrees of freedom.

    The trend is against the row number; residual sums come from one aggregate per date.
    """
    from barline.grid import numbered

    rows = numbered(df.filter(F.col(y).isNotNull()), grid, "_i")
    x, v = F.col("_i").cast("double"), F.col(y)
    structs = []
    for d in dates:
        left = F.col(grid.time) < F.lit(d).cast("timestamp")

        def rss(keep: Column) -> Column:
            a, b = F.when(keep, v), F.when(keep, x)
            sxx = F.regr_sxx(a, b)
            sxy = F.regr_sxy(a, b)
            return F.regr_syy(a, b) - F.try_divide(sxy * sxy, sxx)

        structs.append(
            F.struct(
                F.lit(d).cast("timestamp").alias("date"),
                F.count_if(left).alias("n_left"),
                F.count_if(~left).alias("n_right"),
                rss(F.lit(True)).alias("rss_all"),
                rss(left).alias("rss_left"),
                rss(~left).alias("rss_right"),
            )
        )
    wide = rows.groupBy(*by).agg(*[s.alias(f"_d{i}") for i, s in enumerate(structs)])
    out = wide.select(*by, F.inline(F.array(*[f"_d{i}" for i in range(len(dates))])))
    out = out.filter((F.col("n_left") >= least) & (F.col("n_right") >= least))
    parts = F.col("rss_left") + F.col("rss_right")
    dof = (F.col("n_left") + F.col("n_right") - 4).cast("double")
    out = out.withColumn("f", F.try_divide((F.col("rss_all") - parts) / 2.0, F.try_divide(parts, dof)))
    return out.withColumn("p", p_f("f", F.lit(2.0), dof))


def separation(df: DataFrame, state: str, signals: list[str], up: str, down: str, by: list[str]) -> DataFrame:
    """|mean in up - mean in down| over the overall deviation, per signal, ranked."""
    rows = df.unpivot([*by, state], signals, "signal", "v").filter(F.col("v").isNotNull())
    out = rows.groupBy(*by, "signal").agg(
        F.avg(F.when(F.col(state) == up, F.col("v"))).alias("mean_up"),
        F.avg(F.when(F.col(state) == down, F.col("v"))).alias("mean_down"),
        F.avg(F.when(~F.col(state).isin(up, down), F.col("v"))).alias("mean_else"),
        F.stddev_samp("v").alias("std"),
    ).filter(F.col("std") > 0)
    out = out.withColumn("separation", F.abs(F.col("mean_up") - F.col("mean_down")) / F.col("std"))
    place = Window.partitionBy(*by).orderBy(F.coalesce("separation", F.lit(0.0)).desc(), "signal")
    return out.withColumn("place", F.row_number().over(place))


def reversal(df: DataFrame, grid: Grid, y: str, signals: list[str], by: list[str], k: int = 5) -> DataFrame:
    """Signal means where the sign of y differs from k rows before against where it does not.

    A missing sign on either side counts as a flip, as comparisons with missing values do in pandas.
    """
    rows = over_series(df, grid, {"_was": R.lagged(y, k)})
    same = F.coalesce(F.signum(y) == F.signum("_was"), F.lit(False))
    long = rows.withColumn("_flip", ~same).unpivot([*by, "_flip"], signals, "signal", "_v")
    return ttest(long, F.col("_flip"), "_v", [*by, "signal"])


def event_study(events: DataFrame, surprise: str, ys: list[str], by: list[str], threshold: float) -> DataFrame:
    """Average reaction per surprise class and how often the last outcome went the expected way."""
    kind = surprise_class(surprise, threshold)
    last = F.col(ys[-1])
    expected = F.when(F.col("class") == "dovish", last > 0).otherwise(last < 0)
    return (
        events.withColumn("class", kind)
        .filter(F.col("class") != "unknown")
        .groupBy(*by, "class")
        .agg(F.count(F.lit(1)).alias("n"), *[F.avg(y).alias(f"mean_{y}") for y in ys], share(expected).alias("hit"))
    )


def surprise_class(x: str, threshold: float) -> Column:
    c = F.col(x)
    return F.when(c.isNull(), "unknown").when(c > threshold, "hawkish").when(c < -threshold, "dovish").otherwise("neutral")


def score_features(df: DataFrame, grid: Grid, features: list[str], y: str, state: str, by: list[str], window: int = 90) -> DataFrame:
    """Score each feature 1-3 (power 0-3) for power, stability and relevance; keep from 5 points.

    Power: r and its p-value against y. Stability: deviation of the rolling correlation.
    Relevance: spread of the state means over the overall deviation.
    """
    rolled = over_series(df, grid, {f"_rc_{f}": R.roll_corr(f, y, window) for f in features})
    structs = []
    for f in features:
        r, n = _pair_corr(F.col(f), F.col(y))
        structs.append(
            F.struct(
                F.lit(f).alias("feature"), r.alias("r"), n.alias("n"),
                F.stddev_samp(f"_rc_{f}").alias("r_std"), F.stddev_samp(f).alias("std"),
            ).alias(f"_s_{f}")
        )
    base = rolled.groupBy(*by).agg(*structs).select(*by, F.inline(F.array(*[f"_s_{f}" for f in features])))
    means = (
        df.filter(F.col(state).isNotNull())
        .unpivot([*by, state], features, "feature", "_v")
        .groupBy(*by, state, "feature")
        .agg(F.avg("_v").alias("_m"))
        .groupBy(*by, "feature")
        .agg(F.when(F.count("_m") > 1, F.max("_m") - F.min("_m")).otherwise(0.0).alias("spread"))
    )
    out = with_pearson_p(base.join(means, [*by, "feature"], "left"))
    a = F.abs("r")
    power = F.when((a > 0.10) & (F.col("p") < 0.05), 3).when((a > 0.05) & (F.col("p") < 0.10), 2).when(a > 0.02, 1).otherwise(0)
    stability = F.when(F.col("r_std") < 0.10, 3).when(F.col("r_std") < 0.20, 2).otherwise(1)
    ratio = safe_div("spread", "std")
    relevance = F.when(ratio > 0.5, 3).when(ratio > 0.2, 2).otherwise(1)
    out = out.withColumns({"power": power, "stability": stability, "relevance": relevance})
    total = F.col("power") + F.col("stability") + F.col("relevance")
    return out.withColumns({"total": total, "include": total >= 5})


def overlap(df: DataFrame, state: str, a, b, y: str, by: list[str], bins: int = 60, least: int = 5) -> DataFrame:
    """Shared area of the density histograms of y in two states over their common range."""
    rows = df.filter(F.col(y).isNotNull() & F.col(state).isin(a, b)).select(*by, state, F.col(y).alias("_y"))
    span = rows.groupBy(*by).agg(
        F.min("_y").alias("_lo"), F.max("_y").alias("_hi"),
        F.count_if(F.col(state) == a).alias("n_a"), F.count_if(F.col(state) == b).alias("n_b"),
    )
    width = (F.col("_hi") - F.col("_lo")) / bins
    slot = F.least(F.floor(safe_div(F.col("_y") - F.col("_lo"), width)), F.lit(bins - 1))
    hist = rows.join(span, by).groupBy(*by, "n_a", "n_b", slot.alias("_bin")).agg(
        F.count_if(F.col(state) == a).alias("_ca"), F.count_if(F.col(state) == b).alias("_cb")
    )
    both = F.least(safe_div("_ca", "n_a"), safe_div("_cb", "n_b"))
    out = hist.groupBy(*by, "n_a", "n_b").agg(F.sum(both).alias("overlap"))
    return out.withColumn("overlap", F.when((F.col("n_a") >= least) & (F.col("n_b") >= least), F.col("overlap")))


def share_check(part: DataFrame, whole: DataFrame, on: list[str], a: str, b: str, by: list[str]) -> DataFrame:
    """Share of a part in its total, and the rows in which the total is below the part."""
    both = part.select(*on, a).join(whole.select(*on, b), on)
    return both.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(safe_div(a, b)).alias("mean_share"),
        F.count_if(F.col(b) < F.col(a)).alias("violations"),
    )


def choose_start(breaks: DataFrame, date: str, asof: str, by: list[str], default: str, days: int = 365) -> DataFrame:
    """Most recent confirmed break that leaves enough days, else the default start."""
    enough = F.datediff(F.lit(asof).cast("timestamp"), F.col(date)) >= days
    best = F.max(F.when(enough & F.col("confirmed"), F.col(date)))
    return breaks.groupBy(*by).agg(F.coalesce(best, F.lit(default).cast("timestamp")).alias("start"))


def touch_stats(df: DataFrame, minutes: str, by: list[str]) -> DataFrame:
    """Hit rate and exact percentiles of the time to touch."""
    rate = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), (F.count(minutes) / F.count(F.lit(1))).alias("hit_rate"))
    q = quantiles(df, minutes, {"p10": 0.10, "p25": 0.25, "median": 0.5, "p75": 0.75}, by)
    return rate.join(q, by, "left")


def entry_stats(df: DataFrame, entry: Column, up: str, down: str, targets: list[float], stop: float, by: list[str]) -> DataFrame:
    """Hit and stop rates of filtered entries at several targets; the ratio's divisor is at least 0.01."""
    rows = df.filter(entry & F.col(up).isNotNull() & F.col(down).isNotNull())
    rows = rows.withColumn("target", F.explode(F.array(*[F.lit(float(t)) for t in targets])))
    out = rows.groupBy(*by, "target").agg(
        F.count(F.lit(1)).alias("n"),
        share(F.col(up) >= F.col("target")).alias("hit_rate"),
        share(F.col(down) <= -stop).alias("stop_rate"),
    )
    return out.withColumn("ratio", F.col("hit_rate") / F.greatest("stop_rate", F.lit(0.01)))


def top_n(df: DataFrame, x: str | Column, n: int, tie: str, largest: bool = True) -> DataFrame:
    """The n largest (or smallest) rows; runs as a take-ordered, not a full sort."""
    c = F.col(x) if isinstance(x, str) else x
    return df.orderBy(c.desc() if largest else c.asc(), tie).limit(n)


def best(df: DataFrame, x: str, by: list[str], tie: str) -> DataFrame:
    """The whole row with the largest x per group; the smallest tie value wins."""
    rest = [c for c in df.columns if c not in by]
    rows = df.withColumn("_x", F.col(x))
    # One aggregate per group with partial results on the map side: no window over a whole group.
    least = F.min_by(F.struct(*rest), F.struct(F.col("_x").isNull().alias("n"), (-F.col("_x")).alias("x"), F.col(tie).alias("t")))
    return rows.groupBy(*by).agg(least.alias("_r")).select(*by, *[F.col(f"_r.`{c}`").alias(c) for c in rest])


