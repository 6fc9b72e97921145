"""Row-framed window functions over series.

Every function returns a ``Roll`` for ``over_series``. Rolling values are null unless the frame
holds ``least`` non-null rows (default: the whole window).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from barline.functions.mathx import clip, col, safe_div
from barline.grid import ROW, Roll, SeriesWindow


def _rolled(x, n: int, agg: Callable[[Column], Column], least: int | None = None) -> Callable[[SeriesWindow], Column]:
    """Guarded rolling aggregate over the last n rows."""
    x = col(x)
    need = n if least is None else least

    def build(w: SeriesWindow) -> Column:
        return F.when(w.agg(F.count(x), 1 - n) >= need, w.agg(agg(x), 1 - n))

    return build


def _roll(x, n: int, agg, least: int | None = None) -> Roll:
    return Roll(_rolled(x, n, agg, least), back=n - 1)


# ---- lags, differences, returns --------------------------------------------------------------


def lagged(x, k: int = 1) -> Roll:
    return Roll(lambda w: w.lag(col(x), k), back=k)


def diff(x, k: int = 1) -> Roll:
    return Roll(lambda w: col(x) - w.lag(col(x), k), back=k)


def log_return(x, k: int = 1) -> Roll:
    return Roll(lambda w: F.ln(safe_div(x, w.lag(col(x), k))), back=k)


def ret(x, k: int = 1) -> Roll:
    """Simple k-row return without filling nulls; also the rate of change."""
    return Roll(lambda w: safe_div(x, w.lag(col(x), k)) - 1.0, back=k)


def pct_change(filled, k: int = 1) -> Roll:
    """Relative change of an already forward-filled column (see ``operators.fill.padded``)."""
    return ret(filled, k)


# ---- moments ---------------------------------------------------------------------------------


def roll_sum(x, n: int, least: int | None = None) -> Roll:
    return _roll(x, n, F.sum, least)


def roll_mean(x, n: int, least: int | None = None) -> Roll:
    return _roll(x, n, F.avg, least)


def roll_std(x, n: int, least: int | None = None) -> Roll:
    return _roll(x, n, F.stddev_samp, max(2, n if least is None else least))


def roll_max(x, n: int, least: int | None = None) -> Roll:
    return _roll(x, n, F.max, least)


def roll_min(x, n: int, least: int | None = None) -> Roll:
    return _roll(x, n, F.min, least)


def roll_quantile(x, n: int, q: float, least: int | None = None) -> Roll:
    return _roll(x, n, lambda c: F.percentile(c, F.lit(q)), least)


def zscore(x, n: int, least: int | None = None, least_std: int | None = None) -> Roll:
    """Distance to the rolling mean in rolling sample deviations; null where that is 0."""
    mean = _rolled(x, n, F.avg, least)
    std = _rolled(x, n, F.stddev_samp, max(2, n if least is None else least) if least_std is None else least_std)
    return Roll(lambda w: safe_div(col(x) - mean(w), std(w)), back=n - 1)


def roll_skew(x, n: int) -> Roll:
    """Bias-corrected skewness; 0 for a constant frame."""

    def build(w: SeriesWindow) -> Column:
        c = col(x)
        k = w.agg(F.count(c), 1 - n).cast("double")
        g = w.agg(F.skewness(c), 1 - n)
        flat = w.agg(F.var_pop(c), 1 - n) == 0
        corrected = g * F.sqrt(k * (k - 1)) / (k - 2)
        return F.when(k >= max(n, 3), F.when(flat, F.lit(0.0)).otherwise(corrected))

    return Roll(build, back=n - 1)


def roll_kurt(x, n: int) -> Roll:
    """Bias-corrected excess kurtosis; -3 for a constant frame."""

    def build(w: SeriesWindow) -> Column:
        c = col(x)
        k = w.agg(F.count(c), 1 - n).cast("double")
        g = w.agg(F.kurtosis(c), 1 - n)
        flat = w.agg(F.var_pop(c), 1 - n) == 0
        corrected = ((k + 1) * g + 6) * (k - 1) / ((k - 2) * (k - 3))
        return F.when(k >= max(n, 4), F.when(flat, F.lit(-3.0)).otherwise(corrected))

    return Roll(build, back=n - 1)


def vol_ratio(short: str, long: str) -> Column:
    return F.when(F.col(long) > 0, F.col(short) / F.col(long))


def roll_sharpe(x, n: int, periods: int = 252) -> Roll:
    mean, std = _rolled(x, n, F.avg), _rolled(x, n, F.stddev_samp)
    return Roll(lambda w: safe_div(mean(w), std(w)) * F.sqrt(F.lit(float(periods))), back=n - 1)


# ---- two columns -----------------------------------------------------------------------------


def _paired(x, y) -> tuple[Column, Column]:
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    return F.when(both, x), F.when(both, y)


def roll_corr(x, y, n: int, least: int | None = None) -> Roll:
    a, b = _paired(x, y)

    def build(w: SeriesWindow) -> Column:
        r = safe_div(w.agg(F.covar_pop(a, b), 1 - n), w.agg(F.stddev_pop(a), 1 - n) * w.agg(F.stddev_pop(b), 1 - n))
        return F.when(w.agg(F.count(a), 1 - n) >= (n if least is None else least), r)

    return Roll(build, back=n - 1)


def roll_beta(y, x, n: int) -> Roll:
    """Rolling covariance over the variance of x in the same frame; null where that is not positive."""
    a, b = _paired(y, x)
    var = _rolled(x, n, F.var_samp)

    def build(w: SeriesWindow) -> Column:
        cov = F.when(w.agg(F.count(a), 1 - n) >= n, w.agg(F.covar_samp(a, b), 1 - n))
        v = var(w)
        return F.when(v > 0, cov / v)

    return Roll(build, back=n - 1)


def autocorr(x, k: int, n: int) -> list[dict[str, Roll]]:
    """Two stages: the lag of x, then its rolling correlation with x."""
    return [{"_lag": lagged(x, k)}, {f"autocorr_{k}": roll_corr(x, "_lag", n)}]


# ---- trend -----------------------------------------------------------------------------------


def drawdown(x, n: int, least: int | None = None) -> Roll:
    top = _rolled(x, n, F.max, least)
    return Roll(lambda w: safe_div(x, top(w)) - 1.0, back=n - 1)


dist_to_high = drawdown


def dist_to_low(x, low, n: int) -> Roll:
    bottom = _rolled(low, n, F.min)
    return Roll(lambda w: safe_div(x, bottom(w)) - 1.0, back=n - 1)


def dist_to_ma(x, n: int) -> Roll:
    mean = _rolled(x, n, F.avg)

    def build(w: SeriesWindow) -> Column:
        m = mean(w)
        return F.when(m > 0, col(x) / m - 1.0)

    return Roll(build, back=n - 1)


def ma_ratio(x, fast: int, slow: int) -> Roll:
    """Fast over slow moving average minus one; above zero the fast average leads."""
    f, s = _rolled(x, fast, F.avg), _rolled(x, slow, F.avg)
    return Roll(lambda w: safe_div(f(w), s(w)) - 1.0, back=slow - 1)


def efficiency_ratio(x, n: int) -> list[dict[str, Roll | Column]]:
    """Net move over path length; 0 in the burn-in and on a flat path."""
    step = Roll(lambda w: F.abs(col(x) - w.lag(col(x), 1)), back=1)
    move = Roll(lambda w: F.abs(col(x) - w.lag(col(x), n)), back=n)
    path = roll_sum("_step", n)
    ratio = F.when(F.col("_path") > 0, F.col("_net_move") / F.col("_path")).otherwise(F.lit(0.0))
    return [{"_step": step, "_net_move": move}, {"_path": path}, {"er": ratio}]


def roll_slope(x, n: int, norm: str = "raw") -> Roll:
    """Least-squares slope per row over n rows: raw, over the last value, or over the mean."""

    def build(w: SeriesWindow) -> Column:
        c = col(x)
        slope = w.agg(F.regr_slope(c, F.col(ROW)), 1 - n)
        if norm == "last":
            slope = F.when(c == 0, F.lit(0.0)).otherwise(safe_div(slope, c))
        elif norm == "mean":
            slope = safe_div(slope, w.agg(F.avg(c), 1 - n))
        return F.when(w.agg(F.count(c), 1 - n) >= n, slope)

    return Roll(build, back=n - 1, needs_row=True)


def cross_up(fast: str, slow: str) -> Roll:
    """1 where fast rises above slow on this row."""

    def build(w: SeriesWindow) -> Column:
        above = F.col(fast) > F.col(slow)
        was = w.lag(above, 1)
        return F.coalesce((above & ~was).cast("double"), F.lit(0.0))

    return Roll(build, back=1)


# ---- bands and oscillators -------------------------------------------------------------------


def bb_width(x, n: int, k: float = 2.0) -> Roll:
    mean, std = _rolled(x, n, F.avg), _rolled(x, n, F.stddev_samp)
    return Roll(lambda w: safe_div(std(w) * (2 * k), mean(w)), back=n - 1)


def bb_position(x, n: int, k: float = 2.0, population: bool = False, flat: float | None = None) -> Roll:
    """Place of x between the bands: 0 lower, 1 upper; ``flat`` where the bands coincide."""
    mean = _rolled(x, n, F.avg)
    std = _rolled(x, n, F.stddev_pop if population else F.stddev_samp)

    def build(w: SeriesWindow) -> Column:
        m, s = mean(w), std(w)
        inside = (col(x) - (m - s * k)) / (s * (2 * k))
        return F.when(s > 0, inside).when(s == 0, F.lit(flat).cast("double"))

    return Roll(build, back=n - 1)


def rsi(x, n: int, zero_loss: float | None = None) -> list[dict[str, Roll | Column]]:
    """Strength index from plain means of gains and losses; stage 1 makes the moves."""
    move = F.col("_change")

    def build(w: SeriesWindow) -> Column:
        gain = _rolled(F.greatest(move, F.lit(0.0)) + move * 0, n, F.avg)(w)
        loss = _rolled(F.greatest(-move, F.lit(0.0)) + move * 0, n, F.avg)(w)
        value = F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + safe_div(gain, loss))
        return F.when(loss == 0, F.lit(zero_loss).cast("double")).otherwise(value)

    return [{"_change": diff(x)}, {f"rsi_{n}": Roll(build, back=n - 1)}]


def range_position(x, high, low, n: int) -> Roll:
    """(x - lowest) / (highest - lowest) over n rows; null where the range is flat."""
    top, bottom = _rolled(high, n, F.max), _rolled(low, n, F.min)

    def build(w: SeriesWindow) -> Column:
        t, b = top(w), bottom(w)
        return F.when(t - b > 0, (col(x) - b) / (t - b))

    return Roll(build, back=n - 1)


def true_range(high="high", low="low", close="close") -> Roll:
    """Largest of the bar range and the gaps to the previous close; the first bar has no gap."""

    def build(w: SeriesWindow) -> Column:
        before = w.lag(col(close), 1)
        h, lo = col(high), col(low)
        return F.greatest(h - lo, F.abs(h - before), F.abs(lo - before))

    return Roll(build, back=1)


def atr(tr: str, close: str, n: int) -> Roll:
    mean = _rolled(tr, n, F.avg)
    return Roll(lambda w: safe_div(mean(w), close), back=n - 1)


def range_rel(high="high", low="low", close="close") -> Column:
    return F.when(col(close) > 0, (col(high) - col(low)) / col(close))


def buy_pressure(taker: str, total: str) -> Column:
    return clip(safe_div(taker, total), 0.0, 1.0)


# ---- array-framed functions ------------------------------------------------------------------


def rolling_expr(x, n: int, f: Callable[[Column], Column], least: int | None = None) -> Roll:
    """Any function of the frame's non-null values, given as an array column (oldest first)."""
    need = n if least is None else least

    def build(w: SeriesWindow) -> Column:
        values = w.agg(F.collect_list(col(x)), 1 - n)
        return F.when(F.size(values) >= need, f(values))

    return Roll(build, back=n - 1)


def hurst_stages(x: str, n: int, name: str) -> list[dict[str, Roll]]:
    """Rescaled-range exponent ln(R/S)/ln(n) as ``name``; 0.5 for short or flat frames.

    With e[k] the sum of x before the frame's k-th row and m the frame mean, the cumulative
    deviations are e[k] - e[0] - k m. They are spelled out, because element access compiles to
    plain arithmetic while a lambda over the array is interpreted per element.
    """
    total, sums = f"_sum_{x}", f"_sums_{name}"

    def before(w: SeriesWindow) -> Column:
        return F.coalesce(F.sum(x).over(w.spec.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))

    def build(w: SeriesWindow) -> Column:
        dev = w.agg(F.stddev_pop(F.col(x)), 1 - n)
        value = F.ln(safe_div(F.col(spread), dev)) / math.log(n)
        flat = F.lit(n < 10) | (dev == 0) | (F.col(spread) == 0)
        return F.when(w.agg(F.count(F.col(x)), 1 - n) >= n, F.when(flat, F.lit(0.5)).otherwise(value))

    first, mean, path, spread = (f"_{k}_{name}" for k in ("first", "mean", "path", "spread"))
    frame = Roll(lambda w: w.agg(F.collect_list(F.col(total)), 1 - n), back=n - 1)
    e0 = F.get(F.col(sums), 0)
    steps = [F.get(F.col(sums), k) - F.col(first) - F.col(mean) * k for k in range(1, n)]
    return [
        {total: Roll(before)},
        {sums: frame},
        {first: e0, mean: (F.get(F.col(sums), n - 1) + F.col(x) - e0) / n},
        {path: F.array(F.lit(0.0), *steps)},
        {spread: F.array_max(path) - F.array_min(path)},
        {name: Roll(build, back=n - 1)},
    ]


def merged(*runs: list[dict]) -> list[dict]:
    """Several stage lists side by side: stage i of the result holds stage i of each."""
    out: list[dict] = [{} for _ in range(max(len(r) for r in runs))]
    for r in runs:
        for i, stage in enumerate(r):
            out[i] |= stage
    return out


def roll_pct_rank(x, n: int) -> Roll:
    """Share of the n-1 rows before that are strictly below the current value.

    Needs two non-null values in the frame; the share is of all earlier rows in the frame,
    nulls included, and a null current value gives 0.
    """

    def build(w: SeriesWindow) -> Column:
        below = F.size(F.filter(w.agg(F.collect_list(col(x)), 1 - n, -1), lambda v: v < col(x)))
        rows = w.agg(F.count(F.lit(1)), 1 - n, -1)
        share = F.when(col(x).isNull(), F.lit(0.0)).otherwise(below / rows)
        return F.when((w.agg(F.count(col(x)), 1 - n) >= 2) & (rows > 0), share)

    return Roll(build, back=n - 1)


def run_starts(state: str) -> Roll:
    """True on the first row of a run of equal states; nulls break runs."""

    def build(w: SeriesWindow) -> Column:
        same = w.lag(F.col(state), 1).eqNullSafe(F.col(state))
        return F.col(state).isNotNull() & ~same

    return Roll(build, back=1)
