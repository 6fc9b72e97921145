"""Null-safe arithmetic, row-wise helpers and tail probabilities."""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def col(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_div(a: str | Column, b: str | Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def clip(x: str | Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Bounded value; null stays null."""
    x = col(x)
    out = x
    if lo is not None:
        out = F.when(out < lo, F.lit(lo)).otherwise(out)
    if hi is not None:
        out = F.when(out > hi, F.lit(hi)).otherwise(out)
    return out


def flag(condition: Column) -> Column:
    """1.0 / 0.0, with an unknown comparison counted as 0.0."""
    return F.coalesce(condition.cast("double"), F.lit(0.0))


def corr_of(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate, null where a side is constant (plain corr raises there)."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def exact_sum(x: str | Column) -> Column:
    """Sum of doubles as an aggregate, exact and rounded once, so that it does not depend on the order of the rows.

    Holds if all values have at most ten decimals and lie below 1e18; any other group gets the plain float sum.
    """
    x = col(x)
    tens = x.try_cast("decimal(28,10)")
    kept = F.when(tens.cast("double") == x, tens)
    return F.when(F.count(kept) == F.count(x), F.sum(kept).cast("double")).otherwise(F.sum(x))


def no_nan(x: str | Column) -> Column:
    x = col(x)
    return F.when(~F.isnan(x), x)


def row_sum(columns: list[str], need_any: bool = False) -> Column:
    """Row total with nulls as 0; ``need_any`` gives null when every column is null."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in columns])
    if not need_any:
        return total
    return F.when(any_of([F.col(c).isNotNull() for c in columns]), total)


def row_max(columns: list[str]) -> Column:
    return F.greatest(*columns) if len(columns) > 1 else F.col(columns[0])


def any_null(columns: list[str]) -> Column:
    return any_of([F.col(c).isNull() for c in columns])


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def entropy2(p_up: str | Column, p_down: str | Column, eps: float = 1e-10) -> Column:
    """Entropy in bits of two state probabilities, each clipped away from 0 and 1."""
    a, b = clip(p_up, eps, 1 - eps), clip(p_down, eps, 1 - eps)
    return -(a * F.log2(a) + b * F.log2(b))


def entropy_n(probabilities: list[str | Column], eps: float = 1e-9) -> Column:
    """Entropy in bits over any number of states."""
    terms = [col(p) * F.log2(col(p) + F.lit(eps)) for p in probabilities]
    return -reduce(lambda a, b: a + b, terms)


# ---- tail probabilities: applied to the few rows left after aggregation -----------------------


def _inc_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _inc_beta(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1.0 + num * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + num / (c if abs(c) > tiny else tiny)
        f *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * (f - 1.0)


def t_tail(t: float, df: float) -> float:
    """Two-sided Student tail."""
    if t != t or df != df or df <= 0:
        return float("nan")
    return 1.0 if t == 0 else _inc_beta(df / 2.0, 0.5, df / (df + t * t))


def f_tail(f: float, d1: float, d2: float) -> float:
    """Upper tail of the F distribution."""
    if f != f or d1 != d1 or d2 != d2 or d2 <= 0:
        return float("nan")
    return 1.0 if f <= 0 else _inc_beta(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


@F.pandas_udf(DoubleType())
def _p_t(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_tail(float(a), float(b)) for a, b in zip(t, df)])


@F.pandas_udf(DoubleType())
def _p_f(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([f_tail(float(a), float(b), float(c)) for a, b, c in zip(f, d1, d2)])


@F.pandas_udf(DoubleType())
def _p_norm(z: pd.Series) -> pd.Series:
    return pd.Series([math.erfc(abs(float(v)) / math.sqrt(2.0)) if v == v else float("nan") for v in z])


def p_t(t: str | Column, df: str | Column) -> Column:
    return no_nan(_p_t(col(t).cast("double"), col(df).cast("double")))


def p_f(f: str | Column, d1: str | Column, d2: str | Column) -> Column:
    return no_nan(_p_f(col(f).cast("double"), col(d1).cast("double"), col(d2).cast("double")))


def p_norm(z: str | Column) -> Column:
    return no_nan(_p_norm(col(z).cast("double")))
