"""Forward-looking columns. They look ahead on purpose; feature modules must not import this one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barline.functions.mathx import col, safe_div
from barline.grid import Roll, SeriesWindow


def _ahead(x, h: int, agg) -> Roll:
    def build(w: SeriesWindow) -> Column:
        return F.when(w.agg(F.count(col(x)), 1, h) >= h, w.agg(agg(col(x)), 1, h))

    return Roll(build, ahead=h)


def fwd_return(x, h: int) -> Roll:
    """x[+h] / x - 1."""
    return Roll(lambda w: safe_div(w.lag(col(x), -h), x) - 1.0, ahead=h)


def fwd_sum(x, h: int) -> Roll:
    """Sum of the next h values (log returns)."""
    return _ahead(x, h, F.sum)


def fwd_vol(x, h: int, periods: int = 252) -> Roll:
    inner = _ahead(x, h, F.stddev_samp)
    return Roll(lambda w: inner.build(w) * F.sqrt(F.lit(float(periods))), ahead=h)


def fwd_up(high, close, h: int) -> Roll:
    inner = _ahead(high, h, F.max)
    return Roll(lambda w: safe_div(inner.build(w), close) - 1.0, ahead=h)


def fwd_down(low, close, h: int) -> Roll:
    inner = _ahead(low, h, F.min)
    return Roll(lambda w: safe_div(inner.build(w), close) - 1.0, ahead=h)


def fwd_min_dd(x, h: int = 3) -> Roll:
    """Worst of the next h values against now."""
    return fwd_down(x, x, h)


def first_touch(level: Column, seen: str, time: str, n: int, above: bool = True) -> Roll:
    """Minutes until ``seen`` first reaches ``level`` within the next n rows; null if it never does."""

    def build(w: SeriesWindow) -> Column:
        pairs = w.agg(F.collect_list(F.struct(F.col(time).alias("t"), F.col(seen).alias("v"))), 1, n)
        hits = F.filter(pairs, lambda e: (e.v >= level) if above else (e.v <= level))
        hit = F.try_element_at(hits, F.lit(1))
        return (F.unix_seconds(hit.t) - F.unix_seconds(F.col(time))) / 60.0

    return Roll(build, ahead=n)
