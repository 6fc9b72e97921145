"""Exponential means over long series, exact at any span and with nulls.

The recurrence is affine: a chunk of a series turns the value that enters it into the one that
leaves it by one factor and one offset. A first pass gives one such row per chunk, these are
chained per series, and a second pass runs each chunk from the value that enters it. The
second pass streams over sorted rows and holds no chunk.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.functions.mathx import safe_div
from barline.grid import CHUNK, Grid

AT = "_row_of_chunk"


def _mean(x: np.ndarray, span: int) -> np.ndarray:
    return pd.Series(x).ewm(span=span, adjust=False).mean().to_numpy()


def _advance(x: np.ndarray, span: int, value: float, gap: int) -> tuple[np.ndarray, float, int]:
    """Means of rows that follow ``value`` after ``gap`` missing rows, and the state they leave."""
    if np.isnan(value):
        out = _mean(x, span)
    else:
        # Beyond this many missing rows the weight of the old value is 0 in double precision.
        missing = np.full(min(int(gap), 400 * (span + 1)), np.nan)
        out = _mean(np.concatenate([[value], missing, x]), span)[1 + len(missing) :]
    known = np.flatnonzero(~np.isnan(x))
    return out, float(out[-1]), len(x) - 1 - int(known[-1]) if len(known) else int(gap) + len(x)


def _summary(span: int):
    """Of one chunk: its first value, rows before it, mean at the end, factor, rows after the last value."""
    a = 2.0 / (span + 1.0)

    def of_chunk(at: pd.Series, x: pd.Series) -> list:
        x = x.to_numpy(np.float64)[np.argsort(at.to_numpy())]
        known = np.flatnonzero(~np.isnan(x))
        if not len(known):
            return [np.nan, float(len(x)), np.nan, 1.0, float(len(x))]
        old = (1.0 - a) ** np.diff(known)
        end = _mean(x[known[0] :], span)[-1]
        return [x[known[0]], float(known[0]), end, float(np.prod(old / (old + a))), float(len(x) - 1 - known[-1])]

    return F.pandas_udf(of_chunk, "array<double>", F.PandasUDFType.GROUPED_AGG)


def _chain(span: int):
    """The value and gap that enter each chunk of a series, flattened in the order of chunks."""
    a = 2.0 / (span + 1.0)

    def of_series(chunk: pd.Series, parts: pd.Series) -> list:
        value, gap, out = np.nan, 0.0, []
        for i in np.argsort(chunk.to_numpy()):
            first, lead, end, factor, trail = parts.iloc[i]
            out += [value, gap]
            if np.isnan(first):
                gap += lead
                continue
            if np.isnan(value):
                value = end
            else:
                old = (1.0 - a) ** (gap + lead + 1)
                value = end + factor * ((old * value + a * first) / (old + a) - first)
            gap = trail
        return out

    return F.pandas_udf(of_series, "array<double>", F.PandasUDFType.GROUPED_AGG)


def _order():
    return F.pandas_udf(lambda chunk: sorted(chunk.tolist()), "array<bigint>", F.PandasUDFType.GROUPED_AGG)


def _run(spans: list[int]):
    n = len(spans)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = [(np.nan, 0)] * n
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.column(AT).to_numpy(zero_copy_only=False)
            edges = np.unique(np.concatenate([[0, len(at)], np.flatnonzero(at == 1)]))
            new = []
            for i, span in enumerate(spans):
                x, value, gap = (batch.column(f"_{k}{i}").to_numpy(zero_copy_only=False).astype(np.float64) for k in "xvg")
                y = np.empty(len(at))
                for lo, hi in pairwise(edges):
                    entering = (value[lo], gap[lo]) if at[lo] == 1 else state[i]
                    y[lo:hi], *left = _advance(x[lo:hi], span, *entering)
                    state[i] = tuple(left)
                new.append(pa.array(y, from_pandas=True))
            kept = batch.num_columns - 1 - 3 * n
            names = batch.schema.names[:kept] + [f"_y{i}" for i in range(n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:kept], *new], names)

    return task


def ewm(df: DataFrame, grid: Grid, means: dict[str, tuple[Column | str, int]], keep_chunk: bool = False) -> DataFrame:
    """Add exponential means ``{name: (column, span)}`` with weight a = 2/(span+1).

    The first known value starts the mean. A missing row keeps the mean and ages it: after k
    missing rows the old mean weighs (1-a)^(k+1) against a. NaN and infinite values count as missing.
    """
    keys = list(grid.key)
    if CHUNK not in df.columns:
        df = grid.with_chunk(df)
    columns, spans = df.columns, [s for _, s in means.values()]
    within = Window.partitionBy(*keys, CHUNK).orderBy(*grid.order)
    inputs = {f"_x{i}": (F.col(x) if isinstance(x, str) else x).cast("double") for i, (x, _) in enumerate(means.values())}
    inputs = {k: F.when(F.abs(x) < float("inf"), x) for k, x in inputs.items()}
    rows = df.withColumns(inputs).withColumn(AT, F.row_number().over(within))
    parts = rows.groupBy(*keys, CHUNK).agg(*[_summary(s)(F.col(AT), F.col(f"_x{i}")).alias(f"_p{i}") for i, s in enumerate(spans)])
    chained = parts.groupBy(*keys).agg(
        _order()(F.col(CHUNK)).alias("_chunks"), *[_chain(s)(F.col(CHUNK), F.col(f"_p{i}")).alias(f"_c{i}") for i, s in enumerate(spans)]
    )
    carried = chained.select(*keys, F.posexplode("_chunks").alias("_i", CHUNK), *[f"_c{i}" for i in range(len(spans))])
    entering = {f"_{k}{i}": F.get(F.col(f"_c{i}"), 2 * F.col("_i") + j) for i in range(len(spans)) for j, k in enumerate("vg")}
    carried = carried.select(*keys, CHUNK, *[c.alias(n) for n, c in entering.items()])
    wide = rows.join(carried, [*keys, CHUNK]).select(*columns, AT, *inputs, *entering)
    wide = wide.repartition(*keys, CHUNK).sortWithinPartitions(*keys, CHUNK, AT)
    schema = T.StructType([*df.schema.fields, *[T.StructField(f"_y{i}", T.DoubleType()) for i in range(len(spans))]])
    out = wide.mapInArrow(_run(spans), schema).drop(*means).withColumnsRenamed({f"_y{i}": name for i, name in enumerate(means)})
    return out if keep_chunk else out.drop(CHUNK)


def macd(df: DataFrame, grid: Grid, x: str, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    """MACD histogram over the price ``x``; also gives ``ema_fast`` and ``ema_slow``."""
    out = ewm(df, grid, {"ema_fast": (x, fast), "ema_slow": (x, slow)}, keep_chunk=True)
    gap = F.col("ema_fast") - F.col("ema_slow")
    out = ewm(out, grid, {"_signal": (gap, signal)})
    return out.withColumn("macd_hist_norm", safe_div(gap - F.col("_signal"), x)).drop("_signal")
