"""Rolling application of a user's Python function."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.grid import CHUNK, HOME, Grid, with_halo


def rolling_pandas(
    df: DataFrame,
    grid: Grid,
    x: str,
    n: int,
    fn: Callable[[np.ndarray], float],
    name: str,
    least: int | None = None,
) -> DataFrame:
    """``rolling(n).apply(fn)`` per series; runs per chunk, so no group is a whole long series."""
    need = n if least is None else least
    lent = with_halo(df, grid, back=n - 1, ahead=0)
    schema = T.StructType([*lent.schema.fields, T.StructField(name, T.DoubleType())])
    order = grid.order

    def apply(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        pdf[name] = pdf[x].astype("float64").rolling(n, min_periods=need).apply(fn, raw=True)
        return pdf

    out = lent.groupBy(*grid.key, CHUNK).applyInPandas(apply, schema)
    out = out.filter(F.col(CHUNK) == F.col(HOME)).drop(CHUNK, HOME)
    return out.withColumn(name, F.when(~F.isnan(name), F.col(name)))
