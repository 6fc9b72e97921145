"""Permutation tests of long/flat strategies without moving rows.

A run permutes the positions of a series. Which row a place takes its position from is computed,
not sorted or joined:

* ``shuffle``: a keyed bijection of the row numbers (four Feistel rounds on the next power of four,
  walked until the number is a row's). Positions are 0 or 1, so place i is held exactly if its image
  is below the number of held rows; every arrangement of the positions comes from some bijection.
* ``shift``: a circular shift by a drawn offset.
* ``bootstrap``: each place starts a new block with probability 1/``mean_block``; a block copies the
  rows from a drawn row on.

All draws are arithmetic modulo 2^31 - 1 on (row, keys), with keys from the MD5 of (seed, series,
run), so reruns, retried tasks and other engines draw the same. A task takes a chunk of rows and a
block of runs and hands on one row of sums per run. ``shift`` and ``bootstrap`` look positions up in
a bitmap of the series, one bit per row, as long as all bitmaps together stay below
``BITMAP_BYTES``; beyond that the rows of each run are joined with their sources.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.grid import Grid, last_of, numbered, running
from barline.session import materialize

PRIME = (1 << 31) - 1
CHUNK, RUN_BLOCK = 4096, 64
BITMAP_BYTES = 64 << 20
KEY = "_series_key"


def hashed(x, a, b):
    """A number below ``PRIME`` for rows ``x`` under the keys ``a`` and ``b``; for arrays and for columns."""
    t = ((x + a) * b) % PRIME
    t = (t * t + a) % PRIME
    return (t * b + x) % PRIME


def run_keys(seed: int, series: str, runs: range) -> np.ndarray:
    """Four keys from 1 to ``PRIME - 1`` for each run."""
    out = []
    for run in runs:
        h = hashlib.md5(f"{seed}|{series}|{run}".encode()).hexdigest()
        out.append([1 + int(h[8 * j : 8 * j + 8], 16) % (PRIME - 1) for j in range(4)])
    return np.array(out, np.int64).reshape(-1, 4)


def _key_columns(seed: int) -> list[Column]:
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), KEY, F.col("run").cast("string")))
    return [1 + F.conv(F.substring(h, 8 * j + 1, 8), 16, 10).cast("long") % (PRIME - 1) for j in range(4)]


def bijection(x: np.ndarray, keys: np.ndarray, size: int) -> np.ndarray:
    """Per run (row of ``keys``), the images of the row numbers ``x`` under a permutation of range(size)."""
    width = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    mask = (1 << width) - 1

    def step(v: np.ndarray, k: np.ndarray) -> np.ndarray:
        left, right = v >> width, v & mask
        for j in range(4):
            f = hashed(right, k[:, j], k[:, (j + 1) % 4])
            left, right = right, left ^ ((f >> 8) & mask)
        return (left << width) | right

    out = np.repeat(x[None, :], len(keys), axis=0).ravel()
    each = np.repeat(keys, len(x), axis=0)
    at = np.arange(len(out))
    while len(at):
        out[at] = step(out[at], each[at])
        at = at[out[at] >= size]
    return out.reshape(len(keys), len(x))


def _sources(kind: str, x: np.ndarray, keys: np.ndarray, size: int, mean_block: int) -> np.ndarray:
    """Per run, the rows that the consecutive places ``x`` take their positions from."""
    if kind == "shift":
        return (x[None, :] - 1 - keys[:, :1] % max(1, size - 1)) % size
    first, back = int(x[0]), 256
    while True:
        wide = np.arange(max(0, first - back), int(x[-1]) + 1)
        starts = (wide == 0) | (hashed(wide[None, :], keys[:, :1], keys[:, 1:2]) * mean_block < PRIME)
        begin = np.maximum.accumulate(np.where(starts, wide[None, :], -1), axis=1)[:, first - wide[0] :]
        if (begin >= 0).all():
            break
        back *= 4
    drawn = hashed(begin, keys[:, 2:3], keys[:, 3:4]) % size
    return (drawn + x[None, :] - begin) % size


def _positions(kind: str, x: np.ndarray, keys: np.ndarray, size: int, held: int, bits: np.ndarray | None, mean_block: int) -> np.ndarray:
    if kind == "shuffle":
        return bijection(x, keys, size) < held
    at = _sources(kind, x, keys, size, mean_block)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


SUMS = ["n", "s1", "s2", "logs", "negative", "zero", "gains", "losses"]


def net_sums(net: np.ndarray) -> list[np.ndarray]:
    """The sums of net returns, along the last axis, that all statistics follow from."""
    growth = 1.0 + net
    logs = np.log(np.where(growth == 0, 1.0, np.abs(growth))).sum(axis=-1)
    n = np.full(net.shape[:-1], float(net.shape[-1]))
    return [n, net.sum(-1), (net * net).sum(-1), logs, (growth < 0).sum(-1).astype(float), (growth == 0).sum(-1).astype(float), np.maximum(net, 0).sum(-1), -np.minimum(net, 0).sum(-1)]


def _task(kind: str, seed: int, cost: float, mean_block: int, bitmaps):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                size, first, ret = r["size"], r["first"], np.array(r["ret"], float)
                keys = run_keys(seed, r[KEY], range(r["run"], min(r["run"] + RUN_BLOCK, r["until"])))
                # The place before the chunk tells whether its first row changes the position.
                x = np.arange(max(0, first - 1), first + len(ret))
                bits = np.frombuffer(bitmaps.value[r[KEY]], np.uint8) if kind != "shuffle" else None
                held = _positions(kind, x, keys, size, r["held"], bits, mean_block).astype(float)
                if first == 0:
                    held = np.concatenate([np.zeros((len(keys), 1)), held], axis=1)
                net = held[:, 1:] * ret - cost * np.abs(np.diff(held, axis=1))
                columns = [pa.array([r[KEY]] * len(keys)), pa.array(np.arange(r["run"], r["run"] + len(keys)))]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(v) for v in net_sums(net)]], [KEY, "run", *SUMS])

    return task


def _pack_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = [np.packbits(np.array(h, bool), bitorder="little").tobytes() for h in batch.column("on").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(KEY), batch.column("first"), pa.array(bits, pa.binary())], [KEY, "first", "bits"])


def ordered(df: DataFrame, grid: Grid, signal: str, ret: str) -> DataFrame:
    """The rows with a signal and a return, numbered from 0 in each series: (key, ``_row``, held, ret)."""
    rows = numbered(df.filter(F.col(ret).isNotNull() & F.col(signal).isNotNull()), grid, "_n")
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in grid.key])
    return rows.select(*grid.key, key.alias(KEY), (F.col("_n") - 1).alias("_row"), (F.col(signal) == 1).alias("held"), F.col(ret).cast("double").alias("ret"))


def permuted_sums(
    rows: DataFrame, kind: str, n: int, seed: int = 42, cost: float = 0.0012, mean_block: int = 21, bitmap_bytes: int = BITMAP_BYTES
) -> DataFrame:
    """(series key, run, sums) for the runs from 1 to ``n`` over the rows of ``ordered``."""
    size = rows.groupBy(KEY).agg(F.count("*").alias("size"), F.count_if("held").alias("held"))
    item = F.struct("_row", F.col("held").alias("on"), "ret")
    chunks = rows.groupBy(KEY, F.expr(f"_row DIV {CHUNK} * {CHUNK}").alias("first")).agg(F.sort_array(F.collect_list(item)).alias("rows"))
    shared = None
    if kind != "shuffle":
        bytes_ = rows.count() / 8 + CHUNK * size.count()
        if bytes_ > bitmap_bytes:
            return _joined_sums(rows, size, kind, n, seed, cost, mean_block)
        parts = chunks.select(KEY, "first", F.col("rows.on").alias("on")).mapInArrow(_pack_bits, f"{KEY} string, first long, bits binary")
        bitmaps: dict[str, bytes] = {}
        for r in parts.orderBy(KEY, "first").collect():
            bitmaps[r[KEY]] = bitmaps.get(r[KEY], b"") + bytes(r["bits"])
        shared = rows.sparkSession.sparkContext.broadcast(bitmaps)
    work = chunks.join(size, KEY).select(
        KEY, "size", "held", "first", F.col("rows.ret").alias("ret"), F.lit(n + 1).alias("until"), F.explode(F.sequence(F.lit(1), F.lit(n), F.lit(RUN_BLOCK))).alias("run")
    )
    dealt = work.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, 1))
    schema = f"{KEY} string, run long, " + ", ".join(f"{c} double" for c in SUMS)
    return dealt.mapInArrow(_task(kind, seed, cost, mean_block, shared), schema).groupBy(KEY, "run").agg(*[F.sum(c).alias(c) for c in SUMS])


def _joined_sums(rows: DataFrame, size: DataFrame, kind: str, n: int, seed: int, cost: float, mean_block: int) -> DataFrame:
    """The same sums for series too long for bitmaps: the rows of each run joined with their sources."""
    runs = rows.join(size.select(KEY, "size"), KEY).withColumn("run", F.explode(F.sequence(F.lit(1), F.lit(n)).cast("array<long>")))
    k, i = _key_columns(seed), F.col("_row")
    order = Grid(key=(KEY, "run"), time="_t", step=1)
    runs = runs.withColumn("_t", F.timestamp_seconds(i))
    if kind == "shift":
        source = F.pmod(i - 1 - k[0] % F.greatest(F.lit(1), F.col("size") - 1), F.col("size"))
    else:
        starts = (i == 0) | (hashed(i, k[0], k[1]) * mean_block < PRIME)
        moved = F.when(starts, hashed(i, k[2], k[3]) % F.col("size") - i)
        runs = running(runs.withColumn("_moved", moved), order, {"_shift": last_of("_moved")})
        source = F.pmod(i + F.col("_shift"), F.col("size"))
    taken = rows.select(KEY, F.col("_row").alias("_from"), F.col("held").cast("double").alias("on"))
    placed = runs.withColumn("_from", source).join(taken, [KEY, "_from"])
    return frame_sums(placed, order, [KEY, "run"], cost)


def frame_sums(rows: DataFrame, order: Grid, by: list[str], cost: float) -> DataFrame:
    """``SUMS`` per group of rows with a position ``on`` (0 or 1) and a return ``ret``."""
    from barline.grid import over_series
    from barline.operators.rolling import lagged

    rows = over_series(rows, order, {"_before": lagged("on", 1)})
    net = F.col("on") * F.col("ret") - cost * F.abs(F.col("on") - F.coalesce("_before", F.lit(0.0)))
    growth, rows = 1 + F.col("_net"), rows.withColumn("_net", net)
    return rows.groupBy(*by).agg(
        F.count("*").cast("double").alias("n"),
        F.sum("_net").alias("s1"),
        F.sum(F.col("_net") * F.col("_net")).alias("s2"),
        F.sum(F.ln(F.when(growth == 0, 1.0).otherwise(F.abs(growth)))).alias("logs"),
        F.count_if(growth < 0).cast("double").alias("negative"),
        F.count_if(growth == 0).cast("double").alias("zero"),
        F.sum(F.greatest("_net", F.lit(0.0))).alias("gains"),
        F.sum(-F.least("_net", F.lit(0.0))).alias("losses"),
    )


def statistics(periods: int) -> dict[str, Column]:
    """Sharpe ratio, yearly growth and profit factor from ``SUMS``; null where they do not exist."""
    mean = F.col("s1") / F.col("n")
    deviation = F.sqrt(F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(0.0)))
    grown = F.exp(F.col("logs") * periods / F.col("n")) - 1.0
    return {
        "sharpe": mean / (deviation + 1e-10) * F.sqrt(F.lit(float(periods))),
        "cagr": F.when(F.col("zero") > 0, -1.0).when(F.col("negative") % 2 == 0, grown),
        "profit_factor": F.try_divide("gains", "losses"),
    }


STATISTICS = ["sharpe", "cagr", "profit_factor"]


def permutation_test(
    df: DataFrame, grid: Grid, signal: str, ret: str, kind: str, n: int, seed: int = 42, periods: int = 252, cost: float = 0.0012,
    mean_block: int = 21, bitmap_bytes: int = BITMAP_BYTES,
) -> DataFrame:
    """Per series and statistic, where the real long/flat strategy stands among ``n`` permuted ones.

    The position is 1 where the signal is 1, else 0; every change of position costs ``cost``. A
    permuted statistic that does not exist counts as 0. ``p`` is the share at or above the real
    one, ``outlier_share`` the share at or above 1.5 times a positive real one, null otherwise; a
    billionth below counts as at it, since equal arrangements are summed in different orders.
    """
    if kind not in ("shuffle", "shift", "bootstrap"):
        raise ValueError(f"unknown kind {kind}")
    key = list(grid.key)
    rows = materialize(ordered(df, grid, signal, ret), "ordered")
    order = replace(grid, key=(KEY,), time="_t", step=1, tie=(), cuts=())
    real = frame_sums(rows.withColumns({"_t": F.timestamp_seconds("_row"), "on": F.col("held").cast("double")}), order, [KEY], cost)
    named = lambda sums: sums.withColumns(statistics(periods))
    real = named(real).unpivot([KEY], STATISTICS, "statistic", "real")
    drawn = named(permuted_sums(rows, kind, n, seed, cost, mean_block, bitmap_bytes)).unpivot([KEY, "run"], STATISTICS, "statistic", "value")
    drawn = drawn.select(KEY, "statistic", F.coalesce("value", F.lit(0.0)).alias("value")).join(real, [KEY, "statistic"])
    reaches = lambda x: F.col("value") >= x - F.abs(F.col("real")) * 1e-9
    beats = F.coalesce(reaches(F.col("real")), F.lit(False))
    out = drawn.groupBy(KEY, "statistic", "real").agg(
        F.count(F.lit(1)).alias("runs"),
        F.avg("value").alias("mean"),
        F.stddev_pop("value").alias("std"),
        F.avg(beats.cast("double")).alias("p"),
        F.avg(F.when(F.col("real") > 0, reaches(F.col("real") * 1.5).cast("double"))).alias("outlier_share"),
    )
    z = (F.col("real") - F.col("mean")) / (F.col("std") + 1e-10)
    out = out.withColumns({"z": z, "significant": (F.col("p") < 0.05).cast("int"), "outlier": F.coalesce((F.col("outlier_share") > 0).cast("int"), F.lit(0))})
    return rows.select(*key, KEY).distinct().join(out, KEY).drop(KEY)
