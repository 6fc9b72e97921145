"""Regimes with persistence: hidden states over whole series, in chunks, by associative scans.

Each row is a step matrix over the states (transition times density). Products of these matrices
are associative, so a series is cut into chunks: a first pass multiplies each chunk's steps into
one matrix, one row per chunk is chained along its series, and a second pass finishes every row
inside its chunk from the vectors that enter it on both sides. Within a chunk the products are
taken by doubling, not row by row. The same in the (max, +) algebra gives the best path: a row's
best state is the one with the best path through it.

Parameters are estimated by expectation and maximisation; the expected transition counts and the
weighted moments are added up on Spark, and only k * (k + 2 d) sums reach the driver per round.

Defined cases: rows with a missing feature belong to no sequence and are left out; series are
sequences of their own under one model; a state without weight keeps its parameters; variances
have a floor.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.grid import CHUNK, Grid
from barline.session import materialize

FLOOR = 1e-4
ROWS = 16_384


@dataclass(frozen=True)
class Chain:
    """Start, transition matrix, and per state the mean and variance of each feature."""

    start: tuple[float, ...]
    transition: tuple[tuple[float, ...], ...]
    means: tuple[tuple[float, ...], ...]
    variances: tuple[tuple[float, ...], ...]

    @property
    def states(self) -> int:
        return len(self.start)

    def log_density(self, x: np.ndarray) -> np.ndarray:
        mean, var = np.array(self.means), np.array(self.variances)
        return -0.5 * (np.log(2 * np.pi * var)[None] + (x[:, None, :] - mean[None]) ** 2 / var[None]).sum(axis=2)


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.matmul(a, b)
    return out / np.maximum(out.max(axis=(1, 2), keepdims=True), 1e-300)


def _plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, :, None] + b[:, None, :, :]).max(axis=2)


def products(steps: np.ndarray, join, backwards: bool = False) -> np.ndarray:
    """All prefix products of ``steps`` (suffix products with ``backwards``), by doubling."""
    out, width = steps.copy(), 1
    while width < len(out):
        if backwards:
            out[:-width] = join(out[:-width], out[width:])
        else:
            out[width:] = join(out[:-width], out[width:])
        width *= 2
    return out


def _log(x) -> np.ndarray:
    return np.log(np.maximum(np.asarray(x, float), 1e-300))


def _steps(chain: Chain, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled step matrices and their logarithms; the first step has no transition."""
    ll = chain.log_density(x)
    e = np.exp(ll - ll.max(axis=1, keepdims=True))
    a, k = np.array(chain.transition), chain.states
    plain, logs = a[None] * e[:, None, :], _log(a)[None] + ll[:, None, :]
    plain[0], logs[0] = np.diag(e[0]), np.where(np.eye(k, dtype=bool), ll[0], -np.inf)
    return plain, logs


def _features(batch: pa.RecordBatch, d: int) -> Iterator[np.ndarray]:
    lists = batch.column("rows")
    for i in range(batch.num_rows):
        rows = lists[i].values
        yield np.stack([rows.field(f"f{j}").to_numpy(zero_copy_only=False) for j in range(d)], axis=1)


def _summaries(chain: Chain, key: list[str], d: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in _features(batch, d):
                plain, logs = _steps(chain, x)
                while len(plain) > 1:  # one product of all steps, halving their number each time
                    odd = len(plain) % 2
                    tails = plain[len(plain) - odd :], logs[len(logs) - odd :]
                    plain, logs = _times(plain[: len(plain) - odd : 2], plain[1::2]), _plus(logs[: len(logs) - odd : 2], logs[1::2])
                    plain, logs = np.concatenate([plain, tails[0]]), np.concatenate([logs, tails[1]])
                out.append((plain[0].ravel().tolist(), logs[0].ravel().tolist()))
            p, q = zip(*out) if out else ((), ())
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*key, CHUNK)], pa.array(p, kind), pa.array(q, kind)], [*key, CHUNK, "p", "q"])

    return task


SIDES = ["alpha", "before", "beta", "delta", "epsilon"]


def _chained(chain: Chain, key: list[str]):
    """Per chunk of a series: what enters from the left and from the right."""
    a, logs, k = np.array(chain.transition), _log(chain.transition), chain.states
    unit = lambda v: v / v.sum()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, parts in enumerate(batch.column("parts").to_pylist()):
                p = [np.array(r["p"]).reshape(k, k) for r in parts]
                q = [np.array(r["q"]).reshape(k, k) for r in parts]
                alpha, before, delta = [np.array(chain.start)], [np.zeros(k)], [_log(chain.start)]
                for m, s in zip(p[:-1], q[:-1]):
                    before.append(unit(alpha[-1] @ m))
                    alpha.append(unit(before[-1] @ a))
                    best = (delta[-1][:, None] + s).max(axis=0)
                    best = (best[:, None] + logs).max(axis=0)
                    delta.append(best - best.max())
                beta, epsilon = [np.ones(k)], [np.zeros(k)]
                for m, s in zip(p[:0:-1], q[:0:-1]):
                    beta.append(unit(a @ (m @ beta[-1])))
                    best = (s + epsilon[-1][None, :]).max(axis=1)
                    best = (logs + best[None, :]).max(axis=1)
                    epsilon.append(best - best.max())
                same = [pa.array([batch.column(c)[i].as_py()] * len(parts), batch.schema.field(c).type) for c in key]
                columns = [alpha, before, beta[::-1], delta, epsilon[::-1]]
                lists = [pa.array([v.tolist() for v in c], pa.list_(pa.float64())) for c in columns]
                yield pa.RecordBatch.from_arrays([*same, pa.array([r[CHUNK] for r in parts], pa.int64()), *lists], [*key, CHUNK, *SIDES])

    return task


def _finished(chain: Chain, x: np.ndarray, sides: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior and best state of each row of a chunk, and its expected transitions (the one into it included)."""
    plain, logs = _steps(chain, x)
    a = np.array(chain.transition)
    side = {c: np.array(v) for c, v in sides.items()}
    forward = np.einsum("i,nij->nj", side["alpha"], products(plain, _times))
    forward /= forward.sum(axis=1, keepdims=True)
    tail = products(plain, _times, backwards=True)[1:]
    behind = np.concatenate([np.einsum("nij,j->ni", tail, side["beta"]), side["beta"][None]])
    behind /= behind.sum(axis=1, keepdims=True)
    posterior = forward * behind
    posterior /= posterior.sum(axis=1, keepdims=True)
    best = (side["delta"][None, :, None] + products(logs, _plus)).max(axis=1)
    ahead = (products(logs, _plus, backwards=True)[1:] + side["epsilon"][None, None, :]).max(axis=2)
    state = (best + np.concatenate([ahead, side["epsilon"][None]])).argmax(axis=1)
    ll = chain.log_density(x)
    e = np.exp(ll - ll.max(axis=1, keepdims=True)) * behind
    left = np.concatenate([side["before"][None], forward[:-1]])
    moves = left[:, :, None] * a[None] * e[:, None, :]
    total = moves.sum(axis=(1, 2), keepdims=True)
    return posterior, state, np.divide(moves, total, out=np.zeros_like(moves), where=total > 0)


def _sums(chain: Chain, d: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            sides = [batch.column(c).to_pylist() for c in SIDES]
            for i, x in enumerate(_features(batch, d)):
                own = {c: s[i] for c, s in zip(SIDES, sides)}
                posterior, _, moves = _finished(chain, x, own)
                first = posterior[0] if not any(own["before"]) else np.zeros(chain.states)
                parts = [first, moves.sum(axis=0), posterior.sum(axis=0), posterior.T @ x, posterior.T @ (x * x)]
                out.append(np.concatenate([p.ravel() for p in parts]).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64()))], ["sums"])

    return task


def _scored(chain: Chain, key: list[str], time: str, d: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = [batch.column(c).to_pylist() for c in SIDES]
            for i, x in enumerate(_features(batch, d)):
                posterior, state, _ = _finished(chain, x, {c: s[i] for c, s in zip(SIDES, sides)})
                rows = batch.column("rows")[i].values
                same = [pa.array([batch.column(c)[i].as_py()] * len(x), batch.schema.field(c).type) for c in key]
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * chain.states), pa.array(posterior.ravel()))
                yield pa.RecordBatch.from_arrays([*same, rows.field(time), pa.array(state.astype(np.int32)), values], [*key, time, "state", "posterior"])

    return task


def chunked(df: DataFrame, grid: Grid, columns: list[str], chunk_rows: int = ROWS) -> DataFrame:
    """One row per series and chunk with its complete rows in order; written once for all passes."""
    from barline.grid import numbered

    known = df.na.drop("any", subset=columns).select(*grid.key, grid.time, *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(columns)])
    placed = numbered(known, grid, "_n").withColumn(CHUNK, F.expr(f"(_n - 1) DIV {chunk_rows}"))
    item = F.struct(grid.time, *[f"f{i}" for i in range(len(columns))])
    return materialize(placed.groupBy(*grid.key, CHUNK).agg(F.sort_array(F.collect_list(item)).alias("rows")), "chunks")


def _entered(chunks: DataFrame, key: list[str], chain: Chain, d: int) -> DataFrame:
    """The chunks with the vectors that enter them."""
    kinds = {c: chunks.schema[c].dataType for c in (*key, CHUNK)}
    of = lambda names: T.StructType([T.StructField(c, kinds.get(c, T.ArrayType(T.DoubleType()))) for c in names])
    parts = chunks.mapInArrow(_summaries(chain, key, d), of([*key, CHUNK, "p", "q"]))
    series = parts.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(CHUNK, "p", "q"))).alias("parts"))
    return chunks.join(series.mapInArrow(_chained(chain, key), of([*key, CHUNK, *SIDES])), [*key, CHUNK])


def smooth(chunks: DataFrame, grid: Grid, chain: Chain) -> DataFrame:
    """(key, time, state, posterior): the best path and the state probabilities over the whole series."""
    key, d = list(grid.key), len(chain.means[0])
    rows = T.StructType([*[chunks.schema[c] for c in key], chunks.schema["rows"].dataType.elementType[grid.time], T.StructField("state", T.IntegerType()), T.StructField("posterior", T.ArrayType(T.DoubleType()))])
    return _entered(chunks, key, chain, d).mapInArrow(_scored(chain, key, grid.time, d), rows)


def improve(chunks: DataFrame, grid: Grid, chain: Chain) -> Chain:
    """One round of expectation and maximisation."""
    key, d, k = list(grid.key), len(chain.means[0]), chain.states
    sums = _entered(chunks, key, chain, d).mapInArrow(_sums(chain, d), "sums array<double>")
    width = k + k * k + k + 2 * k * d
    row = sums.agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]).first()
    if row[0] is None:
        return chain
    first, moves, weight, x, xx = np.split(np.array(row, float), np.cumsum([k, k * k, k, k * d]))
    moves, x, xx = moves.reshape(k, k), x.reshape(k, d), xx.reshape(k, d)
    start = first / first.sum()
    leaving = moves.sum(axis=1, keepdims=True)
    transition = np.where(leaving > 0, moves / np.maximum(leaving, 1e-300), chain.transition)
    held = weight[:, None] > 1e-9
    means = np.where(held, x / np.maximum(weight[:, None], 1e-300), chain.means)
    variances = np.where(held, np.maximum(xx / np.maximum(weight[:, None], 1e-300) - means**2, FLOOR), chain.variances)
    rows = lambda m: tuple(tuple(map(float, r)) for r in m)
    return Chain(tuple(map(float, start)), rows(transition), rows(means), rows(variances))


def fit(chunks: DataFrame, grid: Grid, chain: Chain, rounds: int = 20, tolerance: float = 1e-4) -> tuple[Chain, int]:
    """The chain after at most ``rounds`` rounds, and how many it took until no parameter moved by more than ``tolerance``."""
    flat = lambda c: np.concatenate([np.ravel(v) for v in (c.transition, c.means, c.variances)])
    for n in range(1, rounds + 1):
        better = improve(chunks, grid, chain)
        moved = np.abs(flat(better) - flat(chain)).max()
        chain = better
        if moved < tolerance:
            break
    return chain, n


def initial(df: DataFrame, columns: list[str], states: int = 2, stay: float = 0.9, seed: int = 42) -> Chain:
    """A first guess from a Gaussian mixture of the single rows."""
    from pyspark.ml.clustering import GaussianMixture

    from barline.modelling.regimes import VECTOR, assembled

    model = GaussianMixture(featuresCol=VECTOR, k=states, seed=seed, maxIter=50).fit(assembled(df.na.drop("any", subset=columns), columns))
    away = (1.0 - stay) / max(1, states - 1)
    moves = tuple(tuple(stay if i == j else away for j in range(states)) for i in range(states))
    variances = tuple(tuple(max(float(g.cov.toArray()[i][i]), FLOOR) for i in range(len(columns))) for g in model.gaussians)
    means = tuple(tuple(float(v) for v in g.mean) for g in model.gaussians)
    return Chain(tuple(1.0 / states for _ in range(states)), moves, means, variances)


def sorted_by(chain: Chain, feature: int) -> Chain:
    """The same chain with its states in the order of their mean of one feature."""
    order = sorted(range(chain.states), key=lambda s: (chain.means[s][feature], s))
    pick = lambda v: tuple(v[s] for s in order)
    return Chain(pick(chain.start), tuple(pick(chain.transition[s]) for s in order), pick(chain.means), pick(chain.variances))
