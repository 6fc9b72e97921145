"""Boosted trees of many models at once, grown from histograms.

Features are cut into bins once; a block of rows then holds one byte per row and feature. All
models (feature sets, splits, horizons, states) grow their next tree together: each level is one
job, in which every block adds up gradients and second derivatives per (model, node, feature,
bin), the sums meet on the executors, and only the chosen splits reach the driver. What it holds
follows from models, trees and depth, not from rows.

Gradients are rounded to fixed point before they are added, so the trees do not depend on the
order in which blocks arrive, and a retried task gives the same tree. Predictions so far stay
with the blocks and are written to the shared folder every ``CHECKPOINT`` trees.

Defined cases: rows without a model's label or with a missing feature do not train it and get no
score from it; NaN counts as missing; a model without rows, or with one class only, has no splits
and scores its mean; rows of another group are not scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.session import materialize, shared_dir

MISSING, ALL = 255, 254
FIXED = float(1 << 24)
CHECKPOINT = 25


@dataclass(frozen=True)
class Model:
    """What to learn: ``label`` from ``features``, on the rows whose group column has the value ``group``."""

    name: str
    features: tuple[str, ...]
    label: str
    group: str | None = None
    weight: str | None = None
    squared: bool = False


@dataclass(frozen=True)
class Growth:
    trees: int = 300
    depth: int = 4
    rate: float = 0.03
    subsample: float = 0.8
    bins: int = 64
    l2: float = 1.0
    min_child: float = 1.0
    seed: int = 42


@dataclass
class Fitted:
    """Trees as full binary ones: per inner node a feature and a threshold, per leaf a value."""

    model: Model
    base: float
    feature: list[np.ndarray] = field(default_factory=list)
    threshold: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)
    gain: np.ndarray | None = None

    @property
    def importances(self) -> dict[str, float]:
        """Share of each feature in the gain of all splits."""
        total = float(self.gain.sum())
        return {f: float(g) / total if total else 0.0 for f, g in zip(self.model.features, self.gain)}

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Predictions for columns of features, one row per feature of the model."""
        at, out = np.arange(x.shape[1]), np.full(x.shape[1], self.base)
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(at), np.int64)
            while node.size and node[0] < len(feature):
                node = 2 * node + 1 + (x[feature[node], at] > threshold[node])
            out += value[node - len(feature)] if node.size else 0.0
        return out if self.model.squared else 1.0 / (1.0 + np.exp(-out))


def _columns(models: list[Model]) -> tuple[list[str], list[str], list[str]]:
    pick = lambda get: sorted({c for m in models for c in get(m) if c})
    return pick(lambda m: m.features), pick(lambda m: [m.label]), pick(lambda m: [m.weight])


def _number(c: str):
    x = F.col(c).cast("double")
    return F.when(~F.isnan(x), x).alias(c)


def cut_points(rows: DataFrame, features: list[str], group: str | None, bins: int) -> dict:
    """Per group value, each feature's increasing cut points: at most ``bins - 1`` quantiles."""
    probs = [i / bins for i in range(1, bins)]
    at = F.col(group).cast("string") if group else F.lit(None).cast("string")
    found = rows.groupBy(at.alias("_g")).agg(*[F.percentile_approx(_number(f), probs, 10_000).alias(f"_{i}") for i, f in enumerate(features)])
    return {r["_g"]: {f: np.unique(np.array(r[f"_{i}"] or [], float)) for i, f in enumerate(features)} for r in found.collect()}


def _blocks(models: list[Model], edges: dict):
    features, labels, weights = _columns(models)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(float)
            group = np.array(batch.column("_g").to_pylist(), object)
            x = np.full((len(features), batch.num_rows), MISSING, np.uint8)
            for i, f in enumerate(features):
                v = column(f"x_{f}")
                for g in set(group.tolist()):
                    own = np.flatnonzero((group == g) & ~np.isnan(v))
                    x[i, own] = np.searchsorted(edges[g][f], v[own])
            parts = []
            for m in models:
                y = column(f"y_{m.label}")
                mine = (group == m.group) & ~np.isnan(y) & (x[[features.index(f) for f in m.features]] != MISSING).all(axis=0)
                at = np.flatnonzero(mine)
                w = column(f"w_{m.weight}")[at] if m.weight else np.ones(len(at))
                parts.append((at.astype(np.int32).tobytes(), y[at].tobytes(), np.nan_to_num(w).tobytes()))
            where, y, w = zip(*parts)
            kinds = [pa.int32(), pa.binary(), *[pa.list_(pa.binary())] * 3]
            row = [batch.num_rows, x.tobytes(), list(where), list(y), list(w)]
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["n", "x", "rows", "y", "w"])

    return task


def _open(row, features: int) -> tuple:
    """(block, bins, [(rows, label, weight, prediction) per model])."""
    x = np.frombuffer(bytes(row["x"]), np.uint8).reshape(features, row["n"])
    parts = []
    for at, y, w in zip(row["rows"], row["y"], row["w"]):
        at, y, w = (np.frombuffer(bytes(v), k) for v, k in ((at, np.int32), (y, float), (w, float)))
        parts.append((at, y, w, np.zeros(len(at))))
    return int(row["block"]), x, parts


def _leaves(x: np.ndarray, at: np.ndarray, features: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """The node of each row after ``levels`` levels, counted from the first node of that level."""
    node = np.zeros(len(at), np.int64)
    for _ in range(levels):
        node = 2 * node + 1 + (x[features[feature[node]], at] > cut[node])
    return node - ((1 << levels) - 1)


def _moments(squared: bool, y, w, margin) -> tuple[np.ndarray, np.ndarray]:
    if squared:
        return w * (margin - y), w
    p = 1.0 / (1.0 + np.exp(-margin))
    return w * (p - y), w * p * (1.0 - p)


def _histograms(blocks: Iterator[tuple], models, index, scale, growth: Growth, tree: int, level: int, grown) -> Iterator[tuple]:
    sums: dict[int, np.ndarray] = {}
    nodes = 1 << level
    for block, x, parts in blocks:
        picked = np.random.default_rng((growth.seed, tree, block)).random(x.shape[1]) < growth.subsample
        for m, (at, y, w, margin) in enumerate(parts):
            own = picked[at] if growth.subsample < 1 else np.ones(len(at), bool)
            if not own.any():
                continue
            g, h = (np.rint(v * scale[m]) for v in _moments(models[m].squared, y[own], w[own], margin[own]))
            node = _leaves(x, at[own], index[m], *grown[m], level)
            if m not in sums:
                sums[m] = np.zeros((2, nodes, len(index[m]), growth.bins))
            for i, f in enumerate(index[m]):
                slot = node * growth.bins + x[f, at[own]]
                for k, v in enumerate((g, h)):
                    sums[m][k, :, i] += np.bincount(slot, v, nodes * growth.bins).reshape(nodes, growth.bins)
    yield from sums.items()


def _choose(item: tuple, scale, growth: Growth) -> tuple:
    """(model, per node: feature or -1, cut, gain, sums of the node and of its left part)."""
    m, sums = item
    g, h = sums / scale[m]
    left_g, left_h = np.cumsum(g, axis=2), np.cumsum(h, axis=2)
    all_g, all_h = left_g[:, :1, -1:], left_h[:, :1, -1:]
    part = lambda a, b: a * a / (b + growth.l2)
    gain = part(left_g, left_h) + part(all_g - left_g, all_h - left_h) - part(all_g, all_h)
    gain[(left_h < growth.min_child) | (all_h - left_h < growth.min_child)] = 0.0
    flat = gain.reshape(len(gain), -1)
    best = flat.argmax(axis=1)
    rows = np.arange(len(gain))
    f, cut = np.divmod(best, growth.bins)
    f = np.where(flat[rows, best] > 1e-12, f, -1)
    return m, (f, cut, flat[rows, best], all_g[:, 0, 0], all_h[:, 0, 0], left_g[rows, f, cut], left_h[rows, f, cut])


def _advance(block: tuple, index, trees) -> tuple:
    """The block with the last trees added to its predictions."""
    name, x, parts = block
    out = []
    for m, (at, y, w, margin) in enumerate(parts):
        feature, cut, value = trees[m]
        depth = len(value).bit_length() - 1
        out.append((at, y, w, margin + value[_leaves(x, at, index[m], feature, cut, depth)]))
    return name, x, out


def _started(block: tuple, base) -> tuple:
    name, x, parts = block
    return name, x, [(at, y, w, margin + base[m]) for m, (at, y, w, margin) in enumerate(parts)]


def _totals(blocks: Iterator[tuple]) -> Iterator[tuple]:
    for _, _, parts in blocks:
        for m, (at, y, w, _) in enumerate(parts):
            if len(at):
                yield m, (float(w.sum()), float((w * y).sum()), float(np.abs(y).max()), float(w.max()))


def _merge(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], a[1] + b[1], max(a[2], b[2]), max(a[3], b[3])


def _grow(rdd: RDD, models, index, scale, growth: Growth, tree: int) -> list[tuple]:
    """The next tree of every model, as features, cuts, values and gains."""
    inner = (1 << growth.depth) - 1
    grown = [(np.zeros(inner, np.int64), np.full(inner, ALL)) for _ in models]
    sums = [np.zeros((2, 2 * inner + 1)) for _ in models]
    gains = [np.zeros(len(i)) for i in index]
    for level in range(growth.depth):
        job = partial(_histograms, models=models, index=index, scale=scale, growth=growth, tree=tree, level=level, grown=grown)
        merged = rdd.mapPartitions(job)
        if rdd.getNumPartitions() > 1:
            merged = merged.reduceByKey(np.add, min(len(models), rdd.getNumPartitions()))
        first = (1 << level) - 1
        for m, (f, cut, gain, g, h, left_g, left_h) in merged.map(partial(_choose, scale=scale, growth=growth)).collect():
            if level == 0:
                sums[m][:, 0] = g[0], h[0]
            for i in range(len(f)):
                node = first + i
                if f[i] < 0:
                    # All rows go to the left child, which has the node's own value.
                    sums[m][:, 2 * node + 1] = sums[m][:, node]
                    continue
                grown[m][0][node], grown[m][1][node] = f[i], cut[i]
                gains[m][f[i]] += gain[i]
                sums[m][:, 2 * node + 1] = left_g[i], left_h[i]
                sums[m][:, 2 * node + 2] = sums[m][:, node] - sums[m][:, 2 * node + 1]
    values = [-growth.rate * s[0, inner:] / (s[1, inner:] + growth.l2) for s in sums]
    return [(f, c, v, g) for (f, c), v, g in zip(grown, values, gains)]


def fit(rows: DataFrame, models: list[Model], group: str | None = None, growth: Growth = Growth()) -> list[Fitted]:
    """Fit all ``models`` on ``rows``; cut points come from the rows of each model's own group."""
    if not 2 <= growth.bins <= ALL:
        raise ValueError(f"bins must be from 2 to {ALL}")
    spark = rows.sparkSession
    features, labels, weights = _columns(models)
    edges = cut_points(rows, features, group, growth.bins)
    at = F.col(group).cast("string") if group else F.lit(None).cast("string")
    named = [at.alias("_g")] + [_number(c).alias(f"{k}_{c}") for k, cs in (("x", features), ("y", labels), ("w", weights)) for c in cs]
    schema = "n int, x binary, rows array<binary>, y array<binary>, w array<binary>"
    stored = rows.select(*named).mapInArrow(_blocks(models, edges), schema)
    # The number of a block decides its subsample, so it is written with the block.
    stored = materialize(stored.withColumn("block", F.monotonically_increasing_id()), "blocks")
    index = [np.array([features.index(f) for f in m.features]) for m in models]
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark, "trees"))
    rdd = stored.rdd.map(partial(_open, features=len(features)))
    totals = rdd.mapPartitions(_totals).reduceByKey(_merge).collectAsMap()
    base, scale = [], []
    for m, model in enumerate(models):
        w, wy, most, heaviest = totals.get(m, (0.0, 0.0, 0.0, 0.0))
        mean = wy / w if w else (0.0 if model.squared else 0.5)
        base.append(mean if model.squared else float(np.log(max(mean, 1e-6) / max(1 - mean, 1e-6))))
        scale.append(FIXED / max((most + abs(mean) if model.squared else 1.0) * heaviest, 1e-12))
    fitted = [Fitted(m, b, gain=np.zeros(len(m.features))) for m, b in zip(models, base)]
    now = rdd.map(partial(_started, base=base)).persist(StorageLevel.MEMORY_AND_DISK)
    before = None
    for tree in range(growth.trees):
        if tree and tree % CHECKPOINT == 0:
            now.checkpoint()
        made = _grow(now, models, index, scale, growth, tree)
        if before is not None:
            before.unpersist()
        for m, (feature, cut, value, gain) in enumerate(made):
            own = edges.get(models[m].group, {})
            line = lambda i: own[models[m].features[feature[i]]] if own else ()  # noqa: B023, E731
            threshold = [float(line(i)[c]) if c < len(line(i)) else np.inf for i, c in enumerate(cut)]
            fitted[m].feature.append(feature)
            fitted[m].threshold.append(np.array(threshold))
            fitted[m].value.append(value)
            fitted[m].gain += gain
        before, now = now, now.map(partial(_advance, index=index, trees=[t[:3] for t in made])).persist(StorageLevel.MEMORY_AND_DISK)
    for x in (before, now):
        if x is not None:
            x.unpersist()
    return fitted


def score(rows: DataFrame, fitted: list[Fitted], group: str | None = None, name: str = "score") -> DataFrame:
    """One row per row of ``rows`` and model that scores it, with the columns ``model`` and ``name``."""
    features = sorted({f for x in fitted for f in x.model.features})
    shared = rows.sparkSession.sparkContext.broadcast(fitted)
    at = F.col(group).cast("string") if group else F.lit(None).cast("string")
    ready = rows.withColumns({"_g": at} | {f"x_{f}": _number(f) for f in features})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = shared.value
        for batch in batches:
            of = np.array(batch.column("_g").to_pylist(), object)
            x = np.stack([batch.column(f"x_{f}").to_numpy(zero_copy_only=False).astype(float) for f in features]) if batch.num_rows else np.zeros((len(features), 0))
            place, number, value = [], [], []
            for i, m in enumerate(models):
                own = x[[features.index(f) for f in m.model.features]]
                rows = np.flatnonzero((of == m.model.group) & ~np.isnan(own).any(axis=0))
                place.append(rows)
                number.append(np.full(len(rows), i))
                value.append(m.scores(own[:, rows]))
            taken = batch.take(pa.array(np.concatenate(place)))
            columns = [c for c, n in zip(taken.columns, taken.schema.names) if n in kept]
            names = pa.array([models[i].model.name for i in np.concatenate(number)], pa.string())
            yield pa.RecordBatch.from_arrays([*columns, names, pa.array(np.concatenate(value))], [*kept, "model", name])

    kept = list(rows.columns)
    schema = T.StructType([*rows.schema.fields, T.StructField("model", T.StringType()), T.StructField(name, T.DoubleType())])
    return ready.mapInArrow(task, schema)
