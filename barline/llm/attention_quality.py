"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded from its text
alone (shares of kinds of characters and words, repetition, hashed words); a small layer turns
the encoding into a representation, gated attention gives every passage a weight within its
document, and the weighted sum is scored. Only document labels are needed. The weights are
learnt on at most ``MAX_DOCS`` labelled documents (a documented bound; the rows with the
smallest hash of their id are taken); every passage of every document is scored on the workers.

Defined cases: a null or empty text is a bag with one empty passage; a null ``doc_id`` is never
learnt from and is not held out; repeated rows get equal scores; without labels of both kinds
the score is the share of label 1, or 0.5 without any; an empty table gives no rows. Columns
other than ``doc_id`` and ``text`` are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.textops import BEYOND, DIGITS, LEADING, LOWER, UPPER, Words, byte_class, documents, slices, take, tidy

PASSAGE = 64
BUCKETS = 16
MAX_DOCS = 6000
FOLDS = 5
THRESHOLD = 0.3
HIDDEN, GATE = 24, 12
#: Kinds of characters counted inside words.
COUNTED = (UPPER, LOWER, DIGITS, BEYOND & LEADING, *map(byte_class, ("#*$%&<>", "|", ".!?", ",;:", "@/", "()[]{}'\"")))
KINDS = len(COUNTED) + 2
FEATURES = KINDS + 6 + BUCKETS


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Rows that labels are never learnt from: crc32 of the id as text divisible by ``FOLDS``."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Encodings of all passages (rows) and where each text's passages start."""
    words = Words(texts)
    n = np.diff(words.starts)
    bags = np.maximum(1, -(-n // PASSAGE))
    first = np.concatenate([[0], np.cumsum(bags)])
    x = np.zeros((first[-1], FEATURES), np.float32)
    if len(words.codes):
        rank = np.arange(len(words.codes)) - np.repeat(words.starts[:-1], n)
        passage = np.repeat(first[:-1], n) + rank // PASSAGE
        begin = np.flatnonzero(rank % PASSAGE == 0)
        rows = passage[begin]
        size = np.diff(np.append(begin, len(rank))).astype(np.float32)
        data, edges = words.bytes()
        capital = UPPER[data[edges[:-1]]]
        counts = [words.count(c) for c in COUNTED]
        kinds = np.stack([*counts, capital & (counts[0] == 1), counts[0] > 1, words.count(LEADING)], 1).astype(np.float32)
        sums = np.add.reduceat(kinds[words.codes], begin, axis=0)
        x[rows, :KINDS] = np.minimum(sums[:, :-1] / size[:, None], 6)
        again = np.concatenate([[False], words.codes[1:] == words.codes[:-1]]) & (rank % PASSAGE > 0)
        key = np.sort(passage * len(words.distinct) + words.codes)
        new = np.concatenate([[True], key[1:] != key[:-1]])
        distinct = np.bincount(key[new] // len(words.distinct), minlength=len(x))[rows]
        more = x[:, KINDS:]
        more[rows, 0] = np.minimum(sums[:, -1] / size, 20) / 5
        more[rows, 1] = np.add.reduceat(again.astype(np.float32), begin) / size
        more[rows, 2] = distinct / size
        more[rows, 3] = size / PASSAGE
        more[:, 4] = np.repeat(np.log1p(np.minimum(n, PASSAGE)) / 4, bags)
        more[:, 5] = np.repeat(n > 0, bags)
        bucket = (words.hashes() % np.uint64(BUCKETS)).astype(np.int64)[words.codes]
        counts = np.bincount(passage * BUCKETS + bucket, minlength=len(x) * BUCKETS).reshape(-1, BUCKETS)
        more[rows, 6:] = counts[rows] / size[:, None]
    return x, first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Model:
    """Weights of the encoder layer, the gated attention and the score; ``prior`` scores without them."""

    prior: float
    centre: np.ndarray | None = None
    scale: np.ndarray | None = None
    weights: dict[str, np.ndarray] | None = None

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, dict]:
        w = self.weights
        h = np.tanh(x @ w["enc"] + w["enc0"])
        v, u = np.tanh(h @ w["v"]), _sigmoid(h @ w["u"])
        e = (v * u) @ w["a"]
        bag = np.repeat(np.arange(len(first) - 1), np.diff(first))
        e = np.exp(e - np.maximum.reduceat(e, first[:-1])[bag])
        a = e / np.add.reduceat(e, first[:-1])[bag]
        z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
        return z @ w["c"] + w["c0"], {"h": h, "v": v, "u": u, "a": a, "z": z, "bag": bag}

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        x, first = encode(texts)
        return _sigmoid(self.forward((x - self.centre) / self.scale, first)[0]).astype(np.float64)


def train(x: np.ndarray, first: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 0.005, seed: int = 3) -> Model:
    """Fit by Adam on the logistic loss; the gradient runs through the attention weights."""
    prior = float(y.mean()) if len(y) else 0.5
    if len(set(y.tolist())) < 2:
        return Model(prior)
    rng = np.random.default_rng(seed)
    dim = x.shape[1]
    shapes = {"enc": (dim, HIDDEN), "enc0": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,), "c0": ()}
    w = {k: rng.normal(0, 0.5 / max(1, s[0] if s else 1) ** 0.5, s).astype(np.float32) for k, s in shapes.items()}
    scale = x.std(0)
    model = Model(prior, x.mean(0), np.where(scale > 1e-3, scale, 1).astype(np.float32), w)
    x = np.clip((x - model.centre) / model.scale, -1e3, 1e3).astype(np.float32)
    m1, m2, t = {k: 0.0 for k in w}, {k: 0.0 for k in w}, 0
    size = np.diff(first)
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for lo in range(0, len(y), batch):
            docs = order[lo : lo + batch]
            starts = np.concatenate([[0], np.cumsum(size[docs])])
            rows = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
            xb = x[rows]
            logit, f = model.forward(xb, starts)
            d = ((_sigmoid(logit) - y[docs]) / len(docs)).astype(np.float32)
            g = {"c": f["z"].T @ d, "c0": d.sum()}
            dz = d[:, None] * w["c"]
            da = (dz[f["bag"]] * f["h"]).sum(1)
            dh = f["a"][:, None] * dz[f["bag"]]
            mean = np.add.reduceat(f["a"] * da, starts[:-1])[f["bag"]]
            de = f["a"] * (da - mean)
            g["a"] = (f["v"] * f["u"]).T @ de
            gate = de[:, None] * w["a"]
            dv, du = gate * f["u"] * (1 - f["v"] ** 2), gate * f["v"] * f["u"] * (1 - f["u"])
            g["v"], g["u"] = f["h"].T @ dv, f["h"].T @ du
            dh += dv @ w["v"].T + du @ w["u"].T
            dh *= 1 - f["h"] ** 2
            g["enc"], g["enc0"] = xb.T @ dh, dh.sum(0)
            t += 1
            step = rate * (1 - epoch / epochs)
            for k in w:
                grad = g[k] + 1e-4 * w[k]
                m1[k] = 0.9 * m1[k] + 0.1 * grad
                m2[k] = 0.999 * m2[k] + 0.001 * grad**2
                w[k] = (w[k] - step * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_docs: int = MAX_DOCS) -> Model:
    """Learn from labelled documents that are not held out, at most ``max_docs`` of them.

    The ids of the sample are a top-k by hash, so their size is bounded and they may be
    broadcast; passages are encoded on the workers and only their encodings reach the driver.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out())
    ids = ids.groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x, first = encode(take(part))
            rows = [x[lo:hi].tobytes() for lo, hi in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array(rows, pa.binary())], ["doc_id", "y", "x"])

    known = documents(docs).join(F.broadcast(ids), "doc_id").mapInArrow(tidy(bags), "doc_id long, y int, x binary")
    rows = sorted(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs).collect(), key=lambda r: (r.doc_id, bytes(r.x)))
    each = [np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) for r in rows]
    first = np.concatenate([[0], np.cumsum([len(e) for e in each])]).astype(np.int64)
    x = np.concatenate(each) if each else np.zeros((0, FEATURES), np.float32)
    return train(x, first, np.array([r.y for r in rows], np.float32))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            s = model.score(take(part))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    got = documents(docs).mapInArrow(tidy(task), "doc_id long, score double, predicted int")
    return got.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``, all columns unchanged."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield part.filter(pa.array(model.score(take(part)) >= threshold))

    return docs.mapInArrow(tidy(task), docs.schema)
