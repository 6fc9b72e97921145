"""Benchmark items inside documents by size-partitioned MinHash containment search.

Items are partitioned by the number of their word shingles in classes [s, 2s). For each class a
document is covered by overlapping windows of 4s shingles, so that an item and a window are of
comparable size however long the document is. An item of which 80 % lies in a document has a
Jaccard similarity of 0.19 or more with one of its windows, or as much in sum over several;
with ``MINIMA`` hash functions that agree one by one it is missed with probability 1e-6.
Windows are tested on the workers against a Bloom filter of the items' minima of bounded size;
what passes is joined with the minima exactly, and every candidate is verified by the exact
number of the item's shingles in the whole document.

Words are runs of ASCII letters and digits and of all characters beyond ASCII, in lower case.

Defined cases: null or empty texts match nothing; an item with fewer words than a shingle has
no shingle and matches nothing; rows that repeat a document or an item give one match; a null
``doc_id`` is reported as null; empty tables give no rows; other columns are not read by
``matches`` and kept by ``drop_matches``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.textops import MinHash, Words, mix, shingles, slices, take, tidy
from barline.session import materialize

SHINGLE = 5
PERCENT = 80
MINIMA = 64
PROBES = 4
#: Bits of a Bloom filter: so many per value, within these bounds (16 MB at most).
BITS_PER_VALUE, LEAST_BITS, MOST_BITS = 128, 1 << 16, 1 << 27
_ODD = np.random.default_rng(9).integers(0, 2**63, PROBES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = [ord(chr(b).lower()) if chr(b).isalnum() else 32 for b in range(128)]


def folded(texts: pa.Array) -> pa.Array:
    """Texts in lower case with ASCII punctuation as spaces."""
    _, edges, data = texts.buffers()
    edges = np.frombuffer(edges, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    body = _FOLD[np.frombuffer(data, np.uint8)[edges[0] : edges[-1]]] if edges[-1] > edges[0] else np.zeros(0, np.uint8)
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((edges - edges[0]).tobytes()), pa.py_buffer(body.tobytes()))


class Bloom:
    """A filter of 64-bit values; the positions of a value are multiply-shift hashes."""

    def __init__(self, bits: int, words: np.ndarray | None = None):
        self.shift = np.uint64(64 - (bits.bit_length() - 1))
        self.words = np.zeros(bits // 64, np.uint64) if words is None else words

    def positions(self, values: np.ndarray, probe: int) -> np.ndarray:
        return (values * _ODD[probe]) >> self.shift

    def add(self, values: np.ndarray) -> None:
        for probe in range(PROBES):
            at = self.positions(values, probe)
            np.bitwise_or.at(self.words, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))

    def holds(self, values: np.ndarray) -> np.ndarray:
        """Places in ``values`` that may be in the set."""
        left = np.arange(len(values))
        for probe in range(PROBES):
            at = self.positions(values[left], probe)
            left = left[(self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1]
        return left


def bloom_of(values: DataFrame, n_values: int) -> Bloom:
    """The filter of a column ``value``: workers fill partial filters, which are or-ed by word.

    At most ``MOST_BITS`` / 64 words reach the driver, whatever the number of values.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_VALUE * max(1, n_values) - 1).bit_length()))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Bloom(bits)
        for b in batches:
            own.add(b.column("value").to_numpy(zero_copy_only=False).astype(np.uint64))
        at = np.flatnonzero(own.words)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(own.words[at].view(np.int64))], ["at", "word"])

    rows = values.select("value").mapInArrow(tidy(fill), "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).collect()
    out = Bloom(bits)
    if rows:
        out.words[np.array([r["at"] for r in rows])] = np.array([r["word"] for r in rows], np.int64).view(np.uint64)
    return out


def _tagged(low: np.ndarray, size_class: int) -> np.ndarray:
    """Minima as 64-bit values that also tell the class and the hash function."""
    tag = np.arange(low.shape[1], dtype=np.uint64) + np.uint64(size_class * MINIMA)
    return mix((low.astype(np.uint64) << np.uint64(32)) | tag)


def _items(k: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(MINIMA)
        for part in slices(batches):
            hashes, starts = shingles(Words(folded(take(part))), k, short=False)
            for item, lo, hi in zip(part.column("item_id").to_pylist(), starts[:-1], starts[1:]):
                if hi > lo:
                    own = np.unique(hashes[lo:hi])
                    size_class = len(own).bit_length() - 1
                    values = _tagged(minhash.minima(own, np.array([0, len(own)])), size_class)[0]
                    row = [[item], [size_class], [len(own)], [own.view(np.int64)], [values.view(np.int64)]]
                    types = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, types)], ["item_id", "size_class", "n_shingles", "shingles", "minima"])

    return task


def window_minima(minhash: MinHash, hashes: np.ndarray, starts: np.ndarray, classes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per class: minima of all windows, and the text of each window.

    Blocks of 2s shingles are reduced once for the smallest class and merged in pairs for the
    larger ones; a window is a block and the next one.
    """
    n = np.diff(starts)
    size = 2 << classes[0]
    count = -(-n // size)
    text = np.repeat(np.arange(len(n)), count)
    rank = np.arange(len(text)) - np.repeat(np.concatenate([[0], np.cumsum(count)[:-1]]), count)
    low = minhash.minima(hashes, np.append(starts[text] + rank * size, starts[-1]))
    for c in classes:
        while size < 2 << c:
            size *= 2
            lead = np.flatnonzero(rank % 2 == 0)
            low = np.minimum.reduceat(low, lead, axis=0)
            text, rank = text[lead], rank[lead] // 2
        window = low.copy()
        follows = np.flatnonzero(text[1:] == text[:-1])
        window[follows] = np.minimum(low[follows], low[follows + 1])
        yield c, window, text


def _documents(k: int, classes: list[int], minima: Bloom, wanted: Bloom):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(MINIMA)
        for part in slices(batches):
            hashes, starts = shingles(Words(folded(take(part))), k, short=False)
            if not len(hashes):
                continue
            hits: dict[int, set[int]] = {}
            for c, low, text in window_minima(minhash, hashes, starts, classes):
                values = _tagged(low, c).ravel()
                for at in minima.holds(values):
                    hits.setdefault(int(text[at // MINIMA]), set()).add(int(values[at].view(np.int64)))
            if not hits:
                continue
            rows = sorted(hits)
            own = []
            for d in rows:
                h = hashes[starts[d] : starts[d + 1]]
                own.append(np.unique(h[wanted.holds(h)]).view(np.int64))
            at = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(at), part.column("key").take(at), pa.array([sorted(hits[d]) for d in rows], pa.list_(pa.int64())), pa.array(own, pa.list_(pa.int64()))],
                ["doc_id", "key", "hits", "own"],
            )

    return task


def _matches(docs: DataFrame, benchmark: DataFrame, k: int, percent: int) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), text.alias("text"))
    items = materialize(items.mapInArrow(tidy(_items(k)), "item_id long, size_class int, n_shingles long, shingles array<long>, minima array<long>"), "items")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("s"), F.sort_array(F.collect_set("size_class")).alias("classes")).first()
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key"))
    schema = "doc_id long, key long, hits array<long>, own array<long>"
    if size.n:
        minima = bloom_of(items.select(F.explode("minima").alias("value")), size.n * MINIMA)
        wanted = bloom_of(items.select(F.explode("shingles").alias("value")), size.s)
        rows = rows.mapInArrow(tidy(_documents(k, list(size.classes), minima, wanted)), schema)
    else:
        rows = docs.sparkSession.createDataFrame([], schema)
    near = materialize(rows, "near")
    ask = items.select("item_id", F.explode("minima").alias("hit")).distinct()
    pairs = near.select("doc_id", "key", F.explode("hits").alias("hit")).join(ask, "hit").select("doc_id", "key", "item_id").distinct()
    pairs = pairs.withColumnsRenamed({"doc_id": "d", "key": "t"})
    whole = near.join(pairs, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("t"))).drop("d", "t", "hits")
    both = whole.join(items.select(F.col("item_id").alias("i"), "n_shingles", "shingles"), F.col("item_id").eqNullSafe(F.col("i")))
    both = both.withColumn("n_shared", F.size(F.array_intersect("own", "shingles")).cast("bigint"))
    return both.where(F.col("n_shared") * 100 >= F.col("n_shingles") * percent).select("doc_id", "key", "item_id", "n_shingles", "n_shared").distinct()


def matches(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) for every item of which a document holds ``percent``."""
    found = _matches(docs, benchmark, shingle, percent).drop("key").distinct()
    return found.withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def drop_matches(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``docs`` without the documents that hold an item; all columns unchanged."""
    found = _matches(docs, benchmark, shingle, percent).select(F.col("doc_id").alias("__d"), F.col("key").alias("__t")).distinct()
    key = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(found, docs["doc_id"].cast("bigint").eqNullSafe(F.col("__d")) & (key == F.col("__t")), "left_anti")
