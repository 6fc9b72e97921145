"""Near-duplicate documents: universal hash minima, banding, verification, components.

1. Every document gets its set of word shingles, 128 minima of universal hash functions and 32
   bands of 4 minima. A pair with similarity 0.8 shares no band with probability 5e-8.
2. Documents with equal sets are one class, represented by their smallest id. Only
   representatives go on.
3. Each member of a band bucket is compared with the bucket's pivot (the member that shares
   most buckets), one pivot per document: groups of copies collapse without forming pairs.
4. Buckets that still hold several components are searched in blocks by signature: which
   document may match which other component. These are compared in blocks on full sets.
5. Components of all confirmed links.

Every link is confirmed on the full shingle sets. A bucket or component of any size is cut into
bounded blocks.

Defined cases: a null or empty text has no shingles and is linked with nothing; a text with
fewer words than a shingle is its whole word sequence; a null ``doc_id`` is linked with nothing
and has no component; a node is a set of shingles with the smallest id that has it, so rows that
repeat a ``doc_id`` with another text are judged by their own text, and ``component_id`` is the
smallest id in the row's component; an empty table gives no rows; columns other than ``doc_id``
and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.components import components
from barline.llm.textops import GOLDEN, MinHash, Words, documents, mix, shingles, slices, take, tidy
from barline.session import materialize

SHINGLE = 5
PERCENT = 80
MINIMA, ROWS = 128, 4
BANDS = MINIMA // ROWS
#: Equal minima below which a pair is not compared: at similarity 0.8 fewer happen once in 500,000 pairs.
LEAST_EQUAL = 80
#: Members of a search block; members and documents of a comparison block.
SEARCH, MEMBERS, DOCS = 1024, 256, 64


def _sets(words: Words, k: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    hashes, starts = shingles(words, k)
    return [np.unique(hashes[lo:hi]) for lo, hi in zip(starts[:-1], starts[1:])], hashes, starts


def _content(shingles: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else None


def _features(k: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minhash = MinHash(MINIMA)
        for part in slices(batches):
            sets, hashes, starts = _sets(Words(take(part), lower=True), k)
            full = np.flatnonzero(np.diff(starts) > 0)
            low = minhash.minima(hashes, np.append(starts[:-1][full], starts[-1])).astype(np.uint64)
            key = np.full((len(full), BANDS), 0, np.uint64) + np.arange(BANDS, dtype=np.uint64) * GOLDEN
            for i in range(ROWS):
                key = mix(key + low[:, i::ROWS])
            sign, keys = [None] * len(sets), [None] * len(sets)
            for row, at in enumerate(full):
                sign[at] = low[row].astype(np.uint8).tobytes()
                keys[at] = key[row].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("key"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_content(s) for s in sets], pa.binary()),
                    pa.array(sign, pa.binary()),
                    pa.array(keys, pa.list_(pa.int64())),
                ],
                ["doc_id", "key", "n_shingles", "content", "minima", "bands"],
            )

    return task


def _set_bytes(k: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets, _, _ = _sets(Words(take(part), lower=True), k)
            own = [_content(s) == c for s, c in zip(sets, part.column("content").to_pylist())]
            ids = part.column("id").filter(pa.array(own, pa.bool_()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([s.tobytes() for s, o in zip(sets, own) if o], pa.binary())], ["id", "shingles"])

    return task


def _groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[list[dict]]:
    """Runs of rows with equal keys from sorted batches."""
    rows, now = [], None
    for batch in batches:
        for row in batch.to_pylist():
            k = tuple(row[c] for c in key)
            if k != now and rows:
                yield rows
                rows = []
            now = k
            rows.append(row)
    if rows:
        yield rows


def _emit(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per pair of blocks of a bucket, the (document, other component) pairs that signatures allow.

    A pair of documents counts in the first band that it shares only.
    """
    out = []
    for rows in _groups(batches, ["band", "key", "block", "side"]):
        there, asked = [r for r in rows if not r["asks"]], [r for r in rows if r["asks"]]
        if not there or not asked:
            continue
        band = rows[0]["band"]

        def table(some: list[dict]) -> tuple:
            sign = np.frombuffer(b"".join(r["minima"] for r in some), np.uint8).reshape(len(some), MINIMA)
            keys = np.array([r["bands"] for r in some], np.int64)[:, : band + 1]
            return sign, keys, *(np.array([r[c] for r in some], np.int64) for c in ("id", "component", "n_shingles", "outside"))

        sign, keys, ids, comp, n, outside = table(there)
        for lo in range(0, len(asked), 32):
            s, b, i, c, m, _ = table(asked[lo : lo + 32])
            ok = (c[:, None] != comp) & ((outside[None, :] == 0) | (i[:, None] < ids))
            ok &= 100 * np.minimum(m[:, None], n) >= PERCENT * np.maximum(m[:, None], n)
            x, y = np.nonzero(ok)
            for at in range(0, len(x), 1 << 15):
                p, q = x[at : at + (1 << 15)], y[at : at + (1 << 15)]
                good = (sign[q] == s[p]).sum(1) >= LEAST_EQUAL
                p, q = p[good], q[good]
                first = ~(keys[q][:, :band] == b[p][:, :band]).any(1)
                out.extend(set(zip(i[p[first]].tolist(), comp[q[first]].tolist())))
        if len(out) >= 4096:
            yield _emit(out, ["id", "component"])
            out = []
    if out:
        yield _emit(out, ["id", "component"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per block, links between the asking documents and the members, confirmed on full sets.

    One link per asking document and block is enough: the members of a block are connected.
    """
    out = []
    for rows in _groups(batches, ["component", "x", "y"]):
        there, asked = [r for r in rows if not r["asks"]], [r for r in rows if r["asks"]]
        if there and asked:
            sets = [np.frombuffer(r["shingles"], np.uint64) for r in there]
            size = np.array([len(s) for s in sets])
            flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
            order = np.argsort(flat, kind="stable")
            flat, owner = flat[order], owner[order]
            for r in asked:
                s = np.frombuffer(r["shingles"], np.uint64)
                lo, hi = np.searchsorted(flat, s), np.searchsorted(flat, s, "right")
                hit = np.flatnonzero(hi > lo)
                if len(hit):
                    n = hi[hit] - lo[hit]
                    at = np.repeat(lo[hit] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                    both = np.bincount(owner[at], minlength=len(sets))
                    good = np.flatnonzero(100 * both >= PERCENT * (size + len(s) - both))
                    if len(good):
                        out.append((r["id"], there[good[0]]["id"]))
        if len(out) >= 4096:
            yield _emit(out, ["u", "v"])
            out = []
    if out:
        yield _emit(out, ["u", "v"])


def _links(asks: DataFrame, members: DataFrame, sets: DataFrame) -> DataFrame:
    """Compare each asking (id, component) with all ``members`` (id, component) of that component, in blocks."""
    parts = lambda n, size: F.ceil(F.col(n) / F.lit(float(size))).cast("int")
    n_asks = asks.groupBy("component").agg(F.count("*").alias("n_asks"))
    n_there = members.join(n_asks.select("component"), "component", "left_semi").groupBy("component").agg(F.count("*").alias("n_there"))
    grid = n_asks.join(n_there, "component").select("component", parts("n_asks", DOCS).alias("xs"), parts("n_there", MEMBERS).alias("ys"))
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asks.join(grid, "component").select("id", "component", own("xs").alias("x"), every("ys").alias("y"), F.lit(True).alias("asks"))
    right = members.join(grid, "component").select("id", "component", own("ys").alias("y"), every("xs").alias("x"), F.lit(False).alias("asks"))
    rows = left.unionByName(right).join(sets, "id")
    block = ["component", "x", "y"]
    return rows.repartition(*block).sortWithinPartitions(*block, "asks", "id").mapInArrow(tidy(_compare), "u long, v long")


def _text_key(text: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def _classed(docs: DataFrame, shingle: int, search: int = SEARCH) -> DataFrame:
    """(doc_id, key, n_shingles, component_id, node, kept) for every row; ``key`` is the hash of its text."""
    docs = documents(docs).withColumn("key", _text_key("text"))
    schema = "doc_id long, key long, n_shingles long, content binary, minima binary, bands array<long>"
    feats = materialize(docs.mapInArrow(tidy(_features(shingle)), schema), "features")
    linked = feats.where("doc_id IS NOT NULL AND n_shingles > 0")
    reps = linked.groupBy("content").agg(F.min("doc_id").alias("low"), *[F.first(c).alias(c) for c in ("n_shingles", "minima", "bands")])
    # Numbers of their own: with repeated ids, two sets may have the same smallest id.
    reps = materialize(reps.withColumn("id", F.monotonically_increasing_id()), "representatives")

    rows = reps.select("id", F.posexplode("bands").alias("band", "key"))
    shared = rows.groupBy("band", "key").agg(F.count("*").alias("size")).where("size > 1")
    buckets = materialize(rows.join(shared, ["band", "key"]), "buckets")
    degree = buckets.groupBy("id").agg(F.sum("size").alias("degree"))
    pivots = buckets.join(degree, "id").groupBy("band", "key").agg(F.max_by("id", F.struct("degree", -F.col("id"))).alias("pivot"))
    best = buckets.join(pivots, ["band", "key"]).where("id <> pivot").groupBy("id", "pivot").agg(F.count("*").alias("n"))
    best = best.groupBy("id").agg(F.max_by("pivot", F.struct("n", -F.col("pivot"))).alias("component"))

    wanted = reps.join(degree.select("id"), "id", "left_semi").select("id", "content", F.col("low").alias("doc_id"))
    texts = docs.join(wanted, "doc_id").select("id", "content", "text")
    sets = texts.mapInArrow(tidy(_set_bytes(shingle)), "id long, shingles binary").groupBy("id").agg(F.first("shingles").alias("shingles"))
    sets = materialize(sets, "sets")

    alone = best.select(F.col("component").alias("id"), "component").distinct()
    links = materialize(_links(best, alone, sets), "links")
    comps = components(links)

    named = buckets.join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
    split = named.groupBy("band", "key", "component").agg(F.count("*").alias("n"))
    split = split.groupBy("band", "key").agg(
        F.max_by("component", F.struct("n", "component")).alias("largest"), F.count("*").alias("parts"), (F.sum("n") - F.max("n")).alias("n_outside")
    ).where("parts > 1")
    open_rows = named.join(split, ["band", "key"]).select("band", "key", "id", "component", (F.col("component") != F.col("largest")).cast("int").alias("outside"), *[F.ceil(F.col(c) / F.lit(float(search))).cast("int").alias(n) for c, n in (("size", "blocks"), ("n_outside", "sides"))])
    open_rows = open_rows.join(reps.select("id", "n_shingles", "minima", "bands"), "id")
    # Both sides are cut into blocks, so a group holds about two times ``search`` rows at most.
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    there = open_rows.withColumn("block", own("blocks")).withColumn("side", every("sides")).withColumn("asks", F.lit(False))
    asked = open_rows.where("outside = 1").withColumn("side", own("sides")).withColumn("block", every("blocks")).withColumn("asks", F.lit(True))
    block = ["band", "key", "block", "side"]
    found = there.unionByName(asked).repartition(*block).sortWithinPartitions(*block, "asks", "id").mapInArrow(tidy(_search), "id long, component long")
    asks = materialize(found.distinct(), "asks")
    inside = asks.select("component").distinct()
    members = reps.select("id").join(comps, "id", "left").select("id", F.coalesce("component", "id").alias("component")).join(inside, "component", "left_semi")
    more = _links(asks, members, sets)
    comps = components(links.union(more))

    classes = reps.join(comps, "id", "left").select("content", "low", F.coalesce("component", "id").alias("node"))
    lowest = comps.join(reps.select("id", "low"), "id").groupBy(F.col("component").alias("node")).agg(F.min("low").alias("least"))
    classes = classes.join(lowest, "node", "left").select("content", "node", F.coalesce("least", "low").alias("component"))
    out = feats.select("doc_id", "key", "n_shingles", "content").join(classes, "content", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "key", "n_shingles", component.alias("component_id"), "node", F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, search: int = SEARCH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``."""
    return _classed(docs, shingle, search).select("doc_id", "n_shingles", "component_id", "kept")


def drop_copies(docs: DataFrame, shingle: int = SHINGLE, search: int = SEARCH) -> DataFrame:
    """``docs`` with one document of each component: its smallest id, repeated rows once.

    Rows without an id stay. Of one id's texts in a component one stays; its texts in other
    components stay as well. All columns are unchanged.
    """
    kept = _classed(docs, shingle, search).where("kept AND doc_id IS NOT NULL")
    alone = F.when(F.col("node").isNull(), F.col("key"))
    kept = kept.groupBy("doc_id", "node", alone.alias("alone")).agg(F.min("key").alias("__near_key"))
    rows = docs.where("doc_id IS NOT NULL").withColumns({"__near_key": _text_key("text"), "__near_id": F.col("doc_id").cast("bigint")})
    kept = kept.select(F.col("doc_id").alias("__near_id"), "__near_key")
    first = rows.join(kept, ["__near_id", "__near_key"], "left_semi").dropDuplicates(["__near_id", "__near_key"])
    plain = [F.col(f"`{c}`") for c in docs.columns]
    return first.select(*plain).unionByName(docs.where("doc_id IS NULL").select(*plain))
