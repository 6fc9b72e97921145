"""Phrase collocations: phrases counted by sorting suffix pointers, then scored against their parts.

Every word's place is a pointer to the suffix that starts there, up to ``DEPTH`` words within its
piece of text. Pointers are routed globally by their leading words: a bounded sample gives splitting
suffixes, and all pointers between two of them go to one range. A frequent leading word is thereby
split by its second word, and so on, so no range grows because a word is common. In a map task equal
suffixes of a slice are merged first, so a passage that many documents share arrives once per slice.

Each range is partitioned by multikey three-way quicksort: by the word at the current depth into
smaller, equal and larger; the equal part is a phrase and its weight the phrase's count, and it
goes on one word deeper. A part that weighs less than the least count is abandoned. Only phrases
that begin a splitting suffix can have pointers in two ranges; they are counted apart, are never
abandoned, and their parts are added up afterwards.

A word below the least count is part of no phrase, so suffixes end before it. A first pass counts all
words at ``FILTER_BITS`` hashed positions; the positions that reach the least count are a bitmap of
16 MB at most, whatever the vocabulary. Words that share a position with others can pass it wrongly;
they are counted like all others and then dropped.

The sample decides where ranges end, never what is counted; it takes documents at random up to
``SAMPLE_BYTES`` of text and one place in ``SAMPLE_EVERY`` of that much.

Defined cases: a null text is empty; a null language is ``und``; words keep every character but
those between them; texts of any length are cut at slices of places, not of text; rows that repeat
count each time; an empty table gives no rows; columns other than ``text`` and ``lang`` are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.textops import GOLDEN, UPPER, Words, byte_class, mix, slices, take, tidy
from barline.session import materialize

DEPTH, LEAST, TOP, COVERED, SCALE = 4, 30, 2000, 80, 2_000_000
NONE = "und"
SLICE = 6 << 20
SAMPLE_BYTES, SAMPLE_EVERY, RANGE_PLACES = 32 << 20, 32, 3 << 20
#: Positions of the word filter, and of one of Spark's bitmaps.
FILTER_BITS, BITMAP = 1 << 27, 1 << 15
#: Words of one slice that fit into the 16-bit fields of a packed pointer; more are cut by places.
CODES, PLACES = 65_534, 60_000
BREAK = byte_class(".,;:!?\n\v\f\r")
GAP = BREAK | byte_class(" \t")
#: Words of a part joined by spaces, its suffixes (one row of 16-bit codes per depth), and their weights; all as Zstandard frames.
ROUTED = "range int, lang string, words binary, suffixes binary, weights binary, places long"
COUNTED = "lang string, phrase string, k int, a long"
Suffix = tuple[str, ...]


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array]]:
    """The texts of each language in a slice."""
    for part in slices(batches, most=SLICE):
        coded = pc.fill_null(part.column("lang"), NONE).dictionary_encode()
        texts, code = take(part), coded.indices.to_numpy(zero_copy_only=False)
        for i, lang in enumerate(coded.dictionary.to_pylist()):
            yield lang, texts.take(pa.array(np.flatnonzero(code == i)))


def places(texts: pa.Array) -> tuple[Words, np.ndarray]:
    """Lower-cased words of the texts, and per word a number that changes where a piece ends."""
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[edges[0] : edges[-1]] if edges[-1] > edges[0] else np.zeros(0, np.uint8)
    edges = np.ascontiguousarray(edges - edges[0])
    gap = GAP[data]
    start = ~gap
    start[1:] &= gap[:-1]
    begins = edges[:-1][edges[:-1] < len(data)]
    start[begins] = ~gap[begins]
    broken = np.cumsum(BREAK[data])
    plain = np.where(gap, np.uint8(32), data + UPPER[data] * np.uint8(32))
    words = Words(pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(edges), pa.py_buffer(plain)))
    return words, broken[start] + np.repeat(np.arange(len(texts)), np.diff(words.starts))


def _positions(lang: str, words: Words) -> np.ndarray:
    """The position in the word filter of each distinct word."""
    salt = np.array([zlib.crc32(lang.encode())], np.uint64) * GOLDEN
    return (mix(words.hashes() ^ salt) % np.uint64(FILTER_BITS)).astype(np.int64)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for lang, texts in _texts(batches):
        words, _ = places(texts)
        n = np.bincount(words.codes, minlength=len(words.distinct))
        yield pa.RecordBatch.from_arrays([pa.array(_positions(lang, words)), pa.array(n.astype(np.int64))], ["place", "n"])


def frequent_words(texts: DataFrame, least: int) -> np.ndarray:
    """The word filter: one bit per position, set where at least ``least`` words fall."""
    found = texts.mapInArrow(tidy(_word_counts), "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    number = F.col("place") + 1  # Spark's bitmaps count from 1
    bits = F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("bits")
    maps = found.where(F.col("n") >= least).groupBy(F.bitmap_bucket_number(number).alias("bucket")).agg(bits)
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for row in maps.collect():
        at = (row["bucket"] - 1) * (BITMAP // 8)
        out[at : at + BITMAP // 8] = np.frombuffer(row["bits"], np.uint8)
    return out


def packed(codes: np.ndarray, piece: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """For the places from ``lo`` to ``hi``, the codes of the next words of the piece in 16 bits each.

    A code of 0 ends the suffix before it.
    """
    key, alive = np.zeros(hi - lo, np.uint64), np.ones(hi - lo, bool)
    for d in range(DEPTH):
        part = np.zeros(hi - lo, np.uint64)
        n = max(0, min(hi, len(codes) - d) - lo)
        part[:n] = np.where(alive[:n] & (piece[lo + d : lo + d + n] == piece[lo : lo + n]), codes[lo + d : lo + d + n], 0)
        alive = part > 0
        key = (key << np.uint64(16)) | part
    return key


def _pointers(lang: str, texts: pa.Array, known: np.ndarray | None) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, int]]:
    """Per run of places: its words in order, its packed suffixes, each once, their weights, and its places."""
    words, piece = places(texts)
    kept = np.arange(len(words.distinct))
    if known is not None:
        at = _positions(lang, words)
        kept = np.flatnonzero((known[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
    spelt = words.distinct.take(pa.array(kept))
    order = pc.array_sort_indices(spelt).to_numpy()
    code = np.zeros(len(words.distinct), np.int64)
    code[kept[order]] = np.arange(1, len(order) + 1)
    spelt, codes = spelt.take(pa.array(order)), code[words.codes]
    step = len(codes) if len(order) <= CODES else PLACES
    for lo in range(0, len(codes), step or 1):
        hi = min(lo + step, len(codes))
        used, own, near = spelt, codes, piece
        if step < len(codes):
            at, own = np.unique(np.append(codes[lo : hi + DEPTH - 1], 0), return_inverse=True)
            used, own, near = spelt.take(pa.array(at[1:] - 1)), own[:-1], piece[lo : hi + DEPTH - 1]
        keys, weights = np.unique(packed(own, near, 0, hi - lo), return_counts=True)
        begins = int(np.searchsorted(keys, np.uint64(1) << np.uint64(16 * (DEPTH - 1))))
        yield used, keys[begins:], weights[begins:], hi - lo


def _fields(keys: np.ndarray) -> np.ndarray:
    """One row of codes per depth."""
    return np.stack([(keys >> np.uint64(16 * (DEPTH - 1 - d))).astype(np.uint16) for d in range(DEPTH)])


def _sample(known: Callable[[], np.ndarray], every: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _texts(batches):
            for spelt, keys, _, _ in _pointers(lang, texts, known()):
                words = spelt.to_pylist()
                rows = _fields(keys[every // 2 :: every]).T.tolist()
                found = [" ".join(words[c - 1] for c in row if c) for row in rows]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found, pa.string())], ["lang", "suffix"])

    return task


def splitters(texts: DataFrame, known: Callable[[], np.ndarray], range_places: int = RANGE_PLACES) -> list[tuple[str, Suffix]]:
    """(language, suffix) borders between ranges of about ``range_places`` places each."""
    size = texts.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    share = min(1.0, SAMPLE_BYTES / max(1, size))
    picked = texts.sample(share, seed=1) if share < 1 else texts
    every = max(1, int(SAMPLE_EVERY * size * share) // SAMPLE_BYTES)
    sample = picked.mapInArrow(tidy(_sample(known, every)), "lang string, suffix string").collect()
    rows = sorted((r.lang, tuple(r.suffix.split(" "))) for r in sample)
    ranges = min(-(-size // (6 * range_places)), len(rows))
    return sorted({rows[len(rows) * i // ranges] for i in range(1, ranges)})


def _border(words: list[str], suffix: Suffix) -> int:
    """The packed suffix at or above which the range behind ``suffix`` begins, in a slice's own codes."""
    key = 0
    for d in range(DEPTH):
        at = bisect_left(words, suffix[d]) if d < len(suffix) else -1
        key |= (at + 1) << (16 * (DEPTH - 1 - d))
        if at == len(words) or (at >= 0 and words[at] != suffix[d]):
            break
    return key


def _route(borders: list[tuple[str, Suffix]], known: Callable[[], np.ndarray]):
    langs = [lang for lang, _ in borders]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3)
        for lang, texts in _texts(batches):
            base = bisect_left(langs, lang)
            own = [s for x, s in borders[base:] if x == lang]
            for spelt, keys, weights, n in _pointers(lang, texts, known()):
                words = spelt.to_pylist()
                cuts = np.searchsorted(keys, np.array([_border(words, s) for s in own], np.uint64))
                edges = [0, *cuts.tolist(), len(keys)]
                rows: list[tuple] = [(base, b"", b"", b"")]
                for i, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
                    if lo == hi:
                        continue
                    fields = _fields(keys[lo:hi])
                    seen = np.flatnonzero(np.bincount(fields.ravel(), minlength=1)[1:])
                    small = np.zeros(len(words) + 1, np.uint16)
                    small[seen + 1] = np.arange(1, len(seen) + 1)
                    spelt_here = " ".join([words[j] for j in seen.tolist()]).encode()
                    parts = (spelt_here, small[fields].tobytes(), weights[lo:hi].astype(np.uint32).tobytes())
                    rows.append((base + i, *map(pack.compress, parts)))
                at, *blobs = zip(*rows)
                columns = [pa.array(at, pa.int32()), pa.array([lang] * len(rows), pa.string()), *[pa.array(b, pa.binary()) for b in blobs]]
                total = pa.array([n] + [0] * (len(rows) - 1), pa.int64())
                yield pa.RecordBatch.from_arrays([*columns, total], ["range", "lang", "words", "suffixes", "weights", "places"])

    return task


def quicksort(columns: np.ndarray, weights: np.ndarray, least: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """(codes, weight) of each phrase of weight ``least`` or more; code 0 is the end of a piece.

    Multikey three-way quicksort with a stack of its own. Parts below ``least`` are abandoned.
    """
    todo = [((), np.arange(columns.shape[1]), columns[0], weights)]
    while todo:
        prefix, rows, word, weight = todo.pop()
        if len(rows) == 0 or weight.sum() < least:
            continue
        pivot = word[len(word) // 2]
        less, more = word < pivot, word > pivot
        for part in (less, more):
            if part.any():
                todo.append((prefix, rows[part], word[part], weight[part]))
        if pivot == 0:
            continue
        equal = ~(less | more)
        rows, weight = rows[equal], weight[equal]
        total = int(weight.sum())
        if total < least:
            continue
        phrase = (*prefix, int(pivot))
        yield phrase, total
        if len(phrase) < len(columns):
            todo.append((phrase, rows, columns[len(phrase)][rows], weight))


def _count(borders: list[tuple[str, Suffix]], least: int):
    def counted(at: int, lang: str, blobs: list[tuple]) -> pa.RecordBatch:
        number: dict[str, int] = {}
        parts, each = [], []
        for spelt, suffixes, weights, _ in blobs:
            own = [number.setdefault(w, len(number) + 1) for w in spelt.decode().split(" ")] if spelt else []
            known = np.array([0, *own], np.int32)
            parts.append(known[np.frombuffer(suffixes, np.uint16).reshape(DEPTH, -1)])
            each.append(np.frombuffer(weights, np.uint32).astype(np.int64))
        words = list(number)
        columns = np.concatenate(parts, axis=1)
        weights = np.concatenate(each)
        rows: list[tuple[str, int, int]] = [("", 0, sum(b[3] for b in blobs))]
        split = set()
        for x, suffix in borders[max(0, at - 1) : at + 1]:
            for k in range(1, len(suffix) + 1) if x == lang else ():
                codes = tuple(number.get(w, -1) for w in suffix[:k])
                if -1 not in codes and codes not in split:
                    split.add(codes)
                    inside = np.all(columns[:k] == np.array(codes)[:, None], axis=0)
                    rows.append((" ".join(suffix[:k]), k, int(weights[inside].sum())))
        for codes, n in quicksort(columns, weights, least):
            if codes not in split:
                rows.append((" ".join(words[c - 1] for c in codes), len(codes), n))
        phrase, k, a = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(rows), pa.string()), pa.array(phrase, pa.string()), pa.array(k, pa.int32()), pa.array(a, pa.int64())], ["lang", "phrase", "k", "a"])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blobs, unpack = None, [], zstandard.ZstdDecompressor()
        for batch in batches:
            for at, lang, *blob, n in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (at, lang):
                    if blobs:
                        yield counted(*now, blobs)
                    now, blobs = (at, lang), []
                blobs.append((*[unpack.decompress(x) if x else x for x in blob], n))
        if blobs:
            yield counted(*now, blobs)

    return task


def phrase_counts(docs: DataFrame, least: int = LEAST, range_places: int = RANGE_PLACES) -> DataFrame:
    """(lang, phrase, k, a): phrases of up to ``DEPTH`` words that occur ``least`` times or more.

    The row with ``k`` 0 has the number of all words of the language.
    """
    texts = docs.select(F.col("text").cast("string").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit(NONE)).alias("lang"))
    shared = docs.sparkSession.sparkContext.broadcast(frequent_words(texts, least))
    known = lambda: shared.value
    borders = splitters(texts, known, range_places)
    routed = texts.mapInArrow(tidy(_route(borders, known)), ROUTED)
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = routed.repartitionById(partitions, F.col("range") % partitions).sortWithinPartitions("range", "lang")
    parts = dealt.mapInArrow(tidy(_count(borders, least)), COUNTED)
    return parts.groupBy("lang", "phrase", "k").agg(F.sum("a").alias("a")).where((F.col("k") == 0) | (F.col("a") >= least))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, range_places: int = RANGE_PLACES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``DEPTH`` words.

    A phrase is cut where ``2a / (l + r)`` is smallest, in millionths. Phrases within a longer one
    that occurs at least ``COVERED`` percent as often are left out.
    """
    counts = materialize(phrase_counts(docs, least, range_places), "phrases")
    totals = counts.where("k = 0").select("lang", F.col("a").alias("n"))
    known = counts.where("k > 0").select("lang", "phrase", "a")
    phrases = counts.where("k > 1").withColumn("w", F.split("phrase", " "))
    part = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    cuts = phrases.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("head"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("tail"))
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l")), ["lang", "head"])
    cuts = cuts.join(known.select("lang", F.col("phrase").alias("tail"), F.col("a").alias("r")), ["lang", "tail"])
    score = F.expr(f"CAST({SCALE} AS DECIMAL(38,0)) * CAST(a AS DECIMAL(20,0)) DIV (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    inner = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    inside = phrases.where("k > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    exact = lambda c: F.col(c).cast("decimal(20,0)")
    free = best.join(inside, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * exact("most") < COVERED * exact("a")))
    rows = free.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    ranked = rows.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
