"""Repeated passages by winnowing over line hashes.

A window is the shortest run of lines with at least ``WORDS`` words, from any line on or up to any
line; blank lines are passed over. A line is deleted if one of its windows occurred earlier, in a
document with a smaller id or further up in the same one; the first occurrence stays. A line of a
repeat of ``WORDS`` words or more has a window inside the repeat: the one from it on, the one up to
it, or, if both leave the repeat, the one from the repeat's first line on. So the deleted lines
are those of all repeats, each to its ends, and no match has to be extended line by line.

Equal windows are found by a hash of the whole window. Before that, each window selects its smallest
line hash (the last one of equals) as a fingerprint; equal windows select equal fingerprints, so a
window whose fingerprint has one place only is dropped. This spares rows and changes no result.
Only counts and first places per fingerprint and window are exchanged, no pairs.

Defined cases: a null text stays null; a text without a window stays as it is; lines are
compared without white space at their ends; rows that repeat a ``doc_id`` and its text are one
document and get equal results; documents without an id come last; an empty table gives no
rows; extra columns are kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.textops import GOLDEN, Words, documents, mix, slices, take, tidy
from barline.session import materialize

WORDS = 50
LAST = (1 << 63) - 1
WINDOW = "doc long, key long, first int, last int, place int, fingerprint long, passage long"


def lines_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """All lines with a word (trimmed), their number of words, and where each text's lines start."""
    lists = pc.split_pattern(texts, "\n")
    flat = pc.ascii_trim_whitespace(lists.flatten())
    edges = lists.offsets.to_numpy().astype(np.int64)
    full = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
    flat = flat.filter(full)
    return flat, np.diff(Words(flat).starts), kept[edges - edges[0]]


def windows(hashes: np.ndarray, words: np.ndarray, starts: np.ndarray, least: int) -> tuple[np.ndarray, ...]:
    """Per window: its first and last line, the place of its fingerprint, and its hash."""
    run = np.cumsum(words)
    line = np.arange(len(words))
    count = np.diff(starts)
    begin, end = np.repeat(starts[:-1], count), np.repeat(starts[1:], count)
    ahead = np.searchsorted(run, run - words + least)
    back = np.searchsorted(run - words, run - least, "right") - 1
    ends = back >= begin
    ends[ends] = ahead[back[ends]] != line[ends]  # the others are windows from a line on as well
    first = np.concatenate([line[ahead < end], back[ends]])
    last = np.concatenate([ahead[ahead < end], line[ends]])
    place, low = first.copy(), hashes[first]
    passage = np.zeros(len(first), np.uint64)
    live = np.arange(len(first))
    step = 0
    while len(live):
        at = first[live] + step
        value = hashes[at]
        passage[live] = mix(passage[live] * GOLDEN + value)
        less = value <= low[live]
        place[live[less]], low[live[less]] = at[less], value[less]
        step += 1
        live = live[first[live] + step <= last[live]]
    return first, last, place, passage


def _scan(least: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            lines, words, starts = lines_of(take(part))
            if not len(lines):
                continue
            coded = lines.dictionary_encode()
            hashes = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False), categorize=False)[coded.indices.to_numpy(zero_copy_only=False)]
            first, last, place, passage = windows(hashes, words, starts, least)
            text = np.searchsorted(starts, first, "right") - 1
            base = starts[text]
            ids = pc.fill_null(part.column("doc_id"), LAST).to_numpy(zero_copy_only=False)
            keys = part.column("key").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids[text]),
                    pa.array(keys[text]),
                    *(pa.array((x - base).astype(np.int32)) for x in (first, last, place)),
                    pa.array(hashes[place].astype(np.int64)),
                    pa.array(passage.astype(np.int64)),
                ],
                ["doc", "key", "first", "last", "place", "fingerprint", "passage"],
            )

    return task


def _key(text: str = "text") -> Column:
    return F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit("")))


def repeated(docs: DataFrame, least: int = WORDS) -> DataFrame:
    """(doc, key, runs): per document with repeats, the line ranges that occurred earlier.

    ``doc`` is the id (the largest long for none), ``key`` the hash of the text; ranges count
    lines with a word from 0.
    """
    rows = documents(docs).withColumn("key", _key())
    found = materialize(rows.mapInArrow(tidy(_scan(least)), WINDOW), "windows")
    place = F.struct("doc", "key", "place")
    shared = found.groupBy("fingerprint").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("fingerprint")
    near = found.join(shared, "fingerprint").select("doc", "key", "first", "last", "passage")
    start = F.struct("doc", "key", "first", "last")
    earliest = near.groupBy("passage").agg(F.min(start).alias("a"), F.max(start).alias("b")).where("a <> b").select("passage", "a")
    same = (F.col("doc") == F.col("a.doc")) & (F.col("key") == F.col("a.key"))
    later = near.join(earliest, "passage").where(~same | (F.col("first") > F.col("a.last")))
    return later.groupBy("doc", "key").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("runs"))


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the text column by the text without its runs; add line counts."""
    for batch in batches:
        texts, counts = [], []
        at = batch.schema.get_field_index("__text")
        for text, runs in zip(batch.column("__text").to_pylist(), batch.column("__runs").to_pylist()):
            lines = (text or "").split("\n")
            full = [i for i, line in enumerate(lines) if line.strip(" \t\n\v\f\r")]
            gone: set[int] = set()
            for run in runs or ():
                gone.update(full[run["first"] : run["last"] + 1])
            texts.append("\n".join(line for i, line in enumerate(lines) if i not in gone) if gone else text)
            counts.append((len(full), len(gone), sum(len(lines[i].encode().split()) for i in gone)))
        columns = [pa.array(texts, batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns[:-1])]
        columns += [pa.array(c, pa.int64()) for c in zip(*counts)] if counts else [pa.array([], pa.int64())] * 3
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-1], "__lines", "__removed", "__words"])


def _cleaned(docs: DataFrame, least: int) -> DataFrame:
    """All columns of ``docs`` under prefixed names, with the cleaned text and the counts."""
    runs = repeated(docs, least)
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias("__text" if c == "text" else f"c_{c}") for c in names])
    plain = plain.withColumn("__text", F.col("__text").cast("string"))
    doc = F.coalesce(F.col("c_doc_id").cast("bigint"), F.lit(LAST))
    joined = plain.join(runs, (doc == F.col("doc")) & (_key("__text") == F.col("key")), "left").drop("doc", "key")
    joined = joined.withColumnRenamed("runs", "__runs")
    schema = joined.drop("__runs").schema.add("__lines", "long").add("__removed", "long").add("__words", "long")
    return joined.mapInArrow(tidy(_apply), schema)


def dedup_lines(docs: DataFrame, least: int = WORDS) -> DataFrame:
    """(doc_id, n_lines, n_removed, words_removed, text) for every row."""
    return _cleaned(documents(docs), least).select(
        F.col("c_doc_id").alias("doc_id"),
        F.col("__lines").alias("n_lines"),
        F.col("__removed").alias("n_removed"),
        F.col("__words").alias("words_removed"),
        F.col("__text").alias("text"),
    )


def clean(docs: DataFrame, least: int = WORDS) -> DataFrame:
    """``docs`` with repeated runs deleted from ``text``; ``n_chars`` follows the text if it is there."""
    out = _cleaned(docs, least)
    columns = []
    for c in docs.columns:
        if c == "text":
            columns.append(F.col("__text").alias("text"))
        elif c == "n_chars":
            columns.append(F.when(F.col("__removed") > 0, F.length("__text")).otherwise(F.col("c_n_chars")).cast(docs.schema[c].dataType).alias(c))
        else:
            columns.append(F.col(f"`c_{c}`").alias(c))
    return out.select(*columns)
