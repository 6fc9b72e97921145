"""Exact duplicates by a distributed radix partition from the most significant byte on.

Texts are compared after every run of white space became one space. Documents are split by
successive bytes until a group has one member or its texts have ended; no digest decides on
equality. The partition has two levels:

* Within a task, each slice of a few megabytes is split by digits of 8, 16, 32, ... bytes. Equal
  texts of a slice become one representative with the list of its rows, so a text that a third
  of all rows hold is exchanged once per slice and not once per row.
* Across tasks, representatives are split by digits of ``DIGITS`` bytes, each group being named
  by its smallest member. A round counts (group, digit) with partial sums before its exchange and
  joins the names of those with two members or more back. Representatives that are alone or at their end are done; only
  the others keep the rest of their text for the next round. The number of rounds follows from the
  longest text that has a copy or shares its beginning up to there, not from the number of rows.

Every round is written to the shared folder, so lost executors cost one round at most.

Defined cases: a null text counts as empty, and all empty texts are one group; white space at the
ends is one space and counts; a null ``doc_id`` comes after all others (the largest long counts
as none); of rows that repeat both id and text one stays; an empty table gives no rows; columns
other than ``doc_id`` and ``text`` are not read, and ``drop_copies`` keeps them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.textops import documents, slices, take, tidy
from barline.session import materialize

#: Bytes of a digit in the first rounds across tasks; later rounds use the last one.
DIGITS = (64, 512, 4096, 32_768, 262_144)
LAST = (1 << 63) - 1
ROW = "__row"
REPS = "rep long, n long, low long, members array<struct<doc_id:long,row:long>>, text_sha256 string, text binary"
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def normalised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts with runs of white space as one space, and where each text starts."""
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[edges[0] : edges[-1]] if edges[-1] > edges[0] else np.zeros(0, np.uint8)
    edges = edges - edges[0]
    space = SPACE[data]
    again = np.zeros(len(data), bool)
    again[1:] = space[1:] & space[:-1]
    again[edges[:-1][edges[:-1] < len(data)]] = False
    kept = np.concatenate([[0], np.cumsum(~again)])
    return np.where(space, np.uint8(32), data)[~again], kept[edges]


def same(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per text, the place of the first text with the same bytes."""
    length = np.diff(starts)
    out = np.arange(len(length))
    rows, group, at, width = out, np.zeros(len(length), np.int64), 0, 8
    while len(rows):
        taken = np.minimum(length[rows] - at, width)
        step = np.arange(width)
        place = np.minimum((starts[rows] + at)[:, None] + step, max(len(data) - 1, 0))
        digit = np.where(step < taken[:, None], data[place] if len(data) else 0, 0).astype(np.uint8).view(np.uint64)
        order = np.lexsort((*digit.T, taken, group))
        rows, group, taken, digit = rows[order], group[order], taken[order], digit[order]
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (group[1:] != group[:-1]) | (taken[1:] != taken[:-1]) | (digit[1:] != digit[:-1]).any(axis=1)
        group = np.cumsum(fresh) - 1
        out[rows] = rows[np.flatnonzero(fresh)][group]
        alive = (np.bincount(group)[group] > 1) & (taken == width)
        rows, group, at, width = rows[alive], group[alive], at + width, min(2 * width, 4096)
    return out


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    made = TaskContext.get().partitionId() << 33
    for part in slices(batches):
        data, starts = normalised(take(part))
        first = same(data, starts)
        ids = part.column("doc_id").fill_null(LAST).to_numpy(zero_copy_only=False)
        order = np.lexsort((np.arange(len(ids)), ids, first))
        heads, begins = np.unique(first[order], return_index=True)
        edges = np.append(begins, len(order)).astype(np.int32)
        doc, row = (part.column(c).take(pa.array(order)) for c in ("doc_id", ROW))
        members = pa.ListArray.from_arrays(pa.array(edges), pa.StructArray.from_arrays([doc, row], ["doc_id", "row"]))
        raw = data.tobytes()
        texts = [raw[starts[i] : starts[i + 1]] for i in heads.tolist()]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(made + np.arange(len(heads))),
                pa.array(np.diff(edges).astype(np.int64)),
                pa.array(ids[order][begins]),
                members,
                pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                pa.array(texts, pa.binary()),
            ],
            ["rep", "n", "low", "members", "text_sha256", "text"],
        )
        made += len(heads)


def _classes(reps: DataFrame, digits: tuple[int, ...]) -> DataFrame:
    """(rep, keep_id, keep_rep, group_size) of every representative."""
    alive = reps.select("rep", "n", "low", F.lit(0).cast("long").alias("node"), F.col("text").alias("rest"))
    found, k = None, 0
    while True:
        width = digits[min(k, len(digits) - 1)]
        key = ["node", "digit", "ended"]
        cut = alive.withColumns({"digit": F.substring("rest", 1, width), "ended": F.octet_length("rest") <= width})
        parts = cut.groupBy(*key).agg(
            F.count("*").alias("k"),
            F.min("rep").alias("next"),
            F.sum("n").alias("all_n"),
            F.min("low").alias("least"),
            F.min_by("rep", "low").alias("least_rep"),
        )
        # A table of its own, so that the join below reads two plain exchanges and adaptive execution
        # can split the rows of a large group. Always a merge join: the groups grow with the documents.
        shared = materialize(parts.where("k > 1").drop("k"), f"groups{k}").hint("merge")
        joined = cut.join(shared, key, "left")
        alone, done = F.col("next").isNull(), F.col("next").isNull() | F.col("ended")
        step = joined.select(
            "rep",
            F.when(alone, F.col("low")).when(done, F.col("least")).alias("keep_id"),
            F.when(alone, F.col("rep")).when(done, F.col("least_rep")).alias("keep_rep"),
            F.when(alone, F.col("n")).when(done, F.col("all_n")).alias("group_size"),
            F.when(~done, F.col("n")).alias("n"),
            F.when(~done, F.col("low")).alias("low"),
            F.when(~done, F.col("next")).alias("node"),
            F.when(~done, F.substring("rest", width + 1, (1 << 31) - 1)).alias("rest"),
        )
        step = materialize(step, f"digits{k}")
        settled = step.where("node IS NULL").select("rep", "keep_id", "keep_rep", "group_size")
        found = settled if found is None else found.unionByName(settled)
        alive = step.where("node IS NOT NULL").select("rep", "n", "low", "node", "rest")
        if alive.isEmpty():
            return found
        k += 1


def groups(docs: DataFrame, digits: tuple[int, ...] = DIGITS) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, row) of every row of ``docs``.

    ``row`` is the column ``ROW`` of ``docs`` if it has one, else a number without meaning.
    """
    row = F.col(ROW) if ROW in docs.columns else F.monotonically_increasing_id()
    reps = materialize(documents(docs, row.alias(ROW)).mapInArrow(tidy(_local), REPS), "texts")
    members = reps.select("rep", "members", "text_sha256").join(_classes(reps, digits), "rep")
    each = members.select("*", F.posexplode("members").alias("pos", "m"))
    return each.select(
        F.col("m.doc_id").alias("doc_id"),
        F.when(F.col("keep_id") < LAST, F.col("keep_id")).alias("keep_id"),
        "group_size",
        ((F.col("rep") == F.col("keep_rep")) & (F.col("pos") == 0)).alias("kept"),
        "text_sha256",
        F.col("m.row").alias("row"),
    )


def drop_copies(docs: DataFrame, digits: tuple[int, ...] = DIGITS) -> DataFrame:
    """``docs`` with one row of each group of equal texts, the one with the smallest ``doc_id``."""
    stored = materialize(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")
    kept = groups(stored, digits).where("kept").select(F.col("row").alias(ROW))
    return stored.join(kept, ROW, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
