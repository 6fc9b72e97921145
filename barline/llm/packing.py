"""Harmonic packing of documents into token sequences of a fixed capacity.

Piece lengths are exactly the reciprocal shares ``capacity // j`` of the capacity, and a bin of
class ``j`` is full with ``j`` pieces. A document gives whole sequences first; its rest is cut
greedily into the largest shares that fit, so that a full bin wastes fewer tokens than one
piece is long. Each worker fills the bins of its own partition and holds at most ``j - 1``
pieces per class. What workers leave over is numbered per class and fills bins of the same
class; fewer than ``j`` pieces per class then remain in the whole table, a bounded number,
which are laid end to end and cut at the capacity; the last sequence is cut at powers of two.

Defined cases: a null or empty text is the end id alone; repeated rows are packed each by
itself; a null ``doc_id`` stays null; an empty table gives no piece; columns other than
``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.textops import documents, encoder, slices, take, tidy
from barline.session import materialize

END_ID = 2
CAPACITY = 4096
#: Bytes that the Parquet writer of the filled bins buffers; pieces are long, so small row groups cost little.
ROW_GROUP = 16 << 20
#: Shares of up to this many tokens have a class for each length.
SMALL = 16
LEFT, TAIL = 1 << 61, 3 << 60
PIECE = "doc_id long, start long, length long, doc_tokens long, worker long, slot long, sequence_id long, offset long, ids binary"
FIELDS = PIECE.replace(" long", "").replace(" binary", "").split(", ")
ARROW = pa.schema([(f, pa.binary() if f == "ids" else pa.int64()) for f in FIELDS])


def shares(capacity: int = CAPACITY, small: int = SMALL) -> list[int]:
    """Piece lengths, ascending: ``capacity // j`` for j of three leading bits' precision, and 1..small."""
    out = set(range(1, min(small, capacity) + 1))
    for j in range(1, capacity // small + 1):
        if j % (1 << max(0, j.bit_length() - 4)) == 0:
            out.add(capacity // j)
    return sorted(out)


def cut(n: int, sizes: list[int]) -> list[int]:
    """Lengths of the pieces of a document of ``n`` ids."""
    out = [sizes[-1]] * (n // sizes[-1])
    rest, at = n % sizes[-1], len(sizes) - 1
    while rest:
        while sizes[at] > rest:
            at -= 1
        out.append(sizes[at])
        rest -= sizes[at]
    return out


def _fill(path: str, end_id: int, capacity: int, small: int):
    sizes = shares(capacity, small)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker, code = TaskContext.get().partitionId(), encoder(path)
        waiting: dict[int, list[list]] = {s: [] for s in sizes}
        out: list[list] = []
        made = 0

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), ARROW)], schema=ARROW)
            out.clear()
            return batch

        for batch in slices(batches, most=8 << 20):
            ids, starts = code.ids(take(batch))
            for doc, lo, hi in zip(batch.column("doc_id").to_pylist(), starts[:-1], starts[1:]):
                whole = np.append(ids[lo:hi], np.uint32(end_id)).astype("<u4")
                at = 0
                for size in cut(len(whole), sizes):
                    group = waiting[size]
                    group.append([doc, at, size, len(whole), worker, len(group), None, None, whole[at : at + size].tobytes()])
                    at += size
                    if len(group) == capacity // size:
                        for i, row in enumerate(group):
                            row[6], row[7] = (worker << 32) + made, i * size
                        made += 1
                        out.extend(group)
                        group.clear()
                if len(out) >= 2048:
                    yield flush()
        for group in waiting.values():
            out.extend(group)
        if out:
            yield flush()

    return task


def _tail(capacity: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in b.to_pylist()]
        total = sum(r["length"] for r in rows)
        ends, at = [], 0
        while at < total:
            left = total - at
            at += capacity if left >= capacity else 1 << (left.bit_length() - 1)
            ends.append(at)
        out, at, k, begin = [], 0, 0, 0
        for r in rows:
            done = 0
            while done < r["length"]:
                n = min(r["length"] - done, ends[k] - at)
                out.append(r | {"start": r["start"] + done, "length": n, "sequence_id": TAIL + k, "offset": at - begin, "ids": r["ids"][4 * done : 4 * (done + n)]})
                done, at = done + n, at + n
                if at == ends[k]:
                    begin, k = at, k + 1
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=ARROW)

    return task


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, small: int = SMALL) -> DataFrame:
    """Pieces of all documents with their place: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    ``ids`` holds little-endian unsigned 32-bit numbers. The filled partitions are written to
    the shared folder once, so every later pass sees the same bins even if executors are lost.
    """
    filled = materialize(documents(docs).mapInArrow(tidy(_fill(tokenizer, end_id, capacity, small)), PIECE), "packed", **{"parquet.block.size": ROW_GROUP})
    left = filled.where("sequence_id IS NULL")
    each = left.groupBy("length", "worker").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("worker")
    each = each.select(
        "length",
        "worker",
        (F.sum("n").over(before) - F.col("n")).alias("before"),
        F.sum("n").over(Window.partitionBy("length")).alias("total"),
    )
    per_bin = F.expr(f"CAST({capacity} DIV length AS BIGINT)")
    left = left.join(each, ["length", "worker"]).withColumn("rank", F.col("before") + F.col("slot"))
    left = left.withColumn("bin", F.expr(f"rank DIV ({capacity} DIV length)"))
    full = (F.col("bin") + 1) * per_bin <= F.col("total")
    columns = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    again = left.where(full).withColumns(
        {
            "sequence_id": F.lit(LEFT) + F.col("length") * F.lit(1 << 40) + F.col("bin"),
            "offset": (F.col("rank") % per_bin) * F.col("length"),
        }
    )
    tail = left.where(~full).orderBy(F.desc("length"), "rank").coalesce(1).select(*FIELDS).mapInArrow(tidy(_tail(capacity)), PIECE)
    return filled.where("sequence_id IS NOT NULL").select(columns).unionByName(again.select(columns)).unionByName(tail.select(columns))
