"""Preference formatting: shared prompt and paired completions with loss masks.

The longest common turn prefix of the chosen and the rejected conversation is rendered once as
the prompt; the remaining turns of each are its completion. The mask of a completion lists the
character ranges that are learnt: text and end mark of every assistant turn; headers and turns
of other roles are masked.

Defined cases: a null role or text is empty; if one conversation is a prefix of the other, or
both are equal, a completion is empty and has no range; a null conversation has no turns;
repeated rows are formatted each by itself; empty tables give no rows; all other columns of the
pairs are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barline.llm.textops import tidy

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
LEARNT = "assistant"
IGNORED = -100


def _header(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"))


def render(turns: Column) -> Column:
    """The text of an array of turns (role, text)."""
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), t["text"], F.lit(CLOSE))), "")


def learnt_ranges(turns: Column) -> Column:
    """Character ranges [start, stop) of ``render(turns)`` that count for the loss."""
    empty = F.expr("CAST(array() AS array<struct<start: int, stop: int>>)")

    def add(state: Column, t: Column) -> Column:
        start = state["at"] + F.length(_header(t))
        stop = start + F.length(t["text"]) + len(CLOSE)
        own = F.array(F.struct(start.alias("start"), stop.alias("stop")))
        return F.struct(stop.alias("at"), F.when(t["role"] == LEARNT, F.concat(state["ranges"], own)).otherwise(state["ranges"]).alias("ranges"))

    begin = F.struct(F.lit(0).alias("at"), empty.alias("ranges"))
    return F.aggregate(turns, begin, add, lambda s: s["ranges"])


def common_turns(a: Column, b: Column) -> Column:
    """Number of leading turns that two conversations share."""
    differs = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), False)
    return F.when(differs == 0, F.size(a)).otherwise(differs - 1).cast("int")


def _clean(turns: Column) -> Column:
    turn = lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text"))
    return F.transform(F.coalesce(turns, F.expr("CAST(array() AS array<struct<role: string, text: string>>)")), turn)


def format_pairs(pairs: DataFrame) -> DataFrame:
    """``pairs`` with chosen and rejected (arrays of role, text) replaced by the formatted columns.

    New columns: prompt_turns, prompt, chosen_text, chosen_learnt, rejected_text, rejected_learnt.
    """
    kept = [c for c in pairs.columns if c not in ("chosen", "rejected")]
    own = pairs.select(*[F.col(f"`{c}`").alias(f"k_{i}") for i, c in enumerate(kept)], _clean(F.col("chosen")).alias("a"), _clean(F.col("rejected")).alias("b"))
    own = own.withColumn("n", common_turns(F.col("a"), F.col("b")))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.size(c))
    own = own.withColumns({"p": F.slice("a", F.lit(1), F.col("n")), "x": rest("a"), "y": rest("b")})
    new = {"prompt_turns": F.col("n"), "prompt": render(F.col("p")), "chosen_text": render(F.col("x")), "chosen_learnt": learnt_ranges(F.col("x")), "rejected_text": render(F.col("y")), "rejected_learnt": learnt_ranges(F.col("y"))}
    return own.select(*[F.col(f"k_{i}").alias(c) for i, c in enumerate(kept) if c not in new], *[v.alias(k) for k, v in new.items()])


def masked_ids(formatted: DataFrame, tokenizer: str) -> DataFrame:
    """Token ids and labels of prompt + completion per side; labels are ``IGNORED`` where masked.

    A token counts for the loss if it lies inside a learnt range of its completion.
    """
    names = [f"{side}_{kind}" for side in ("chosen", "rejected") for kind in ("ids", "labels")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        code = Tokenizer.from_file(tokenizer)
        for batch in batches:
            columns: dict[str, list] = {n: [] for n in names}
            for row in batch.select(["prompt", "chosen_text", "chosen_learnt", "rejected_text", "rejected_learnt"]).to_pylist():
                prompt = code.encode(row["prompt"], add_special_tokens=False).ids
                for side in ("chosen", "rejected"):
                    got = code.encode(row[f"{side}_text"], add_special_tokens=False)
                    ranges = row[f"{side}_learnt"]
                    labels = [i if any(r["start"] <= lo and hi <= r["stop"] for r in ranges) else IGNORED for i, (lo, hi) in zip(got.ids, got.offsets)]
                    columns[f"{side}_ids"].append(prompt + got.ids)
                    columns[f"{side}_labels"].append([IGNORED] * len(prompt) + labels)
            made = [pa.array(columns[n], pa.list_(pa.int32())) for n in names]
            old = [(n, c) for n, c in zip(batch.schema.names, batch.columns) if n not in names]
            yield pa.RecordBatch.from_arrays([c for _, c in old] + made, [n for n, _ in old] + names)

    schema = formatted.drop(*names).schema
    for n in names:
        schema = schema.add(n, T.ArrayType(T.IntegerType()))
    return formatted.mapInArrow(tidy(task), schema)


def conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): the turns of each conversation in order."""
    turn = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    each = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return each.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def stale_pairs(convs: DataFrame) -> DataFrame:
    """Each conversation against itself with its last assistant turn replaced by a stale one.

    The stale text is that of the first assistant turn if there are two or more, else that of
    the turn before. Conversations without an assistant turn give no pair.
    """
    replies = F.filter("turns", lambda t: t["role"] == LEARNT)
    last = F.array_max(F.transform("turns", lambda t, i: F.when(t["role"] == LEARNT, i)))
    rows = convs.withColumns({"replies": replies, "last": last}).where(F.size("replies") > 0)
    before = F.when(F.col("last") > 0, F.element_at("turns", F.greatest(F.col("last"), F.lit(1)))["text"]).otherwise(F.lit(""))
    rows = rows.withColumn("stale", F.when(F.size("replies") > 1, F.element_at("replies", 1)["text"]).otherwise(before))
    swapped = F.transform("turns", lambda t, i: F.when(i == F.col("last"), F.struct(t["role"].alias("role"), F.col("stale").alias("text"))).otherwise(t))
    return rows.select(F.lit("stale").alias("kind"), F.col("conv_id").alias("chosen_id"), F.col("conv_id").alias("rejected_id"), F.col("turns").alias("chosen"), swapped.alias("rejected"))


def sibling_pairs(convs: DataFrame) -> DataFrame:
    """Conversations with the same first turn against the longest of them (the smallest id of equals).

    One pair for each other conversation: linear however many share a first turn.
    """
    rows = convs.withColumn("opening", F.xxhash64(F.element_at("turns", 1)["role"], F.element_at("turns", 1)["text"]))
    best = rows.groupBy("opening").agg(F.max_by("conv_id", F.struct(F.size("turns"), -F.col("conv_id"))).alias("best_id"), F.count("*").alias("n")).where("n > 1")
    best = best.join(rows.select(F.col("conv_id").alias("best_id"), F.col("turns").alias("chosen")), "best_id").drop("n")
    return rows.join(best, "opening").where("conv_id <> best_id").select(F.lit("sibling").alias("kind"), F.col("best_id").alias("chosen_id"), F.col("conv_id").alias("rejected_id"), "chosen", F.col("turns").alias("rejected"))
