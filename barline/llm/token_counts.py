"""Exact length histogram of encoded documents and suffix sums over it.

Defined cases: a null or empty text has length 0 and counts as a document; repeated rows count
each; an empty table gives an empty histogram; only the text column is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.textops import encoder, slices, take, tidy
from barline.session import materialize

#: Lengths per range of the two-level sums.
SPAN = 4096


def histogram(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(length, n_docs): documents by number of ids, without special ids.

    Each task counts its own lengths before the shuffle.
    """

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(tokenizer)
        for batch in slices(batches, most=8 << 20):
            yield pa.RecordBatch.from_arrays([pa.array(code.lengths(take(batch)), pa.int64())], ["length"])

    each = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(tidy(lengths), "length long")
    return materialize(each.groupBy("length").agg(F.count("*").alias("n_docs")), "histogram")


def with_sums(hist: DataFrame, span: int = SPAN) -> DataFrame:
    """The histogram with, per length L: documents and tokens of documents longer than L, and the totals.

    Suffix sums are taken inside ranges of ``span`` lengths; one row per range carries the sums
    of all longer ranges over. The number of ranges is the longest length over ``span``.
    """
    h = hist.withColumn("part", F.expr(f"length DIV {span}"))
    tokens = F.col("length") * F.col("n_docs")
    parts = h.groupBy("part").agg(F.sum("n_docs").alias("part_docs"), F.sum(tokens).alias("part_tokens"))
    longer = Window.orderBy(F.desc("part"))
    everything = Window.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    parts = parts.select(
        "part",
        (F.sum("part_docs").over(longer) - F.col("part_docs")).alias("carry_docs"),
        (F.sum("part_tokens").over(longer) - F.col("part_tokens")).alias("carry_tokens"),
        F.sum("part_docs").over(everything).alias("total_docs"),
        F.sum("part_tokens").over(everything).alias("total_tokens"),
    )
    inside = Window.partitionBy("part").orderBy(F.desc("length"))
    return (
        h.join(parts, "part")
        .withColumn("docs_over", F.sum("n_docs").over(inside) - F.col("n_docs") + F.col("carry_docs"))
        .withColumn("tokens_over", F.sum(tokens).over(inside) - tokens + F.col("carry_tokens"))
        .select("length", "n_docs", "docs_over", "tokens_over", "total_docs", "total_tokens")
    )


def truncated_total(limit: Column | str = "length") -> Column:
    """Tokens left when every document is cut at ``limit``, for a limit in the histogram."""
    limit = F.col(limit) if isinstance(limit, str) else limit
    return F.col("total_tokens") - F.col("tokens_over") + F.col("docs_over") * limit


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Totals for any limits: docs_over, truncated_total, total_docs, total_tokens per limit.

    A limit between two lengths has the suffix sums of the longest length not above it.
    """
    rows = sums.select("length", "docs_over", "tokens_over", "total_docs", "total_tokens")
    best = rows.agg(
        *[F.max(F.when(F.col("length") <= n, F.struct("length", "docs_over", "tokens_over"))).alias(f"m{i}") for i, n in enumerate(limits)],
        F.max("total_docs").alias("total_docs"),
        F.max("total_tokens").alias("total_tokens"),
    )
    each = F.array(*[F.struct(F.lit(n).cast("bigint").alias("limit"), F.col(f"m{i}").alias("m")) for i, n in enumerate(limits)])
    flat = best.where("total_docs IS NOT NULL").select(F.explode(each).alias("x"), "total_docs", "total_tokens")
    over = F.coalesce("x.m.docs_over", "total_docs")
    return flat.select(
        "x.limit",
        over.alias("docs_over"),
        (F.col("total_tokens") - F.coalesce("x.m.tokens_over", "total_tokens") + over * F.col("x.limit")).alias("truncated_total"),
        "total_docs",
        "total_tokens",
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """Smallest length that at least ``share`` of all documents do not exceed, per share."""
    reached = (F.col("total_docs") - F.col("docs_over")).cast("double")
    best = sums.agg(*[F.min(F.when(reached >= F.col("total_docs") * s, F.col("length"))).alias(f"q{i}") for i, s in enumerate(shares)])
    each = F.array(*[F.struct(F.lit(float(s)).alias("share"), F.col(f"q{i}").alias("length")) for i, s in enumerate(shares)])
    return best.select(F.explode(each).alias("x")).select("x.share", "x.length")
