"""Exact duplicates against plain Python, on small digits so that every round runs."""

import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from barline.llm import exact_dedup
from tests.llm.test_operators import ROWS, docs, edge, none  # noqa: F401

SPACES = re.compile(r"[\x20\x09-\x0D]+")


def brute(rows):
    groups = collections.defaultdict(list)
    for doc, text in rows:
        groups[SPACES.sub(" ", text or "")].append(doc)
    out = []
    for text, ids in groups.items():
        ids = sorted(ids, key=lambda x: (x is None, x or 0))
        digest = hashlib.sha256(text.encode()).hexdigest()
        out += [(x, ids[0], len(ids), i == 0, digest) for i, x in enumerate(ids)]
    return sorted(out, key=str)


def result(df, digits):
    got = exact_dedup.groups(df, digits).drop("row")
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("digits", [(3, 5), exact_dedup.DIGITS])
def test_groups(spark, digits):
    stem = "The same beginning of many texts, "
    rows = [(i, stem + "x" * (i % 7)) for i in range(60)] + [(100 + i, stem[:i]) for i in range(20)]
    rows += [(200, "a \t\n b"), (201, "a b"), (202, " a b"), (203, "é\x00"), (204, "é"), (205, "é\x00"), (205, "é\x00")]
    rows += [(None, "a b"), (None, None), (300, ""), (None, "none"), (None, "none"), (301, None), (302, "\x00" * 8), (303, "\x00" * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(df, digits) == brute(rows)


def test_hot_group_over_many_slices(spark):
    """A text of a third of all rows leaves each slice as one representative."""
    rows = [(i, "hot text" if i % 3 else f"text {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    assert result(df, (4, 4)) == brute(rows)


def test_same_bytes():
    rng = np.random.default_rng(1)
    texts = [bytes(rng.integers(0, 2, n).astype(np.uint8)) for n in rng.integers(0, 40, 500)]
    texts += [b"y" * 100_000, b"y" * 100_000, b"y" * 99_999, b"y" * 99_999 + b"z"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    first = exact_dedup.same(data, np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    assert first.tolist() == [texts.index(t) for t in texts]


def test_edge_rows(edge, none):  # noqa: F811
    assert result(edge, exact_dedup.DIGITS) == brute([r[:2] for r in ROWS])
    assert exact_dedup.groups(none).count() == 0
    kept = exact_dedup.drop_copies(edge)
    assert kept.columns == edge.columns and kept.count() == len({SPACES.sub(" ", r[1] or "") for r in ROWS})
    assert exact_dedup.drop_copies(none).count() == 0
    assert kept.where(F.col("text").startswith("passage")).select("doc_id").collect() == [(2,)]
