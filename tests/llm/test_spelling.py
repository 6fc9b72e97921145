"""Spelling variants against plain Python; ranges are kept apart so that nodes are taken over."""

import collections
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from barline.llm import spelling
from barline.llm.textops import Words
from tests.llm.test_operators import ROWS, docs, edge, none  # noqa: F401

RUNS = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture
def apart(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def brute_words(rows):
    n = collections.Counter()
    for doc, text in rows:
        for run in RUNS.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def one_apart(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a[i + 1 :] == (b[i + 1 :] if len(a) == len(b) else b[i:])


def brute_variants(n):
    near = collections.defaultdict(list)
    for a, b in itertools.combinations(n, 2):
        if one_apart(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for a, others in near.items():
        best = min(others, key=lambda w: (-n[w], w))
        if n[best] >= 5 * n[a]:
            form[a] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return sorted(out, key=str)


def test_variants_of_dense_words(apart):
    """Many words over two letters, with runs of equal letters, prefixes of each other and chains of forms."""
    rng = np.random.default_rng(3)
    words = {"".join(rng.choice(list("abé"), rng.integers(1, 9))) for _ in range(900)}
    n = {w: int(5 ** rng.integers(0, 9)) for w in sorted(words)} | {"z" * 2_000: 7, "z" * 2_001: 700, "z" * 2_002: 5_000_000_000}
    df = apart.createDataFrame(list(n.items()), "word string, n long").repartition(3)
    got = sorted(map(tuple, spelling.variants(df).collect()), key=str)
    assert got == brute_variants(n)
    assert {r[2] for r in got if r[0] == "z" * 2_000} == {"z" * 2_002}


def test_nodes_are_the_same_for_equal_prefixes_only(apart):
    rng = np.random.default_rng(4)
    words = sorted({"".join(rng.choice(list("ab"), rng.integers(1, 12))) for _ in range(600)} | {"x" * 300 + c for c in "abc"})
    df = apart.createDataFrame([(w,) for w in words], "word string").repartition(5)
    rows = spelling.numbered(df, df["word"]).collect()
    assert sorted(r.word for r in rows) == words
    by_prefix = {(r.word[:i], node) for r in rows for i, node in enumerate(r.nodes)}
    assert len(by_prefix) == len({p for p, _ in by_prefix}) == len({x for _, x in by_prefix})
    last = [r.nodes[-1] for r in sorted(rows, key=lambda r: r.word)]
    assert last == sorted(last)


def test_chains_of_many_forms(spark):
    words = [("q" * 6 + "abcdefghijklmnopqrst"[:i], 5 * 5**i) for i in range(21)]
    got = {r.word: r.root for r in spelling.variants(spark.createDataFrame(words, "word string, n long")).collect()}
    assert set(got.values()) == {words[-1][0]} and len(got) == 21


def test_vocabulary_and_edge_rows(spark, edge, none):  # noqa: F811
    text = "Straße straßen STRASSEN naïveté ÉCOLES écoles über×÷lang x" + "y" * 90 + " don't_stop "
    rows = [(i, text * (1 + i % 3)) for i in range(400)] + [(None, text), (None, None), (401, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute_words(rows)
    assert {r.word: r.n for r in spelling.vocabulary(df).collect()} == want and len(want) > 8
    assert {r.word: r.n for r in spelling.vocabulary(edge).collect()} == brute_words([r[:2] for r in ROWS])
    assert spelling.variants(spelling.vocabulary(none)).count() == 0


def test_checksums():
    texts = pa.array(["abc é" + "d" * 200, "", "abc"], pa.large_string())
    words = Words(texts)
    heads = [b"17:", b":", b"-9:"]
    text = np.repeat(np.arange(3), np.diff(words.starts))
    prefix = np.array([zlib.crc32(h) for h in heads], np.uint32)
    got = spelling.checksums(prefix, words, text, words.codes, heads)
    want = [zlib.crc32(heads[t] + words.distinct[c].as_py().encode()) for t, c in zip(text.tolist(), words.codes.tolist())]
    assert got.tolist() == want
