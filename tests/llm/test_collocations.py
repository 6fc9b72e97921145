"""Phrase collocations against plain Python; small ranges, so that phrases lie across their borders."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from barline.llm import collocations
from tests.llm.test_operators import ROWS, docs, edge, none  # noqa: F401

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def grams(text):
    for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
        words = re.findall(r"[^\x20\x09]+", piece)
        for i in range(len(words)):
            for k in range(1, min(4, len(words) - i) + 1):
                yield tuple(words[i : i + k])


def brute_counts(rows, least):
    n = collections.defaultdict(collections.Counter)
    for text, lang in rows:
        n[lang or "und"].update(grams(text))
    out = {(lang, "", 0): sum(c for p, c in f.items() if len(p) == 1) for lang, f in n.items()}
    out |= {(lang, " ".join(p), len(p)): c for lang, f in n.items() for p, c in f.items() if c >= least}
    return {k: v for k, v in out.items() if v}


def brute(rows, least, top):
    counts, out = brute_counts(rows, least), []
    for lang in {k[0] for k in counts}:
        f = {tuple(p.split(" ")): a for (x, p, k), a in counts.items() if x == lang and k}
        scored = []
        for p, a in f.items():
            if len(p) < 2 or any(
                len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= 80 * a for q, b in f.items()
            ):
                continue
            score, cut = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), f[p[:cut]], f[p[cut:]]))
        for i, (s, a, p, l, r) in enumerate(sorted(scored)[:top]):
            out.append((lang, i + 1, p.decode(), -a, l, r, counts[lang, "", 0], -s))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocabulary = ["New", "York", "the", "of", "city", "é", "x#y", "Z", "\x01", "aa"]
    out = []
    for i in range(500):
        words = rng.choices(vocabulary, [9, 9, 30, 20, 5, 3, 2, 1, 1, 1], k=rng.randrange(0, 60))
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", " ! "]) for w in words)
        out.append((text, rng.choice(["en", "en", "de", None, "und", "fr"])))
    return out + [("the of the of the", "en")] * 400 + [(None, "en"), ("", None), ("only once", "rare")]


@pytest.mark.parametrize("places", [200, 1 << 20])
def test_counts_and_ranks(spark, rows, places):
    df = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    texts = df.fillna("und", ["lang"])
    known = collocations.frequent_words(texts, 30)
    assert places > 200 or len(collocations.splitters(texts, lambda: known, places)) > 20
    got = {(r.lang, r.phrase, r.k): r.a for r in collocations.phrase_counts(df, 30, places).collect()}
    assert got == brute_counts(rows, 30)
    ranked = collocations.collocations(df, 30, 25, places)
    assert ranked.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, ranked.collect())) == brute(rows, 30, 25)


def test_slices_with_many_words(monkeypatch):
    """More words than 16 bits name: the places are cut, and suffixes reach over the cuts."""
    monkeypatch.setattr(collocations, "CODES", 50)
    monkeypatch.setattr(collocations, "PLACES", 37)
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(n)) for n in (0, 1, 2, 500, 3)]
    got = collections.Counter()
    total = 0
    for words, keys, weights, n in collocations._pointers("en", pa.array(texts, pa.large_string()), None):
        total += n
        for row, n in zip(collocations._fields(keys).T.tolist(), weights.tolist()):
            got[tuple(words[c - 1].as_py() for c in row if c)] += n
    want = collections.Counter(tuple(t.split()[i : i + 4]) for t in texts for i in range(len(t.split())))
    assert got == want and total == sum(want.values())


def test_full_filter_changes_nothing(rows):
    """Where every position of the filter is taken, the suffixes are those without a filter."""
    known = np.full(collocations.FILTER_BITS // 8, 255, np.uint8)
    texts = pa.array([r[0] for r in rows if r[1] == "en"], pa.large_string())
    free = [(k.tolist(), w.tolist()) for _, k, w, _ in collocations._pointers("en", texts, None)]
    assert free == [(k.tolist(), w.tolist()) for _, k, w, _ in collocations._pointers("en", texts, known)]


def test_quicksort_counts_prefixes():
    rng = np.random.default_rng(2)
    columns = rng.integers(1, 5, (4, 3000))
    columns[2, ::3], columns[3, ::3], columns[3, 1::5] = 0, 0, 0
    weights = rng.integers(1, 4, 3000)
    want = collections.Counter()
    for row, n in zip(columns.T.tolist(), weights.tolist()):
        row = [c for c in row if c]
        for k in range(1, len(row) + 1):
            want[tuple(row[:k])] += n
    got = list(collocations.quicksort(columns, weights, 40))
    assert len(got) == len(dict(got)) and dict(got) == {p: n for p, n in want.items() if n >= 40}


def test_exact_beyond_64_bits(spark, monkeypatch):
    big = 1 << 61
    counts = [("en", "", 0, big), ("en", "a", 1, big), ("en", "b", 1, big - 1), ("en", "a b", 2, big - 3)]
    monkeypatch.setattr(collocations, "phrase_counts", lambda *a: spark.createDataFrame(counts, collocations.COUNTED))
    got = collocations.collocations(None).collect()
    assert [tuple(r) for r in got] == [("en", 1, "a b", big - 3, big, big - 1, big, 2_000_000 * (big - 3) // (2 * big - 1))]


def test_edge_rows(edge, none):  # noqa: F811
    got = {(r.lang, r.phrase, r.k): r.a for r in collocations.phrase_counts(edge, 2).collect()}
    assert got == brute_counts([(r[1], r[2]) for r in ROWS], 2)
    assert collocations.collocations(none).count() == 0
