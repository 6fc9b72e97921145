"""Near-duplicates where ids repeat with other texts, and families of many blocks without a hub."""

import random

import pytest

from barline.llm import near_dedup

KINDS = "doc_id long, text string"


def text(seed, n=60):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(10_000)}" for _ in range(n))


def shingles(t, k):
    w = t.lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def brute_components(rows, k):
    """Per row, the smallest id in its component; a row is a node with its own text."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        low[find(i)] = min(doc, low.get(find(i), doc))
    return [low[find(i)] for i in range(len(rows))]


def test_repeated_ids_with_other_texts(spark):
    a, b = text("a"), text("b")
    near_b = b.rsplit(" ", 1)[0] + " other"
    rows = [(1, a), (1, b), (2, b), (3, a), (4, near_b), (5, text("c")), (5, text("c")), (6, text("d")), (5, text("d"))]
    df = spark.createDataFrame(rows, KINDS)
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df, 4).collect())
    assert got == sorted((d, c, d == c) for (d, _), c in zip(rows, brute_components(rows, 4)))
    left = sorted((r.doc_id, r.text) for r in near_dedup.drop_copies(df, 4).collect())
    assert left == sorted([(1, a), (1, b), (5, text("c")), (5, text("d"))])


@pytest.mark.parametrize("search", [8, 1024])
def test_families_in_many_blocks(spark, search):
    """Chains of texts, each near its neighbours only, so that no member is near all others."""
    rng = random.Random(9)
    rows = []
    for family in range(4):
        words = text(f"f{family}", 80).split()
        for step in range(40):
            rows.append((len(rows) * 7 + rng.randrange(3), " ".join(words)))
            words[(step * 3) % 80] = f"n{family}_{step}"
    rng.shuffle(rows)
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(spark.createDataFrame(rows, KINDS), 4, search).collect()}
    assert got == {d: c for (d, _), c in zip(rows, brute_components(rows, 4))}
