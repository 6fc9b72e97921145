"""Repeats are deleted to their ends: every run of lines with enough words, by comparing all runs."""

import random

import pytest

from barline.llm import line_dedup

KINDS = "doc_id long, text string"


def text_of(*counts_and_names):
    return "\n".join(" ".join(f"{name}{i}" for i in range(n)) for n, name in counts_and_names)


def brute(rows, least=50):
    """Per id, the numbers of the lines of any run with ``least`` words that occurred earlier."""
    first, gone = {}, {}
    for doc, text in sorted(rows):
        lines = text.split("\n")
        gone[doc] = set()
        for s in range(len(lines)):
            for e in range(s, len(lines)):
                run = tuple(lines[s : e + 1])
                if sum(len(x.split()) for x in run) < least:
                    continue
                d, last = first.setdefault(run, (doc, e))
                if d != doc or s > last:
                    gone[doc].update(range(s, e + 1))
    return gone


@pytest.mark.parametrize("passage", [((50, "a"), (49, "b")), ((49, "a"), (50, "b")), ((9, "a"), (50, "b"), (20, "c"), (20, "d")), ((30, "a"), (15, "b"), (30, "c"))])
def test_tail_of_a_repeat_goes(spark, passage):
    rows = [(1, text_of(*passage, (40, "x"))), (2, text_of((3, "y"), *passage, (40, "z")))]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, KINDS)).collect()}
    assert got[1].text == rows[0][1]
    assert got[2].text == text_of((3, "y"), (40, "z")) and got[2].words_removed == sum(n for n, _ in passage)


def test_tail_known_from_another_place_than_the_first(spark):
    head, tail = (50, "a"), (30, "b")
    rows = [(1, text_of(head, (40, "x"))), (2, text_of(head, tail, (40, "y"))), (3, text_of(head, tail, (40, "z")))]
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, KINDS)).collect()}
    assert got[2] == text_of(tail, (40, "y")) and got[3] == text_of((40, "z"))


def test_equals_a_comparison_of_all_runs(spark):
    rng = random.Random(3)
    pool = [text_of((rng.choice([1, 5, 13, 24, 49, 50, 60]), f"l{k}_")) for k in range(12)]
    rows = []
    for doc in range(80):
        lines = []
        while len(lines) < 14:
            at = rng.randrange(len(pool))
            lines += pool[at : at + rng.randint(1, 5)]
        rows.append((doc, "\n".join(lines)))
    want = {d: "\n".join(x for i, x in enumerate(t.split("\n")) if i not in brute_of) for (d, t), brute_of in zip(rows, brute(rows).values())}
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, KINDS)).collect()}
    assert got == want
