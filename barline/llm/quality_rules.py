"""Quality rules as a short-circuit cascade.

Every task times each rule and counts its rejections on the first slice of its own rows, then
runs the rules in order of rejections per second; a row that one rule rejects is not shown to
the next. A row is kept if every rule passes, so the order changes the cost and never the
verdict.

Defined cases: a null text has no words and fails the base rule; repeated rows get equal
verdicts; an empty table gives no rows; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.textops import BEYOND, DIGITS, LEADING, LOWER, UPPER, Words, byte_class, documents, mix, slices, take, tidy

SYMBOLS = byte_class("#*$%&|<>")


class Texts:
    """Some texts with measures that are computed when first asked for."""

    def __init__(self, column: pa.Array):
        self.column = column

    def __len__(self) -> int:
        return len(self.column)

    def some(self, rows: np.ndarray) -> Texts:
        return Texts(self.column.take(pa.array(rows)))

    @cached_property
    def words(self) -> Words:
        return Words(self.column)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.words.starts)

    def chars(self, wanted: np.ndarray) -> np.ndarray:
        """Per text, characters of a byte class inside words."""
        return self.words.total(self.words.count(wanted))

    @cached_property
    def word_chars(self) -> np.ndarray:
        return self.chars(LEADING)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self.chars(SYMBOLS)

    @cached_property
    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Lines with a word, and those equal to an earlier line of the text."""
        lists = pc.split_pattern(self.column, "\n")
        coded = lists.flatten().dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        edges = lists.offsets.to_numpy().astype(np.int64)
        text = np.repeat(np.arange(len(self)), np.diff(edges))
        full = pc.match_substring_regex(coded.dictionary, r"[^\x20\x09-\x0D]").to_numpy(zero_copy_only=False)[code]
        code, text = code[full], text[full]
        lines = np.bincount(text, minlength=len(self))
        first = np.unique(text * (len(coded.dictionary) + 1) + code) // (len(coded.dictionary) + 1)
        return lines, lines - np.bincount(first, minlength=len(self))

    @property
    def n_lines(self) -> np.ndarray:
        return self._lines[0]

    @property
    def n_dup_lines(self) -> np.ndarray:
        return self._lines[1]

    @cached_property
    def n_repeat_words(self) -> np.ndarray:
        """Words inside 3-word windows that the text holds twice or more."""
        starts, code = self.words.starts, self.words.codes.astype(np.uint64)
        text = np.repeat(np.arange(len(self)), self.n_words)
        places = max(0, len(code) - 2)
        inside = text[:places] == text[2:]
        key = mix(mix(mix(code[:places]) + code[1 : 1 + places]) + code[2:]) + text[:places].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        at = np.flatnonzero(inside)
        order = at[np.argsort(key[at])]
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(code), bool)
        hit = np.concatenate([order[1:][same], order[:-1][same]])
        for i in range(3):
            twice[hit + i] = True
        run = np.concatenate([[0], np.cumsum(twice)])
        return run[starts[1:]] - run[starts[:-1]]


@dataclass(frozen=True)
class Rule:
    name: str
    passes: Callable[[Texts], np.ndarray]


def base_failed(t: Texts) -> np.ndarray:
    return (t.n_words < 50) | (100 * t.n_repeat_words > 50 * t.n_words)


#: Rules of the cascade, in whole numbers so that every engine decides alike.
RULES = (
    Rule("symbols", lambda t: 10 * t.n_symbols <= t.n_words),
    Rule("word_length", lambda t: (t.word_chars >= 3 * t.n_words) & (t.word_chars <= 10 * t.n_words)),
    Rule("duplicate_lines", lambda t: 2 * t.n_dup_lines <= t.n_lines),
    Rule("letters", lambda t: 10 * t.words.total((t.words.count(UPPER | LOWER | BEYOND) > 0).astype(np.int64)) >= 6 * t.n_words),
    Rule("capitals", lambda t: t.chars(UPPER) <= t.chars(LOWER)),
    Rule("digits", lambda t: 10 * t.chars(DIGITS) <= 3 * t.word_chars),
)


def measure(texts: Texts, rules: tuple[Rule, ...]) -> list[tuple[str, float, int]]:
    """(rule, seconds, rejected) of each rule alone on these texts."""
    out = []
    for rule in rules:
        fresh = Texts(texts.column)
        start = time.perf_counter()
        ok = rule.passes(fresh)
        out.append((rule.name, time.perf_counter() - start, int((~ok).sum())))
    return out


def ordered(rules: tuple[Rule, ...], costs: list[tuple[str, float, int]]) -> tuple[Rule, ...]:
    """Most rejections per second first; rules that reject nothing by their cost."""
    rank = {name: (-rejected / max(seconds, 1e-9), seconds) for name, seconds, rejected in costs}
    return tuple(sorted(rules, key=lambda r: rank[r.name]))


def cascade(texts: Texts, rules: tuple[Rule, ...], alive: np.ndarray) -> np.ndarray:
    """Rows of ``alive`` that pass all rules; each rule sees only the rows that are left."""
    now = texts if len(alive) == len(texts) else texts.some(alive)
    for rule in rules:
        if not len(alive):
            break
        ok = rule.passes(now)
        if not ok.all():
            alive, now = alive[ok], now.some(np.flatnonzero(ok))
    return alive


def estimates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(rule, seconds, rejected, sampled): what the tasks' samples say, summed over tasks."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(slices(batches), None)
        if first is not None:
            rows = measure(Texts(take(first)), rules)
            yield pa.RecordBatch.from_pylist([{"rule": a, "seconds": b, "rejected": c, "sampled": first.num_rows} for a, b, c in rows])

    got = documents(docs).mapInArrow(tidy(task), "rule string, seconds double, rejected long, sampled long")
    return got.groupBy("rule").agg(*[F.sum(c).alias(c) for c in ("seconds", "rejected", "sampled")])


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document: doc_id, base measures, base_failed and kept."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = None
        for batch in slices(batches):
            texts = Texts(take(batch))
            if order is None:
                order = ordered(rules, measure(texts, rules))
            failed = base_failed(texts)
            kept = np.zeros(len(texts), bool)
            kept[cascade(texts, order, np.flatnonzero(~failed))] = True
            values = [pa.array(getattr(texts, n), pa.int64()) for n in names]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *values, pa.array(failed), pa.array(kept)], ["doc_id", *names, "base_failed", "kept"])

    schema = "doc_id long, " + ", ".join(f"{n} long" for n in names) + ", base_failed boolean, kept boolean"
    return documents(docs).mapInArrow(tidy(task), schema)
