"""Helpers used inside tasks: word tables of Arrow batches, shingle hashes, minima, token ids."""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GOLDEN = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD6E8FEB86659FD93)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, *extra: str) -> DataFrame:
    """``doc_id`` and ``text`` of ``df`` with fixed types; other columns are pruned from the scan."""
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)


def tidy(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """``task``, returning the Arrow memory that it has freed: a worker process lives on after its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        pa.default_memory_pool().release_unused()

    return run


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in pieces of about ``most`` bytes of ``column``; a longer text is a piece of its own."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(size, dtype=np.int64) // most
        edges = np.flatnonzero(np.diff(part)) + 1
        for lo, hi in zip([0, *edges], [*edges, batch.num_rows]):
            yield batch.slice(int(lo), int(hi - lo))
        pa.default_memory_pool().release_unused()


def take(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """A text column with nulls as empty texts."""
    col = batch.column(column)
    return pc.fill_null(col.cast(pa.large_string()), "")


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * STEP
    x = x ^ (x >> np.uint64(29))
    x = x * GOLDEN
    return x ^ (x >> np.uint64(32))


def byte_class(members: str) -> np.ndarray:
    """A table of 256 flags for ASCII characters."""
    out = np.zeros(256, bool)
    out[list(members.encode("ascii"))] = True
    return out


UPPER, LOWER, DIGITS = byte_class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), byte_class("abcdefghijklmnopqrstuvwxyz"), byte_class("0123456789")
#: First bytes of characters in UTF-8; bytes of characters beyond ASCII.
LEADING = (np.arange(256) & 0xC0) != 0x80
BEYOND = np.arange(256) >= 0x80


class Words:
    """Words of several texts: distinct words, a code per place, and where each text starts.

    Words are maximal runs without space, tab, line feed, vertical tab, form feed and
    carriage return.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        lists = pc.ascii_split_whitespace(texts)
        flat = lists.flatten()
        edges = lists.offsets.to_numpy().astype(np.int64)
        edges -= edges[0]
        full = pc.greater(pc.binary_length(flat), 0)
        kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
        flat = flat.filter(full)
        coded = (pc.ascii_lower(flat) if lower else flat).dictionary_encode()
        self.distinct: pa.Array = coded.dictionary
        self.codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.starts = kept[edges]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each distinct word, the same in every process."""
        if not len(self.distinct):
            return np.zeros(0, np.uint64)
        return pd.util.hash_array(self.distinct.to_numpy(zero_copy_only=False), categorize=False)

    def bytes(self) -> tuple[np.ndarray, np.ndarray]:
        """The UTF-8 bytes of the distinct words and where each word starts."""
        _, edges, data = self.distinct.buffers()
        edges = np.frombuffer(edges, np.int64)[self.distinct.offset : self.distinct.offset + len(self.distinct) + 1] if len(self.distinct) else np.zeros(1, np.int64)
        return (np.frombuffer(data, np.uint8) if edges[-1] else np.zeros(0, np.uint8)), edges

    def count(self, wanted: np.ndarray) -> np.ndarray:
        """Per distinct word, its bytes of a class; ``wanted`` is a table of 256 flags."""
        data, edges = self.bytes()
        run = np.concatenate([[0], np.cumsum(wanted[data[edges[0] : edges[-1]]], dtype=np.int64)])
        return run[edges[1:] - edges[0]] - run[edges[:-1] - edges[0]]

    def total(self, value: np.ndarray) -> np.ndarray:
        """Per text, the sum of ``value[word]`` over its words."""
        run = np.concatenate([[0], np.cumsum(value[self.codes])])
        return run[self.starts[1:]] - run[self.starts[:-1]]


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, ... (count[0] of them), first[1], ..."""
    out = np.ones(int(count.sum()), np.int64)
    if not len(out):
        return out
    first, count = first[count > 0], count[count > 0]
    at = np.concatenate([[0], np.cumsum(count)[:-1]])
    out[at] = first - np.concatenate([[0], first[:-1] + count[:-1] - 1])
    return np.cumsum(out)


def shingles(words: Words, k: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``k``-word shingles and where each text's hashes start.

    A text with fewer words has its whole sequence as the one shingle (none with
    ``short=False``); a text without words has none.
    """
    per_word = words.hashes()[words.codes]
    n = np.diff(words.starts)
    count = np.where(n >= k, n - k + 1, ((n > 0) & short).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(count)])
    places = max(0, len(per_word) - k + 1)
    rolled = np.zeros(places, np.uint64)
    for i in range(k):
        rolled *= GOLDEN
        rolled += per_word[i : i + places]
    out = np.zeros(starts[-1], np.uint64)
    long = n >= k
    at = ranges(starts[:-1][long], count[long])
    out[at] = rolled[ranges(words.starts[:-1][long], count[long])]
    if short:
        for d in np.flatnonzero((n > 0) & (n < k)):
            h = np.uint64(n[d])
            with np.errstate(over="ignore"):
                for w in per_word[words.starts[d] : words.starts[d + 1]]:
                    h = h * STEP + w
            out[starts[d]] = h
    return mix(out), starts


class MinHash:
    """``size`` multiply-shift hash functions and their minima over ranges of a hash array."""

    BLOCK = 1 << 16

    def __init__(self, size: int, seed: int = 1):
        draw = np.random.default_rng(seed).integers(0, 2**63, (2, size), dtype=np.uint64)
        self.factor, self.shift, self.size = draw[0] * np.uint64(2) + np.uint64(1), draw[1], size

    def minima(self, hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One row of 32-bit minima per range; ranges must not be empty."""
        rows = len(starts) - 1
        out = np.full((rows, self.size), 0xFFFFFFFF, np.uint32)
        for lo in range(0, len(hashes), self.BLOCK):
            part = hashes[lo : lo + self.BLOCK]
            first = int(np.searchsorted(starts, lo, "right")) - 1
            last = int(np.searchsorted(starts, lo + len(part), "left"))
            at = np.maximum(starts[first:last] - lo, 0)
            value = np.empty_like(part)
            for i in range(self.size):
                np.multiply(part, self.factor[i], out=value)
                value += self.shift[i]
                value >>= np.uint64(32)
                low = np.minimum.reduceat(value, at).astype(np.uint32)
                np.minimum(out[first:last, i], low, out=out[first:last, i])
        return out


class Encoder:
    """Token ids of texts.

    With a vocabulary of whole words (``WORDWISE``), the normalizer and pre-tokenizer never join two
    words, so each distinct word is encoded once. Plain words with trailing punctuation are taken
    apart; their letters and their punctuation go to the model itself, other words through the full
    tokenizer. Encoded letters are kept per process in two generations of ``CACHE`` entries each
    (about 200 bytes an entry); the older one goes when the younger one is full. With any other
    vocabulary, whole texts go through the full tokenizer.
    """

    CACHE = 80_000
    SAFE = r"^[!-~À-ÖØ-öø-ÿ]+$"
    PLAIN = r"^(?P<letters>[a-zß-öø-ÿ]+)(?P<marks>[!-/:-@\[-`{-~]*)$"
    #: The configuration for which words can be encoded one by one.
    WORDWISE = {
        "normalizer": {
            "type": "Sequence",
            "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
        },
        "pre_tokenizer": {
            "type": "Sequence",
            "pretokenizers": [
                {
                    "type": "Split",
                    "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
                    "behavior": "Removed",
                    "invert": True,
                },
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
    }

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        self.byte_names = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.wordwise = self._is_wordwise()

    def _is_wordwise(self) -> bool:
        told = json.loads(self.tokenizer.to_str())
        plain = re.compile(r"[a-zß-öø-ÿ]*[!-/:-@\[-`{-~]*")
        apart = all(len(t["content"].split()) == 1 and not plain.fullmatch(t["content"].lower()) for t in told["added_tokens"])
        return apart and told["model"]["type"] == "BPE" and all(told[k] == v for k, v in self.WORDWISE.items())

    def part(self, s: str) -> bytes:
        """Ids of one run of letters or of punctuation, 4 bytes each."""
        got = self.young.get(s)
        if got is None:
            got = self.old.get(s)
            if got is None:
                named = s if s.isascii() else s.encode().decode("latin-1").translate(self.byte_names)
                got = array("I", [x.id for x in self.tokenizer.model.tokenize(named)]).tobytes()
            if len(self.young) >= self.CACHE:
                self.old, self.young = self.young, {}
            self.young[s] = got
        return got

    def _coded(self, words: Words) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Per distinct word the numbers of its one or two parts, and all parts; part 0 is empty."""
        spelt = words.distinct
        taken = pc.extract_regex(pc.utf8_lower(spelt), self.PLAIN)
        plain = pc.and_(pc.match_substring_regex(spelt, self.SAFE), taken.is_valid()).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(plain)
        first, second = np.zeros(len(spelt), np.int64), np.zeros(len(spelt), np.int64)
        parts = [b""]
        for out, field in ((first, 0), (second, 1)):
            coded = taken.field(field).take(pa.array(at)).dictionary_encode()
            out[at] = coded.indices.to_numpy(zero_copy_only=False) + len(parts)
            parts += [self.part(s) if s else b"" for s in coded.dictionary.to_pylist()]
        at = np.flatnonzero(~plain)
        first[at] = np.arange(len(parts), len(parts) + len(at))
        parts += [array("I", self.tokenizer.encode(s, add_special_tokens=False).ids).tobytes() for s in spelt.take(pa.array(at)).to_pylist()]
        return first, second, parts

    def _whole(self, texts: pa.Array) -> Iterator[list[int]]:
        for lo in range(0, len(texts), 64):
            for x in self.tokenizer.encode_batch(texts[lo : lo + 64].to_pylist(), add_special_tokens=False):
                yield x.ids

    def lengths(self, texts: pa.Array) -> np.ndarray:
        if not self.wordwise:
            return np.fromiter(map(len, self._whole(texts)), np.int64, len(texts))
        words = Words(texts)
        first, second, parts = self._coded(words)
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        return words.total(size[first] + size[second])

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids as unsigned 32-bit numbers, and where each text's ids start."""
        if not self.wordwise:
            each = [np.array(x, np.uint32) for x in self._whole(texts)]
            return np.concatenate([np.zeros(0, np.uint32), *each]), np.cumsum([0, *map(len, each)])
        words = Words(texts)
        first, second, parts = self._coded(words)
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        # The ids of every distinct word side by side, then the words' own ranges of them.
        both = np.stack([first, second], axis=1).ravel()
        own = np.frombuffer(b"".join(parts), np.uint32)[ranges(begin[both], size[both])]
        each = size[first] + size[second]
        start = np.concatenate([[0], np.cumsum(each)[:-1]]) if len(each) else each
        n = words.total(each)
        return own[ranges(start[words.codes], each[words.codes])], np.concatenate([[0], np.cumsum(n)])


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
