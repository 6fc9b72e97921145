"""Spelling variants: words one letter apart, found through numbered trie nodes.

Words are the nodes' paths in two tries, one over the words and one over the reversed words. A
prefix and a suffix are then two integers, and two words are one letter apart exactly if they meet
in such a pair:

* a replaced letter: both skip one position between the same prefix and suffix node;
* an inserted or deleted letter: the longer word skips a position, the shorter one skips none.
  Skipping any letter of a run of equal ones gives the same shorter word, so only the first counts.

Nodes are numbered by a scan over the sorted words: a word opens new nodes behind the letters that
it shares with its predecessor. The words are dealt out by ranges; each range numbers its own
nodes, and what its first words share with the range before is taken over afterwards. Only one row
per range (its first and last word) reaches the driver for that.

A pair of nodes has at most one word for each letter in between and one for none, so no group
grows with the data, and counts and best neighbours come from the groups without pairs of words.
The last form of a chain is found by doubling the steps; forms are at least ``RATIO`` times as
frequent each time, so chains end, and five rounds reach the end of any chain of 64-bit counts.

Defined cases: a null text has no words; a null ``doc_id`` reads as an empty one where a run's
checksum is formed; rows that repeat id and text count once each; ties between equally frequent
forms go to the smallest word in code-point order; an empty table gives no rows; columns other
than ``doc_id`` and ``text`` are not read. Lengths are in code points.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barline.llm.textops import LEADING, LOWER, UPPER, Words, documents, slices, take, tidy
from barline.session import materialize

LENGTH, OCCURRENCES, RATIO, ERRORS = 6, 5, 5, 199
#: Bytes up to which a word's checksum is joined to its document's by tables.
TABLED = 64
ROUNDS = 5


def letters_only(texts: pa.Array) -> pa.Array:
    """The texts with A-Z lower-cased and all but letters (A-Z, a-z, U+00C0 to U+00FF) as spaces."""
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], np.uint8)[edges[0] : edges[-1]] if edges[-1] > edges[0] else np.zeros(0, np.uint8)
    upper, lead = UPPER[data], data == 0xC3
    letter = upper | LOWER[data] | lead
    letter[1:] |= lead[:-1]
    out = np.where(letter, data + (upper * np.uint8(32)), np.uint8(32))
    return pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(np.ascontiguousarray(edges - edges[0])), pa.py_buffer(out))


def _shift_tables(longest: int) -> np.ndarray:
    """``tables[n, k, b]``: the checksum state ``b << 8 * k`` moved past ``n`` bytes."""
    byte = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
    byte ^= byte[0]  # the change that a byte makes, without the start and end values
    step = np.zeros(256, np.uint32)
    for b in range(256):
        c = b
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        step[b] = c
    out = np.zeros((longest + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(longest):
        out[n + 1] = (out[n] >> np.uint32(8)) ^ step[out[n] & np.uint32(255)]
    return out


def checksums(prefix: np.ndarray, words: Words, text: np.ndarray, code: np.ndarray, heads: list[bytes]) -> np.ndarray:
    """crc32 of ``heads[text] + word`` for each (text, code); ``prefix`` holds the heads' own crc32."""
    tables = _TABLES.setdefault(TABLED, None)
    if tables is None:
        tables = _TABLES[TABLED] = _shift_tables(TABLED)
    raw, edges = words.bytes()
    size = np.diff(edges)
    blob = raw.tobytes()
    own = np.fromiter((zlib.crc32(blob[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())), np.uint32, len(size))
    n, c = size[code], prefix[text]
    short = np.minimum(n, TABLED)
    moved = np.zeros(len(c), np.uint32)
    for k in range(4):
        moved ^= tables[short, k, (c >> np.uint32(8 * k)) & np.uint32(255)]
    out = moved ^ own[code]
    for i in np.flatnonzero(n > TABLED):
        out[i] = zlib.crc32(blob[edges[code[i]] : edges[code[i] + 1]], zlib.crc32(heads[text[i]]))
    return out


_TABLES: dict[int, np.ndarray | None] = {}


def _count(least: int, errors: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            words = Words(letters_only(take(part)))
            if not len(words.codes):
                continue
            size = words.count(LEADING)
            text = np.repeat(np.arange(part.num_rows), np.diff(words.starts))
            wanted = size[words.codes] >= least
            text, code = text[wanted], words.codes[wanted]
            heads = [f"{'' if d is None else d}:".encode() for d in part.column("doc_id").to_pylist()]
            prefix = np.fromiter(map(zlib.crc32, heads), np.uint32, len(heads))
            h = checksums(prefix, words, text, code, heads)
            hit = h % np.uint32(errors) == 0
            plain = np.bincount(code[~hit], minlength=len(words.distinct))
            used = np.flatnonzero(plain)
            changed: Counter[str] = Counter()
            spelt = words.distinct.take(pa.array(code[hit])).to_pylist()
            for word, x in zip(spelt, h[hit].tolist()):
                at = x % len(word)
                if len(word) > least:
                    changed[word[:at] + word[at + 1 :]] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([words.distinct.take(pa.array(used)).cast(pa.string()), pa.array(list(changed), pa.string())]),
                    pa.array(np.concatenate([plain[used], np.fromiter(changed.values(), np.int64, len(changed))])),
                ],
                ["word", "n"],
            )

    return task


def vocabulary(docs: DataFrame, length: int = LENGTH, occurrences: int = OCCURRENCES, errors: int = ERRORS) -> DataFrame:
    """(word, n): words of at least ``length`` letters that occur at least ``occurrences`` times.

    Every run whose checksum with its document's id is divisible by ``errors`` loses a letter.
    """
    each = documents(docs).mapInArrow(tidy(_count(length, errors)), "word string, n long")
    return each.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def shared(a: str, b: str) -> int:
    """How many leading letters two words share."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _open_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per word of a sorted range, the numbers of the nodes on its path; 0 is the root."""
    part = TaskContext.get().partitionId()
    before, path, made = "", [0], part << 40
    for batch in batches:
        out = []
        for word in batch.column("path").to_pylist():
            keep = shared(before, word)
            fresh = len(word) - keep
            path = path[: keep + 1] + list(range(made + 1, made + fresh + 1))
            made += fresh
            before = word
            out.append(path)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([part] * len(out), pa.int64()), pa.array(out, pa.list_(pa.int64()))], [*batch.schema.names, "part", "nodes"]
        )


def _take_over(carried: dict[int, tuple[str, list[int]]]):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for word, part, nodes in zip(*(batch.column(c).to_pylist() for c in ("path", "part", "nodes"))):
                first, ids = carried.get(part, ("", [0]))
                keep = min(shared(first, word) + 1, len(ids))
                out.append(ids[:keep] + nodes[keep:])
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(out, pa.list_(pa.int64()))], ["word", "nodes"])

    return task


def numbered(words: DataFrame, path: Column) -> DataFrame:
    """(word, nodes): the trie nodes on each word's ``path``, from the root on."""
    rows = words.select("word", path.alias("path"))
    ordered = rows.repartitionByRange("path").sortWithinPartitions("path")
    local = materialize(ordered.mapInArrow(_open_nodes, "word string, path string, part long, nodes array<long>"), "nodes")
    ends = local.groupBy("part").agg(F.min("path").alias("first"), F.max("path").alias("last"), F.max_by("nodes", "path").alias("nodes"))
    carried: dict[int, tuple[str, list[int]]] = {}
    before, ids = "", [0]
    for row in ends.orderBy("part").collect():
        taken = ids[: shared(before, row["first"]) + 1]
        carried[row["part"]] = (row["first"], taken)
        keep = min(shared(row["first"], row["last"]) + 1, len(taken))
        before, ids = row["last"], taken[:keep] + row["nodes"][keep:]
    return local.mapInArrow(_take_over(carried), "word string, nodes array<long>")


def _paths(words: DataFrame) -> DataFrame:
    """(id, word, n, p, s): the nodes of each word's prefixes and suffixes.

    The node of the whole word names it; these numbers are in the words' order.
    """
    forward = numbered(words, F.col("word")).withColumnRenamed("nodes", "p")
    back = numbered(words, F.reverse("word")).withColumnRenamed("nodes", "s")
    return words.join(forward, "word").join(back, "word").select(F.element_at("p", -1).alias("id"), "word", "n", "p", "s")


def _meetings(paths: DataFrame) -> DataFrame:
    """(p, s, skip, first, id, n): every pair of nodes around a skipped letter or around none."""
    both = paths.withColumn("len", F.length("word"))
    skips = F.expr(
        "transform(sequence(0, len - 1), i -> struct(p[i] AS p, s[len - i - 1] AS s, true AS skip,"
        " i = 0 OR substring(word, i + 1, 1) <> substring(word, i, 1) AS first))"
    )
    whole = F.expr("transform(sequence(0, len), i -> struct(p[i] AS p, s[len - i] AS s, false AS skip, false AS first))")
    each = both.select("id", "n", F.explode(F.concat(skips, whole)).alias("m"))
    return each.select("m.p", "m.s", "m.skip", "m.first", "id", "n")


def neighbours(words: DataFrame) -> DataFrame:
    """(id, word, n, n_near, near_id, near_n): how many words are near, and the most frequent of them."""
    words = materialize(words.where("word <> ''"), "words")
    paths = materialize(_paths(words), "paths")
    one = F.struct((-F.col("n")).alias("rank"), "id", "first")
    groups = _meetings(paths).groupBy("p", "s").agg(
        F.sort_array(F.collect_list(F.when(F.col("skip"), one))).alias("xs"),
        F.max(F.when(~F.col("skip"), one)).alias("short"),
    )
    groups = groups.where("size(xs) > 1 OR (size(xs) = 1 AND short IS NOT NULL)")
    long = groups.select("*", F.explode("xs").alias("x")).select(
        F.col("x.id").alias("id"),
        F.expr("size(xs) - 1 + int(short IS NOT NULL AND x.first)").alias("near"),
        F.expr("array_min(array(get(filter(xs, y -> y.id <> x.id), 0), IF(x.first, short, NULL)))").alias("best"),
    )
    short = groups.where("short IS NOT NULL").select(
        F.col("short.id").alias("id"), F.expr("size(filter(xs, y -> y.first))").alias("near"), F.expr("get(filter(xs, y -> y.first), 0)").alias("best")
    )
    best = F.min(F.when(F.col("best").isNotNull(), F.struct("best.rank", "best.id")))
    found = long.unionByName(short).groupBy("id").agg(F.sum("near").alias("n_near"), best.alias("best"))
    return paths.join(found, "id", "left").select(
        "id",
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.col("best.id").alias("near_id"),
        (-F.col("best.rank")).alias("near_n"),
    )


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each word of ``words(word, n)``.

    ``form`` is the most frequent near word if it is at least ``ratio`` times as frequent.
    """
    near = materialize(neighbours(words), "near")
    is_form = F.col("near_n").cast("decimal(38,0)") >= F.col("n").cast("decimal(38,0)") * ratio
    links = near.where(is_form).select("id", F.col("near_id").alias("root"))
    for k in range(ROUNDS):
        links = materialize(links, "roots")
        ahead = links.select(F.col("id").alias("root"), F.col("root").alias("further"))
        if k and links.join(ahead, "root", "left_semi").isEmpty():
            break
        links = links.join(ahead, "root", "left").select("id", F.coalesce("further", "root").alias("root"))
    spelt = lambda id, word: near.select(F.col("id").alias(id), F.col("word").alias(word))
    forms = near.where(is_form).select("id", F.col("near_id").alias("form_id"), F.col("near_n").alias("form_n"))
    named = forms.join(links, "id").join(spelt("form_id", "form"), "form_id").join(spelt("root", "root_word"), "root")
    return near.join(named.select("id", "form", "form_n", "root_word"), "id", "left").select(
        "word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n"
    )
