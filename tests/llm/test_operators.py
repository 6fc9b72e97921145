"""Operators of the llm package against plain Python, and their defined cases."""

import collections
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from barline.llm import attention_quality, components, decontamination, license_scan, line_dedup, near_dedup, packing, preferences, quality_rules, token_counts, warc
from barline.llm.queries import QUERIES, tokenizer
from barline.llm.textops import Encoder

SF = "/root/testdata/sf0.001"
PASSAGE = " ".join(f"passage{i}" for i in range(60))
NOTE = "Licensed under the Apache License, Version 2.0."
ROWS = [
    (1, "alpha beta gamma delta epsilon " * 3 + "\n" + PASSAGE + "\nend", "en", "s", 1),
    (2, PASSAGE + "\n" + " ".join(f"own{i}" for i in range(80)), None, None, None),
    (2, PASSAGE + "\n" + " ".join(f"own{i}" for i in range(80)), None, None, None),
    (3, None, "en", "s", 0),
    (4, "", "en", "s", 0),
    (5, " \n\t ", "en", "s", 3),
    (6, " ".join(f"w{i % 977}" for i in range(60_000)), "en", "s", 9),
    (7, "one two", "en", "s", 7),
    (8, "One  TWO", "en", "s", 7),
    (None, NOTE + " " + PASSAGE, "en", "s", 7),
    (None, None, None, None, None),
    (9, f"{NOTE} <|endoftext|> GNU General Public License cc by mit license ÉÀß Kelvin", "en", "s", 7),
]
NAMES = ["doc_id", "text", "lang", "source", "n_chars"]
KINDS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves.
CLASHES = ("key", "score", "id", "component", "runs", "start", "length", "hits", "__lines")


@pytest.fixture(scope="module")
def edge(spark):
    df = spark.createDataFrame(ROWS, KINDS)
    return df.withColumns({c: F.lit("x") for c in CLASHES})


@pytest.fixture(scope="module")
def none(edge):
    return edge.where("false")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    code = Tokenizer.from_file(tokenizer())
    return lambda text: code.encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_tokenizer(ids):
    words = ["don't", "ÀÉ,", "éa", "x" * 300, "<|endoftext|>a", "12.5%", "Kelvin", "İ", "naïve!!", "日本語", "a b", "ﬁne", "ª½"]
    check_encoder(Encoder(tokenizer()), words, ids)


def check_encoder(code, texts, ids):
    array = pa.array(texts, pa.large_string())
    got, starts = code.ids(array)
    for text, lo, hi in zip(texts, starts[:-1], starts[1:]):
        assert got[lo:hi].tolist() == ids(text), text
    assert code.lengths(array).tolist() == [len(ids(t)) for t in texts]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_of_any_vocabulary(name, docs, monkeypatch):
    """A vocabulary whose ids hold white space goes through the full tokenizer; the memory of words may be small."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(Encoder, "CACHE", 50)
    full, code = Tokenizer.from_file(tokenizer(name)), Encoder(tokenizer(name))
    assert code.wordwise == (name == "word_bpe_49k.json")
    texts = [r.text for r in docs.select("text").limit(60).collect()] + ["", " a  b\n", "it's 'S don't''s"]
    check_encoder(code, texts, lambda t: full.encode(t, add_special_tokens=False).ids)


def test_packing_with_another_vocabulary(spark, docs):
    from tokenizers import Tokenizer

    name = tokenizer("byte_bpe_50k.json")
    full = Tokenizer.from_file(name)
    some = docs.limit(40)
    want = {r.doc_id: len(full.encode(r.text or "", add_special_tokens=False).ids) for r in some.collect()}
    got = packing.pack(some, name).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n - 1 for r in got} == want
    hist = {r.length: r.n_docs for r in token_counts.histogram(some, name).collect()}
    assert hist == dict(collections.Counter(want.values()))


def check_packing(df, rows, ids):
    got = packing.pack(df, tokenizer()).toPandas()
    pieces = collections.defaultdict(list)
    for r in got.sort_values("start").itertuples():
        pieces[None if r.doc_id != r.doc_id else int(r.doc_id)].append(r)
    want = collections.Counter()
    for doc, text in rows:
        want[doc] += len(ids(text)) + 1
    assert {d: sum(p.length for p in v) for d, v in pieces.items()} == dict(want)
    for doc, text in rows:
        if [d for d, _ in rows].count(doc) == 1:
            whole = np.array(ids(text) + [2], "<u4").tobytes()
            assert b"".join(bytes(p.ids) for p in pieces[doc]) == whole
            assert all(p.doc_tokens == len(whole) // 4 for p in pieces[doc])
    padding = 0
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 4096
        n = int(g.length.sum())
        padding += 0 if n & (n - 1) == 0 else 4096 - n
    return padding / max(1, got.length.sum())


def test_packing(docs, edge, none, ids):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert check_packing(docs, rows, ids) < 0.01
    assert check_packing(docs.repartition(7), rows, ids) < 0.01
    check_packing(edge, [(r[0], r[1]) for r in ROWS], ids)
    assert packing.pack(none, tokenizer()).count() == 0


def test_piece_lengths_add_up():
    sizes = packing.shares()
    for n in (1, 2, 4095, 4096, 4097, 12_345):
        assert sum(packing.cut(n, sizes)) == n


def test_histogram(docs, edge, none, ids):
    for df in (docs, edge):
        lengths = np.array([len(ids(r.text)) for r in df.collect()])
        sums = token_counts.with_sums(token_counts.histogram(df, tokenizer()), span=64).cache()
        for r in sums.collect():
            over = lengths[lengths > r.length]
            assert (r.n_docs, r.docs_over, r.tokens_over) == ((lengths == r.length).sum(), len(over), over.sum())
        for r in token_counts.at_limits(sums, [0, 3, 700, 10**6]).collect():
            assert r.truncated_total == np.minimum(lengths, r.limit).sum()
        ordered = np.sort(lengths)
        for r in token_counts.quantiles(sums, [0.25, 0.5, 1.0]).collect():
            assert r.length == ordered[int(np.ceil(r.share * len(ordered))) - 1]
    empty = token_counts.with_sums(token_counts.histogram(none, tokenizer()))
    assert empty.count() == 0 and token_counts.at_limits(empty, [5]).count() == 0


def shingle_set(text, k):
    w = [x.decode() for x in (text or "").encode().lower().split()]
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute_components(rows, k):
    sets = {d: shingle_set(t, k) for d, t in rows if d is not None}
    group = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((group[a], group[b]))
                group = {d: x if g == y else g for d, g in group.items()}
    return sets, group


def test_near_duplicates(spark, docs, edge, none):
    base = [f"t{i}" for i in range(120)]
    chain = [(100 + n, " ".join([*(f"n{j}" for j in range(4 * n)), *base[4 * n :]])) for n in range(6)]
    made = spark.createDataFrame([*chain, *[(200 + i, " ".join([*base[:-1], f"z{i}"])) for i in range(30)]], "doc_id long, text string")
    for df in (docs, made, edge):
        sets, group = brute_components([(r.doc_id, r.text) for r in df.collect()], 4)
        for r in near_dedup.near_duplicates(df, 4).collect():
            if r.doc_id is None:
                assert r.component_id is None and r.kept
            else:
                assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), group[r.doc_id], group[r.doc_id] == r.doc_id)
    left = near_dedup.drop_copies(edge, 4)
    assert left.columns == edge.columns
    assert collections.Counter(r.doc_id for r in left.collect()) == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 9: 1, None: 2}
    assert near_dedup.near_duplicates(none).count() == 0 and near_dedup.drop_copies(none).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (7, 7), (101, 100), (100, 103)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_licenses(text):
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x80" else c for c in text or "")) if x]
    places, labels = [], set()
    for label, phrase in license_scan.PHRASES:
        p = phrase.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_license_scan(spark, docs, edge, none):
    for df in (docs, edge):
        text = collections.defaultdict(list)
        for r in df.collect():
            text[r.doc_id].append(brute_licenses(r.text))
        for r in license_scan.scan(df).collect():
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) in text[r.doc_id]
            assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    near = [(1, "this work is licensed under the new gnu general public license version 3"), (2, "under the mit of the work is released"), (3, "Licensed under CC BY-NC 4.0!")]
    got = {r.doc_id: r for r in license_scan.scan(spark.createDataFrame(near, "doc_id long, text string")).collect()}
    assert got[1].labels == "gpl,gpl-3.0" and got[2].labels == "" and "cc-by-nc-4.0" in got[3].labels
    assert license_scan.scan(none).count() == 0
    assert "Python" not in license_scan.scan(docs)._jdf.queryExecution().toString()


def test_line_dedup(edge, none):
    got = {}
    for r in line_dedup.clean(edge).collect():
        got.setdefault(r.doc_id, []).append(r.text)
    own = ROWS[1][1].split("\n")[1]
    assert got[1] == [ROWS[0][1]] and got[2] == [own, own]
    assert got[3] == [None] and got[4] == [""] and got[None] == [ROWS[9][1], None]
    assert line_dedup.clean(edge).columns == edge.columns
    assert line_dedup.clean(none).count() == 0


def test_line_dedup_inside_one_text(spark):
    line = " ".join(f"a{i}" for i in range(20))
    df = spark.createDataFrame([(1, "\n".join([line] * 9)), (2, f"x\n{line}\n\n{line}\n{line} \ny")], "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert got[1].text == "\n".join([line] * 3) and got[1].n_removed == 6
    assert got[2].text == "x\n\ny" and got[2].words_removed == 60


def test_attention_learns(spark, docs):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    more = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = attention_quality.score(more, attention_quality.fit(more, labels)).join(labels, "doc_id").where("held_out").toPandas()
    rank = got.score.rank()
    good = got.quality == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / (good.sum() * (~good).sum())
    assert auc > 0.95
    assert (got.held_out == [zlib.crc32(str(d).encode()) % 5 == 0 for d in got.doc_id]).all()


def test_attention_gradient():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, attention_quality.FEATURES)).astype(np.float32)
    first = np.arange(0, 401, 4)
    y = (x[:, 0].reshape(-1, 4).max(1) > 1).astype(np.float32)
    model = attention_quality.train(x, first, y, epochs=150)
    s = model.forward((x - model.centre) / model.scale, first)[0]
    assert ((s > 0) == (y > 0)).mean() > 0.95


def test_attention_cases(spark, edge, none):
    few = spark.createDataFrame([(1, 1, 0), (None, 0, 0), (2, None, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")
    model = attention_quality.fit(edge, few)
    got = attention_quality.score(edge, model).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert all(not r.held_out for r in got if r.doc_id is None)
    assert attention_quality.fit(none, few.where("false")).prior == 0.5
    both = few.union(spark.createDataFrame([(7, 0, 0), (9, 0, 0)], few.schema))
    kept = attention_quality.keep(edge, attention_quality.fit(edge, both), 0.0)
    assert kept.columns == edge.columns and kept.count() == len(ROWS)
    assert attention_quality.keep(none, model).count() == 0


def test_rule_order_and_verdict(edge, none):
    rules = quality_rules.RULES
    costs = [(r.name, float(i + 1), i) for i, r in enumerate(rules)]
    assert quality_rules.ordered(rules, costs)[-1].name == rules[0].name
    got = quality_rules.judge(edge).collect()
    again = quality_rules.judge(edge, rules[::-1]).collect()
    assert got == again and len(got) == len(ROWS)
    assert quality_rules.judge(none).count() == 0 and quality_rules.estimates(none).count() == 0
    assert {r.rule for r in quality_rules.estimates(edge).collect()} == {r.name for r in rules}


def test_warc_round_trip(spark):
    page = "<p>" + "é" * 80 + "</p>"
    rows = [(3, "u", page), (1, None, page), (1, None, page), (2, "a\r\nb", None), (5, "u", "short"), (6, "u", "short"), (None, "u", page), (9, "v", "z" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    path = warc.shared_dir(spark, "warc")
    warc.write_archives(df, path, archive_bytes=1000)
    got = warc.read_archives(spark, path).collect()
    assert all(r.problem is None for r in got)
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got)
    assert kinds == [(0, "revisit", 1), (1, "response", None), (1, "response", None), (2, "response", None), (3, "revisit", 1), (5, "response", None), (6, "response", None), (9, "response", None)]
    whole = {r.page_id: r.payload.decode() for r in got if r.record_type == "response"}
    assert whole == {1: page, 2: "", 5: "short", 6: "short", 9: "z" * 300_000}
    assert warc.round_trip(df.where("false")).count() == 0


def test_warc_faults():
    good = warc.record(7, "u", b"x" * 50, __import__("hashlib").sha256(b"x" * 50).hexdigest(), None)
    assert warc.parse(good)["problem"] is None and warc.parse(good)["payload"] == b"x" * 50
    assert "block" in warc.parse(good[:-5])["problem"]
    assert "digest" in warc.parse(good.replace(b"xxx", b"xyx", 1))["problem"]
    assert "missing" in warc.parse(good.replace(b"WARC-Date", b"Other"))["problem"]
    assert warc.parse(b"junk")["problem"] == "no WARC header"
    samples = [f"record {i} of many with a common body and header {i * 7}".encode() * 3 for i in range(200)]
    raw = zstandard.train_dictionary(2048, samples).as_bytes()
    pack = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=True)
    for body in (raw, zstandard.compress(raw)):
        data = struct.pack("<II", warc.DICTIONARY_MAGIC, len(body)) + body + pack.compress(samples[0]) + warc.SEPARATOR.encode() + pack.compress(samples[1])
        assert list(warc.frames(data)) == samples[:2]
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.frames(data[:-3]))


def test_decontamination(spark, edge, none):
    items = [(1, PASSAGE), (2, None), (3, "one two"), (4, PASSAGE + " " + " ".join(f"q{i}" for i in range(200))), (5, " ".join(f"own{i}" for i in range(40, 60))), (5, " ".join(f"own{i}" for i in range(40, 60)))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.matches(edge, bench).collect()}
    assert got == {(1, 1), (2, 1), (2, 5), (None, 1)}
    left = decontamination.drop_matches(edge, bench)
    assert left.columns == edge.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 3, 4, 5, 6, 7, 8, 9]
    assert decontamination.matches(none, bench).count() == 0 and decontamination.matches(edge, bench.where("false")).count() == 0


def test_preferences(spark):
    turn = lambda role, text: {"role": role, "text": text}
    a = [turn("user", "q"), turn("assistant", "yes"), turn("user", "so"), turn("assistant", "é")]
    b = [turn("user", "q"), turn("assistant", "no")]
    rows = [(1, a, b, "x"), (2, a, a, "x"), (3, None, b, "x"), (4, [turn(None, None)], [], "x"), (2, a, a, "x")]
    kind = "array<struct<role: string, text: string>>"
    df = spark.createDataFrame(rows, f"pair long, chosen {kind}, rejected {kind}, prompt string")
    got = {r.pair: r for r in preferences.format_pairs(df).collect()}
    assert preferences.format_pairs(df).count() == 5
    r = got[1]
    assert r.prompt_turns == 1 and r.prompt == "<|im_start|>user\nq<|im_end|>\n"
    assert [r.chosen_text[x.start : x.stop] for x in r.chosen_learnt] == ["yes<|im_end|>\n", "é<|im_end|>\n"]
    assert [r.rejected_text[x.start : x.stop] for x in r.rejected_learnt] == ["no<|im_end|>\n"]
    assert got[2].chosen_text == "" and got[2].chosen_learnt == [] and got[3].prompt_turns == 0
    import public_tokenizers

    one = preferences.masked_ids(preferences.format_pairs(df), public_tokenizers.path("byte_bpe_50k.json")).where("pair = 1").first()
    from tokenizers import Tokenizer

    code = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    learnt = [i for i in one.rejected_labels if i != preferences.IGNORED]
    assert code.decode(one.rejected_ids) == r.prompt + r.rejected_text and code.decode(learnt) == "no<|im_end|>\n"
    assert preferences.format_pairs(df.where("false")).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
@pytest.mark.parametrize("name", ["op1_preference_format", "op3_minhash_near_dedup", "op4_license_scan", "op5_line_dedup", "op7_quality_rules", "op8_warc_zstd", "op9_decontamination"])
def test_query_equals_sql(spark, name):
    import duckdb

    import __spark_entry__ as entry
    from check import canonical

    con = duckdb.connect()
    for t in entry.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)
