"""Registered queries of the operators in this package, and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import attention_quality, collocations, decontamination, exact_dedup, license_scan, line_dedup, near_dedup, packing, preferences, quality_rules, spelling, token_counts, warc
from barline.llm.textops import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return register


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    """Place of a public vocabulary file; it is installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _render(turns: str) -> str:
    return f"array_to_string(list_transform({turns}, lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), '')"


def _ranges(turns: str) -> str:
    at = f"coalesce(list_sum(list_transform({turns}[1:i - 1], lambda y: 24 + length(y.role) + length(y.text))), 0) + 13 + length(x.role)"
    each = f"CASE WHEN x.role = 'assistant' THEN ({at})::BIGINT::VARCHAR || '-' || ({at} + length(x.text) + 11)::BIGINT::VARCHAR END"
    return f"array_to_string(list_filter(list_transform({turns}, lambda x, i: {each}), lambda z: z IS NOT NULL), ',')"


@query(
    "op1_preference_format",
    f"""
WITH c AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations GROUP BY conv_id),
r AS (
  SELECT *, list_filter(turns, lambda x: x.role = 'assistant') AS replies,
    list_max(list_transform(turns, lambda x, i: CASE WHEN x.role = 'assistant' THEN i END)) AS last FROM c),
s AS (
  SELECT *, CASE WHEN len(replies) > 1 THEN replies[1].text WHEN last > 1 THEN turns[last - 1].text ELSE '' END AS stale
  FROM r WHERE len(replies) > 0),
o AS (SELECT *, turns[1].role AS o1, turns[1].text AS o2 FROM c),
best AS (SELECT o1, o2, arg_max(conv_id, struct_pack(n := len(turns), i := -conv_id)) AS best_id FROM o GROUP BY o1, o2 HAVING count(*) > 1),
pairs AS (
  SELECT 'stale' AS kind, conv_id AS chosen_id, conv_id AS rejected_id, turns AS chosen,
    list_transform(turns, lambda x, i: {{'role': x.role, 'text': CASE WHEN i = last THEN stale ELSE x.text END}}) AS rejected FROM s
  UNION ALL
  SELECT 'sibling', best_id, o.conv_id, b.turns, o.turns
  FROM o JOIN best ON o.o1 = best.o1 AND o.o2 = best.o2 JOIN c b ON b.conv_id = best_id WHERE o.conv_id <> best_id),
n AS (
  SELECT *, coalesce(list_min(list_transform(chosen, lambda x, i:
    CASE WHEN i <= len(rejected) AND x.role = rejected[i].role AND x.text = rejected[i].text THEN NULL ELSE i END)) - 1, len(chosen)) AS prompt_turns FROM pairs),
q AS (SELECT *, chosen[1:prompt_turns] AS p, chosen[prompt_turns + 1:] AS a, rejected[prompt_turns + 1:] AS b FROM n)
SELECT kind, chosen_id, rejected_id, prompt_turns::INTEGER AS prompt_turns, {_render('p')} AS prompt,
  {_render('a')} AS chosen_text, {_ranges('a')} AS chosen_learnt, {_render('b')} AS rejected_text, {_ranges('b')} AS rejected_learnt
FROM q
""",
)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stale and sibling pairs of the conversations; ranges as text."""
    convs = preferences.conversations(table(spark, sf_dir, "conversations"))
    got = preferences.format_pairs(preferences.stale_pairs(convs).unionByName(preferences.sibling_pairs(convs)))
    show = lambda c: F.array_join(F.transform(c, lambda r: F.concat_ws("-", r["start"].cast("string"), r["stop"].cast("string"))), ",")
    return got.withColumns({c: show(c) for c in ("chosen_learnt", "rejected_learnt")})


@query("op2_length_histogram")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per encoded length of the documents, as context limit."""
    hist = token_counts.histogram(table(spark, sf_dir, "documents"), tokenizer())
    sums = token_counts.with_sums(hist)
    return sums.select(
        F.col("length").alias("context_limit"),
        "n_docs",
        "docs_over",
        "tokens_over",
        token_counts.truncated_total().alias("truncated_total"),
        ((F.col("total_docs") - F.col("docs_over")) / F.col("total_docs")).alias("quantile"),
        "total_docs",
        "total_tokens",
    )


@query(
    "op3_minhash_near_dedup",
    r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g FROM d, unnest(range(1, greatest(len(w) - 2, 2))) AS u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.id),
k AS (SELECT id, min(c) AS component_id FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM d JOIN k ON k.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
""",
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


_TEMPLATES = ", ".join(f"('{label}', {base}, '{phrase}')" for base, group in ((True, license_scan.PHRASES), (False, license_scan.NOTICES)) for label, phrase in group)


@query(
    "op4_license_scan",
    rf"""
WITH t(label, base, phrase) AS (VALUES {_TEMPLATES}),
tw AS (SELECT label, base, string_split(phrase, ' ') AS w FROM t),
tg AS (SELECT label, base, len(w) - 1 AS grams, i - 1 AS pos, w[i] AS a, w[i + 1] AS b FROM tw, unnest(range(1, len(w))) AS u(i)),
d AS (
  SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT doc_id, i - 1 AS place, w[i] AS x, w[i + 1] AS y FROM d, unnest(range(1, len(w))) AS u(i)),
l AS (
  SELECT doc_id, label, base, grams, place - pos AS diagonal, bit_or((1::BIGINT) << pos::INT) AS votes, min(place) AS low, max(place) + 2 AS high
  FROM g JOIN tg ON x = a AND y = b GROUP BY ALL),
f AS (
  SELECT *, bit_count(votes) = grams AS whole,
    coalesce((diagonal - lag(diagonal) OVER (PARTITION BY doc_id, label ORDER BY diagonal) > {license_scan.GAP})::INT, 1) AS fresh FROM l),
k AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, label ORDER BY diagonal) AS cluster FROM f),
m AS (
  SELECT doc_id, label, base, grams, cluster, bit_or(votes) AS votes, bit_count(bit_or(votes)) AS got, max(high) - min(low) AS size, sum(whole::INT) AS places,
    min(diagonal) FILTER (whole) AS first_place, max(diagonal) FILTER (whole) AS last_place
  FROM k GROUP BY doc_id, label, base, grams, cluster),
v AS (
  SELECT *, got::DOUBLE / grams AS share FROM m
  WHERE places > 0 OR (NOT base AND (votes >> (grams - 1)::INT) & 1 = 1 AND got::BIGINT * 100 >= grams * {license_scan.PERCENT} AND size <= grams + 1 + {license_scan.EXTRA})),
r AS (
  SELECT doc_id, sum(places) FILTER (base) AS n_base, min(first_place) FILTER (base) AS first_word, max(last_place) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM v GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN r ON r.doc_id = d.doc_id
""",
)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


@query(
    "op5_line_dedup",
    rf"""
WITH raw AS (SELECT doc_id, text, i, string_split(coalesce(text, ''), chr(10))[i] AS line FROM documents, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS u(i)),
f AS (
  SELECT doc_id, i, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM raw),
l AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM f WHERE n > 0),
r AS (SELECT a.doc_id, a.j AS first, b.j AS last FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.j >= a.j AND b.run - a.run + a.n >= {line_dedup.WORDS}),
e AS (SELECT doc_id, first, min(last) AS last FROM r GROUP BY doc_id, first UNION SELECT doc_id, max(first), last FROM r GROUP BY doc_id, last),
w AS (
  SELECT e.doc_id, first, last, string_agg(line, chr(10) ORDER BY j) AS passage FROM e JOIN l ON l.doc_id = e.doc_id AND j BETWEEN first AND last GROUP BY 1, 2, 3),
k AS (
  SELECT *, first_value(doc_id) OVER o AS d0, first_value(last) OVER o AS last0, row_number() OVER o AS nth
  FROM w WINDOW o AS (PARTITION BY passage ORDER BY doc_id, first)),
gone AS (
  SELECT DISTINCT l.doc_id, l.i, l.n FROM k JOIN l ON l.doc_id = k.doc_id AND l.j BETWEEN first AND last
  WHERE nth > 1 AND (k.doc_id <> d0 OR first > last0)),
t AS (
  SELECT raw.doc_id, string_agg(raw.line, chr(10) ORDER BY raw.i) FILTER (gone.i IS NULL) AS text, count(gone.i) AS n_removed, coalesce(sum(gone.n), 0) AS words_removed
  FROM raw LEFT JOIN gone ON gone.doc_id = raw.doc_id AND gone.i = raw.i GROUP BY raw.doc_id)
SELECT d.doc_id, (SELECT count(*) FROM l WHERE l.doc_id = d.doc_id)::BIGINT AS n_lines, t.n_removed::BIGINT AS n_removed, t.words_removed::BIGINT AS words_removed,
  CASE WHEN n_removed = 0 THEN d.text ELSE coalesce(t.text, '') END AS text
FROM documents d JOIN t ON t.doc_id = d.doc_id
""",
)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


@query("op6_attention_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return attention_quality.score(docs, attention_quality.fit(docs, table(spark, sf_dir, "labels")))


@query(
    "op7_quality_rules",
    r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n FROM d, unnest(range(1, len(w) - 1)) AS u(i)),
rep AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM g, unnest([0, 1, 2]) AS v(o) WHERE n > 1 GROUP BY doc_id),
ln AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, len(regexp_extract_all(text, '[A-Z]')) AS up, len(regexp_extract_all(text, '[a-z]')) AS low,
    len(regexp_extract_all(text, '[0-9]')) AS digits, len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS lettered
  FROM d LEFT JOIN rep ON rep.doc_id = d.doc_id LEFT JOIN ln ON ln.doc_id = d.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 10 * n_symbols <= n_words AND word_chars BETWEEN 3 * n_words AND 10 * n_words AND 2 * n_dup_lines <= n_lines
    AND 10 * lettered >= 6 * n_words AND up <= low AND 10 * digits <= 3 * word_chars AS kept
FROM b
""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


@query(
    "op8_warc_zstd",
    f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS original FROM p),
r AS (SELECT *, n >= {warc.LEAST_BYTES} AND page_id <> original AS again FROM f)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN original END AS refers_to
FROM r
""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query(
    "op9_decontamination",
    rf"""
WITH words AS (
  SELECT kind, id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM (SELECT 'd' AS kind, doc_id AS id, coalesce(text, '') AS text FROM documents UNION ALL SELECT 'i', item_id, coalesce(text, '') FROM benchmark)),
s AS (SELECT DISTINCT kind, id, array_to_string(w[i:i + 4], ' ') AS g FROM words, unnest(range(1, len(w) - 3)) AS u(i)),
n AS (SELECT id AS item_id, count(*) AS n FROM s WHERE kind = 'i' GROUP BY id),
p AS (SELECT a.id AS doc_id, b.id AS item_id, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.kind = 'd' AND b.kind = 'i' GROUP BY 1, 2)
SELECT doc_id, p.item_id, n::BIGINT AS n_shingles, c::BIGINT AS n_shared, c::DOUBLE / n AS containment
FROM p JOIN n ON n.item_id = p.item_id WHERE 100 * c >= {decontamination.PERCENT} * n
""",
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_harmonic_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = packing.pack(table(spark, sf_dir, "documents"), tokenizer())
    return got.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query(
    "op11_exact_dedup",
    r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = min(doc_id) OVER same AS kept, h AS text_sha256
FROM d WINDOW same AS (PARTITION BY h)
""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents")).drop("row")


@query(
    "op12_spelling_variants",
    rf"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
r AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
o AS (SELECT doc_id, run, count(*) AS c, coalesce(doc_id::VARCHAR, '') || ':' || run AS key FROM r WHERE length(run) >= {spelling.LENGTH} GROUP BY doc_id, run),
h AS (
  SELECT run, c, xor(4294967295, list_reduce(list_transform(range(strlen(key)), lambda i: ('0x' || substr(hex(key), 2 * i + 1, 2))::BIGINT),
    lambda a, b: xor(a >> 8, t[1 + (xor(a, b) & 255)]), 4294967295)) AS h FROM o, crc),
g AS (
  SELECT CASE WHEN h % {spelling.ERRORS} = 0 THEN left(run, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, c FROM h),
v AS (SELECT word, sum(c)::BIGINT AS n FROM g WHERE length(word) >= {spelling.LENGTH} GROUP BY word HAVING sum(c) >= {spelling.OCCURRENCES}),
d AS (SELECT DISTINCT word, n, left(word, i) AS a, substr(word, i + 2) AS b FROM v, unnest(range(length(word))) AS u(i)),
w AS (SELECT word, n, left(word, i) AS a, substr(word, i + 1) AS b FROM v, unnest(range(length(word) + 1)) AS u(i)),
p AS (
  SELECT x.word, x.n, y.word AS other, y.n AS m FROM d x JOIN d y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT x.word, x.n, y.word, y.n FROM d x JOIN w y ON x.a = y.a AND x.b = y.b
  UNION SELECT y.word, y.n, x.word, x.n FROM d x JOIN w y ON x.a = y.a AND x.b = y.b),
f AS (SELECT word, any_value(n) AS n, count(*) AS n_near, first(other ORDER BY m DESC, other) AS other, max(m) AS m FROM p GROUP BY word),
k AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {spelling.RATIO} * v.n THEN other END AS form, CASE WHEN m >= {spelling.RATIO} * v.n THEN m END AS form_n
  FROM v LEFT JOIN f ON f.word = v.word),
s(word, root) AS (SELECT word, word FROM k UNION ALL SELECT s.word, k.form FROM s JOIN k ON k.word = s.root WHERE k.form IS NOT NULL),
z AS (SELECT word, last.root AS root FROM (SELECT s.word, arg_min(s, k.form IS NOT NULL) AS last FROM s JOIN k ON k.word = s.root GROUP BY s.word))
SELECT k.word, form, root, n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM k JOIN z ON z.word = k.word
""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents")))


@query(
    "op13_phrase_collocations",
    rf"""
WITH p AS (
  SELECT coalesce(lang, '{collocations.NONE}') AS lang,
    regexp_extract_all(unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
g AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM p, unnest(range(1, {collocations.DEPTH} + 1)) AS v(k), unnest(range(1, len(w) - k + 2)) AS u(i)),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY lang, k, phrase HAVING count(*) >= {collocations.LEAST}),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
x AS (SELECT lang, phrase, a, j, array_to_string(w[1:j], ' ') AS head, array_to_string(w[j + 1:], ' ') AS tail FROM c, unnest(range(1, k)) AS u(j)),
s AS (
  SELECT x.lang, x.phrase, x.a, j, h.a AS l, t.a AS r, {collocations.SCALE}::HUGEINT * x.a // (h.a + t.a) AS score
  FROM x JOIN f h ON h.lang = x.lang AND h.phrase = head JOIN f t ON t.lang = x.lang AND t.phrase = tail),
b AS (SELECT lang, phrase, a, arg_min(struct_pack(l := l, r := r, score := score), struct_pack(s := score, j := j)) AS best FROM s GROUP BY lang, phrase, a),
i AS (
  SELECT lang, array_to_string(w[o:o + m - 1], ' ') AS phrase, max(a) AS most
  FROM c, unnest(range(2, k)) AS v(m), unnest(range(1, k - m + 2)) AS u(o) GROUP BY ALL),
r AS (
  SELECT b.lang, b.phrase, a, best.l AS l, best.r AS r, best.score AS score,
    row_number() OVER (PARTITION BY b.lang ORDER BY best.score DESC, a DESC, b.phrase) AS rank
  FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE most IS NULL OR 100 * most < {collocations.COVERED} * a)
SELECT r.lang, rank, phrase, a, l, r.r, n, score::BIGINT AS score FROM r JOIN n ON n.lang = r.lang WHERE rank <= {collocations.TOP}
""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
