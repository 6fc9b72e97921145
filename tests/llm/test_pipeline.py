"""The pipeline's stages against plain Python on the smallest table."""

import re

import pytest

import corpus_pipeline as P
from tests.llm.test_operators import CLASHES, KINDS, ROWS, SF, brute_components, ids  # noqa: F401


def folded(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in text or ""))


def test_stages(spark, ids):  # noqa: F811
    stages = dict(P.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = stages["quality"](spark, docs, SF)
    assert good.columns == docs.columns
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 0").collect()}
    kept = {r.doc_id for r in good.collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert len(kept & clean) > 0.97 * len(clean) and len(kept & bad) < 0.5 * len(bad)
    cut = stages["lines"](spark, docs, SF)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    assert all(r.n_chars == len(r.text) for r in cut.collect())
    rows = [(r.doc_id, r.text) for r in cut.collect()]
    _, group = brute_components(rows, 5)
    near = stages["near"](spark, cut, SF)
    assert sorted(r.doc_id for r in near.collect()) == sorted(set(group.values()))
    items = [folded(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in items]

    def holds(text):
        w = folded(text)
        own = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        return any(i and 100 * len(i & own) >= 80 * len(i) for i in items)

    free = stages["benchmark"](spark, docs, SF)
    assert sorted(r.doc_id for r in free.collect()) == sorted(r.doc_id for r in docs.collect() if not holds(r.text))
    packed = P.run(spark, SF).toPandas()
    assert set(packed.doc_id) <= {r.doc_id for r in docs.collect()}
    for _, g in packed.groupby("doc_id"):
        assert g.length.sum() == g.doc_tokens.iloc[0]


@pytest.mark.parametrize("empty", [False, True])
def test_defined_cases(spark, empty):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([] if empty else ROWS, KINDS).withColumns({c: F.lit("x") for c in CLASHES})
    for name, stage in P.STAGES:
        out = stage(spark, df, SF)
        if name != "pack":
            assert out.columns == df.columns
        assert (out.count() == 0) == empty
