"""The pipeline against its stages' brute-force versions, and the registered queries against their SQL."""

import sys
from pathlib import Path

import pytest
from check_oracle import compare, duck

from fieldseries.llm.queries import ORACLES, QUERIES
from fieldseries.operators.materialize import materialize

sys.path.insert(0, str(Path(__file__).parent))
from test_operators import jaccard_components, words  # noqa: E402

corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_small, name):
    assert compare(QUERIES[name](spark, sf_small), duck(sf_small), ORACLES[name]) is None


def brute_lines(texts):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    def key(line):
        return line.strip(" \t\n\x0b\f\r").translate(lower)
    holders = {}
    for i, t in texts.items():
        for line in t.split("\n"):
            holders.setdefault(key(line), set()).add(i)
    gone = {k: max(v) for k, v in holders.items() if len(k) >= 40 and len(v) >= 5}
    return {i: "\n".join(x for x in t.split("\n") if gone.get(key(x), i) == i) for i, t in texts.items()}


def test_pipeline_equals_brute_force(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    columns = docs.columns
    texts = {r.doc_id: r.text or "" for r in docs.collect() if r.text and any(c.isalpha() for c in r.text)}
    after_lines = brute_lines(texts)
    comps = jaccard_components(after_lines.items())
    one_each = {i: t for i, t in after_lines.items() if comps[i][1] == i}
    items = [" ".join(words(r.text)) for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    leaking = {i for i, t in one_each.items() if any(f" {x} " in f" {' '.join(words(t))} " for x in items)}
    expected = [set(texts), set(texts), set(one_each), set(one_each) - leaking, set(one_each) - leaking]
    for (name, stage), ids in zip(corpus_pipeline.STAGES, expected):
        docs = materialize(stage(spark, docs, sf_small))
        got = {r.doc_id: r for r in docs.collect()}
        if name in ("decontaminate", "byte_bpe"):
            # near-verbatim passages go too
            assert set(got) <= ids and len(ids - set(got)) <= 2, name
        else:
            assert set(got) == ids, name
        if name != "byte_bpe":
            assert docs.columns == columns
        if name == "line_dedup":
            assert {i: r.text for i, r in got.items()} == after_lines and all(r.n_chars == len(r.text) for r in got.values())
    assert all(r.n_tokens == len(r.ids) for r in got.values())
