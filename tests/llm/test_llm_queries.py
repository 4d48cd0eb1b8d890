"""Registered queries against DuckDB, and the pipeline stage by stage, on the smallest data set."""

import os
from collections import Counter

import pytest
from compare import duck, spark_rows
from test_near_copies import brute_groups
from test_operators import brute_mix, brute_pii

import corpus_pipeline
from flowseries.llm import queries, quality_rules

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_duckdb(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, SF)) == duck(SF, queries.ORACLE_SQL[name])


@needs_data
def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    references = quality_rules.language_references(docs)
    good = {r.doc_id: r for r in docs.collect() if quality_rules.judge(r.text.encode(), r.lang, references, quality_rules.QualityLimits())[6]}
    out = corpus_pipeline.quality(spark, docs, SF).cache()
    assert out.columns == COLUMNS and sorted(r.doc_id for r in out.collect()) == sorted(good)
    # Near copies: five words a shingle, Jaccard similarity of 0.8 or more, over all pairs.
    first = set(brute_groups({i: r.text for i, r in good.items()}).values())
    out = corpus_pipeline.dedup(spark, out, SF).cache()
    assert out.columns == COLUMNS and sorted(r.doc_id for r in out.collect()) == sorted(first)
    out = corpus_pipeline.personal_data(spark, out, SF).cache()
    clean = {r.doc_id: r for r in out.collect()}
    assert out.columns == COLUMNS and sorted(clean) == sorted(first)
    for i, r in clean.items():
        assert brute_pii(r.text) == "" and r.n_chars == len(r.text) and (brute_pii(good[i].text) != "" or r.text == good[i].text)
    want = brute_mix([(i, r.text, r.source) for i, r in clean.items()])
    out = corpus_pipeline.mixture(spark, out, SF).cache()
    assert out.columns == COLUMNS and Counter(r.doc_id for r in out.collect()) == Counter({i: t // n for i, (n, _, _, t) in want.items() if t})
    last = corpus_pipeline.tokens(spark, out, SF).collect()
    assert len(last) == out.count() and all(r.round_trip and r.token_ids for r in last)


def test_registration():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert all(any(k.startswith(f"op{n}_") for k in found) for n in range(1, 14)) and "pipeline" in found
