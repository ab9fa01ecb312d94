"""The pipeline and the registered queries over the smallest provided tables, against brute force."""

from __future__ import annotations

import os

import pytest

import __spark_entry__
from tallymark.llm import quality, recompression, registry, simhash

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the provided tables")


def test_each_operator_has_its_query():
    names = registry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    assert set(registry.oracle_sql()) <= set(names)
    assert "pipeline" in __spark_entry__.queries()


def test_stages_and_their_effects(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF).cache()
        assert kept.columns == columns, name
        assert kept.dtypes == docs.dtypes, name
        if name == "quality":
            good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
            ids = {r.doc_id for r in kept.select("doc_id").collect()}
            assert len(good & ids) >= 0.97 * len(good)
        if name == "near_duplicates":
            prints = {}
            for r in before.collect():
                prints.setdefault(simhash.fingerprint(r.text, 5), []).append(r.doc_id)
            ids = {r.doc_id for r in kept.select("doc_id").collect()}
            assert all(len(ids & set(group)) <= 1 for group in prints.values())
        if name == "repeated_passages":
            again = recompression.dedup(kept.select("doc_id", "text"))
            assert again.agg({"n_removed": "sum"}).first()[0] <= 0.01 * again.agg({"n_words": "sum"}).first()[0]
    last = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
    by = {}
    for r in last:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for s in by.values():
        s.sort()
        assert s[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(s, s[1:])) and sum(n for _, n in s) <= 1024
    assert len(by) <= 1.1 * sum(r.length for r in last) / 1024 + 1


def test_quality_stage_returns_only_kept_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in quality.classify(docs.select("doc_id", "text"), labels).filter("kept").collect()}
    assert {r.doc_id for r in quality.quality_stage(spark, docs, SF).collect()} == kept
