"""Every stage of the pipeline on its own input."""

import os
from collections import Counter

import pytest
from pyspark.sql import Row

import corpus_pipeline
from slipspark.llm.common import written
from tests.llm import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.collect()
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), f"test-{name}")
        stored = docs.select("*", "_metadata.file_name", "_metadata.row_index").collect()  # files are numbered in order
        after = [r[:-2] for r in sorted(stored, key=lambda r: r[-2:])]
        after = [Row(*docs.columns)(*r) for r in after]
        texts = [(r.doc_id, r.text) for r in before]
        if name != "token_output":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert not Counter(map(tuple, after)) - Counter(map(tuple, before))
        if name == "language_id":
            assert len(after) >= 0.95 * len(before)
        if name == "ngram_jaccard_join":
            assert sorted(r.doc_id for r in after) == sorted({c if n else d for d, n, c in brute.join(texts)})
        if name == "decontamination":
            assert {r.doc_id for r in after} == {r[0] for r in brute.decontamination(texts, items) if not r[5]}
        if name == "mixing":
            assert len(after) == len(before) and len({r.source for r in after[:200]}) > 1
        if name == "token_output":
            assert Counter(map(tuple, after)) == Counter(brute.token_output(texts))
        before = after
