"""The subpackage's queries against their SQL, and the pipeline's stages."""

import hashlib

import pytest

import corpus_pipeline
import __spark_entry__ as entry
from askbase.llm.registry import ORACLES, QUERIES
from run_checks import compare

DATA = "/root/testdata/sf0.001"


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    if name in ORACLES:
        assert compare(spark, DATA, name)[0] is None
    else:
        assert QUERIES[name](spark, DATA).count() >= 50


def test_pipeline(spark):
    """Each stage on what its predecessor kept, with the documents' columns up to the last."""
    docs = first = spark.read.parquet(f"{DATA}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, corpus_pipeline.stored(stage(spark, docs, DATA), name)
        sizes.append(docs.count())
        if name != "sentencepiece":
            assert docs.columns == first.columns
        if name == "decontamination":
            assert docs.exceptAll(before).isEmpty()
    assert sizes == sorted(sizes, reverse=True) and sizes[1] < sizes[0] and sizes[-1] == sizes[-2]
    assert docs.where("NOT round_trip").isEmpty()
    rows = {(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest(), tuple(r.piece_ids)) for r in docs.collect()}
    again = corpus_pipeline.run(spark, DATA).collect()
    assert {(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest(), tuple(r.piece_ids)) for r in again} == rows


def test_pipeline_of_nothing(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, DATA), name)
    assert docs.count() == 0
