"""The registered queries of the subpackage at the smallest scale, and the pipeline."""

import hashlib

import pytest

import corpus_pipeline
from tests.compare import compare, connect
from tests.llm.test_duplicates import brute_repeats
from tickloom.llm import pii, queries


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_sql(spark, folder, name):
    assert compare(spark, connect(folder), folder, name, queries.QUERIES[name], queries.ORACLES[name]) is None


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n.split("_")[0] not in ("op1", "op8", "op13")])
def test_one_row_per_document(spark, folder, name):
    rows = queries.QUERIES[name](spark, folder).select("doc_id").collect()
    wanted = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id").collect()
    assert sorted(r[0] for r in rows) == sorted(r[0] for r in wanted)


def test_substring_query_equals_brute_force(spark, folder):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    wanted = {i: (n, gone, hashlib.sha256(kept).hexdigest()) for i, (n, gone, kept) in brute_repeats(docs, 20).items()}
    assert {r.doc_id: tuple(r)[1:] for r in queries.op5_substring_dedup(spark, folder).collect()} == wanted


def test_pipeline_stages(spark, folder):
    """Each stage works on all of its predecessor, and its decisions take effect."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    extra = docs.where("doc_id < 20").selectExpr("doc_id + 100000 AS doc_id", "text", "lang", "source", "n_chars")
    null = docs.limit(1).selectExpr("CAST(-1 AS BIGINT) AS doc_id", "CAST(NULL AS STRING) AS text", "lang", "source", "n_chars")
    docs = docs.unionByName(extra).unionByName(null).cache()
    quality, near, passages, private, pack = (f for _, f in corpus_pipeline.STAGES)
    good = quality(spark, docs, folder).cache()
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    right = [(i in kept) == bool(q) for i, q in label.items()]
    assert sum(right) >= 0.97 * len(right) and good.columns == docs.columns
    unique = near(spark, good, folder).cache()
    ids = {r.doc_id for r in unique.collect()}
    assert ids <= kept and not any(i >= 100_000 and i - 100_000 in kept for i in ids)
    cut = passages(spark, unique, folder).cache()
    wanted = brute_repeats([(r.doc_id, r.text) for r in unique.collect()], 20)
    assert {r.doc_id: (r.text or "").encode().split() for r in cut.collect()} == {i: w[2].split() for i, w in wanted.items()}
    clean = private(spark, cut, folder).cache()
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == ids
    found = [r for r in clean.collect() if r.text and any(k < pii.BASE for _, k, _ in pii.finder().spans(r.text))]
    assert found == [] and clean.where("n_chars <> length(text)").count() == 0
    assert {r.doc_id for r in pack(spark, clean, folder).collect()} == ids


def test_pipeline_of_an_empty_table(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
    assert docs.collect() == []
