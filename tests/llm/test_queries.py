"""The registered queries against their SQL, and the pipeline's stages against what each promises."""

import hashlib

import pytest

import corpus_pipeline
from ledgerline.llm import queries

from .. import oracle


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    oracle.assert_same(spark, queries.QUERIES[name], queries.ORACLES[name])


def test_pipeline(spark):
    docs, seen = spark.read.parquet(f"{oracle.DATA}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        seen[name] = (docs, stage(spark, docs, oracle.DATA).cache())
        docs = seen[name][1]
        assert docs.columns == columns or name == "packing"
    before, after = seen["quality_classifier"]
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{oracle.DATA}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in after.collect()}
    assert sum(labels[i] == 1 for i in labels if i in kept) >= 0.95 * sum(q == 1 for q in labels.values())
    before, after = seen["decontamination"]
    hit = {r["doc_id"] for r in queries.decontamination.contamination(before, spark.read.parquet(f"{oracle.DATA}/benchmark.parquet")).filter("contaminated").collect()}
    assert {r["doc_id"] for r in before.collect()} - hit == {r["doc_id"] for r in after.collect()}
    before, after = seen["ngram_join"]
    groups = {r["doc_id"]: r["component_id"] for r in queries.ngram_join.similar_groups(before).collect()}
    assert {r["doc_id"] for r in after.collect()} == set(groups.values())
    before, after = seen["line_dedup"]
    gone = {r["doc_id"] for r in before.collect()} - {r["doc_id"] for r in after.collect()}
    assert len(gone) < 0.2 * before.count()
    packed = seen["packing"][1]
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in seen["packing"][0].collect()}
    assert packed.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0


def test_digest_of_no_items(spark):
    clean = queries.op4_benchmark_decontamination(spark, oracle.DATA).filter("not contaminated").first()
    assert clean["items_sha256"] == hashlib.sha256(b"").hexdigest()


def test_every_line_that_is_not_blank_is_judged(spark, tmp_path):
    texts = ["Les.", "Les.", "日本語の長い行がここにある", "日本語の長い行がここにある\n \n", "And ornd.", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["line_no"]): r["first_doc_id"] for r in queries.op5_fuzzy_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {(0, 0): 0, (1, 0): 0, (2, 0): 2, (3, 0): 2, (4, 0): 4}
