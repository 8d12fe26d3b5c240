"""The corpus pipeline: stages over ``documents``, each of them one operator of ``ledgerline.llm``.

Each stage takes what its predecessor kept. All but the last return the columns of ``documents``, whatever other
columns there are. An empty table stays empty in every stage. Null texts and texts without words count as empty; rows with a
null id are scored, cut by no line, alike with nothing, and packed; rows that repeat an id are each judged by their own text, but for
near duplicates, where they are one document; ties go to the least id, and within it to the first line.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerline.llm import decontamination, line_dedup, ngram_join, packing, quality_classifier
from ledgerline.llm.common import staged, table
from ledgerline.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go; it learns from those that are labelled and not held out."""
    scored = quality_classifier.accepted(docs, table(spark, sf_dir, "labels"))
    return scored.select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of alike lines the first stays; documents of which nothing is left go; ``n_chars`` follows the text."""
    return line_dedup.deduplicated(docs, length_col="n_chars", min_words=1)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays, that with the least id."""
    return ngram_join.one_of_each_group(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of the benchmark occurs go."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their ids and places in sequences."""
    return packing.pack_documents(docs, tokenizer_path(), keep_ids=False).select("doc_id", F.col("piece"), "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("ngram_join", near_duplicates), ("decontamination", benchmark_free), ("packing", packed)]
#: A compression classifier, MinHash and packing aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
