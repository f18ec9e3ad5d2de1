"""A corpus from documents to tokens: quality, near copies, personal data, mixing, byte-level BPE.

Each stage works on all that the stage before it has kept; its result is written to the folder that all machines share and read again.
Belongs to the subpackage kelpforge.llm.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpforge.llm import bpe, jaccard, mixing, pii, quality
from kelpforge.llm.common import fresh_dir, unused, written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier, fitted on what is labelled among them, rejects. Null or empty texts are judged by their metadata; without labels of both kinds all stay."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, labels))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies, one document: that of the smallest id, null ids last, ties by a hash of the text.

    Rows count one by one, also those that repeat an id or have none; so rows of one id whose texts differ all stay. Documents
    without words are near copies of nothing and stay.
    """
    mark, tie = unused(docs, "_mark"), unused(docs, "_tie")
    marked = written(docs.withColumn(mark, F.monotonically_increasing_id()).withColumn(tie, F.xxhash64("text")), "marked")
    found = jaccard.jaccard_components(marked, id_col=mark)
    best = F.min(F.struct(F.isnull("doc_id"), "doc_id", tie, mark))[mark]
    kept = found.join(marked.select(mark, "doc_id", tie), mark).groupBy("component_id").agg(best.alias(mark))
    return marked.join(kept, mark, "left_semi").select(*[marked[c] for c in docs.columns])


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data in its text masked and n_chars counted anew. Null texts stay null."""
    return pii.redact_pii(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: documents taken twice are two rows, those of which nothing is taken (or that have no words) are gone."""
    return mixing.mix_documents(docs).withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row of the mix: doc_id and digests of its token ids and of what they decode to."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", good_documents),
    ("n-gram Jaccard join", one_of_each_group),
    ("personal data", without_personal_data),
    ("mixing to target weights", mixed),
    ("byte-level BPE", tokens),
]

#: Several stages (a trained classifier, merges of a vocabulary) cannot be written in SQL. tests/llm/test_pipeline.py holds every stage against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = fresh_dir(spark, f"stage{k + 1}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
