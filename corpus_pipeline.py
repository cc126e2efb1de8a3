"""A training corpus from ``documents``: quality, near duplicates, benchmark passages, personal data, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs. Stages keep the
rows and columns of documents but for what they decide; the last returns token ids. Null columns stay null; an empty table gives an empty table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import decontaminate, jaccard, pieces, pii, quality
from strandline.llm._common import held_out, tables
from strandline.llm.queries import table, tokenizer_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject: score of 0.5 or more. It learns from rows of ``labels`` that are not held out, and scores in the pass that filters.

    Null and empty texts get the intercept's score; repeated rows go or stay together; without labels all stay.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"), lambda c: ~held_out(c, 3, 1))
    return quality.score(docs, model, "__score").where(F.col("__score") >= 0.5).select(*docs.columns)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest doc_id, nulls last; an empty text is no copy of anything. Rows that share a doc_id but not the text count as different documents."""
    return jaccard.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with passages of two or more benchmark items go; from others the passages go. Null and empty texts stay; an empty benchmark changes nothing."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data give way to their kinds, such as [EMAIL]. Null and empty texts stay as they are."""
    return pii.redact(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, input_ids, decoded_text) of every document; a null text counts as empty."""
    return pieces.encode(docs.select("doc_id", "text"), tokenizer_path(), keep=["doc_id"], decoded=True)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("personal_data", without_personal_data),
    ("sentencepiece", token_ids),
]

#: A trained classifier, learnt patterns and a tokenizer's merges are beyond SQL; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    base = f"{tables(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return docs
