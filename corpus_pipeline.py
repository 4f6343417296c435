"""Document pipeline: toxic documents, near copies and benchmark leaks go, personal data is masked, the rest is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. Between stages the rows are
written as Parquet to the shared folder and read again, so a lost executor costs one stage at
most. Stages that filter return the rows they keep, with all columns.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import decontam, near_dedup, pii, sentencepiece_codec, toxicity
from veilframe.llm.common import read
from veilframe.llm.queries import PIECE_MODEL
from veilframe.session import ensure_checkpoint_dir

PERCENT = 85  # similarity at which documents count as near copies


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the cut, judged by a model of the labelled ones among them."""
    texts, labels = toxicity.fit_sample(docs, read(spark, sf_dir, "labels"), F.lit(True))
    return toxicity.without_toxic(docs, toxicity.fit(texts, labels))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id. Repeated rows of it count as one."""
    return near_dedup.one_of_each_group(docs, PERCENT)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontam.without_contaminated(docs, read(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind; n_chars follows the text where it counted it."""
    return pii.redacted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text."""
    return sentencepiece_codec.round_trip_digests(docs, public_tokenizers.path(PIECE_MODEL))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("pii", mask_personal_data),
    ("sentencepiece", encode),
]

# The network's scores and the graph's confidences cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
