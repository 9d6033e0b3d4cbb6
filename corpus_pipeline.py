"""A training corpus from raw documents: five stages, each written as Parquet and read by the next.

SQL cannot express the classifier, the similarity join and the tokenizer, so ORACLE_SQL is None and
the tests compare ``run`` with a brute-force version on a small table.

Defined cases: null and empty texts are scored at the classifier's intercept, have no near copies and
no secrets, and encode to no tokens; documents with a null id stay until mixing; of rows equal in id
and text one stays; an empty table gives an empty result; further columns pass through all stages but
the last, which returns ids, counts and digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meshspark.llm import bpe, mixing, near_dedup, secrets, toxicity
from meshspark.llm.common import table, written
from meshspark.llm.queries import vocabulary_file


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays."""
    return near_dedup.distinct_documents(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text become marks."""
    return secrets.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as systematic sampling to the sources' targets draws them."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every drawn document."""
    return bpe.encode_decode_digests(docs, vocabulary_file())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("bpe", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
