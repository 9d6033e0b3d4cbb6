"""The registered queries: each applies one operator to a whole table with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from . import ann, bpe, conversations, kd_shards, maxent_lm, mixing, near_dedup, quality, repair, repeats, secrets, sql, toxicity, whitening
from .common import table


def vocabulary_file() -> str:
    """The installed vocabulary; TOKENIZER_FILE names another."""
    if path := os.environ.get("TOKENIZER_FILE"):
        return path
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark, sf_dir):
    return bpe.encode_decode_digests(table(spark, sf_dir, "documents"), vocabulary_file())


def op2_secrets(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


def op3_lm_scores(spark, sf_dir):
    return maxent_lm.lm_scores(table(spark, sf_dir, "documents"))


def op4_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_token_shards(spark, sf_dir):
    shards = repair.write_shards(table(spark, sf_dir, "documents"), vocabulary_file())
    return repair.read_shards(shards).select("doc_id", "start", "n_tokens", "ids_crc32")


def op6_quality(spark, sf_dir):
    return quality.quality_verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_shards(spark, sf_dir):
    return kd_shards.kd_shards(table(spark, sf_dir, "documents"), shards=40)


def op8_ann(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"))


def op9_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mixing(spark, sf_dir):
    mixed = mixing.mix_copies(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op11_repeats(spark, sf_dir):
    cut = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc.doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("runs").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_conversations(spark, sf_dir):
    return conversations.repaired_conversations(table(spark, sf_dir, "conversations"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_bpe, op2_secrets, op3_lm_scores, op4_near_dedup, op5_token_shards, op6_quality, op7_shards, op8_ann, op9_toxicity, op10_mixing, op11_repeats, op12_whitening, op13_conversations)}


def oracle_sql() -> dict[str, str]:
    return sql.oracle_sql()
