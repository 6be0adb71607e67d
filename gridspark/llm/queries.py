"""Registered queries of the text operators and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import (
    decontamination,
    exact_dedup,
    extraction,
    hard_negatives,
    near_dedup,
    packing,
    recompression,
    secrets,
    sharding,
    suffix_dedup,
    toxicity,
    url_filter,
    whitening,
)
from .common import table

SHARD_BYTES = 16 << 20


def op1_url_reputation(spark, folder):
    """Verdicts of every page's url."""
    return url_filter.judge_urls(table(spark, folder, "pages"))


def op2_recompression_dedup(spark, folder):
    """Words that stay when passages of 13 words are removed after their first document."""
    return recompression.drop_repeats(table(spark, folder, "documents")).drop("kept")


def op3_spaced_seed_decontamination(spark, folder):
    """Documents that hold benchmark items."""
    return decontamination.overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_weighted_minhash(spark, folder):
    """Classes of near-duplicate documents."""
    return near_dedup.near_duplicates(table(spark, folder, "documents"))


def op5_bucket_refinement_dedup(spark, folder):
    """Bytes that stay when repeated strings of 200 bytes are removed."""
    return suffix_dedup.drop_repeats(table(spark, folder, "documents")).drop("kept")


def op6_extendible_sharding(spark, folder):
    """Shards of at most 16 MiB of all documents."""
    return sharding.extendible_shards(table(spark, folder, "documents"), SHARD_BYTES)


def op7_minimum_cut_extraction(spark, folder):
    """Main text of every page."""
    return extraction.extract(table(spark, folder, "pages"))


def op8_best_fit_packing(spark, folder):
    """Sequences of at most 1024 ids of all documents."""
    import public_tokenizers

    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_exact_dedup(spark, folder):
    """Groups of equal documents, all documents listed."""
    return exact_dedup.exact_dedup(table(spark, folder, "documents"))


def op10_toxicity(spark, folder):
    """Toxicity of every document."""
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op11_packed_tree_negatives(spark, folder):
    """Hard negatives of every hundredth embedding; every seventh has the next label."""
    rows = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", moved))


def op12_block_matrix_whitening(spark, folder):
    """Embeddings on the four strongest components, whitened."""
    return whitening.whiten(table(spark, folder, "embeddings"))


def op13_guess_cost_secrets(spark, folder):
    """Secrets of every document."""
    return secrets.find_secrets(table(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_reputation,
        op2_recompression_dedup,
        op3_spaced_seed_decontamination,
        op4_weighted_minhash,
        op5_bucket_refinement_dedup,
        op6_extendible_sharding,
        op7_minimum_cut_extraction,
        op8_best_fit_packing,
        op9_exact_dedup,
        op10_toxicity,
        op11_packed_tree_negatives,
        op12_block_matrix_whitening,
        op13_guess_cost_secrets,
    )
}
ORACLES = {
    "op1_url_reputation": url_filter.ORACLE,
    "op2_recompression_dedup": recompression.ORACLE,
    "op3_spaced_seed_decontamination": decontamination.oracle(),
    "op6_extendible_sharding": sharding.oracle(SHARD_BYTES),
    "op9_exact_dedup": exact_dedup.ORACLE,
    "op11_packed_tree_negatives": hard_negatives.ORACLE,
}
