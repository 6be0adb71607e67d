"""From raw documents to packed training sequences: every stage reads what the one before kept.

All stages but the last return whole rows: every column, whatever its name, and every null as it
came.  None of them fails on an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridspark.llm import decontamination, exact_dedup, near_dedup, packing, toxicity
from gridspark.llm.common import materialize, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not scored as toxic; what lacks a label is judged like the rest.  Null and
    empty texts have the score of a text without words; repeated rows stay or go together."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts, that with the largest doc_id; null texts count as
    empty, and of rows that repeat id and text one stays."""
    return exact_dedup.drop_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every class of near duplicates, that with the smallest doc_id (rows without
    one come last); texts without words are only alike if they are equal."""
    return near_dedup.drop_near_duplicates(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item; null, empty and short texts hold none and stay."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 ids; a null or empty text is one piece
    with the closing id alone."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxic),
    ("exact dedup", exact),
    ("near dedup", near),
    ("decontamination", decontaminated),
    ("packing", packed),
]
#: Tokenising, Viterbi decoding and sampling cannot be said in SQL; tests compare the stages
#: with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over the documents of `sf_dir`; each result is written to
    the shared folder and read again.  Returns the packed pieces."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
