"""Exact duplicates by skew-safe combining (DataFrame functions only).

1. Every task combines its own rows by (digest, whole text).
2. The partial groups are dealt by (digest, whole text, salt) and merged, so that one
   group that holds a third of all rows still meets in `salts` places only.
3. One winner per salt is left of each group; the winners meet by (digest, whole text).

The whole text is part of the key at each stage: a digest never decides alone that two
texts are equal.  Only the finished groups, which no longer hold texts, are joined to the
documents by their digests and lengths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, whole_row


def duplicate_groups(docs: DataFrame, salts: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct normalised text: text_sha256, other_hash, n_bytes, keep_id, group_size."""
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), lower_ascii(F.col(text_col)).alias("_text"))
    rows = rows.withColumns({"_digest": F.xxhash64("_text"), "_salt": F.pmod(F.xxhash64("_id"), F.lit(salts))})
    partial = rows.groupBy("_digest", "_text", "_salt").agg(F.max("_id").alias("_id"), F.count(F.lit(1)).alias("_n"))
    whole = partial.groupBy("_digest", "_text").agg(F.max("_id").alias("keep_id"), F.sum("_n").alias("group_size"))
    return whole.select(*_keys(F.col("_text")), "keep_id", "group_size")


def _keys(norm):
    return [
        F.sha2(norm, 256).alias("text_sha256"),
        F.xxhash64(norm).alias("other_hash"),
        F.octet_length(norm).alias("n_bytes"),
    ]


def exact_dedup(docs: DataFrame, salts: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z.  Null texts count as empty, and
    empty texts are one group like any other.  Of a group the largest doc_id stays; null ids
    are smaller than all others, and a group of null ids only has a null keep_id and keeps one
    row.  Rows that repeat both id and text are all returned and just one of them is kept.
    Extra columns are ignored.  An empty table gives an empty result.
    """
    groups = duplicate_groups(docs, salts, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), *_keys(lower_ascii(F.col(text_col))))
    keys = ["text_sha256", "other_hash", "n_bytes"]
    # Rows that agree in id and text are alike in the result: count them, then number them.
    rows = rows.groupBy("doc_id", *keys).agg(F.count(F.lit(1)).alias("_n"))
    out = rows.join(groups, keys).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return out.select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"),
        "text_sha256",
    )


def drop_duplicates(docs: DataFrame, salts: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with all their columns; of rows that repeat id and text, one."""
    # One key that is never null deals the rows for the join and for dropping repeats alike.
    key = lambda i, sha: F.concat_ws("|", F.coalesce(i.cast("string"), F.lit("")), sha).alias("key")
    kept = exact_dedup(docs, salts, id_col, text_col).where("kept").select(key(F.col("doc_id"), F.col("text_sha256")))
    sha = F.sha2(lower_ascii(F.col(text_col)), 256)
    rows = docs.select(whole_row(docs).alias("row"), key(F.col(id_col).cast("long"), sha))
    return rows.join(kept, "key", "left_semi").dropDuplicates(["key"]).select("row.*")


ORACLE = """
WITH t AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents),
g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY norm)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
