"""Shards by extendible hashing (DataFrame functions only).

A directory is indexed by the leading bits of a row's hash.  Bucket sizes are summed over
cells that are a few bits deeper than the directory is likely to become; from the sums of
all shorter prefixes every cell takes the shortest prefix that fits.  That is the bucket
that is reached when only oversized buckets are split on one more bit.  Cells that are
themselves too large go through another round on further bits, and only their rows do.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

BITS = 60


def _prefix(bits: Column, depth: Column | int) -> Column:
    depth = F.lit(depth) if isinstance(depth, int) else depth
    return F.call_function("shiftright", bits, (F.lit(BITS) - depth).cast("int"))


def extendible_shards(
    docs: DataFrame, limit: int, spare_bits: int = 4, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_bytes, shard, depth, shard_bytes, shard_rows.

    `shard` is the text of the bucket's leading bits ('' while one bucket holds all); no
    shard is above `limit` bytes, unless a single document is: that one has a shard to itself.
    Null texts have no bytes.  Rows that repeat id and text are numbered, so they have
    different hashes and may part.  Other columns are ignored.  An empty table gives an empty
    result.
    """
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        F.md5(F.coalesce(F.col(text_col), F.lit(""))).alias("_md5"),
    )
    rows = rows.groupBy("doc_id", "n_bytes", "_md5").agg(F.count(F.lit(1)).alias("_n"))
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    name = F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "_md5", F.col("_copy").cast("string"))
    rows = rows.select("doc_id", "n_bytes", F.conv(F.substring(F.md5(name), 1, 15), 16, 10).cast("long").alias("_bits"))
    rows = materialize(rows, "shard-rows")

    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + spare_bits)
    start, todo, parts = 0, rows, []
    while True:
        placed = _place(todo, limit, start, depth)
        placed = materialize(placed, "shard-cells")
        cell = _prefix(F.col("_bits"), depth)
        # Only a cell of several rows can have no place; at the last bit it has to stay whole.
        done = todo.withColumn("_cell", cell).join(placed.where("depth is not null"), "_cell")
        parts.append(done.select("doc_id", "n_bytes", "depth", "_bucket", "shard_bytes", "shard_rows"))
        rest = placed.where("depth is null").select("_cell")
        if rest.isEmpty():
            break
        todo = materialize(todo.withColumn("_cell", cell).join(rest, "_cell", "left_semi").drop("_cell"), "shard-rest")
        start, depth = depth + 1, min(BITS, depth + 1 + spare_bits)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    bits = F.lpad(F.conv(F.col("_bucket").cast("string"), 10, 2), 64, "0")
    shard = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("right(_b, depth)"))
    return out.withColumn("_b", bits).select("doc_id", "n_bytes", shard.alias("shard"), "depth", "shard_bytes", "shard_rows")


def _place(rows: DataFrame, limit: int, start: int, depth: int) -> DataFrame:
    """For every cell of `depth` bits the shortest prefix of `start` bits or more that fits
    (depth null: none does)."""
    cells = rows.groupBy(_prefix(F.col("_bits"), depth).alias("_cell")).agg(
        F.sum("n_bytes").alias("_bytes"), F.count(F.lit(1)).alias("_rows")
    )
    levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(start), F.lit(depth)))).withColumn(
        "_bucket", F.expr(f"shiftright(_cell, cast({depth} - depth as int))")
    )
    sums = levels.groupBy("depth", "_bucket").agg(
        F.sum("_bytes").alias("shard_bytes"), F.sum("_rows").alias("shard_rows")
    )
    fits = (F.col("shard_bytes") <= limit) | (F.col("shard_rows") == 1) | (F.col("depth") == BITS)
    best = levels.select("_cell", "depth", "_bucket").join(sums, ["depth", "_bucket"]).groupBy("_cell").agg(
        F.min(F.when(fits, F.struct("depth", "_bucket", "shard_bytes", "shard_rows"))).alias("_best")
    )
    return best.select("_cell", "_best.*")


def oracle(limit: int, deepest: int = 40) -> str:
    return f"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes, md5(coalesce(text, '')) AS m,
    row_number() OVER (PARTITION BY doc_id, coalesce(text, '')) AS copy
  FROM documents),
r AS (
  SELECT doc_id, n_bytes, m, copy,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || m || '|' || CAST(copy AS VARCHAR)), 1, 15) AS BIGINT) AS bits
  FROM d),
p AS (
  SELECT r.*, g.depth, bits >> CAST({BITS} - g.depth AS INTEGER) AS bucket
  FROM r, (SELECT unnest(range(0, {deepest} + 1)) AS depth) g),
s AS (SELECT depth, bucket, sum(n_bytes) AS b, count(*) AS n FROM p GROUP BY ALL),
f AS (
  SELECT p.doc_id, p.m, p.copy, p.n_bytes, p.bits, p.depth, s.b, s.n,
    row_number() OVER (PARTITION BY p.doc_id, p.m, p.copy ORDER BY p.depth) AS k
  FROM p JOIN s ON p.depth = s.depth AND p.bucket = s.bucket WHERE s.b <= {limit} OR s.n = 1)
SELECT doc_id, n_bytes, CAST(depth AS INTEGER) AS depth, CAST(b AS BIGINT) AS shard_bytes, n AS shard_rows,
  CASE WHEN depth = 0 THEN '' ELSE substr(lpad(bin(bits), {BITS}, '0'), 1, CAST(depth AS INTEGER)) END AS shard
FROM f WHERE k = 1
"""
