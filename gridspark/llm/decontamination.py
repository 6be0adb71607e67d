"""Benchmark decontamination by spaced seeds (DataFrame functions only).

A seed is the hash of the words that a mask selects; words at the positions it leaves out may
differ.  Every position of every document is hashed under each mask and joined to the hashes
of the benchmark's positions.  A hit fixes how item and document lie to each other, and the
words around it are compared one by one, so that only overlaps with few substitutions count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, whole_row

#: Selected positions.  Whatever words of 9 to 13 are substituted within the default tolerance,
#: some mask at some place selects none of them.
MASKS = (
    (0, 1, 3, 5, 6, 8), (0, 1, 2, 4, 5, 6), (0, 1, 3, 4, 6, 7), (0, 1, 2, 3, 4, 5), (0, 1, 2, 3, 4, 6), (0, 1, 2, 6, 7, 8),
)
SPAN = 9
LEAST = 5  # shorter items are no evidence
WINDOW, SHARE = 13, 0.8
BROADCAST_ROWS = 500_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def _hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _seeds(rows: DataFrame, masks: Sequence[tuple[int, ...]], *keep: str) -> DataFrame:
    """One row per position and mask: keep columns, _pos, _seed.  `_h` has the words' hashes."""
    at = rows.select(*keep, "_h", F.explode(F.sequence(F.lit(0), F.size("_h") - 1)).alias("_pos"))
    h = lambda k: F.get(F.col("_h"), F.col("_pos") + k)
    # A mask that reaches over the end has no seed; its number keeps masks apart.
    seeds = [F.when(F.col("_pos") + m[-1] < F.size("_h"), F.xxhash64(F.lit(n), *map(h, m))) for n, m in enumerate(masks)]
    return at.select(*keep, "_pos", F.explode(F.array(*seeds)).alias("_seed")).where("_seed is not null")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, marked for broadcasting if it has few rows; a shuffled join serves the rest."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _alignments(docs: DataFrame, benchmark: DataFrame, window: int, share: float, id_col: str, text_col: str) -> DataFrame:
    """Verified alignments: _id, _text_hash (of the document), item_id, _n, _matched."""
    items = benchmark.select("item_id", _hashes(F.col("text")).alias("_h")).where(F.size("_h") >= LEAST).distinct()
    items = materialize(items.withColumn("_item", F.xxhash64("item_id", "_h")), "items")
    short = sorted(r[0] for r in items.select(F.size("_h")).where(F.size("_h") < SPAN).distinct().collect())  # 4 at most
    masks = (*MASKS, *(tuple(range(n)) for n in short))
    known = _seeds(items, masks, "_item").select("_item", F.col("_pos").alias("_at"), "_seed").distinct()
    known = materialize(known, "item-seeds")

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_text_hash"), _hashes(text).alias("_h"))
    hits = _seeds(rows, masks, "_id", "_text_hash").join(small(known), "_seed")
    hits = hits.select("_id", "_text_hash", "_item", (F.col("_pos") - F.col("_at")).alias("_shift")).distinct()
    hits = materialize(hits, "seed-hits")

    keyed = docs.select(F.col(id_col).cast("long").alias("_id0"), F.xxhash64(text).alias("_hash0"), text.alias("_text"))
    same = F.col("_id0").eqNullSafe(F.col("_id")) & (F.col("_hash0") == F.col("_text_hash"))
    found = keyed.join(small(hits), same).select("_id", "_text_hash", "_item", "_shift", _hashes(F.col("_text")).alias("_d"))
    found = found.join(small(items), "_item")
    n = F.size("_h")
    equal = F.transform(F.col("_h"), lambda w, j: F.when(F.get(F.col("_d"), F.col("_shift") + j) == w, 1).otherwise(0))
    size = F.when(n < SPAN, n).otherwise(F.least(n, F.lit(window)))
    need = F.when(n < SPAN, n).otherwise(F.ceil(size * F.lit(share)))
    found = found.select("_id", "_text_hash", "item_id", n.alias("_n"), equal.alias("_equal"), size.alias("_size"), need.alias("_need"))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    enough = F.exists(
        F.sequence(F.lit(1), F.col("_n") - F.col("_size") + 1),
        lambda s: total(F.slice(F.col("_equal"), s, F.col("_size"))) >= F.col("_need"),
    )
    return found.where(enough).select("_id", "_text_hash", "item_id", "_n", total(F.col("_equal")).alias("_matched"))


def overlaps(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per contaminated document and item: doc_id, item_id, n_words (of the item),
    n_matched (words of the item that stand at their places, for the best alignment).

    A document holds an item if, in some alignment with a seed in common, at least `share` of
    `window` consecutive words of the item (all, if it is shorter) are equal.  Items of 5 to 8
    words have to occur word for word; shorter ones, empty and null texts never match.  Null
    ids are returned as null.  Repeated rows give one row.  Extra columns are ignored.  Empty
    tables give an empty result.
    """
    found = _alignments(docs, benchmark, window, share, id_col, text_col)
    return found.groupBy(F.col("_id").alias("doc_id"), "item_id").agg(
        F.max("_n").cast("long").alias("n_words"), F.max("_matched").cast("long").alias("n_matched")
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, share: float = SHARE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The rows without a benchmark item, with all their columns."""
    bad = _alignments(docs, benchmark, window, share, id_col, text_col).select("_id", "_text_hash").distinct()
    bad = small(materialize(bad, "contaminated"))
    rows = docs.select(
        whole_row(docs).alias("row"),
        F.col(id_col).cast("long").alias("id"),
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("hash"),
    )
    return rows.join(bad, F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_text_hash")), "left_anti").select("row.*")


def oracle(window: int = WINDOW, share: float = SHARE) -> str:
    """For items of at least 9 words, as all have."""
    seeds = " UNION ALL ".join(
        f"SELECT key, pos, {n} AS mask, concat_ws(' ', {', '.join(f'w[pos + {k + 1}]' for k in m)}) AS seed FROM {{0}} WHERE pos + {m[-1]} < len(w)"
        for n, m in enumerate(MASKS)
    )
    of = lambda t: seeds.replace("{0}", t)
    return f"""
WITH i AS (SELECT item_id AS key, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM benchmark),
d AS (SELECT doc_id AS key, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS w FROM documents),
ip AS (SELECT key, w, unnest(range(0, len(w))) AS pos FROM i WHERE len(w) >= {SPAN}),
dp AS (SELECT key, w, unnest(range(0, len(w))) AS pos FROM d),
ise AS ({of('ip')}),
dse AS ({of('dp')}),
hit AS (
  SELECT DISTINCT a.key AS doc_id, b.key AS item_id, CAST(a.pos AS BIGINT) - CAST(b.pos AS BIGINT) AS shift
  FROM dse a JOIN ise b ON a.mask = b.mask AND a.seed = b.seed),
eq AS (
  SELECT h.doc_id, h.item_id, h.shift, j.pos,
    CASE WHEN h.shift + j.pos >= 0 AND d.w[h.shift + j.pos + 1] = j.w[j.pos + 1] THEN 1 ELSE 0 END AS e, len(j.w) AS n
  FROM hit h JOIN ip j ON j.key = h.item_id JOIN d ON d.key = h.doc_id),
win AS (
  SELECT *, sum(e) OVER (PARTITION BY doc_id, item_id, shift ORDER BY pos ROWS BETWEEN CURRENT ROW AND {window - 1} FOLLOWING) AS got,
    sum(e) OVER (PARTITION BY doc_id, item_id, shift) AS total
  FROM eq),
ok AS (
  SELECT doc_id, item_id, shift, any_value(n) AS n, any_value(total) AS total FROM win
  WHERE got >= ceil(least(n, {window}) * {share}) AND pos <= n - least(n, {window}) GROUP BY ALL)
SELECT doc_id, item_id, CAST(max(n) AS BIGINT) AS n_words, CAST(max(total) AS BIGINT) AS n_matched FROM ok GROUP BY doc_id, item_id
"""
