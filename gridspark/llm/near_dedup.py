"""Near duplicates by weighted minima.

A text is a weighted set of shingles of five words; a shingle weighs its count times the mean
inverse document frequency of its words.  Improved consistent weighted sampling draws, for
every bin of shingles, the one that a random order by weight puts first, so that two texts
draw the same one about as often as their weighted Jaccard similarity says.  Bands of draws
bring likely pairs together; in every bucket all members are compared with two pivots, by their
exact weighted Jaccard similarity, and the confirmed links are joined to classes.  Members of
buckets that still hold several classes are compared once more, all pairs that can be similar
at all: those that share one of their rarest shingles.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, whole_row
from .components import components
from .decontamination import small
from .tokens import mix, portions, run_hashes, run_starts, word_hashes, word_lists

WORDS = 5
SIMILARITY = 0.8
GROUPS, BINS = 4, 32  # every shingle is in one bin of each group
ROWS = 5  # draws in a band; 25 bands find a pair of similarity 0.8 with probability 0.99995
CROWD, TURNS = 64, 2  # members of a shingle whose neighbours are compared first, and how often
BUCKETS = 1 << 16  # counters of document frequencies, by hash of the word
SEEDS = [np.uint64(0x9E3779B97F4A7C15 * k % (1 << 64)) for k in range(1, 64)]


def _prepared(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    coded, first = word_lists(pc.utf8_lower(texts.cast(pa.large_string())))
    return word_hashes(coded), first


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """For each hash bucket of words the number of documents with such a word; bucket -1 has
    the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(BUCKETS, dtype=np.int64), 0
        last, places = np.zeros(BUCKETS, dtype=np.int64), np.arange(0)
        for batch in batches:
            texts = batch.column(0)
            n += len(texts)
            for a, b in portions(texts):
                words, first = _prepared(texts.slice(a, b - a))
                bucket = (words % np.uint64(BUCKETS)).astype(np.int64)
                if len(places) < len(bucket):
                    places = np.arange(len(bucket))
                for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
                    # Each bucket of a text counts at its last place.
                    own, at = bucket[i:j], places[i:j]
                    last[own] = at
                    total[own[last[own] == at]] += 1
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(seen, -1).astype(np.int32)), pa.array(np.append(total[seen], n))], names=["bucket", "n"]
        )

    return docs.select(text_col).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def inverse_frequencies(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """ln(1 + documents / documents with the bucket's words); at most `BUCKETS` numbers."""
    counts = dict(document_frequencies(docs, text_col).collect())
    n = counts.pop(-1, 0)
    out = np.full(BUCKETS, math.log(1 + n))
    for k, v in counts.items():
        out[k] = math.log(1 + n / v)
    return out


def weighted_shingles(texts: pa.Array, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, shingle hash, weight and count of every distinct shingle.  A text of 1 to 4 words
    is one shingle."""
    words, first = _prepared(texts)
    value = idf[(words % np.uint64(BUCKETS)).astype(np.int64)]
    at, doc = run_starts(first, WORDS)
    sums = np.concatenate([[0.0], np.cumsum(value)])
    hashes = run_hashes(words, WORDS)[at] if len(at) else np.zeros(0, np.uint64)
    weight = (sums[at + WORDS] - sums[at]) / WORDS
    size = np.diff(first)
    for d in np.flatnonzero((size > 0) & (size < WORDS)):
        part = words[first[d] : first[d + 1]]
        doc, hashes = np.append(doc, d), np.append(hashes, run_hashes(part, len(part)) ^ SEEDS[len(part)])
        weight = np.append(weight, value[first[d] : first[d + 1]].mean())
    # The same shingle may come by other rounding of the running sums: take one weight for all.
    own = mix(hashes ^ mix(doc.astype(np.uint64) + SEEDS[20]))
    _, index, count = np.unique(own, return_index=True, return_counts=True)
    return doc[index], hashes[index], np.round(weight[index], 6) * count, count


def draws(doc: np.ndarray, shingle: np.ndarray, weight: np.ndarray, texts: int) -> np.ndarray:
    """(texts, GROUPS * BINS) hashes of the drawn (shingle, level); a bin without a shingle
    takes another bin's draw, which one is a function of the bin and the try alone."""
    out = np.zeros((texts, GROUPS * BINS), np.uint64)
    half = lambda x: ((x >> np.uint64(32)).astype(np.float64) + 0.5) / 2**32
    low = lambda x: ((x & np.uint64(0xFFFFFFFF)).astype(np.float64) + 0.5) / 2**32
    log_w = np.log(np.maximum(weight, 1e-9))
    for g in range(GROUPS):
        x, y, z = (mix(shingle ^ SEEDS[24 + 3 * g + j]) for j in range(3))
        r, log_c = -np.log(half(x) * low(x)), np.log(-np.log(half(y) * low(y)))
        beta = half(z)
        level = np.floor(log_w / r + beta)
        log_a = log_c - r * (level - beta + 1)
        cell = doc * BINS + (z % np.uint64(BINS)).astype(np.int64)
        least = np.full(texts * BINS, np.inf)
        np.minimum.at(least, cell, log_a)
        won = log_a == least[cell]
        part = np.zeros(texts * BINS, np.uint64)
        part[cell[won]] = mix(shingle[won] ^ mix(level[won].astype(np.int64).astype(np.uint64) + SEEDS[21]))
        full = np.isfinite(least).reshape(texts, BINS)
        part = part.reshape(texts, BINS)
        some = full.any(1)
        for t in range(1, 64 * BINS):
            todo = ~full & some[:, None]
            if not todo.any():
                break
            source = (mix(np.arange(BINS, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (t + 64) % (1 << 64))) % np.uint64(BINS)).astype(np.int64)
            give = todo & np.isfinite(least).reshape(texts, BINS)[:, source]
            part[give] = part[:, source][give] ^ SEEDS[22]
            full |= give
        out[:, g * BINS : (g + 1) * BINS] = part
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """(texts, bands) keys of every ROWS draws."""
    n = signature.shape[1] // ROWS
    order = np.argsort(mix(np.arange(signature.shape[1], dtype=np.uint64) + SEEDS[23]))  # bands across all groups
    out = np.zeros((len(signature), n), np.uint64)
    for k in range(n):
        key = np.full(len(signature), SEEDS[k], np.uint64)
        for j in order[k * ROWS : (k + 1) * ROWS]:
            key = mix(key ^ signature[:, j])
        out[:, k] = key
    return out


def signatures(texts: DataFrame, idf: np.ndarray) -> DataFrame:
    """`texts(node, text)` -> (node, key): one row per band.  Texts without words have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in portions(batch.column("text")):
                doc, shingle, weight, _ = weighted_shingles(batch.column("text").slice(a, b - a), idf)
                some = np.unique(doc)
                keys = band_keys(draws(np.searchsorted(some, doc), shingle, weight, len(some))).view(np.int64)
                node = batch.column("node").slice(a, b - a).take(pa.array(np.repeat(some, keys.shape[1])))
                yield pa.RecordBatch.from_arrays([node, pa.array(keys.ravel())], names=["node", "key"])

    return texts.select("node", "text").mapInArrow(run, "node binary, key long")


def candidates(keys: DataFrame) -> DataFrame:
    """Distinct pairs (a, b): every member of a bucket with the bucket's smallest and largest."""
    pivots = keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi")
    met = keys.join(pivots, "key").select("node", F.explode(F.array("lo", "hi")).alias("pivot")).where("node != pivot")
    return met.select(F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")).distinct()


def unresolved(keys: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root): the members of buckets that hold several classes, with their class."""
    named = keys.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    named = materialize(named, "bucket-classes")
    mixed = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("key")
    return named.join(small(materialize(mixed, "mixed-buckets")), "key", "left_semi").select("node", "root").distinct()


def rare_shingles(members: DataFrame, texts: DataFrame, idf: np.ndarray, similarity: float) -> DataFrame:
    """For `members(node, root)` the shingles at which a similar text of another class may meet
    them: kind (0: by weights, 1: by counts), shingle, node, size (of the text), rest (what this
    shingle and all later ones weigh), small (whether it is enough for the smaller of two texts).

    Shingles are ordered, those that only one class has first, then by the number of members that
    have them.  A pair's overlap lies after its first common shingle, so that shingle must leave
    either text enough: `similarity` s of the larger text's size, and of the smaller one's 2 s /
    (1 + s).  What a family of texts shares comes late in the order, so texts that differ by more
    than the threshold allows do not meet in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in portions(batch.column("text")):
                doc, shingle, weight, count = weighted_shingles(batch.column("text").slice(a, b - a), idf)
                sums = [np.bincount(doc, v, b - a)[doc] for v in (weight, count)]
                ids = [batch.column(c).slice(a, b - a).take(pa.array(doc)) for c in ("node", "root")]
                arrays = [pa.array(shingle.view(np.int64)), *(pa.array(np.asarray(v, float)) for v in (weight, count, *sums))]
                yield pa.RecordBatch.from_arrays([*ids, *arrays], names=["node", "root", "shingle", "w", "c", "all_w", "all_c"])

    schema = "node binary, root binary, shingle long, w double, c double, all_w double, all_c double"
    rows = materialize(members.join(texts, "node").select("node", "root", "text").mapInArrow(run, schema), "member-shingles")
    shared = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    rows = rows.join(shared.where("lo != hi").select("shingle", "n"), "shingle")
    order = Window.partitionBy("node").orderBy(F.desc("n"), F.desc("shingle"))  # the shingles of one text
    rows = rows.withColumns({f"rest_{x}": F.sum(x).over(order) for x in ("w", "c")})
    least = lambda x, share: F.col(f"rest_{x}") >= F.col(f"all_{x}") * (share - 1e-9)
    kinds = [
        F.when(
            least(x, similarity),
            F.struct(
                F.lit(k).alias("kind"),
                F.col(f"all_{x}").alias("size"),
                F.col(f"rest_{x}").alias("rest"),
                least(x, 2 * similarity / (1 + similarity)).alias("small"),
            ),
        )
        for k, x in enumerate(("w", "c"))
    ]
    heads = rows.select("node", "shingle", F.explode(F.array_compact(F.array(*kinds))).alias("k"))
    return heads.select("k.kind", "shingle", "node", "k.size", "k.rest", "k.small")


def _fits(similarity: float) -> Column:
    """Whether a smaller text (columns with _u) and a larger one that meet at a shingle may be similar."""
    enough = F.least("rest", "rest_u") >= (F.col("size") + F.col("size_u")) * (similarity / (1 + similarity) - 1e-9)
    return enough & (F.col("size_u") <= F.col("size") * (1 + 1e-9)) & (F.col("size_u") >= F.col("size") * (similarity - 1e-9))


def _pair(u: str, v: str) -> tuple[Column, Column]:
    return F.least(u, v).alias("a"), F.greatest(u, v).alias("b")


def neighbours(heads: DataFrame, similarity: float, turn: int) -> DataFrame:
    """Distinct pairs (a, b) of neighbours at crowded shingles, in an order that depends on the turn."""
    crowd = heads.groupBy("kind", "shingle").count().where(F.col("count") >= CROWD).select("kind", "shingle")
    place = F.xxhash64(F.lit(turn), "node")
    rows = heads.join(small(crowd), ["kind", "shingle"]).withColumn("part", F.pmod(place, F.lit(CROWD // 4)))
    order = Window.partitionBy("kind", "shingle", "part").orderBy(place)
    late = rows.withColumns({f"{c}_u": F.lag(c).over(order) for c in ("node", "size", "rest")}).where("node_u is not null")
    swapped = late.where("size_u > size").select("node_u", "node", *(F.col(x).alias(y) for c in ("size", "rest") for x, y in ((c, f"{c}_u"), (f"{c}_u", c))))
    both = late.where("size_u <= size").select(*swapped.columns).unionByName(swapped)
    return both.where(_fits(similarity)).select(*_pair("node", "node_u")).distinct()


def further(heads: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (a, b) that meet in `heads`, are in different classes and may be similar; no
    similar pair of different classes is left out."""
    heads = heads.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = heads.groupBy("kind", "shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi")
    heads = heads.join(mixed.select("kind", "shingle"), ["kind", "shingle"], "left_semi")
    heads = materialize(heads, "rare-shingles")
    left = heads.where("small").select("kind", "shingle", *(F.col(c).alias(f"{c}_u") for c in ("node", "root", "size", "rest")))
    met = left.join(heads, (left.kind == heads.kind) & (left.shingle == heads.shingle) & (F.col("root") != F.col("root_u")) & _fits(similarity))
    return met.select(*_pair("node", "node_u")).distinct()


def similar(pairs: DataFrame, texts: DataFrame, idf: np.ndarray, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) whose Jaccard similarity, by weights or by plain counts, is `similarity`
    or more."""
    both = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = both.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: OrderedDict[bytes, tuple[np.ndarray, np.ndarray]] = OrderedDict()

        def vector(node: bytes, text: str) -> tuple[np.ndarray, np.ndarray]:
            """Shingles in order; their weights and their counts."""
            if node not in seen:
                _, shingle, weight, count = weighted_shingles(pa.array([text]), idf)
                order = np.argsort(shingle)
                seen[node] = shingle[order], np.stack([weight, count])[:, order]
                if len(seen) > 64:
                    seen.popitem(last=False)
            seen.move_to_end(node)
            return seen[node]

        for batch in batches:
            out = []
            for i, j in portions(batch.column("text_a")):
                part = batch.slice(i, j - i)
                for a, b, ta, tb in zip(*(part.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b"))):
                    (x, v), (y, w) = vector(a, ta), vector(b, tb)
                    if len(x) and len(y):
                        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                        common = np.minimum(v, w[:, at])[:, y[at] == x].sum(1)
                        if (common >= similarity * (v.sum(1) + w.sum(1) - common) - 1e-9).any():
                            out.append((a, b))
            cols = list(zip(*out)) if out else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in cols], names=["a", "b"])

    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def _classes(docs: DataFrame, similarity: float, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, node) and the nodes (node, class_id, class_size, first): a node is a
    distinct text, `first` the one that stands for the class."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("node", F.unhex(F.md5("text")))
    idf = inverse_frequencies(rows)
    keys = materialize(signatures(rows, idf).distinct(), "band-keys")
    pairs = materialize(candidates(keys), "pairs")
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    needed = materialize(needed, "pair-nodes")
    texts = rows.select("node", "text").join(small(needed), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    texts = materialize(texts, "pair-texts")
    links = materialize(similar(pairs, texts, idf, similarity), "links")
    roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    members = materialize(unresolved(keys, roots), "members")
    heads = materialize(rare_shingles(members, texts, idf, similarity), "heads")
    for turn in range(TURNS + 1):
        # Neighbours first: what they link into one class need not be compared pair by pair.
        met = neighbours(heads, similarity, turn) if turn < TURNS else further(heads, roots, similarity)
        new = materialize(met.join(pairs, ["a", "b"], "left_anti"), "more-pairs")
        if not new.isEmpty():
            found = materialize(similar(new, texts, idf, similarity), "more-links")
            pairs = pairs.unionByName(new)
            if not found.isEmpty():
                links = links.unionByName(found)
                roots = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    nodes = rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    nodes = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "least", "n")
    nodes = materialize(nodes, "nodes")
    named = F.struct(F.col("least").isNull(), "least", "node")
    classes = nodes.groupBy("root").agg(
        F.min("least").alias("class_id"), F.sum("n").alias("class_size"), F.min(named)["node"].alias("first")
    )
    return rows.select("doc_id", "node"), nodes.join(classes, "root").select("node", "class_id", "class_size", "first")


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, class_id, class_size.

    Documents are in one class if a chain of links joins them; equal texts are linked, and
    different ones if their Jaccard similarity, by weights or by plain counts, is `similarity`
    or more.  The smallest doc_id of a class names it (null if it has none).  Null texts count
    as empty; texts without a word are linked to equal ones only.  Long texts are compared whole.  Repeated rows are in one
    class and all returned.  Extra columns are ignored.  An empty table gives an empty result.
    """
    rows, nodes = _classes(docs, similarity, id_col, text_col)
    return rows.join(nodes, "node").select("doc_id", "class_id", "class_size")


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of every class the row with the smallest doc_id, with all its columns, whatever their names;
    of rows that repeat id and text, one.  Nulls, empty and long texts and empty tables are treated
    as in `near_duplicates`; of rows without an id the one with the least digest stays."""
    _, nodes = _classes(docs, similarity, id_col, text_col)
    kept = nodes.where("node = first").select("class_id", "first")
    rows = docs.select(
        whole_row(docs).alias("row"),
        F.col(id_col).cast("long").alias("id"),
        F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("node"),
    )
    rows = rows.join(kept, F.col("id").eqNullSafe(F.col("class_id")) & (F.col("node") == F.col("first")), "left_semi")
    return rows.dropDuplicates(["id", "node"]).select("row.*")
