"""Hard negatives by best-first search in a packed R-tree.

Sort-tile-recursive packing deals the rows into tiles by label and by the two dimensions that
vary most; inside a tile the same packing makes leaves of some rows and levels of boxes above
them.  The minimum and maximum of every coordinate of a box give the interval in which an inner
product with any of its rows lies.  A search takes the box with the greatest upper end first and
passes over boxes that miss the score window or end strictly below the kth best score so far (or
on it, if all their ids come later).  The boxes of the tiles are the directory: it tells to
which tiles an anchor has to go at all.  Anchors visit tiles in blocks.

The tree is built by Spark tasks, one per tile.  A tile has about `TILE` rows, or a `TILES`th of
all rows if that is more, so the directory keeps its size however many rows there are; copies of
one vector are dealt to several tiles by their ids.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .decontamination import small
from .vectors import whole_vectors

POSITIVES, NEGATIVES = 5, 10
WINDOW = (30, 90)  # percent of the positive's score
EVERY = 100  # rows whose id this divides are anchors
TILE, TILES = 4096, 1 << 13
LEAF, FAN = 32, 16  # rows of a leaf, boxes of a node
STEP = 32  # leaves that are scored together
BLOCK = 1 << 14  # anchors that visit a tile together
LONG = (1 << 63) - 1


class Want(NamedTuple):
    """Rows with a score from low to high, the first k of them; kth is the best known kth
    (score, id), None as long as there are fewer."""

    name: int
    low: int
    high: int
    kth: tuple[int, int] | None


def exact(*arrays: np.ndarray) -> list[np.ndarray]:
    """As floats if all inner products are whole numbers that floats hold, else as Python numbers."""
    size = math.prod(max(abs(int(a.min(initial=0))), abs(int(a.max(initial=0)))) for a in arrays)
    kind = np.float64 if size * arrays[0].shape[-1] < 1 << 53 else object
    return [a.astype(kind) for a in arrays]


def clipped(scores: np.ndarray) -> np.ndarray:
    """`scores` within the range of a long (floats are, see `exact`)."""
    return np.minimum(np.maximum(scores, -LONG - 1), LONG) if scores.dtype == object else scores


def intervals(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of every query with any vector of every box."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    return clipped(up @ lo.T + down @ hi.T), clipped(up @ hi.T + down @ lo.T)


def useful(want: Want, low, high, least_id):
    """Whether boxes (or one box) may hold a row that `want` still lacks."""
    out = (high >= want.low) & (low <= want.high)
    if want.kth:
        score, ident = want.kth
        out &= (high > score) & (want.high > score) | (high >= score) & (least_id < ident)
    return out


def labelled(same: bool, label: int, first, last):
    """Whether label ranges hold the label (`same`), or any other one."""
    return (first <= label) & (label <= last) if same else (first != label) | (last != label)


def slabs(order: np.ndarray, keys: list[np.ndarray], count: int) -> Iterator[np.ndarray]:
    """`order` sorted by the first key and cut into slabs for the other keys; `count` leaves."""
    order = order[np.argsort(keys[0][order], kind="stable")]
    if len(keys) == 1:
        yield order
        return
    cuts = max(1, round(count ** (1 / len(keys))))
    leaves = -(-count // cuts)
    for start in range(0, len(order), leaves * LEAF):
        yield from slabs(order[start : start + leaves * LEAF], keys[1:], leaves)


class Tree:
    """Packed R-tree over the rows of a tile, given in leaf order."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        self.ids, self.labels, self.x = ids, labels, x
        lo, hi, first, last, least, size = x, x, labels, labels, ids, LEAF
        self.levels = []  # from the leaves to the root
        while not self.levels or len(lo) > 1:
            at = np.arange(0, len(lo), size)
            lo, hi = np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at)
            first, last, least = np.minimum.reduceat(first, at), np.maximum.reduceat(last, at), np.minimum.reduceat(least, at)
            self.levels.append((lo, hi, first, last, least))
            size = FAN

    @staticmethod
    def order(ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> np.ndarray:
        widest = np.argsort(-x.astype(np.float64).var(axis=0), kind="stable")[:2]
        keys = [labels, *(x[:, k] for k in widest)]
        return np.concatenate(list(slabs(np.argsort(ids, kind="stable"), keys, -(-len(ids) // LEAF))))

    def search(self, q: np.ndarray, own: np.ndarray, label: np.ndarray, wants: list[list[Want]], k: int, same: bool) -> list[list[list[tuple[int, int]]]]:
        """For every query (vector, id, label) and want the first k (score, id) of this tile
        that the want lacks: rows with the query's label (`same`) or with another one."""
        x, q = exact(self.x, q)
        boxes = [intervals(q, *(b.astype(x.dtype) for b in level[:2])) for level in self.levels]
        return [
            self._best(x, q[n], int(own[n]), int(label[n]), wants[n], k, same, [(low[n], high[n]) for low, high in boxes])
            for n in range(len(q))
        ]

    def _best(self, x, q, own, label, wants, k, same, boxes):
        found: list[list[tuple[int, int]]] = [[] for _ in wants]
        wants = list(wants)
        for_label = [labelled(same, label, level[2], level[3]) for level in self.levels]

        def needed(level: int, node: int) -> bool:
            low, high, least = boxes[level][0][node], boxes[level][1][node], self.levels[level][4][node]
            return for_label[level][node] and any(useful(w, low, high, least) for w in wants)

        top = len(self.levels) - 1
        queue = [(-boxes[top][1][0], top, 0)]
        while queue:
            leaves = []
            while queue and len(leaves) < STEP:
                _, level, node = heapq.heappop(queue)
                if not needed(level, node):
                    continue
                if level == 0:
                    leaves.append(node)
                    continue
                for child in range(node * FAN, min(node * FAN + FAN, len(self.levels[level - 1][0]))):
                    if needed(level - 1, child):
                        heapq.heappush(queue, (-boxes[level - 1][1][child], level - 1, child))
            if not leaves:
                break
            rows = (np.array(leaves)[:, None] * LEAF + np.arange(LEAF)).ravel()
            rows = rows[rows < len(x)]
            rows = rows[((self.labels[rows] == label) == same) & (self.ids[rows] != own)]
            score = clipped(x[rows] @ q)
            for n, want in enumerate(wants):
                fits = (score >= want.low) & (score <= want.high)
                if want.kth:
                    fits &= (score >= want.kth[0])
                fits = np.flatnonzero(fits.astype(bool))
                if len(fits):
                    pairs = self._first(score[fits], self.ids[rows[fits]], k)
                    found[n] = sorted(found[n] + pairs, key=lambda p: (-p[0], p[1]))[:k]
                    if len(found[n]) == k:
                        kth = found[n][-1]
                        if not want.kth or (-kth[0], kth[1]) < (-want.kth[0], want.kth[1]):
                            wants[n] = want._replace(kth=kth)
        return found

    @staticmethod
    def _first(score: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
        if score.dtype == object:
            return sorted(((int(s), int(i)) for s, i in zip(score, ids)), key=lambda p: (-p[0], p[1]))[:k]
        order = np.lexsort((ids, -score))[:k]
        return [(int(s), int(i)) for s, i in zip(score[order], ids[order])]


ANYTHING = Want(0, -LONG - 1, LONG, None)
WANTS = pa.list_(pa.struct([(c, pa.int64()) for c in ("name", "low", "high", "kth_score", "kth_id")]))
QUERY = "who long, seen long, own long, label long, q array<long>"
WANTED = "wants array<struct<name:long,low:long,high:long,kth_score:long,kth_id:long>>"
FOUND = "array<struct<name:long,score:long,id:long>>"


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    """List column of longs as a matrix."""
    return pa.concat_arrays(column.chunks if isinstance(column, pa.ChunkedArray) else [column]).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _read_wants(column) -> list[list[Want]]:
    return [
        [Want(w["name"], w["low"], w["high"], None if w["kth_score"] is None else (w["kth_score"], w["kth_id"])) for w in wants]
        for wants in column.to_pylist()
    ]


def tiled(rows: DataFrame, tile: int = TILE) -> tuple[DataFrame, int]:
    """`rows(vec_id, label, x)` with the tile that packing gives each; the vectors' length."""
    spread = rows.select(F.posexplode("x").alias("place", "value")).groupBy("place").agg(F.var_pop("value").alias("v"))
    widest = [r["place"] for r in spread.orderBy(F.desc("v"), "place").limit(2).collect()]
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.first(F.size("x")).alias("width")).first()
    tile = max(tile, -(-size["n"] // TILES))
    keys = [F.col("label"), *(F.get("x", F.lit(k)) for k in widest)]
    cuts = math.ceil((size["n"] / tile) ** (1 / len(keys)))
    cells: list[str] = []
    for level, key in enumerate(keys):
        if cuts > 1:
            shares = [k / cuts for k in range(1, cuts)]
            ends = rows.groupBy(*cells).agg(F.percentile_approx(key, shares, 10_000).alias("_ends"))
            if cells:  # at most cuts^2 groups: less than the tiles
                rows = rows.join(F.broadcast(ends), cells)
            else:
                rows = rows.withColumn("_ends", F.array(*(F.lit(e) for e in ends.first()["_ends"])))
            rows = rows.withColumn(f"cell{level}", F.size(F.filter("_ends", lambda e: e <= key))).drop("_ends")
        else:
            rows = rows.withColumn(f"cell{level}", F.lit(0))
        cells.append(f"cell{level}")
    counts, parts, start = rows.groupBy(*cells).count().collect(), [], 0  # about TILES rows at most
    for r in sorted(counts):
        pieces = -(-r["count"] // tile)
        parts.append((*(r[c] for c in cells), start, pieces))
        start += pieces
    parts = rows.sparkSession.createDataFrame(parts, ", ".join(f"{c} int" for c in cells) + ", _start long, _pieces long")
    rows = rows.join(F.broadcast(parts), cells)
    number = F.col("_start") + F.pmod(F.xxhash64("vec_id", "x"), F.col("_pieces"))
    return rows.select(number.alias("tile"), "vec_id", "label", "x"), size["width"] or 0


def build(rows: DataFrame, width: int, every: int, k: int) -> DataFrame:
    """One row per tile: its rows in leaf order, its box, and its anchors with the k positives
    that the tile itself has for them."""
    schema = (
        "tile long, ids array<long>, labels array<long>, x array<long>, lo array<long>, hi array<long>, "
        f"first long, last long, least long, anchors array<struct<at:long,found:{FOUND}>>"
    )
    hit = pa.list_(pa.struct([("name", pa.int64()), ("score", pa.int64()), ("id", pa.int64())]))

    def run(table: pa.Table) -> pa.Table:
        ids, labels = (table.column(c).to_numpy() for c in ("vec_id", "label"))
        x = _vectors(table.column("x"), width)
        order = Tree.order(ids, labels, x)
        tree = Tree(ids[order], labels[order], x[order])
        at = np.flatnonzero(tree.ids % every == 0)
        found = tree.search(tree.x[at], tree.ids[at], tree.labels[at], [[ANYTHING]] * len(at), k, True)
        anchors = [
            {"at": int(a), "found": [{"name": 0, "score": s, "id": i} for s, i in hits[0]]} for a, hits in zip(at, found)
        ]
        lo, hi, first, last, least = tree.levels[-1]
        columns = [
            pa.array([table.column("tile")[0].as_py()]),
            *(pa.array([a.tolist()], pa.list_(pa.int64())) for a in (tree.ids, tree.labels, tree.x.ravel(), lo[0], hi[0])),
            *(pa.array([int(a[0])]) for a in (first, last, least)),
            pa.array([anchors], pa.list_(pa.struct([("at", pa.int64()), ("found", hit)]))),
        ]
        return pa.Table.from_arrays(columns, names=["tile", "ids", "labels", "x", "lo", "hi", "first", "last", "least", "anchors"])

    return rows.groupBy("tile").applyInArrow(run, schema)


def routes(requests: DataFrame, directory, width: int, blocks: int, same: bool, first: bool) -> DataFrame:
    """`requests(who, seen, own, label, q, wants)` with every tile but `seen` that may hold what
    they want, or (`first`) with the one whose middle is nearest to the anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, lo, hi, low_label, high_label, least = directory.value
        for batch in batches:
            if not len(batch):
                continue
            q = _vectors(batch.column("q"), width)
            low, high = intervals(*exact_boxes(q, lo, hi))
            who, seen, label = (batch.column(c).to_numpy() for c in ("who", "seen", "label"))
            wants = _read_wants(batch.column("wants"))
            for n in range(len(q)):
                may = labelled(same, label[n], low_label, high_label) & (tile != seen[n])
                if wants[n]:
                    may = may & np.any([useful(w, low[n], high[n], least).astype(bool) for w in wants[n]], axis=0)
                at = np.flatnonzero(may if wants[n] else np.zeros(len(tile), bool))
                if first and len(at):
                    at = at[[int(np.argmax(low[n][at] + high[n][at]))]]
                if len(at):
                    cells = [pa.array(np.repeat(i, len(at))) for i in (who[n] % blocks, who[n], seen[n], batch.column("own")[n].as_py(), label[n])]
                    lists = [batch.column(c).take(pa.array(np.full(len(at), n))) for c in ("q", "wants")]
                    yield pa.RecordBatch.from_arrays([pa.array(tile[at]), *cells, *lists], names=["tile", "block", "who", "seen", "own", "label", "q", "wants"])

    return requests.mapInArrow(run, f"tile long, block long, {QUERY}, {WANTED}")


def exact_boxes(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[np.ndarray]:
    both, points = exact(np.concatenate([lo, hi]), q)
    return [points, both[: len(lo)], both[len(lo) :]]


def visit(trees: DataFrame, requests: DataFrame, width: int, k: int, same: bool) -> DataFrame:
    """What the tiles of `requests` (as `routes` gives them) hold: who, tile, name, score, id."""
    needed = requests.select("tile", "block").distinct()
    left = trees.select("tile", "ids", "labels", "x").join(small(needed), "tile")

    def run(tile: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple[int, ...]] = []
        if len(tile) and len(asked):
            ids, labels = (tile.column(c).chunk(0).flatten().to_numpy(zero_copy_only=False) for c in ("ids", "labels"))
            tree = Tree(ids, labels, _vectors(tile.column("x"), width))
            own, label, who = (asked.column(c).to_numpy() for c in ("own", "label", "who"))
            wants = _read_wants(asked.column("wants"))
            number = tile.column("tile")[0].as_py()
            for n, hits in enumerate(tree.search(_vectors(asked.column("q"), width), own, label, wants, k, same)):
                out += [(int(who[n]), number, w.name, s, i) for w, found in zip(wants[n], hits) for s, i in found]
        columns = list(zip(*out)) if out else [[]] * 5
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["who", "tile", "name", "score", "id"])

    schema = "who long, tile long, name long, score long, id long"
    asking = requests.withColumnsRenamed({"tile": "_tile", "block": "_block"})
    return left.groupBy("tile", "block").cogroup(asking.groupBy("_tile", "_block")).applyInArrow(run, schema)


def best(found: DataFrame, k: int) -> DataFrame:
    """The first k of every who and name, with their rank.  A tile has sent k at most."""
    order = Window.partitionBy("who", "name").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _kth(found: DataFrame, k: int) -> DataFrame:
    """(who, name, kth_score, kth_id) of those that have k."""
    return found.where(F.col("rank") == k).select("who", "name", F.col("score").alias("kth_score"), F.col("id").alias("kth_id"))


def hard_negatives(
    rows: DataFrame,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    window: tuple[int, int] = WINDOW,
    every: int = EVERY,
    tile: int = TILE,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
) -> DataFrame:
    """One row per anchor, positive and negative: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score.

    Vectors are floor(256 * c), scores inner products; higher ones come first, ties by smaller
    id.  Anchors are the rows whose id `every` divides; their positives the first other rows of
    their label, their negatives, for each positive, the first rows of another label whose score
    is between `window` percent of the positive's.  A positive without negatives gives no row.
    Rows with a null id, label or vector, with a null or non-finite entry, or with another length
    than most take no part.  Rows equal in id, label and vector count once; of different rows
    that share an id each counts, but not for an anchor with that id.  Scores beyond a long
    become its ends.  Extra columns are ignored, whatever their names.  An empty table gives an
    empty result.
    """
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark = rows.sparkSession
    named = F.col(id_col).isNotNull() & F.col(label_col).isNotNull()
    points = whole_vectors(rows.where(named), vector_col, vec_id=F.col(id_col).cast("long"), label=F.col(label_col).cast("long"))
    points = materialize(points.where(F.size("x") > 0).distinct(), "points")
    if points.isEmpty():
        return spark.createDataFrame([], schema)
    dealt, width = tiled(points, tile)
    trees = materialize(build(dealt, width, every, positives), "tiles")

    tiles = trees.select("tile", "lo", "hi", "first", "last", "least").orderBy("tile").toArrow()  # about TILES rows at most
    boxes = [_vectors(tiles.column(c), width) for c in ("lo", "hi")]
    numbers = [tiles.column(c).to_numpy() for c in ("tile", "first", "last", "least")]
    directory = spark.sparkContext.broadcast((numbers[0], *boxes, *numbers[1:]))

    anchors = trees.select("tile", "ids", "labels", "x", F.explode("anchors").alias("a")).select(
        (F.shiftleft("tile", 32) + F.col("a.at")).alias("who"),
        F.col("tile").alias("seen"),
        F.get("ids", F.col("a.at").cast("int")).alias("own"),
        F.get("labels", F.col("a.at").cast("int")).alias("label"),
        F.slice("x", (F.col("a.at") * width + 1).cast("int"), width).alias("q"),
        F.col("a.found").alias("found"),
    )
    anchors = materialize(anchors, "anchors")
    blocks = -(-anchors.count() // BLOCK) or 1

    # Positives: what the own tile has sets the score that other tiles have to reach.
    last = F.get("found", F.lit(positives - 1))
    all_scores = [F.lit(v).cast("long") for v in (0, -LONG - 1, LONG)]
    want = F.struct(*(c.alias(n) for c, n in zip([*all_scores, last["score"], last["id"]], ("name", "low", "high", "kth_score", "kth_id"))))
    asked = routes(anchors.select("who", "seen", "own", "label", "q", F.array(want).alias("wants")), directory, width, blocks, True, False)
    near = visit(trees, materialize(asked, "positive-routes"), width, positives, True)
    home = anchors.select("who", F.col("seen").alias("tile"), F.explode("found").alias("hit")).select("who", "tile", "hit.*")
    chosen = materialize(best(near.unionByName(home), positives), "positives")

    # Negatives: one tile first, for a score that the others have to reach.
    low, high = window
    # In whole numbers: low * p <= 100 * s <= high * p.
    p = F.col("score").cast("decimal(38,0)")
    ends = [F.ceil(p * low / 100).cast("long"), F.floor(p * high / 100).cast("long")]
    wants = chosen.select("who", F.col("score").alias("name"), ends[0].alias("low"), ends[1].alias("high")).where("low <= high").distinct()

    def requests(seen: DataFrame | None, kth: DataFrame | None) -> DataFrame:
        open_ = wants.join(kth, ["who", "name"], "left") if kth is not None else wants.withColumns(
            {c: F.lit(None).cast("long") for c in ("kth_score", "kth_id")}
        )
        lists = open_.groupBy("who").agg(F.collect_list(F.struct("name", "low", "high", "kth_score", "kth_id")).alias("wants"))  # `positives` at most
        out = anchors.select("who", "own", "label", "q").join(lists, "who")
        out = out.join(seen, "who", "left") if seen is not None else out.withColumn("seen", F.lit(-1).cast("long"))
        return out.select("who", F.coalesce("seen", F.lit(-1)).alias("seen"), "own", "label", "q", "wants")

    begun = materialize(routes(requests(None, None), directory, width, blocks, False, True), "first-routes")
    found = materialize(visit(trees, begun, width, negatives, False), "first-negatives")
    seen = begun.select("who", F.col("tile").alias("seen"))
    asked = routes(requests(seen, _kth(best(found, negatives), negatives)), directory, width, blocks, False, False)
    more = visit(trees, materialize(asked, "negative-routes"), width, negatives, False)
    mined = best(found.unionByName(more), negatives)

    pairs = chosen.select("who", F.col("score").alias("name"), F.col("id").alias("positive_id"))
    return (
        mined.join(pairs, ["who", "name"])
        .join(anchors.select("who", F.col("own").alias("anchor_id")), "who")
        .select(
            "anchor_id",
            "positive_id",
            F.col("rank").cast("int").alias("rank"),
            F.col("id").alias("negative_id"),
            F.col("name").alias("positive_score"),
            F.col("score").alias("negative_score"),
        )
    )


#: The query's labels: rows whose vec_id 7 divides get the next of ten.
ORACLE = """
WITH whole AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * c::DOUBLE) for c in embedding] AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([c for c in embedding if c IS NULL OR NOT isfinite(c)]) = 0
), points AS (
  SELECT * FROM whole
  WHERE len(x) = (SELECT len(x) FROM whole GROUP BY 1 ORDER BY count(*) DESC, 1 DESC LIMIT 1)
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS anchor_label, r.vec_id AS id, r.label = a.label AS same,
         CAST(list_inner_product(a.x, r.x) AS BIGINT) AS score
  FROM points a JOIN points r ON a.vec_id % 100 = 0 AND r.vec_id <> a.vec_id
), positives AS (
  SELECT anchor_id, anchor_label, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id, anchor_label ORDER BY score DESC, id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.anchor_label, p.positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS "rank",
       s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.anchor_label = p.anchor_label AND NOT s.same
  AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY "rank" <= 10
"""
