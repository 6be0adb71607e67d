"""Which windows of a corpus of sequences occur again, without shuffling every window.

A finder gives every window a landmark that depends on the window's own content, so equal
windows have equal landmarks at equal places.  Consecutive windows with one landmark are a
run; runs are what is shuffled, by landmark:

1. Runs of one landmark that cover equal content settle all their windows at once.
2. Runs of one landmark that differ, but agree on the left or the right of it, may share some
   windows (mostly at the ends of repeated passages).  Only these are hashed window by window,
   and of them only the windows that do not hold all of the side on which no other run agrees.
3. The settled ranges go back to their texts.

A task combines its own runs before they are dealt out: copies that it settles itself are not
dealt at all, and of a landmark with many different runs only a note is, its runs being hashed
by window in any case.  So the rows that meet for one landmark are a few per task of the first
stage, however common a passage is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, partitions
from .decontamination import small
from .tokens import mix, portions

#: texts -> (text number, landmark, run content, left side, right side, first window, windows,
#: windows at the head without all of the right side, windows at the tail without all of the left)
Finder = Callable[[pa.Array], tuple[np.ndarray, ...]]
NO_ID = (1 << 63) - 1  # stands for a missing id and is larger than all others
WIDEST = (1 << 16) - 1  # windows of a run, so no window may be wider
CHUNK = 1 << 20  # runs that a task combines at once
HASHED = 1 << 20  # bytes of text whose windows are hashed together
MANY = 16  # different runs of one landmark in a chunk from which only a note is dealt
SETTLED, OPEN = 0, 2
TEXT = ("doc", "k1", "k2")  # what tells texts apart
PLACE = (*TEXT, "pos")
COLUMNS = ("name", "run", "sides", "part", *PLACE)
KEYS = "doc long, k1 long, k2 long"


def identified(docs: DataFrame) -> DataFrame:
    """`docs(doc, text)` -> doc, k1, k2, none, text.  Texts of rows that share an id, or have
    none, are told apart by 128 bits of their content, k1 and k2, which are 0 for all others
    and cost nothing then; `none` marks missing ids."""
    docs = docs.select(F.col("doc").cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    shared = docs.where("doc is not null").groupBy("doc").count().where("count > 1").select(F.col("doc").alias("_shared"))
    shared = small(materialize(shared, "shared-ids"))
    rows = docs.join(shared, F.col("doc") == F.col("_shared"), "left")
    none = F.col("doc").isNull()
    digest = F.when(none | F.col("_shared").isNotNull() | (F.col("doc") == NO_ID), F.md5(F.concat(F.when(none, "0").otherwise("1"), "text")))
    half = lambda at: F.coalesce(F.conv(F.substr(digest, F.lit(at), F.lit(16)), 16, -10).cast("long"), F.lit(0))
    return rows.select(F.coalesce("doc", F.lit(NO_ID)).alias("doc"), half(1).alias("k1"), half(17).alias("k2"), none.alias("none"), "text")


def pack_pos(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """First window, number of windows (at most `WIDEST`)."""
    return (start.astype(np.int64) << np.int64(16)) | count.astype(np.int64)


def starts(pos: np.ndarray) -> np.ndarray:
    return pos >> np.int64(16)


def counts(pos: np.ndarray) -> np.ndarray:
    return pos & np.int64(WIDEST)


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Numbers of the groups of equal neighbours."""
    new = np.zeros(len(keys[0]), dtype=bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.cumsum(new)


def settle(cols: dict[str, np.ndarray], earlier: bool) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Sorts runs by landmark and content.  Returns the sorted columns, which rows are settled
    (all windows occur again), which stand for their content, and the landmark's number."""
    order = np.lexsort((cols["pos"], cols["doc"], cols["run"], cols["name"]))
    cols = {k: v[order] for k, v in cols.items()}
    if not len(order):
        none = np.zeros(0, dtype=bool)
        return cols, none, none, np.zeros(0, np.int64)
    name, run = _groups(cols["name"]), _groups(cols["name"], cols["run"])
    first = np.flatnonzero(np.diff(run, prepend=-1))
    if earlier:
        settled = cols["doc"] > cols["doc"][first][run]
        return cols, settled, ~settled, name
    stands = np.zeros(len(order), dtype=bool)
    stands[first] = True
    return cols, np.bincount(run)[run] > 1, stands, name


def _take(cols: dict[str, np.ndarray], rows: np.ndarray) -> dict[str, np.ndarray]:
    return {k: v[rows] for k, v in cols.items()}


def _blob(cols: dict[str, np.ndarray], names: tuple[str, ...]) -> bytes:
    """Columns, bytes of equal weight together, compressed."""
    parts = [np.ascontiguousarray(cols[c]).view(np.uint8).reshape(-1, cols[c].itemsize).T.tobytes() for c in names]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _unblob(blob: bytes, n: int, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.uint8)
    kinds = {"name": np.uint64, "run": np.uint64, "sides": np.uint32, "part": np.uint32, **dict.fromkeys(PLACE, np.int64)}
    out, at = {}, 0
    for c in names:
        size = np.dtype(kinds[c]).itemsize
        out[c] = raw[at : at + n * size].reshape(size, n).T.copy().view(kinds[c]).ravel()
        at += n * size
    return out


def _deal(cols: dict[str, np.ndarray], buckets: int, earlier: bool) -> Iterator[tuple[int, int, int, bytes]]:
    """(bucket, kind, rows, blob) of a chunk of runs.  Kind 1: runs to be met with others; 3:
    landmarks with many runs; 0 and 2: settled and open ranges, done with."""
    cols, settled, stands, name = settle(cols, earlier)
    many = np.bincount(name[stands], minlength=1)[name] >= MANY if len(name) else stands
    done, left = _take(cols, settled), _take(cols, stands & many)
    away = lambda x: mix((x["doc"] ^ x["k1"]).view(np.uint64)) % np.uint64(buckets)
    for kind, part, bucket in ((SETTLED, done, away(done)), (OPEN, left, away(left))):
        yield from _pieces(part, bucket, kind, PLACE)
    note = _take(cols, np.flatnonzero(many)[np.diff(name[many], prepend=-1) != 0]) if many.any() else _take(cols, many)
    rest = _take(cols, stands & ~many)
    yield from _pieces(note, note["name"] % np.uint64(buckets), 3, ("name",))
    yield from _pieces(rest, rest["name"] % np.uint64(buckets), 1, COLUMNS)


def _pieces(cols: dict[str, np.ndarray], bucket: np.ndarray, kind: int, names: tuple[str, ...]) -> Iterator[tuple[int, int, int, bytes]]:
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    edges = [*np.flatnonzero(np.diff(bucket, prepend=bucket[:1] + np.uint64(1))), len(bucket)]
    for a, b in zip(edges, edges[1:]):
        yield int(bucket[a]), kind, b - a, _blob(_take(cols, order[a:b]), names)


def _meet(blobs: list[tuple[int, int, bytes]], earlier: bool) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Kind and places of all that came to one bucket."""
    rows = [_unblob(b, n, COLUMNS) for kind, n, b in blobs if kind == 1]
    notes = [_unblob(b, n, ("name",))["name"] for kind, n, b in blobs if kind == 3]
    for kind, n, b in blobs:
        if kind in (SETTLED, OPEN):
            yield kind, _unblob(b, n, PLACE)
    if not rows:
        return
    cols, settled, stands, _ = settle({c: np.concatenate([r[c] for r in rows]) for c in COLUMNS}, earlier)
    yield SETTLED, {c: cols[c][settled] for c in PLACE}
    rest = _take(cols, stands)
    noted = np.isin(rest["name"], np.concatenate(notes)) if notes else np.zeros(len(rest["name"]), dtype=bool)
    agree = []
    for side in (rest["sides"] >> np.uint32(16), rest["sides"] & np.uint32(0xFFFF)):
        order = np.lexsort((rest["run"], side, rest["name"]))
        group = _groups(rest["name"][order], side[order])
        both = _groups(rest["name"][order], side[order], rest["run"][order])
        kinds = np.zeros(len(order) and group[-1] + 1, np.int64)
        np.add.at(kinds, group[np.diff(both, prepend=-1) != 0], 1)
        agree.append(noted.copy())
        agree[-1][order] |= kinds[group] > 1
    start, n = starts(rest["pos"]), counts(rest["pos"])
    head, tail = (rest["part"] >> np.uint32(16)).astype(np.int64), (rest["part"] & np.uint32(WIDEST)).astype(np.int64)
    first = np.where(agree[0], start, start + n - tail)
    size = np.where(agree[0] & agree[1], n, np.where(agree[0], head, np.where(agree[1], tail, 0)))
    some = size > 0
    yield OPEN, {**{c: rest[c][some] for c in TEXT}, "pos": pack_pos(first[some], size[some])}


def repeated_runs(docs: DataFrame, find: Finder, earlier: bool) -> DataFrame:
    """`docs(doc, k1, k2, text)` -> (kind, doc, k1, k2, pos): settled ranges of windows, and open ones."""
    buckets = 4 * partitions(docs.sparkSession)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[dict[str, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            cols = {c: np.concatenate([p[c] for p in parts]) for c in COLUMNS}
            parts.clear()
            rows = list(zip(*_deal(cols, buckets, earlier))) or [()] * 4
            kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=["bucket", "kind", "n", "blob"])

        size = 0
        for batch in batches:
            for a, b in portions(batch.column("text")):
                texts = batch.column("text").slice(a, b - a)
                ids = [batch.column(c).slice(a, b - a).to_numpy() for c in TEXT]
                own, name, run, left, right, start, count, head, tail = find(texts)
                sides = (left >> np.uint64(48) << np.uint64(16) | right >> np.uint64(48)).astype(np.uint32)
                part = (head << 16 | tail).astype(np.uint32)
                place = {**{c: x[own] for c, x in zip(TEXT, ids)}, "pos": pack_pos(start, count)}
                parts.append({"name": name, "run": run, "sides": sides, "part": part, **place})
                size += len(own)
                if size >= CHUNK:
                    yield flush()
                    size = 0
        if parts:
            yield flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(blobs):
            for kind, place in _meet(blobs, earlier):
                kinds = pa.array(np.full(len(place["pos"]), kind, np.int32))
                yield pa.RecordBatch.from_arrays([kinds, *(pa.array(place[c]) for c in PLACE)], names=["kind", *PLACE])

        now, blobs = None, []
        for batch in batches:
            for bucket, kind, n, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now:
                    yield from out(blobs)
                    now, blobs = bucket, []
                blobs.append((kind, n, blob))
        yield from out(blobs)

    dealt = docs.select(*TEXT, "text").mapInArrow(deal, "bucket int, kind int, n int, blob binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, f"kind int, {KEYS}, pos long")


def packed_texts(docs: DataFrame) -> DataFrame:
    """The rows of `identified` with `z`, the text compressed before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            z = pa.array([pack(t) for t in batch.column("text").cast(pa.binary()).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*TEXT, "none")), z], names=[*TEXT, "none", "z"])

    return docs.select(*TEXT, "none", "text").mapInArrow(run, f"{KEYS}, none boolean, z binary")


def by_text(ranges: DataFrame) -> DataFrame:
    """(doc, k1, k2, pos) -> (doc, k1, k2, at): all ranges of one text."""
    return ranges.groupBy(*TEXT).agg(F.collect_list("pos").alias("at"))


def unpack_text(z: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(z)


def expand(pos: np.ndarray) -> np.ndarray:
    """All windows of some ranges, each once."""
    n = counts(pos)
    return np.unique(np.repeat(starts(pos), n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))


def covered(pos: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of n places the windows of some ranges cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, starts(pos), 1)
    np.add.at(edge, starts(pos) + counts(pos) + window - 1, -1)
    return np.cumsum(edge)[:n] > 0


def repeated_windows(
    docs: DataFrame, find: Finder, windows: Callable[[pa.Array, np.ndarray, np.ndarray], np.ndarray], window: int, earlier: bool
) -> DataFrame:
    """`docs(doc, text)` -> doc (null where it was), z (the text, compressed), at: the ranges of
    its windows whose content occurs again (null if none does): with `earlier` in a text of a
    smaller `doc`, else anywhere.  `windows(texts, text numbers, starts)` hashes windows."""
    if not 1 <= window <= WIDEST:
        raise ValueError(f"a window has 1 to {WIDEST} places")
    docs = identified(docs)
    runs = materialize(repeated_runs(docs, find, earlier), "runs")
    texts = packed_texts(docs)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, size, first = [], 0, 0
            z = batch.column("z")
            for n in range(len(batch)):
                raw.append(unpack_text(z[n].as_py()))
                size += len(raw[-1])
                if size >= HASHED or n + 1 == len(batch):
                    part = batch.slice(first, n + 1 - first)
                    at = [expand(x) for x in _lists(part.column("at"))]
                    own = np.repeat(np.arange(len(at)), [len(x) for x in at])
                    start = np.concatenate(at)
                    found = windows(pa.array(raw, pa.large_binary()).cast(pa.large_string()), own, start)
                    ids = [pa.array(part.column(c).to_numpy()[own]) for c in TEXT]
                    place = pa.array(pack_pos(start, np.ones(len(start), np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), *ids, place], names=["window", *PLACE])
                    raw, size, first = [], 0, n + 1

    left = by_text(runs.where(F.col("kind") == OPEN))
    found = texts.join(left, list(TEXT)).select(*TEXT, "z", "at").mapInArrow(hashed, f"window long, {KEYS}, pos long")
    found = materialize(found, "windows")
    if earlier:
        least = found.groupBy("window").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
        again = found.join(least, "window").where("doc > least")
    else:
        again = found.join(found.groupBy("window").count().where("count > 1"), "window")
    marks = runs.where(F.col("kind") == SETTLED).select(*PLACE).unionByName(again.select(*PLACE))
    joined = texts.join(by_text(marks), list(TEXT), "left")
    return joined.select(F.when(~F.col("none"), F.col("doc")).alias("doc"), "z", "at")


def _lists(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column of longs."""
    values, ends = column.flatten().to_numpy(), np.cumsum(pa.compute.list_value_length(column).to_numpy())
    return np.split(values, ends[:-1])
