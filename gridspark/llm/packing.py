"""Best-fit packing planned on the length histogram.

The tokenised pieces are only counted by length.  Best-fit decreasing runs over the counts:
sequences that look alike are one range of sequence numbers, so one step places thousands of
pieces and the plan's size depends on the sequence length, not on the corpus.  Pieces then
take planned slots by their rank within their length.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, partitions
from .tokens import portions

#: Fixed value: the pre-token pattern of byte-level BPE.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_names() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for
    themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def encoder(path: str):
    """texts -> bytes of each text's unsigned 32-bit ids, as the byte-level BPE tokenizer in
    `path` gives them without special tokens added.  tiktoken runs the vocabulary's merges over whole texts,
    parted at special tokens only: in a corpus with ever new words that is faster than to
    remember the ids of words, and takes no memory.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    name = byte_names()
    special = {t["content"]: np.array([t["id"]], dtype="<u4").tobytes() for t in spec["added_tokens"]}
    ranks = {bytes(name[c] for c in w): i for w, i in spec["model"]["vocab"].items() if w not in special}
    bpe = tiktoken.Encoding("bpe", pat_str=PRE_TOKEN, mergeable_ranks=ranks, special_tokens={})
    ids = lambda text: bpe.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
    apart = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def whole(text: str) -> bytes:
        if not apart or not apart.search(text):
            return ids(text)
        out, at = [], 0
        for m in apart.finditer(text):
            out += [ids(text[at : m.start()]), special[m[0]]]
            at = m.end()
        return b"".join([*out, ids(text[at:])])

    return lambda texts: [whole(text) for text in texts]


def token_pieces(
    docs: DataFrame, path: str, size: int = 1024, end: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32.  A longer document is cut
    into pieces of `size` ids, of which the first may be shorter."""
    last = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            out: list[tuple] = []
            for i, j in portions(batch.column(1), 1 << 20):
                part = batch.slice(i, j - i)
                for doc, ids in zip(part.column(0).to_pylist(), encode([t or "" for t in part.column(1).to_pylist()])):
                    ids += last
                    n = len(ids) // 4
                    edges = [0, *range((n - 1) % size + 1, n + 1, size)]
                    for k, (a, b) in enumerate(zip(edges, edges[1:])):
                        out.append((doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def plan_slots(counts: dict[int, int], size: int = 1024) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts of lengths -> slots (length, first rank, number of pieces,
    first sequence, pieces per sequence, offset): piece r of a slot lies in sequence
    first + r // per at offset + (r % per) * length."""
    free: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges of alike sequences
    rooms: list[int] = []  # sorted keys of `free`

    def put(room: int, lo: int, hi: int) -> None:
        if room not in free:
            bisect.insort(rooms, room)
        free.setdefault(room, []).append((lo, hi))

    out, used = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                break
            room = rooms[k]
            lo, hi = free[room].pop()
            if not free[room]:
                del free[room], rooms[k]
            # A sequence that stays the best fit takes as many as the room allows before the next does.
            per = room // length
            take = min(hi - lo, left // per)
            if take:
                out.append((length, rank, take * per, lo, per, size - room))
                put(room - per * length, lo, lo + take)
                rank, left = rank + take * per, left - take * per
            else:
                take, per = 1, left
                out.append((length, rank, left, lo, left, size - room))
                put(room - left * length, lo, lo + 1)
                rank, left = rank + left, 0
            if lo + take < hi:
                put(room, lo + take, hi)
        per = size // length
        for n, k in ((left // per, per), (1, left % per)):
            if n and k:
                out.append((length, rank, n * k, used, k, 0))
                put(size - k * length, used, used + n)
                rank, used = rank + n * k, used + n
    return out


def ranked(pieces: DataFrame) -> DataFrame:
    """Adds `_rank`, 0, 1, … within each length.  Lengths are split over hash buckets that are
    counted first, so no task numbers all pieces of a common length."""
    buckets = partitions(pieces.sparkSession)
    rows = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    return (
        rows.withColumn("_in", F.row_number().over(inside) - 1)
        .join(sizes, ["length", "_bucket"])
        .withColumn("_rank", F.col("_before") + F.col("_in"))
        .drop("_bucket", "_before", "_in")
    )


def pack(
    docs: DataFrame, path: str, size: int = 1024, end: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null texts count as empty and are one end id.  Texts of any length are cut, never
    dropped.  Null ids and repeated rows are packed like all others.  Extra columns are
    ignored.  An empty table gives an empty result.  The plan that goes to the tasks has at
    most `size` lengths and a few slots for each.
    """
    pieces = materialize(token_pieces(docs, path, size, end, id_col, text_col), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # `size` rows at most
    plan = np.array(plan_slots(counts, size), dtype=np.int64).reshape(-1, 6)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    length, first, _, seq0, per, offset0 = plan.T
    starts = {int(n): np.searchsorted(length, n) for n in np.unique(length)}
    ends = {int(n): np.searchsorted(length, n, "right") for n in np.unique(length)}

    def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, r = b.column("length").to_numpy(), b.column("_rank").to_numpy()
            slot = np.empty(len(n), dtype=np.int64)
            for x in np.unique(n):
                at = n == x
                lo, hi = starts[int(x)], ends[int(x)]
                slot[at] = lo + np.searchsorted(first[lo:hi], r[at], "right") - 1
            k = r - first[slot]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in NAMES), pa.array(seq0[slot] + k // per[slot]), pa.array(offset0[slot] + k % per[slot] * n)],
                names=[*NAMES, "sequence_id", "offset"],
            )

    NAMES = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return ranked(pieces).mapInArrow(
        seat, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
