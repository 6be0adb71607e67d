"""Repeated byte strings, found by minimizers of hashed strings and compared by fingerprints.

Buckets of suffixes are not refined by sorting here: every such round would shuffle a row per
byte of the corpus, while what follows shuffles a row per run of windows, once.  Each start gets
a hash of its first eight bytes; hashes at i and i + 8 give those of 16 bytes, which at i and
i + 16 give those of 32, and so on up to 64.  Of the starts in a window the one with the least
hash is its landmark, so equal windows choose equal ones.  Runs of windows around equal
landmarks are compared by fingerprints of what they cover (see `repeats`); strings with equal
64-bit fingerprints count as equal.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .recompression import runs_of
from .repeats import covered, repeated_windows, unpack_text
from .tokens import Spans, mix, portions

#: A 64-bit name for each byte.
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
PIECE = 1 << 18  # bytes that are worked on together
_STEP, _LATER = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other, and where each begins."""
    texts = texts.cast(pa.large_string()).fill_null("")
    first = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)
    return data[first[0] : first[-1]], first - first[0]


def bucket_ids(data: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the strings of `length` (8, 16, 32, …) bytes from every start."""
    n, size = len(data), 8
    ids = np.zeros(max(0, n - 7), np.uint64)
    for k in range(8):
        ids |= data[k : k + len(ids)].astype(np.uint64) << np.uint64(8 * k)
    while size < length:
        later = ids[size:]
        ids = ids[: len(later)] * _STEP
        ids ^= ids >> np.uint64(32)
        ids += later
        ids *= _LATER
        ids ^= ids >> np.uint64(29)
        size *= 2
    return ids


def sliding_least(x: np.ndarray, n: int) -> np.ndarray:
    """Least of every n neighbours."""
    size = 1
    while 2 * size <= n:
        x = np.minimum(x[:-size], x[size:]) if len(x) > size else x[:0]
        size *= 2
    extra = n - size
    return np.minimum(x[:-extra], x[extra:]) if extra and len(x) > extra else x if not extra else x[:0]


def find_runs(texts: pa.Array, window: int, length: int = 64) -> tuple[np.ndarray, ...]:
    """Runs of windows that follow one suffix, as `repeats` wants them."""
    parts = []
    for a, b in portions(texts, PIECE):
        data, first = raw_bytes(texts.slice(a, b - a))
        n = len(data)
        lo = np.full(n, -1, np.int64)
        name = np.zeros(n, np.uint64)
        if n >= window:
            ids = bucket_ids(data, length)
            bits = np.uint64(max(20, n.bit_length()))
            # The place in the low bits: of equal identifiers the leftmost is followed.
            order = mix(ids) >> bits << bits | np.arange(len(ids), dtype=np.uint64)
            place = (sliding_least(order, window - length + 1) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
            inside = np.arange(len(place)) <= np.repeat(first[1:] - window, np.diff(first))[: len(place)]
            lo[: len(place)] = np.where(inside, place, -1)
            name[: len(place)] = ids[place]
        values = BYTES[data]
        own, *rest = runs_of(values, first, window, name, lo, np.where(lo >= 0, lo + length, -1), mixed=True)
        parts.append((own + a, *rest))
    return tuple(np.concatenate(p) for p in zip(*parts))


def drop_repeats(docs: DataFrame, window: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept.

    A UTF-8 byte is removed if it is in a string of `window` bytes that also starts at another
    place, in the same document or another, the first one included; a span is a longest stretch
    of removed bytes.  Null texts are empty.  Rows that repeat id and text are different
    documents, so all of their long strings go.  Null ids are returned as null.  Texts shorter
    than a window stay.  Extra columns are ignored.  An empty table gives an empty result.
    `kept` has the bytes that stay, which need not be whole characters.
    """
    if window < 8:
        raise ValueError("a window has 8 bytes at least")
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    length = min(64, 1 << (window.bit_length() - 1))  # of the strings that landmarks are chosen by

    def find(texts: pa.Array) -> tuple[np.ndarray, ...]:
        return find_runs(texts, window, length)

    def windows(texts: pa.Array, own: np.ndarray, start: np.ndarray) -> np.ndarray:
        data, first = raw_bytes(texts)
        return Spans(BYTES[data], mixed=True)(first[own] + start, first[own] + start + window)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, z, at in zip(*(batch.column(c).to_pylist() for c in ("doc", "z", "at"))):
                raw = unpack_text(z)
                n, spans, kept = len(raw), 0, raw
                if at:
                    gone = covered(np.array(at, dtype=np.int64), window, n)
                    spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                    kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
                out.append((doc, n, n - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
            cols = list(zip(*out)) if out else [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)

    return repeated_windows(rows, find, windows, window, earlier=False).mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
