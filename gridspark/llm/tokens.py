"""Hashes of words and of runs of words, for whole batches of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

PORTION = 4 << 20  # bytes of text that are worked on together


def portions(texts: pa.Array, size: int = PORTION) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes; a longer text is a range of its own."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + size)))
        yield start, stop
        start = stop


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_lists(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """Words between ASCII white space, coded, and where each text's words begin (one more
    entry than texts).  Nulls have none."""
    texts = pc.ascii_trim_whitespace(texts.cast(pa.large_string()).fill_null(""))
    lists = pc.ascii_split_whitespace(texts)
    first = lists.offsets.to_numpy()
    words = lists.values.slice(first[0], first[-1] - first[0])
    first = first - first[0]
    empty = pc.equal(texts, "").to_numpy(zero_copy_only=False)
    coded = words.dictionary_encode()
    if empty.any():  # an empty text is split into one empty word
        keep = np.ones(len(coded), dtype=bool)
        keep[first[:-1][empty]] = False
        coded = coded.filter(pa.array(keep))
        first = np.concatenate([[0], np.cumsum(np.diff(first) - empty)])
    return coded, first.astype(np.int64)


def word_hashes(coded: pa.DictionaryArray) -> np.ndarray:
    """64-bit hashes of the words."""
    names = coded.dictionary.to_numpy(zero_copy_only=False)
    table = np.fromiter(map(xxhash.xxh3_64_intdigest, names), dtype=np.uint64, count=len(names))
    return table[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.uint64)


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on (of those that have n left)."""
    size = max(0, len(words) - n + 1)
    out = np.zeros(size, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + size]
        out ^= out >> np.uint64(29)
    return mix(out)


def run_starts(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which n words of one text begin, and the texts' numbers."""
    size = np.diff(first)
    count = np.maximum(size - n + 1, 0)
    text = np.repeat(np.arange(len(size)), count)
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return first[:-1][text] + inside, text


class Spans:
    """Hashes of any stretches of a sequence, from running sums of a polynomial hash."""

    BASE = 0x9E3779B97F4A7C15
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self, values: np.ndarray, mixed: bool = False):
        n = len(values)
        powers = lambda b: np.cumprod(np.append(np.uint64(1), np.full(n, b, np.uint64)))
        self.back = powers(np.uint64(self.INVERSE))
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((values if mixed else mix(values)) * powers(np.uint64(self.BASE))[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return mix((self.sums[stop] - self.sums[start]) * self.back[start] + (stop - start).astype(np.uint64))
