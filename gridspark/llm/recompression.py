"""Repeated passages of words, found by recompression.

A text is a string of word names.  A round first names every maximal run of one symbol and then
every pair of neighbours of which the first falls in the left and the second in the right half
of the alphabet.  A name is a hash of what it stands for, so equal runs and pairs get equal
names in every task.  For every symbol the round also keeps which words decided it; inside
equal passages, symbols decided by the passage alone are equal.

Names are not handed out by a shuffle: with hashes for names no round has to move the corpus.
Windows with equal 64-bit fingerprints of their words count as equal; the words themselves are
not compared again.

Of the symbols that a window of words decides, the highest, and among these the smallest, is
the window's landmark.  Equal windows have equal landmarks at equal places, so only passages
around a landmark that occurs again need be compared (see `repeats`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import covered, repeated_windows, unpack_text
from .tokens import Spans, mix, run_hashes, word_hashes, word_lists

FAR = 1 << 40
_NAME, _PAIR, _HALF = (np.uint64(x) for x in (0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93))


def next_level(
    sym: np.ndarray, start: np.ndarray, lo: np.ndarray, hi: np.ndarray, text: np.ndarray, seed: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One round: names of runs, then of pairs.  `start`: first word; `lo`, `hi`: the words
    that decide the symbol, beyond `FAR` if the end of a text does; `text`: its number."""
    if not len(sym):
        return sym, start, lo, hi, text
    head = np.flatnonzero(np.concatenate([[True], (sym[1:] != sym[:-1]) | (text[1:] != text[:-1])]))
    size = np.diff(np.append(head, len(sym))).astype(np.uint64)
    # A run is known only with what stands on either side of it.
    before, after = np.maximum(head - 1, 0), np.minimum(np.append(head[1:], len(sym)), len(sym) - 1)
    lo = np.where((head > 0) & (text[before] == text[head]), lo[before], -FAR)
    hi = np.where((text[after] == text[head]) & (np.append(head[1:], len(sym)) < len(sym)), hi[after], FAR)
    sym, start, text = np.where(size > 1, mix(mix(sym[head] ^ _NAME) + size), sym[head]), start[head], text[head]

    right = (mix(sym ^ _HALF + np.uint64(seed)) >> np.uint64(63)) == 1
    near = np.append(text[1:] == text[:-1], False)  # the next one is of the same text
    pair = np.append(~right[:-1] & right[1:], False) & near
    second = np.concatenate([[False], pair[:-1]])
    after = np.minimum(np.arange(len(sym)) + 1, len(sym) - 1)
    before = np.maximum(np.arange(len(sym)) - 1, 0)
    # A left symbol is settled by the next one, a right symbol by the one before.
    new_hi = np.where(right, hi, np.where(near, hi[after], FAR))
    new_lo = np.where(right, np.where(np.concatenate([[False], near[:-1]]), lo[before], -FAR), lo)
    named = np.where(pair, mix(mix(sym ^ _PAIR) + sym[after]), sym)
    keep = ~second
    return named[keep], start[keep], new_lo[keep], new_hi[keep], text[keep]


def landmarks(words: np.ndarray, first: np.ndarray, window: int, rounds: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every start of a window of words inside one text the name of its landmark and the
    words that decided it, from where to where; -1 where no window starts.

    A landmark is named by its level, its symbol and all words that decided it, which every
    window that sees it holds.
    """
    n = len(words)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(n)
    level = (words, at, at, at + 1, text)
    levels = [level]
    for k in range(rounds):
        level = next_level(*level, k + 1)
        levels.append(level)
    last = (first[1:][text] - window) if n else at  # last start of a window in the word's text
    begin, end = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    name = np.zeros(n, np.uint64)
    span = Spans(words)
    for depth in range(rounds, -1, -1):
        sym, start, lo, hi, own = levels[depth]
        seen = np.flatnonzero((lo >= 0) & (hi - lo <= window))
        sym, start, lo, hi, own = sym[seen], start[seen], lo[seen], hi[seen], own[seen]
        order = mix(sym + np.uint64(depth))
        best = np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
        which = np.full(n, -1, np.int64)
        for back in range(window - 1, -1, -1):  # later symbols first, so that the leftmost wins a tie
            w = lo - back
            i = np.flatnonzero((hi - lo + back <= window) & (w >= first[own]))
            w = w[i]
            i, w = i[w <= last[start[i]]], w[w <= last[start[i]]]
            less = order[i] <= best[w]
            i, w = i[less], w[less]
            best[w], which[w] = order[i], i
        new = np.flatnonzero((begin < 0) & (which >= 0))
        i = which[new]
        begin[new], end[new] = lo[i], hi[i]
        name[new] = mix(order[i] ^ span(lo[i], hi[i]))
    return name, begin, end


def find_runs(texts: pa.Array, window: int, rounds: int = 1) -> tuple[np.ndarray, ...]:
    """Runs of windows with one landmark, as `repeats` wants them."""
    coded, first = word_lists(texts)
    words = word_hashes(coded)
    return runs_of(words, first, window, *landmarks(words, first, window, rounds))


def runs_of(
    words: np.ndarray, first: np.ndarray, window: int, name: np.ndarray, lo: np.ndarray, hi: np.ndarray, mixed: bool = False
) -> tuple[np.ndarray, ...]:
    """Neighbouring windows with the landmark [lo, hi) are one run.  A window reaches at least
    half of the words it has besides the landmark either to the left or to the right of it."""
    span = Spans(words, mixed)
    some = lo >= 0
    new = some & np.concatenate([[True], (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]) | (name[1:] != name[:-1])])[: len(lo)]
    begin = np.flatnonzero(new)
    stop = np.flatnonzero(some & ~np.append(some[1:] & ~new[1:], False)) + 1
    text = np.searchsorted(first, begin, "right") - 1
    a, b = lo[begin], hi[begin]
    half = (window - (b - a) + 1) // 2
    left, right = np.maximum(a - half, first[text]), np.minimum(b + half, first[text + 1])
    # The first windows end before the right half does, the last ones start after the left half.
    head = np.clip(b + half - window - begin, 0, stop - begin)
    tail = np.clip(stop - 1 - (a - half), 0, stop - begin)
    content = span(begin, stop + window - 1)
    return text, name[begin], content, span(left, a), span(b, right), begin - first[text], stop - begin, head, tail


def drop_repeats(docs: DataFrame, window: int = 13, rounds: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept.

    Words lie between ASCII white space.  A word is removed if it is in a window of `window`
    words whose words also start, in this order, in a document with a smaller doc_id.  Null
    texts have no words.  A null id is larger than all others.  Rows that share an id never
    remove each other's words.  Texts shorter than a window stay.  Extra columns are ignored.
    An empty table gives an empty result.  `kept` is the text that stays, words joined by one
    space.
    """
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))

    def find(texts: pa.Array) -> tuple[np.ndarray, ...]:
        return find_runs(texts, window, rounds)

    def windows(texts: pa.Array, own: np.ndarray, start: np.ndarray) -> np.ndarray:
        coded, first = word_lists(texts)
        return run_hashes(word_hashes(coded), window)[first[own] + start]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, z, at in zip(*(batch.column(c).to_pylist() for c in ("doc", "z", "at"))):
                words = unpack_text(z).split()  # bytes split at ASCII white space
                n = len(words)
                if at:
                    gone = covered(np.array(at, dtype=np.int64), window, n)
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                kept = b" ".join(words)
                out.append((doc, n, n - len(words), hashlib.sha256(kept).hexdigest(), kept.decode()))
            cols = list(zip(*out)) if out else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]
            )

    return repeated_windows(rows, find, windows, window, earlier=True).mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


ORACLE = """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM w),
g AS (SELECT doc_id, k, array_to_string(w[k:k + 12], ' ') AS win FROM p WHERE k + 12 <= len(w)),
m AS (SELECT win, min(doc_id) AS least FROM g GROUP BY win),
h AS (SELECT g.doc_id, g.k FROM g JOIN m ON g.win = m.win AND m.least < g.doc_id),
c AS (
  SELECT p.doc_id, p.k, p.w[p.k] AS word,
    max(CASE WHEN h.k IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY p.doc_id ORDER BY p.k ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone
  FROM p LEFT JOIN h ON p.doc_id = h.doc_id AND p.k = h.k)
SELECT w.doc_id, CAST(len(any_value(w.w)) AS BIGINT) AS n_words, CAST(count(*) FILTER (c.gone = 1) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(c.word, ' ' ORDER BY c.k) FILTER (c.gone = 0), '')) AS kept_sha256
FROM w LEFT JOIN c ON w.doc_id = c.doc_id GROUP BY w.doc_id
"""
