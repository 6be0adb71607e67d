import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from gridspark.llm import recompression, repeats, suffix_dedup, tokens


def brute_words(rows, window):
    words = [(t or "").encode().split() for _, t in rows]
    least = {}
    for (i, _), w in zip(rows, words):
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(least.get(key, 1 << 70), 1 << 69 if i is None else i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < (1 << 69 if i is None else i):
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def brute_bytes(rows, window):
    count = collections.Counter()
    raw = [(t or "").encode() for _, t in rows]
    for b in raw:
        count.update(b[k : k + window] for k in range(len(b) - window + 1))
    out = []
    for (i, _), b in zip(rows, raw):
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - window + 1):
            if count[b[k : k + window]] > 1:
                gone[k : k + window] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r))


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [rng.choice("abcdé") * rng.randint(1, 3) for _ in range(8)]
    make = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    shared = [make(rng.randint(5, 60)) for _ in range(6)] + [["a"] * 40, ["a", "b"] * 30]
    rows = []
    for i in range(n):
        parts = [make(rng.randint(0, 25))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(shared), make(rng.randint(0, 12))]
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(w for p in parts for w in p)))
    return rows + [(5, rows[5][1]), (7, rows[8][1]), (n, None), (n + 1, ""), (None, rows[3][1]), (None, rows[3][1] + " q"), (n + 2, "\x0b a\x1cb ")]


@pytest.mark.parametrize("seed, window", [(1, 13), (2, 7), (3, 13)])
def test_word_passages_equal_brute_force(docs, seed, window):
    rows = corpus(seed)
    got = recompression.drop_repeats(docs(rows).repartition(5), window=window).collect()
    assert order([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got]) == order(brute_words(rows, window))
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)


@pytest.mark.parametrize("seed, window", [(1, 100), (2, 70)])
def test_byte_strings_equal_brute_force(docs, seed, window):
    rows = corpus(seed)
    got = suffix_dedup.drop_repeats(docs(rows).repartition(5), window=window).collect()
    assert order([tuple(r[:5]) for r in got]) == order(brute_bytes(rows, window))


@pytest.mark.parametrize("earlier", [True, False])
def test_hot_passages_and_small_chunks(docs, monkeypatch, earlier):
    """Many different runs of one landmark: only notes are dealt, the result is the same."""
    monkeypatch.setattr(repeats, "CHUNK", 50)
    monkeypatch.setattr(repeats, "MANY", 3)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    make = lambda k: " ".join(rng.choice(words) for _ in range(k))
    hot = make(30)
    rows = [(i, f"{make(15)} {hot} {make(15)}") for i in range(90)] + [(200 + i, hot) for i in range(90)]
    if earlier:
        got = recompression.drop_repeats(docs(rows).repartition(3)).collect()
        assert order([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got]) == order(brute_words(rows, 13))
    else:
        got = suffix_dedup.drop_repeats(docs(rows).repartition(3), window=80).collect()
        assert order([tuple(r[:5]) for r in got]) == order(brute_bytes(rows, 80))


@pytest.mark.parametrize("ids", ["null", "equal", "largest"])
def test_many_texts_that_share_an_id(docs, ids):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(2000)]
    hot = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(20)]
    text = lambda k: " ".join(rng.choice(words) for _ in range(30)) + " " + rng.choice(hot)
    own = {"null": None, "equal": 4, "largest": 2**63 - 1}[ids]
    rows = [(own, text(k)) for k in range(3000)] + [(1, hot[0]), (9, hot[1] + " " + hot[2]), (4, hot[3])]
    rows += [(None, rows[0][1]), (own, rows[1][1])]
    got = recompression.drop_repeats(docs(rows).repartition(5)).collect()
    want = [(1 << 69 if ids == "null" else 2**63 - 1, t) if i is None else (i, t) for i, t in rows]
    want = [(None if i == 1 << 69 else i, *r[1:]) for (i, _), r in zip(want, brute_words(want, 13))]
    assert sorted(r[1:4] for r in got) == sorted(r[1:] for r in want)
    got = suffix_dedup.drop_repeats(docs(rows).repartition(5), window=80).collect()
    assert order([tuple(r[:5]) for r in got]) == order(brute_bytes(rows, 80))
    assert sum(r.doc_id is None for r in got) == sum(i is None for i, _ in rows)


@pytest.mark.parametrize("window", [300, 700])
def test_wide_windows(docs, window):
    rng = random.Random(window)
    make = lambda k: [f"w{rng.randint(0, 50)}" for _ in range(k)]
    long = make(1500)
    rows = [(k, " ".join(make(40) + long[k * 10 : k * 10 + 900] + make(40))) for k in range(12)]
    got = recompression.drop_repeats(docs(rows).repartition(3), window=window).collect()
    assert order([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got]) == order(brute_words(rows, window))
    got = suffix_dedup.drop_repeats(docs(rows).repartition(3), window=window).collect()
    assert order([tuple(r[:5]) for r in got]) == order(brute_bytes(rows, window))


def test_narrow_byte_windows_and_refused_ones(docs):
    rows = corpus(4, 30)
    got = suffix_dedup.drop_repeats(docs(rows).repartition(3), window=20).collect()
    assert order([tuple(r[:5]) for r in got]) == order(brute_bytes(rows, 20))
    for wrong in (lambda: suffix_dedup.drop_repeats(docs(rows), window=7), lambda: recompression.drop_repeats(docs(rows), window=1 << 16)):
        with pytest.raises(ValueError):
            wrong()


def test_empty_tables(docs):
    assert recompression.drop_repeats(docs([])).count() == 0
    assert suffix_dedup.drop_repeats(docs([])).count() == 0


@pytest.mark.parametrize("rounds", [0, 1, 2, 3])
def test_equal_windows_have_equal_landmarks(rounds):
    texts = pa.array([t for _, t in corpus(9, 60)])
    coded, first = tokens.word_lists(texts)
    words = tokens.word_hashes(coded)
    name, lo, hi = recompression.landmarks(words, first, 13, rounds)
    seen = {}
    for t in range(len(first) - 1):
        for k in range(first[t], first[t + 1] - 12):
            mark = (name[k], lo[k] - k, hi[k] - k)
            assert 0 <= mark[1] < mark[2] <= 13
            assert seen.setdefault(words[k : k + 13].tobytes(), mark) == mark
    assert (lo >= 0).sum() == np.maximum(np.diff(first) - 12, 0).sum()


def test_bucket_ids_name_what_follows():
    data = np.frombuffer(b"abcdefghijklmnopabcdefghijklmnopqrstuvwxyz" * 5, dtype=np.uint8)
    for length in (8, 16, 32, 64):
        ids, seen = suffix_dedup.bucket_ids(data, length), {}
        assert len(ids) == len(data) - length + 1
        for k, x in enumerate(ids.tolist()):
            assert seen.setdefault(x, data[k : k + length].tobytes()) == data[k : k + length].tobytes()
        assert len(seen) == len({data[k : k + length].tobytes() for k in range(len(ids))})


@pytest.mark.parametrize("n", [1, 2, 7, 137])
def test_sliding_least(n):
    x = np.random.default_rng(0).integers(0, 99, 500).astype(np.uint64)
    assert (suffix_dedup.sliding_least(x, n) == [x[k : k + n].min() for k in range(501 - n)]).all()
    assert len(suffix_dedup.sliding_least(x[: n - 1], n)) == 0


def test_word_lists_split_like_bytes():
    texts = ["a b", "", None, " a  b\n", "\t", "é　x \x0bq", "a\x1cb c"]
    coded, first = tokens.word_lists(pa.array(texts))
    words = coded.dictionary.to_pylist()
    got = [[words[k] for k in coded.indices.to_pylist()[a:b]] for a, b in zip(first, first[1:])]
    assert got == [[w.decode() for w in (t or "").encode().split()] for t in texts]
