import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridspark.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("seed", range(3))
def test_plan_places_every_piece_once(seed):
    rng = random.Random(seed)
    size = 64
    counts = {rng.randint(1, size): rng.randint(1, 300) for _ in range(50)}
    rooms, placed = {}, {}
    for length, first, n, seq, per, offset in packing.plan_slots(counts, size):
        for r in range(n):
            s = seq + r // per
            at = offset + r % per * length
            assert rooms.get(s, 0) == at
            placed.setdefault(length, []).append(first + r)
            rooms[s] = rooms.get(s, 0) + length
    assert all(sorted(v) == list(range(counts[k])) for k, v in placed.items()) and set(placed) == set(counts)
    assert max(rooms.values()) <= size
    least = -(-sum(k * v for k, v in counts.items()) // size)
    assert least <= len(rooms) <= least * 1.03 + sum(v for k, v in counts.items() if k > size // 2) and set(rooms) == set(range(len(rooms)))


def plain_best_fit(lengths, size):
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [k for k, r in enumerate(rooms) if r >= x]
        if fits:
            k = min(fits, key=lambda k: rooms[k])
            rooms[k] -= x
        else:
            rooms.append(size - x)
    return len(rooms)


@pytest.mark.parametrize("seed", range(5))
def test_plan_is_as_good_as_plain_best_fit(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 100): rng.randint(1, 9) for _ in range(40)}
    plan = packing.plan_slots(counts, 100)
    used = max(s + -(-n // per) for _, _, n, s, per, _ in plan)
    assert used <= plain_best_fit([k for k, v in counts.items() for _ in range(v)], 100)


TEXTS = [
    "a  b", "a   b \n c", "x<|endoftext|> y\n\n  z ", "", None, "  ", "\u3000 a", "a\x1c b\x1f", "don't  'S we'll\t\tx", "a \nb", "a ", " a",
    "a\n", "\na b\nc d", "a\tb c\rd", "naïve café — ok 123 4567", "word " * 3000, "日本語 テスト", "\u0000 x",
]


def test_pieces_round_trip(docs):
    tok = Tokenizer.from_file(PATH)
    rows = list(enumerate(TEXTS)) + [(3, ""), (None, "null id")]
    got = packing.pack(docs(rows), PATH).collect()
    want = []
    for i, t in rows:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        first = (len(ids) - 1) % 1024 + 1
        edges = [0, *range(first, len(ids) + 1, 1024)]
        want += [(-1 if i is None else i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(edges, edges[1:]))]
    assert sorted((-1 if r.doc_id is None else r.doc_id, *r[1:5]) for r in got) == sorted(want)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        parts.sort()
        assert parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:]))
        assert sum(parts[-1]) <= 1024
    assert len(sequences) == -(-sum(w[3] for w in want) // 1024)


def test_hot_length_ranks(spark, docs):
    got = packing.pack(docs([(k, "same text") for k in range(3000)]), PATH)
    assert got.count() == 3000 and got.groupBy("sequence_id", "offset").count().where("count > 1").isEmpty()
    assert packing.pack(docs([]), PATH).count() == 0


def test_encoder_remembers_no_words():
    import tracemalloc

    encode = packing.encoder(PATH)
    encode(["a b"])
    tracemalloc.start()
    try:
        for k in range(0, 60_000, 3000):
            encode([" ".join(f"w{n}" for n in range(k, k + 3000))])
        held, _ = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert held < 1e6
