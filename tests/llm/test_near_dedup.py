import collections
import random

import numpy as np
import pytest
import xxhash

from gridspark.llm import near_dedup as N
from gridspark.llm.components import components


def shingles(text):
    w = (text or "").lower().split()
    return collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else collections.Counter()


def brute_classes(rows, similarity=0.8):
    """Classes by plain Jaccard similarity; row numbers."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = sum((sets[i] & sets[j]).values())
            size = sum(sets[i].values()) + sum(sets[j].values()) - common
            if (rows[i][1] or "") == (rows[j][1] or "") or size and common >= similarity * size:
                parent[find(i)] = find(j)
    groups = collections.defaultdict(list)
    for k in range(len(rows)):
        groups[find(k)].append(rows[k][0])
    return sorted(sorted(g) for g in groups.values())


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(60, 300))]
        for _ in range(rng.choice([1, 2, 3, 12])):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((len(rows), " ".join(copy)))
    rows += [(500, ""), (501, None), (502, "one two"), (503, "One  Two"), (504, "one two three"), (505, "w " * 4000)]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_classes_equal_brute_force(docs, seed):
    rows = corpus(seed)
    got = collections.defaultdict(list)
    result = N.near_duplicates(docs(rows).repartition(4)).collect()
    for r in result:
        got[r.class_id].append(r.doc_id)
    assert sorted(sorted(g) for g in got.values()) == brute_classes(rows)
    assert all(r.class_id == min(got[r.class_id]) and r.class_size == len(got[r.class_id]) for r in result)


def family(seed, size=100, twins=30):
    """Texts of one template, 0.78 to 0.796 similar to each other; a twin is 0.817 similar to its text."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(400)]
    changes = []

    def change(keep):
        while True:
            new = keep | {p: base[(p + 1 + len(changes)) % 400] for p in rng.sample(range(7, 393, 5), 5 - len(keep))} | keep
            if len(new) == 5 and all(len(new.keys() & c.keys()) < 2 for c in changes):
                return new

    for _ in range(size):
        changes.append(change({}))
    for k in range(twins):
        p = rng.choice(sorted(changes[k]))
        changes.append(change({p: changes[k][p]}))
    order = rng.sample(range(len(changes)), len(changes))
    return [(i, " ".join(changes[k].get(p, w) for p, w in enumerate(base))) for i, k in enumerate(order)]


def test_pairs_inside_a_family_that_fills_the_buckets(docs):
    rows = family(5)
    want = brute_classes(rows)
    assert len(want) == 100 and sum(len(g) == 2 for g in want) == 30
    got = collections.defaultdict(list)
    for r in N.near_duplicates(docs(rows).repartition(4)).collect():
        got[r.class_id].append(r.doc_id)
    assert sorted(sorted(g) for g in got.values()) == want


@pytest.mark.parametrize("seed, similarity", [(1, 0.8), (2, 0.6), (3, 0.9)])
def test_pairs_by_rare_shingles_lose_no_similar_pair(spark, seed, similarity):
    """Texts of all sizes and overlaps: whatever is similar by weights or by counts is a pair."""
    rng = random.Random(seed)
    base = [f"w{k}" for k in range(60)]
    texts = []
    for _ in range(70):
        a = rng.randrange(40)
        part = base[a : a + rng.randint(5, 60)] * rng.choice([1, 1, 2])
        texts.append(" ".join(rng.choice(base) if rng.random() < 0.03 else w for w in part))
    texts = sorted(set(texts))
    idf = np.random.default_rng(seed).uniform(0.5, 8, N.BUCKETS)
    rows = spark.createDataFrame([(b"%03d" % k, b"%03d" % (k // 2), t) for k, t in enumerate(texts)], "node binary, root binary, text string")
    heads = N.rare_shingles(rows.select("node", "root"), rows.select("node", "text"), idf, similarity)
    pairs = N.further(heads, rows.select("node", "root"), similarity)
    found = {(int(bytes(r.a)), int(bytes(r.b))) for r in pairs.collect()}
    every = spark.createDataFrame([(b"%03d" % i, b"%03d" % j) for j in range(len(texts)) for i in range(j)], "a binary, b binary")
    want = {(int(bytes(r.a)), int(bytes(r.b))) for r in N.similar(every, rows.select("node", "text"), idf, similarity).collect()}
    want = {(i, j) for i, j in want if i // 2 != j // 2}
    assert want and want <= found and all(i // 2 != j // 2 for i, j in found)


def test_a_large_family_gives_few_pairs(spark):
    """2,000 texts of one template, any two 0.6 similar: two million pairs, next to none compared."""
    rng = random.Random(3)
    base = [f"w{k}" for k in range(400)]
    rows = []
    for k in range(2000):
        words = list(base)
        for p in rng.sample(range(5, 395, 6), 10):
            words[p] = f"x{k}_{p}"
        rows.append((b"%05d" % k, " ".join(words)))
    rows.append((b"99999", rows[0][1].replace("w399", "y")))
    rows = spark.createDataFrame(rows, "node binary, text string").repartition(8)
    idf = np.full(N.BUCKETS, 1.0)
    own = rows.selectExpr("node", "node AS root")
    heads = N.materialize(N.rare_shingles(own, rows, idf, 0.8), "heads")
    pairs = N.further(heads, own, 0.8).collect()
    assert (b"00000", b"99999") in {(bytes(r.a), bytes(r.b)) for r in pairs}
    assert len(pairs) < 2000 and N.neighbours(heads, 0.8, 0).count() < 4000


def test_names_that_need_quotes(docs):
    df = docs([(1, "a b c d e f"), (2, "a b c d e f"), (3, "z")]).selectExpr("*", "1 AS `a.b`", "2 AS `c``d`")
    kept = N.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_drop_keeps_one_of_each_class(docs):
    rows = [(3, "a b c d e f g"), (1, "a b c d e f g"), (1, "a b c d e f g"), (None, "x y z u v w"), (None, "p q r s t u"), (9, None)]
    df = docs(rows)
    kept = N.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in kept.collect()) == [
        (-1, "p q r s t u"), (-1, "x y z u v w"), (1, "a b c d e f g"), (9, "")
    ]
    assert N.near_duplicates(docs([])).count() == 0 and N.drop_near_duplicates(docs([])).count() == 0


def test_weighted_similarity_decides(spark):
    import pyarrow as pa

    idf = np.random.default_rng(0).uniform(0.5, 8, N.BUCKETS)
    a, b = "the cat sat on the mat and then it left", "the cat sat on the mat and then he left"
    vectors = []
    for t in (a, b):
        doc, shingle, weight, count = N.weighted_shingles(pa.array([t]), idf)
        assert (doc == 0).all() and count.sum() == len(t.split()) - 4
        vectors.append(dict(zip(shingle.tolist(), weight.tolist())))
    low = sum(min(vectors[0].get(k, 0), vectors[1].get(k, 0)) for k in vectors[0].keys() | vectors[1].keys())
    high = sum(max(vectors[0].get(k, 0), vectors[1].get(k, 0)) for k in vectors[0].keys() | vectors[1].keys())
    texts = spark.createDataFrame([(b"a", a), (b"b", b)], "node binary, text string")
    pairs = spark.createDataFrame([(b"a", b"b")], "a binary, b binary")
    plain = 4 / 8
    assert N.similar(pairs, texts, idf, max(plain, low / high) - 0.001).count() == 1
    assert N.similar(pairs, texts, idf, max(plain, low / high) + 0.001).count() == 0


def test_draws_agree_as_often_as_weights_do():
    rng = np.random.default_rng(1)
    n = 4000
    shingle = rng.integers(0, 2**63, n).astype(np.uint64)
    x, y = rng.uniform(0.5, 5, n), rng.uniform(0.5, 5, n)
    doc = np.repeat([0, 1], n)
    s = N.draws(doc, np.tile(shingle, 2), np.concatenate([x, y]), 2)
    assert abs((s[0] == s[1]).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum()) < 0.12


def test_components(spark):
    rng = random.Random(4)
    links = [(k, k + 1) for k in range(60)] + [(100 + rng.randrange(40), 100 + rng.randrange(40)) for _ in range(25)] + [(200, 200 + k) for k in range(1, 90)]
    parent = {x: x for e in links for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_document_frequencies_count_each_text_once(spark, docs):
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["a", "B", "b", "c", "dd", "é"], k=rng.randint(0, 12))) for _ in range(300)] + [None, "", "  "]
    got = dict(N.document_frequencies(docs(list(enumerate(texts)))).collect())
    want = {-1: len(texts)}
    for t in texts:
        for k in {xxhash.xxh3_64_intdigest(w) % N.BUCKETS for w in (t or "").lower().split()}:
            want[k] = want.get(k, 0) + 1
    assert got == want
