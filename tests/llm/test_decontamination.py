import itertools
import math
import random
import re

import pytest

from gridspark.llm import decontamination as D

WORD = re.compile(r"[^\W_]+")


def words(t):
    return WORD.findall((t or "").lower())


def brute(rows, items, window=13, share=0.8):
    out = {}
    for i, t in rows:
        d = words(t)
        for item, u in items:
            w = words(u)
            n = len(w)
            if n < 5:
                continue
            for shift in range(-n, len(d)):
                eq = [0 <= shift + j < len(d) and d[shift + j] == w[j] for j in range(n)]
                if n < 9:
                    hit = all(eq)
                else:
                    seed = any(
                        all(0 <= shift + k + m < len(d) and k + m < n and eq[k + m] for m in mask) for mask in D.MASKS for k in range(n)
                    )
                    size = min(n, window)
                    hit = seed and any(sum(eq[s : s + size]) >= share * size - 1e-9 for s in range(n - size + 1))
                if hit:
                    out[i, item] = max(out.get((i, item), 0), sum(eq))
    return out


def case(seed):
    rng = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(60)]
    make = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    items = [(k, make(rng.choice([3, 5, 8, 9, 12, 20, 40]))) for k in range(20)]
    rows = []
    for i in range(80):
        text = make(rng.randint(0, 40))
        if rng.random() < 0.6:
            passage = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, 1 + len(passage) // 4)):
                passage[rng.randrange(len(passage))] = "changed"
            text += passage[rng.randint(0, 2) :] + make(rng.randint(0, 20))
        rows.append((i, rng.choice([" ", ", ", "\n"]).join(text).title()))
    items = [(k, " ".join(w)) for k, w in items] + [(90, None), (91, ""), (92, items[5][1] and " ".join(items[5][1]))]
    return rows + [(900, None), (901, ""), (902, "x " * 3000)], items


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_overlaps_equal_brute_force(spark, docs, seed):
    rows, items = case(seed)
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS _h", "2 AS _seed", "3 AS doc_id")
    got = D.overlaps(docs(rows), bench)
    want = brute(rows, items)
    assert {(r.doc_id, r.item_id): r.n_matched for r in got.collect()} == want and got.count() == len(want)
    kept = D.drop_contaminated(docs(rows), bench)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert kept.columns == docs(rows).columns


def test_every_pattern_within_the_tolerance_has_a_seed(spark, docs):
    items, rows = [], []
    for n in range(9, 14):
        item = [f"n{n}i{k}" for k in range(n)]
        items.append((n, " ".join(item)))
        for gone in itertools.combinations(range(n), n - math.ceil(0.8 * n)):
            rows.append((100 * len(rows) + n, " ".join("x" if k in gone else w for k, w in enumerate(item))))
    got = D.overlaps(docs(rows), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(i, i % 100) for i, _ in rows}


def test_periodic_substitutions_are_found(spark, docs):
    item = [f"i{k}" for k in range(30)]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    rows = [(p, " ".join("x" if k % p == 0 else w for k, w in enumerate(item))) for p in (5, 6, 7)]
    assert {r.doc_id for r in D.overlaps(docs(rows), bench).collect()} == {5, 6, 7}


def test_null_ids_repeated_rows_and_empty_tables(spark, docs):
    text = "one two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    rows = [(None, text), (None, "clean"), (4, text), (4, text), (4, "clean too")]
    assert sorted((r.doc_id or -1, r.item_id) for r in D.overlaps(docs(rows), bench).collect()) == [(-1, 1), (4, 1)]
    assert sorted(r.text for r in D.drop_contaminated(docs(rows), bench).collect()) == ["clean", "clean too"]
    assert D.overlaps(docs([]), bench).count() == 0
    assert D.drop_contaminated(docs(rows), bench.limit(0)).count() == 5


def test_no_python_in_the_plan(docs, spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    plan = D.overlaps(docs([(1, "a b c d e f g h i j")]), bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
