import random
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridspark.llm import toxicity as X
from gridspark.llm.common import table

BAD = ["idiot", "moron", "pathetic", "loser"]


def corpus(n=1500, seed=0, disguise=False):
    rng = random.Random(seed)
    syllables = ["ta", "re", "mo", "li", "sun", "ko", "per", "and", "the"]
    make = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 3)))
    rows, labels = [], []
    for i in range(n):
        text = [make() for _ in range(rng.randint(3, 60))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(BAD)
        rows.append((i, " ".join(text)))
        labels.append((i, 1, toxic))
    return rows, labels


@pytest.fixture(scope="module")
def frames(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS score", "1 AS row", "2 AS toxic")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(frames):
    docs, labels = frames
    got = {r.doc_id: r for r in X.toxicity(docs, labels).collect()}
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(got) == 1500 and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert sum(got[i].predicted == truth[i] for i in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())


def test_held_out_labels_do_not_teach(frames):
    docs, labels = frames
    flipped = labels.withColumn("toxic", F.when(X.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(X.toxicity(docs, x).select("doc_id", "score").collect()) for x in (labels, flipped))
    assert a == b


def test_disguised_words_are_restored(frames, spark):
    docs, labels = frames
    weights, model = X.train(docs, labels)
    disguised = ["1d10t", "m0r0n", "p@thetic", "l0ser", "i d i o t", "m.o.r.o.n", "l-o-s-e-r", "mooooron", "PATHET1C!!", "$un lo$er"]
    clean = ["the sun and 1234", "ta re mo", "a.b.c", "", "co-op 50%", "$$$", "ab12cd34ef56"]
    rows = spark.createDataFrame([(t,) for t in disguised + clean], "text string")
    got = {r.text: r.score for r in X.scored(rows, weights, model).collect()}
    assert all(got[t] >= 0.5 for t in disguised), got
    assert all(got[t] < 0.5 for t in clean), got


def test_signs_at_the_ends_and_between_spaces(spark):
    docs = spark.createDataFrame([("the idiot is a loser and moron with bastard hate and puta",)] * 50, "text string")
    read = X.reader(X.char_model(X.char_counts(docs)))
    wanted = {"hat3": "hate", "put4": "puta", "1d10+": "idiot", "l o $ e r": "loser", "b @ s t @ r d": "bastard", "m  o  r  o  n": "moron", "idioot": "idiot"}
    for text, word in wanted.items():
        assert word in read(text), (text, read(text))
    assert X.SPACED.search("you m @ r o n!")[0] == "m @ r o n"
    for token in ("a$$", "a55", "hat3", "puta5", "id10", "$#!t", "4$$"):
        assert X.disguised(token) and not X.NUMBER.fullmatch(token)
    assert not read("1990 $455 50% 1,234.50")


def test_long_tokens_take_time_in_proportion():
    model = np.zeros((X.SIZE,) * 3, np.float32)
    read = X.reader(model)
    many = "".join(chr(0x4E00 + (7 * k) % 20000) for k in range(300_000))
    for text in (many, many + many[::-1], "." * 300_000 + "a", "a" + "._" * 150_000, "a-" * 150_000, "ab" * 150_000):
        began = time.perf_counter()
        read(text)
        assert time.perf_counter() - began < (1 if "-" not in text else 20)
    assert [X.disguised(t) for t in ("abc", "a.b", "a._!b", "a!b", "..a", "letter", "漢漢字", "4", "ab4", "44")] == [
        False, True, True, True, False, True, False, False, True, True
    ]


def brute(token, model):
    """All paths of the lattice."""
    paths = [(0.0, "")]
    for readings in X.lattice(token):
        paths = [(c + e, t + x) for c, t in paths for x, e in readings]
    best = []
    for cost, text in paths:
        a = b = 0
        for ch in [*text, ""]:
            z = X.CODE.get(ch, 0)
            cost -= float(model[a, b, z])
            a, b = b, z
        best.append((cost, text))
    return min(best)


@pytest.mark.parametrize("token", ["1d10t", "ssttuu", "m.0.r*n", "$$$", "aa4", "p@7h"])
def test_viterbi_is_the_best_path(spark, token):
    docs = spark.createDataFrame([("the idiot is stupid and the moron at that path",)] * 3, "text string")
    model = X.char_model(X.char_counts(docs))
    assert X.viterbi(token, model) == brute(token, model)[1]


def test_edge_cases(spark, docs):
    labels = spark.createDataFrame([(1, 1, None), (None, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    rows = [(1, None), (1, None), (None, "x" * 100_000), (2, ""), (3, "\u0000 ü 日本 ퟿")]
    got = X.toxicity(docs(rows), labels).collect()
    assert len(got) == 5 and all(r.predicted == 0 for r in got) and [r.held_out for r in got if r.doc_id is None] == [False]
    assert {r.score for r in X.toxicity(docs(rows), labels.limit(0)).collect()} == {0.5}
    assert X.toxicity(docs([]), labels).count() == 0
    assert X.drop_toxic(docs(rows), labels).columns == docs(rows).columns


def test_given_documents(spark):
    """Precision and recall on the held-out fifth of the given labels."""
    folder = "/root/testdata/sf0.1"
    labels = table(spark, folder, "labels")
    got = X.toxicity(table(spark, folder, "documents"), labels).where("held_out").join(labels, "doc_id")
    n = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.8 * (n[1, 1] + n.get((1, 0), 0)) and n.get((0, 1), 0) <= 0.01 * (n[0, 0] + n.get((0, 1), 0))


def test_portions_of_a_batch_are_scored_one_by_one(spark, docs, monkeypatch):
    """Small batches go back; every column goes to the tasks once, and comes back under its name."""
    rows = docs([(k, f"text {k} " + "x" * 50) for k in range(40)] + [(None, None)]).coalesce(1).withColumn("a.`b", F.lit(1))
    model = np.zeros((64, 64, 64), np.float32)
    sent = []
    keep = type(rows).mapInArrow
    monkeypatch.setattr(type(rows), "mapInArrow", lambda df, run, *a, **k: sent.append((df, run)) or keep(df, run, *a, **k))
    monkeypatch.setattr(X, "train", lambda *a, **k: ({"": -5.0, "text": 1.0}, model))
    kept = X.drop_toxic(rows, None)
    assert kept.columns == rows.columns and kept.count() == 41
    df, run = sent[-1]
    assert len(df.columns) == len(rows.columns)  # the text is in no second column
    monkeypatch.setattr(X, "portions", lambda column: ((i, min(i + 10, len(column))) for i in range(0, len(column), 10)))
    batch = df.toArrow().combine_chunks().to_batches()[0]
    assert [b.num_rows for b in run(iter([batch]))] == [10, 10, 10, 10, 1]


def test_few_words_are_remembered():
    read = X.reader(np.zeros((64, 64, 64), np.float32))
    cache = next(c.cell_contents for c in read.__closure__ if isinstance(c.cell_contents, dict))
    for k in range(0, 120_000, 1000):
        read(" ".join(f"w{n}" for n in range(k, k + 1000)))
    assert 0 < len(cache) <= 100_000
