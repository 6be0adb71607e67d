"""Toxicity of texts whose words may be disguised.

A disguised word is read as the output of a noisy channel: digits and signs stand for letters,
letters are repeated, or set apart one by one.  Its readings form a lattice, and a Viterbi
search under a character trigram model of the whole corpus picks the likeliest.  The restored
words, beside those written plainly, are scored by a logistic regression on words and their
beginnings.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize
from .tokens import portions

#: The model's letters; every other character ends a word.
LETTERS = "abcdefghijklmnopqrstuvwxyzàâäáãåçèéêëìíîïñòóôöõùúûüýÿßœæ"
CODE = {c: i + 1 for i, c in enumerate(LETTERS)}
SIZE = 64
#: What a sign may stand for, and the cost (negative log likelihood) of writing it so.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou", "#": "aeiou", "%": "aeiou",
}
SIGN_COST, DROP_COST, REPEAT_COST = 1.0, 2.0, 0.5
BETWEEN = " .-_*~"
SPACED = re.compile(r"(?<![^\W_])(?:(?:[^\W_]|[@$!|+(€£#%])[ .\-_*~]++){2,}(?:[^\W_]|[@$!|+(€£#%])(?![^\W_])")
WORD = re.compile(r"[^\W\d_]+")
LETTER, SIGN, TWICE = re.compile(r"[^\W\d_]"), re.compile(r"[0-9@$!|+(€£*#%]"), re.compile(f"([{LETTERS}])\\1")
APART = re.compile(r"[^\W\d_]((?:[^\w\s]|_)++)(?=[^\W\d_])")
NUMBER = re.compile(r"[#$€£+(\-]?\d[\d.,:/\-]*[%+)]?")
AROUND = "\"'.,;:?&#%*!)>]}"  # not part of a word at its ends
ENDS = "\"'.,;:?&)>]}"  # of these, those that stand for no letter
PREFIXES = range(3, 8)
HEAD = PREFIXES[0]
WORDS_KEPT, FEWER_KEPT = 200_000, 50_000  # words whose known features, or all features, a task remembers


def _texts(column: pa.Array) -> Iterator[str]:
    """The texts of a column; a portion at a time is held as Python strings."""
    for a, b in portions(column):
        for text in column.slice(a, b - a).to_pylist():
            yield text or ""


def char_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Counts of letter trigrams over all texts, lower-cased: `gram` (base 64 code), `n`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = np.zeros(0x110000, dtype=np.int32)
        for c, k in CODE.items():
            codes[ord(c)] = k
        total = np.zeros(SIZE**3, dtype=np.int64)
        for batch in batches:
            for text in _texts(batch.column(0)):
                x = codes[np.frombuffer(f"  {text.lower()} ".encode("utf-32-le", "replace"), dtype="<u4")]
                total += np.bincount((x[:-2] * SIZE + x[1:-1]) * SIZE + x[2:], minlength=SIZE**3)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], names=["gram", "n"])

    return docs.select(text_col).mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def char_model(counts: DataFrame) -> np.ndarray:
    """Log probabilities of a letter after two others.  At most 64^3 counts reach the driver."""
    grid = np.zeros(SIZE**3)
    for gram, n in counts.collect():
        grid[gram] = n
    grid = grid.reshape(SIZE, SIZE, SIZE)
    used = len(LETTERS) + 1
    one = grid.sum((0, 1)) + 1
    one[used:] = 0
    one /= one.sum()
    two = grid.sum(0)
    two = (two + 5 * one) / (two.sum(1, keepdims=True) + 5)
    three = (grid + 5 * two) / (grid.sum(2, keepdims=True) + 5)
    return np.log(np.maximum(three, 1e-12)).astype(np.float32)


def lattice(token: str) -> Iterator[list[tuple[str, float]]]:
    """Readings of each run of equal characters: (letters, cost)."""
    for m in re.finditer(r"(.)\1*", token, re.S):
        c, k = m[1], len(m[0])
        if c in CODE:
            yield [(c * k, 0.0)] if k == 1 else [(c, REPEAT_COST * (k > 1)), (c * 2, REPEAT_COST * (k > 2))]
        elif c in SIGNS:
            reads = [(x * n, SIGN_COST * n + REPEAT_COST * (k > n)) for x in SIGNS[c] for n in {1, min(k, 2)}]
            yield [*reads, ("", DROP_COST)] if not c.isalnum() else reads
        else:
            yield [("", 0.0 if c in BETWEEN else DROP_COST)]


def disguised(token: str) -> bool:
    """Whether a token may hide a word: a letter and a sign, two signs, signs between letters of
    which one sets apart, or a doubled letter.  One pass over the token for each."""
    signs = SIGN.findall(token)
    if len(signs) > 1 or signs and LETTER.search(token) or TWICE.search(token):
        return True
    return any(not set("._-").isdisjoint(m[1]) for m in APART.finditer(token))


def viterbi(token: str, model: np.ndarray) -> str:
    """The likeliest letters behind a token."""
    best = {(0, 0): (0.0, None)}  # the last two letters -> cost so far, (what came before, letters)
    for readings in lattice(token):
        step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, link) in best.items():
            for letters, extra in readings:
                x, y, c = a, b, cost + extra
                for ch in letters:
                    z = CODE[ch]
                    c -= float(model[x, y, z])
                    x, y = y, z
                if (x, y) not in step or c < step[x, y][0]:
                    step[x, y] = (c, (link, letters) if letters else link)
        best = step
    link = min(((c - float(model[a, b, 0]), link) for (a, b), (c, link) in best.items()), key=lambda e: e[0])[1]
    out = []
    while link:
        link, letters = link
        out.append(letters)
    return "".join(reversed(out))


def may_begin(token: str, heads: set[str]) -> bool:
    """Whether some reading of the token begins with one of `heads` (of `HEAD` letters, or whole
    words that are shorter)."""
    begun, done = {""}, set()
    for readings in lattice(token):
        begun = {(a + letters)[:HEAD] for a in begun for letters, _ in readings}
        done |= {a for a in begun if len(a) == HEAD}
        begun = {a for a in begun if len(a) < HEAD}
        if not begun:
            break
    return not heads.isdisjoint(done | begun)


def _own(word: str) -> list[str]:
    return [word, *(f"{word[:n]}~" for n in PREFIXES if len(word) > n)]


def reader(model: np.ndarray, known: dict[str, float] | None = None) -> Callable[[str], set[str]]:
    """text -> its features: plain and restored words, and their first 3 to 7 letters; only
    those in `known`, if given."""

    # Every feature of a word begins like the word.
    heads = None if known is None else {f.rstrip("~")[:HEAD] for f in known}

    def features(words: list[str]) -> tuple[str, ...]:
        if heads is not None:
            words = [w for w in words if w[:HEAD] in heads]
            if not words:
                return ()
        found = [f for w in words if len(w) > 1 for f in _own(w)]
        return tuple(found if known is None else [f for f in found if f in known])

    def restored(token: str) -> list[str]:
        return [viterbi(token, model)] if heads is None or may_begin(token, heads) else []

    class Cache(dict):
        def __missing__(self, token: str) -> tuple[str, ...]:
            if len(self) > (FEWER_KEPT if heads is None else WORDS_KEPT):
                self.clear()
            if token.isalpha():
                words = [token]
                if TWICE.search(token):
                    words += restored(token)
            else:
                words = WORD.findall(token)
                # Signs at the ends may be letters or punctuation.
                for core in {token.strip(ends).lstrip("([{<") for ends in (AROUND, ENDS)}:
                    if disguised(core) and not NUMBER.fullmatch(core):
                        words += restored(core)
            out = self[token] = features(words)
            return out

    cache = Cache()

    def read(text: str) -> set[str]:
        text = text.lower()
        out = set()
        for found in map(cache.__getitem__, set(text.split())):
            if found:
                out.update(found)
        for m in SPACED.finditer(text):
            out.update(features(restored(m[0])))
        return out

    return read


def held_out(doc_id: Column) -> Column:
    """The fifth of the rows that never teaches."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    model: np.ndarray,
    sample: int = 20_000,
    candidates: int = 100_000,
    features: int = 10_000,
    least: int = 4,
    z: float = 4.5,
) -> dict[str, float]:
    """Weights by feature ('' is the intercept), learned from at most `sample` labelled rows
    outside the held-out fifth (those with the smallest hashes of doc_id).

    Features are the at most `candidates` that most toxic texts share, of them the `features`
    that lie furthest, and at least `z` deviations, above what chance gives.
    """
    rows = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = rows.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = materialize(rows.select("doc_id", F.col("toxic").cast("int").alias("toxic")), "toxic-sample")
    # Copies of a text would make all its words look telling.
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(rows), "doc_id")
    texts = texts.groupBy(F.xxhash64("text").alias("row")).agg(F.max("toxic").alias("toxic"), F.first("text").alias("text"))
    texts = materialize(texts, "toxic-texts")
    n, n1 = texts.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    if not n or n1 in (0, n):
        return {"": 0.0 if not n else 5.0 if n1 else -5.0}
    p = n1 / n

    def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader(model)
        for batch in batches:
            for t in _texts(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(sorted(read(t)), pa.string())], names=["f"])

    common = texts.where("toxic = 1").select("text").mapInArrow(names, "f string").groupBy("f").count()
    common = common.where(F.col("count") >= least).orderBy(F.desc("count"), "f").limit(candidates)
    index = {f: i for i, f in enumerate(sorted(r["f"] for r in common.select("f").collect()))}

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader(model, index)
        for batch in batches:
            for a, b in portions(batch.column("text")):
                part = batch.slice(a, b - a)
                found = pa.array([sorted(index[f] for f in read(t)) for t in _texts(part.column("text"))], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("toxic"), found], names=["toxic", "f"])

    data = materialize(texts.select("toxic", "text").mapInArrow(hits, "toxic int, f array<int>"), "toxic-hits")
    sums = data.select("toxic", F.explode("f").alias("f")).groupBy("f").agg(
        F.count(F.lit(1)).alias("c"), F.sum("toxic").alias("c1")
    )
    above = (F.col("c1") - F.col("c") * p) / F.sqrt(F.col("c") * (p * (1 - p)))
    kept = sums.withColumn("z", above).where(F.col("z") >= z).orderBy(F.desc("z"), "f").limit(features).collect()
    place = {r["f"]: i for i, r in enumerate(kept)}

    def narrow(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in parts:
            yield pd.DataFrame({"toxic": x["toxic"], "f": [[place[i] for i in f if i in place] for f in x["f"]]})

    got = data.mapInPandas(narrow, "toxic int, f array<int>").collect()  # `sample` rows at most
    y, cols = np.array([r["toxic"] for r in got], dtype=float), [r["f"] for r in got]
    w, _ = lasso(cols, y, len(place))
    # The strong penalty chose the features and shrank them; a weak one fits those alone.
    w, b = lasso([[i for i in c if w[i]] for c in cols], y, len(place), strength=0.3)
    name = {i: f for f, i in index.items()}
    return {"": b} | {name[f]: float(w[i]) for f, i in place.items() if w[i]}


def lasso(cols: list[list[int]], y: np.ndarray, n: int, steps: int = 600, strength: float = 2.0) -> tuple[np.ndarray, float]:
    """Logistic regression on 0/1 features by accelerated proximal steps.  A feature's L1
    penalty is `strength` deviations of the gradient that chance alone would give it."""
    size, p = len(y), y.mean()
    row = np.repeat(np.arange(size), [len(c) for c in cols])
    col = np.array([i for c in cols for i in c], dtype=np.int64)
    penalty = strength * np.sqrt(np.bincount(col, minlength=n) * p * (1 - p)) / size

    def times(w: np.ndarray) -> np.ndarray:
        return np.bincount(row, w[col], minlength=size)

    def back(r: np.ndarray) -> np.ndarray:
        return np.bincount(col, r[row], minlength=n)

    v, top = np.ones(n), 1.0
    for _ in range(30 * bool(len(col))):  # largest curvature, by power iteration
        v = back(times(v))
        top = float(np.linalg.norm(v))
        v /= top
    rate = 1 / (0.25 * (1.1 * top / size + 1))
    w = pw = np.zeros(n)
    b = pb = math.log(p / (1 - p))
    for k in range(steps):
        m = k / (k + 3)
        vw, vb = w + m * (w - pw), b + m * (b - pb)
        r = (1 / (1 + np.exp(-(vb + times(vw)))) - y) / size
        pw, pb = w, b
        w, b = vw - rate * back(r), vb - rate * r.sum()
        w = np.sign(w) * np.maximum(np.abs(w) - rate * penalty, 0)
    return w, float(b)


def scored(docs: DataFrame, weights: dict[str, float], model: np.ndarray, name: str = "score", text_col: str = "text") -> DataFrame:
    """`docs` with one more column, the probability that the text is toxic."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {f: w for f, w in weights.items() if f}
        read = reader(model, known)
        for batch in batches:
            # Small batches go back, so that neither side holds a large one twice.
            for a, b in portions(batch.column(text_col)):
                part = batch.slice(a, b - a)
                sums = np.array([weights[""] + sum(known[f] for f in sorted(read(t))) for t in _texts(part.column(text_col))], dtype=float)
                prob = pa.array(1 / (1 + np.exp(-np.clip(sums, -500, 500))))
                yield pa.RecordBatch.from_arrays([*part.columns, prob], names=[*part.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def train(docs: DataFrame, labels: DataFrame, **options) -> tuple[dict[str, float], np.ndarray]:
    model = char_model(char_counts(docs))
    return fit(docs, labels, model, **options), model


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Null texts count as empty; an empty text gets the score of the intercept.  Texts and tokens of
    any length are read whole, in time that grows with their length.  Null ids are
    not held out, and labels without id or verdict teach nothing; of several labels of one id
    the toxic one counts.  Repeated rows are scored alike and all returned.  Without any label
    all scores are 0.5.  Extra columns are ignored.  An empty table gives an empty result.
    """
    weights, model = train(docs, labels, **options)
    rows = scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), weights, model)
    return rows.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows that are not predicted toxic, with all their columns, whatever their names.  Nulls,
    empty and long texts, repeated rows and empty tables are treated as in `toxicity`."""
    weights, model = train(docs, labels, **options)
    # Columns by number, since names may clash; each goes to the tasks once.
    at = docs.columns.index("text") if "text" in docs.columns else [c.lower() for c in docs.columns].index("text")
    rows = docs.toDF(*(f"_{i}" for i in range(len(docs.columns))))
    return scored(rows, weights, model, text_col=f"_{at}").where("score < 0.5").drop("score").toDF(*docs.columns)
