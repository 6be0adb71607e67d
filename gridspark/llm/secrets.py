"""Secrets in texts: fixed patterns, and values in a credential context that cost many guesses.

The cost of a value is the least over all ways of cutting it into segments, each with the guesses
that an informed guesser needs: words of the corpus (rare ones cost more), dates, repeats, walks
over the keyboard or the alphabet, and single characters by brute force.  The words' prices are
counts over all documents, outside of the values themselves: one job finds the values, one counts
words, a join gives every distinct value the words that it may hold, and each distinct value is
cut once.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .decontamination import small

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # runs are maximal, so this is [0-9a-f]+ of 24 or more
ASSIGN_LEAST, ACCESS_LEAST = 6, 20

#: Names that announce a credential, with what may stand between name and value.
NAMES = (
    r"pass(?:word|wd|phrase|code)?|passwort|kennwort|contraseña|mot de passe|pwd|secret|token|credentials?|bearer"
    r"|(?:api|access|private|client|account|storage|signing|auth)[_-]?(?:key|secret|token)|auth(?:orization)?"
)
CONTEXT = re.compile(
    rf"""(?<![a-z])(?:{NAMES})["'\]]{{0,2}}(?:\x20{{0,3}}(?::=|=>|->|[:=])|\x20is\b|(?<=bearer))\x20{{0,3}}(?:(?:bearer|basic)\x20)?"""
    r"""(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"'<>,;]+))""",
    re.IGNORECASE,
)
USERINFO = re.compile(r"://[^\s/:@]+:([^\s/@]+)@")
HINTS = ("pass", "kennwort", "contrase", "pwd", "secret", "token", "credential", "bearer", "key", "auth")

THRESHOLD = 10.0  # decimal digits of guesses from which a value is a secret
LEAST = 0.5  # digits that any segment costs
SEGMENT = 64  # longest segment
WORD = (3, 24)  # lengths of words
LEET = str.maketrans({"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"})
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
KEYS = {c: (r, k) for r, row in enumerate(ROWS) for k, c in enumerate(row)}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, in order."""
    low = text.lower()
    out = []
    if any(name in low for name in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def credential_values(text: str) -> list[tuple[int, int, str]]:
    """(start, end, value) of what stands in a credential context, without closing punctuation."""
    low = text.lower()
    found = {}
    if any(h in low for h in HINTS):
        for m in CONTEXT.finditer(text):
            group = m.lastindex
            end = m.end(group)
            if group == 3:
                end -= len(m.group(3)) - len(m.group(3).rstrip(".:!?)]}"))
            found[m.start(group)] = end
        for m in ASSIGN.finditer(text):
            found.setdefault(m.start(2), m.end(2))
    if "://" in text:
        for m in USERINFO.finditer(text):
            found[m.start(1)] = m.end(1)
    return [(a, b, text[a:b]) for a, b in sorted(found.items()) if a < b]


def plain(value: str) -> str:
    """`value` in lower case, with signs and digits read as the letters that they imitate."""
    return "".join(c if len(c) == 1 else "?" for c in map(str.lower, value)).translate(LEET)


def word_places(value: str) -> Iterator[tuple[int, int, str, int]]:
    """(start, end, word, letters imitated) of the stretches of `value` that may be words: letters
    a to z, of which at most two fifths are imitated by other signs."""
    read = plain(value)
    fake = [0]
    for c, r in zip(value, read):
        fake.append(fake[-1] + (c.lower() != r))
    for i in range(len(value)):
        for j in range(i + 1, min(len(value), i + WORD[1]) + 1):
            if not "a" <= read[j - 1] <= "z":
                break
            odd = fake[j] - fake[i]
            if j - i >= WORD[0] and 5 * odd <= 2 * (j - i):
                yield i, j, read[i:j], odd


def brute_cost(c: str) -> float:
    pool = 10 if "0" <= c <= "9" else 26 if "a" <= c <= "z" or "A" <= c <= "Z" else 33 if c < "\x80" else 1000
    return math.log10(pool)


def word_cost(part: str, odd: int, price: float) -> float:
    """`price`, and what capitals (first only, all, or any) and imitated letters add."""
    upper = sum(c.isupper() for c in part)
    if upper:
        easy = upper == 1 and part[0].isupper() or upper == len(part)
        price += math.log10(2) if easy else math.log10(sum(math.comb(len(part), k) for k in range(1, upper + 1)))
    return max(LEAST, price + odd * math.log10(2))


def _date(a: int, b: int, c: int) -> bool:
    """Whether the numbers are a day, a month and a year in a usual order (years of two or four digits)."""
    year = lambda y: 0 <= y <= 99 or 1900 <= y <= 2099
    return any(1 <= m <= 12 and 1 <= d <= 31 and year(y) for d, m, y in ((a, b, c), (b, a, c), (c, b, a)))


DATE = re.compile(r"(\d{1,4})([-/._ ])(\d{1,2})\2(\d{1,4})", re.ASCII)
#: How the digits of a date without separators are cut.
CUTS = {4: ((1, 2), (2, 3)), 5: ((1, 3), (2, 3)), 6: ((1, 2), (2, 4), (4, 5)), 7: ((1, 3), (2, 3), (4, 5), (4, 6)), 8: ((2, 4), (4, 6))}


def date_cost(part: str) -> float | None:
    """Digits for a year (4 digits), or for a date of 4 to 8 digits or with separators."""
    if part.isascii() and part.isdigit():
        if len(part) == 4 and "1900" <= part <= "2099":
            return math.log10(200)
        if any(_date(int(part[:x]), int(part[x:y]), int(part[y:])) for x, y in CUTS.get(len(part), ())):
            return math.log10(365 * 100)
    elif 6 <= len(part) <= 10 and (m := DATE.fullmatch(part)) and _date(*(int(m.group(k)) for k in (1, 3, 4))):
        return math.log10(365 * 100 * 4)
    return None


def repeat_cost(part: str) -> float | None:
    """A block of up to four characters, three times or more (two times if it has several)."""
    for size in range(1, 5):
        times, rest = divmod(len(part), size)
        if not rest and times >= (3 if size == 1 else 2) and part == part[:size] * times:
            return sum(map(brute_cost, part[:size])) + math.log10(times)
    return None


def _step(a: str, b: str) -> tuple[int, int] | None:
    """From one key to a neighbour, or from a letter or digit to the next or the one before."""
    if a in KEYS and b in KEYS:
        (r, k), (s, j) = KEYS[a], KEYS[b]
        if (s - r, j - k) in ((0, 1), (0, -1), (1, 0), (-1, 0), (1, -1), (-1, 1)):
            return s - r, j - k
    if a.isascii() and b.isascii() and (a.isdigit() and b.isdigit() or a.isalpha() and b.isalpha()):
        if abs(ord(b) - ord(a)) == 1:
            return 9, ord(b) - ord(a)
    return None


def walk_cost(part: str) -> float | None:
    """Three or more keys in a row; every turn costs a choice of direction."""
    low = part.lower()
    steps = [_step(a, b) for a, b in zip(low, low[1:])]
    if len(part) < 3 or None in steps:
        return None
    turns = 1 + sum(a != b for a, b in zip(steps, steps[1:]))
    case = math.log10(2) if part != low else 0
    return math.log10(47 * len(part)) + turns * math.log10(4) + case


def guess_cost(value: str, prices: dict[str, float], enough: float = math.inf) -> float:
    """Least decimal digits of guesses over all segmentations of `value` (or some number of
    `enough` or more, if the least is that much).  A word of `prices` costs what stands there."""
    if len(value) > SEGMENT * enough / LEAST:
        return enough
    words: dict[int, list[tuple[int, float]]] = {}
    for i, j, word, odd in word_places(value):
        if word in prices:
            words.setdefault(j, []).append((i, word_cost(value[i:j], odd, prices[word])))
    low = value.lower() if len(value.lower()) == len(value) else value
    best = [0.0]
    walk = 0  # where the walk began that ends here
    for j in range(1, len(value) + 1):
        cost = best[j - 1] + brute_cost(value[j - 1])
        for i, price in words.get(j, ()):
            cost = min(cost, best[i] + price)
        if j >= 2 and _step(low[j - 2], low[j - 1]) is None:
            walk = j - 1
        ends = [(i, walk_cost(value[i:j])) for i in range(max(walk, j - SEGMENT), j - 2)]
        ends += [(i, date_cost(value[i:j])) for i in range(max(0, j - 10), j - 3)] if value[j - 1].isdigit() else []
        for size in range(1, 5):
            i = j - 2 * size
            while i >= max(0, j - SEGMENT) and value[i : i + size] == value[j - size : j]:
                ends.append((i, repeat_cost(value[i:j])))
                i -= size
        for i, price in ends:
            if price is not None:
                cost = min(cost, best[i] + max(LEAST, price))
        best.append(cost)
        if min(best[-SEGMENT:]) >= enough:  # every way to the end passes one of these
            return min(best[-SEGMENT:])
    return best[-1]


def _scan(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, base and found: the spans of both kinds of every document."""
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())])
    hit = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("value", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, found = [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                base.append([dict(zip(("start", "kind", "stop"), s)) for s in base_spans(text)])
                found.append([dict(zip(("start", "stop", "value"), s)) for s in credential_values(text)])
            arrays = [batch.column("doc_id"), pa.array(base, pa.list_(span)), pa.array(found, pa.list_(hit))]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "base", "found"])

    schema = "doc_id long, base array<struct<start:int,kind:int,stop:int>>, found array<struct<start:int,stop:int,value:string>>"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema)


def _words(text: Column) -> Column:
    """Runs of the letters a to z, of the lengths that words may have."""
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: F.length(w).between(*WORD))


def word_counts(docs: DataFrame, values: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): occurrences in all documents, less those in `values(value, times)`."""
    inside = values.select(F.explode(_words(F.col("value"))).alias("word"), (-F.col("times")).alias("n"))
    words = docs.select(F.explode(_words(F.col(text_col))).alias("word"))
    counts = words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).unionByName(inside)
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where("n > 0")


def strong_values(values: DataFrame, counts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(key): those of the distinct `values(key, value)` that cost `threshold` digits of guesses or more."""
    total = float(counts.agg(F.sum("n")).first()[0] or 1)
    longest = SEGMENT * threshold / LEAST  # a longer value is above the threshold however it is cut

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, value in zip(batch.column("key").to_pylist(), batch.column("value").to_pylist()):
                words = sorted({w for _, _, w, _ in word_places(value)}) if len(value) <= longest else []
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(words), pa.binary()), pa.array(words, pa.string())], names=["key", "word"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, value, words in zip(*(batch.column(c).to_pylist() for c in ("key", "value", "words"))):
                prices = {w["word"]: math.log10(max(1.0, total / w["n"])) for w in words or ()}
                if guess_cost(value, prices, threshold) >= threshold:
                    out.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["key"])

    may = materialize(values.select("key", "value").mapInArrow(parts, "key binary, word string"), "value-words")
    known = materialize(counts.join(small(may.select("word").distinct()), "word", "left_semi"), "known-words")
    # A value has at most `longest` characters here, and 22 words may begin at each.
    priced = may.join(small(known), "word").groupBy("key").agg(F.collect_list(F.struct("word", "n")).alias("words"))
    return values.join(priced, "key", "left").select("key", "value", "words").mapInArrow(cut, "key binary")


def _listed(spans: Column) -> Column:
    kinds = F.array(*(F.lit(k) for k in KINDS))
    one = lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["stop"])
    return F.concat_ws(",", F.transform(F.array_sort(spans), one))


def find_secrets(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_guess, base_sha256, spans.

    A span is kind:start:end in code points, the end exclusive; `spans` lists those of the fixed
    patterns (assign, access, hex) and of the values in a credential context whose least guess
    cost is `threshold` decimal digits or more (guess), by start, kind and end; `base_sha256` is
    the digest of the former alone.  A value that a fixed pattern covers is judged, too, and gets
    a guess span of its own beside it.  Null texts count as empty: no spans, the digest of the
    empty text.  Texts and values of any length are searched whole; a value is judged strong as
    soon as no way of cutting it stays below the threshold.  Repeated rows, repeated and null ids
    give a row each.  Extra columns are ignored, whatever their names.  An empty table gives an
    empty result.
    """
    rows = materialize(_scan(docs, id_col, text_col).withColumn("_row", F.monotonically_increasing_id()), "credentials")
    hits = rows.select("_row", F.explode("found").alias("hit")).select("_row", "hit.*", F.unhex(F.md5("hit.value")).alias("key"))
    values = materialize(hits.groupBy("key", "value").agg(F.count(F.lit(1)).alias("times")), "credential-values")
    counts = materialize(word_counts(docs, values, text_col), "word-counts")
    strong = materialize(strong_values(values, counts, threshold), "strong-values")
    guessed = hits.join(small(strong), "key").groupBy("_row").agg(
        F.collect_list(F.struct("start", F.lit(KINDS.index("guess")).alias("kind"), "stop")).alias("guess")
    )
    rows = rows.drop("found").join(guessed, "_row", "left")
    number = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long")
    guess = F.coalesce("guess", F.array().cast("array<struct<start:int,kind:int,stop:int>>"))
    return rows.select(
        "doc_id",
        *(number(k).alias(f"n_{k}") for k in KINDS[:3]),
        F.size(guess).cast("long").alias("n_guess"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.concat("base", guess)).alias("spans"),
    )
