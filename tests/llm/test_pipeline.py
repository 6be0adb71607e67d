import collections
import string

import public_tokenizers
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from gridspark.llm import queries, toxicity
from gridspark.llm.common import materialize, table
from test_decontamination import brute as leaks
from test_near_dedup import shingles

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def test_registered():
    names = entry.queries()
    assert "pipeline" in names
    for n in range(1, 11):
        assert sum(k.startswith(f"op{n}_") for k in names) == 1
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def test_every_stage_equals_brute_force(spark):
    docs = table(spark, FOLDER, "documents")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialize(stage(spark, docs, FOLDER), "stage")
        kept[name] = before, docs
        if name != "packing":
            assert docs.columns == columns
    texts = lambda df: {r.doc_id: r.text or "" for r in df.collect()}

    before, after = map(texts, kept["toxicity"])
    scores = toxicity.toxicity(kept["toxicity"][0], table(spark, FOLDER, "labels"))
    assert set(after) == {r.doc_id for r in scores.where("predicted = 0").collect()}

    before, after = map(texts, kept["exact dedup"])
    groups = collections.defaultdict(list)
    for i, t in before.items():
        groups[t.translate(LOWER)].append(i)
    assert set(after) == {max(g) for g in groups.values()}

    before, after = map(texts, kept["near dedup"])
    ids, sets, parent = sorted(before), {i: shingles(t) for i, t in before.items()}, {i: i for i in before}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i in enumerate(ids):
        for j in ids[:k]:
            common = sum((sets[i] & sets[j]).values())
            if common and common >= 0.8 * (sum(sets[i].values()) + sum(sets[j].values()) - common):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    assert set(after) == {i for i in ids if find(i) == i}

    before, after = map(texts, kept["decontamination"])
    items = [(r.item_id, r.text) for r in table(spark, FOLDER, "benchmark").collect()]
    plain = " ".join
    held = {i for i, t in before.items() if any(plain(u.split()) in plain(t.split()) for _, u in items)}
    assert held <= set(before) - set(after)
    assert {i for i, _ in leaks([(i, before[i]) for i in set(before) - set(after)], items)} == set(before) - set(after)

    before = texts(kept["packing"][0])
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in before.items()}
    got = collections.Counter()
    for r in kept["packing"][1].collect():
        got[r.doc_id] += r.length
    assert got == sizes


def test_run_and_queries_without_sql(spark):
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
    for name, query in queries.QUERIES.items():
        assert query(spark, FOLDER).count() > 0, name
