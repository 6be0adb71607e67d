import collections
import hashlib
import string

import pytest

from gridspark.llm import exact_dedup, sharding
from oracle import connect, rows_of

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(rows):
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[(t or "").translate(LOWER)].append(i)
    return groups


def test_exact_dedup_equals_brute_force(docs):
    rows = [(1, "A b"), (2, "a B"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, "a b "), (8, "x" * 200_000), (9, "X" * 200_000)]
    rows += [(100 + k, "hot copy") for k in range(500)]
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(docs(rows), salts=3).collect()}
    assert len(got) == len(rows)
    for text, ids in brute(rows).items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept) == (max(ids), len(ids), i == max(ids))
            assert r.text_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_exact_dedup_repeated_rows_and_null_ids(docs):
    rows = [(1, "a"), (1, "a"), (1, "b"), (None, "c"), (None, "c"), (None, "a")]
    got = exact_dedup.exact_dedup(docs(rows)).collect()
    assert len(got) == 6
    assert sorted((r.doc_id or -1, r.text_sha256[:4]) for r in got if r.kept) == sorted(
        [(i, hashlib.sha256(t).hexdigest()[:4]) for i, t in ((1, b"a"), (1, b"b"), (-1, b"c"))]
    )
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got if r.group_size == 3} == {(1, 1, 3), (None, 1, 3)}
    kept = exact_dedup.drop_duplicates(docs(rows))
    assert kept.columns == docs(rows).columns and kept.count() == 3


def test_empty_tables(docs):
    assert exact_dedup.exact_dedup(docs([])).count() == 0
    assert exact_dedup.drop_duplicates(docs([])).count() == 0
    assert sharding.extendible_shards(docs([]), 100).count() == 0


@pytest.mark.parametrize("limit, spare", [(2_000, 4), (2_000, 0), (60, 1), (10**9, 4)])
def test_shards_equal_sql_and_fit(spark, docs, tmp_path, limit, spare):
    rows = [(k, "w" * (k * 7 % 97)) for k in range(400)] + [(1000, "v" * 5_000), (1001, None), (1002, "")] + [(7, "same")] * 40
    df = docs(rows)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    con = connect("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = sharding.extendible_shards(df, limit, spare)
    cur = con.execute(sharding.oracle(limit))
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())
    for r in got.collect():
        assert r.shard_bytes <= limit or r.shard_rows == 1


def test_shard_names_are_a_prefix_code(docs):
    got = sharding.extendible_shards(docs([(k, "w" * 50) for k in range(300)]), 500).collect()
    names = {r.shard for r in got}
    assert len(got) == 300 and all(not a.startswith(b) for a in names for b in names if a != b)
    assert sum(2.0 ** -len(n) for n in names) <= 1
