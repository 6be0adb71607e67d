import pytest
from pyspark.sql import functions as F

from gridspark.llm import url_filter as U
from oracle import connect, rows_of


def pages(spark, urls):
    return spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls)], "page_id long, url string, html string").selectExpr(
        "*", "'x' AS host", "'y' AS path", "1 AS rule"
    )


def test_url_parts(spark):
    cases = {
        "http://A.Example.ORG/En/1?x#y": ("a.example.org", "/En/1"),
        "https://a.b": ("a.b", ""),
        "x://h?q=://z/": ("h", ""),
        "h/p": ("", ""),
        None: ("", ""),
        "a://b://c/d": ("b:", "//c/d"),
        "://x#a/b": ("x", ""),
        "http://É.org/ü\nv?w": ("É.org", "/ü\nv"),
    }
    host, path = U.url_parts(F.col("url"))
    got = pages(spark, cases).select("url", host.alias("h"), path.alias("p")).collect()
    assert {r.url: (r.h, r.p) for r in got} == cases


def test_rules_and_longest_match(spark):
    urls = {
        "http://example.org/en/2": ("org/", "allow"),
        "http://a.example.org/en/12": ("example.org/en/1", "block"),
        "http://example.org/es/": ("example.org/es/", "block"),
        "http://notexample.org/es/": ("org/", "allow"),
        "http://org": (None, "allow"),
        "http://x.com/fr/1": ("com/fr/", "allow"),
        "http://x.com/de/1": ("com/de/", "block"),
    }
    got = U.judge_urls(pages(spark, urls)).join(pages(spark, urls).select("page_id", "url"), "page_id").collect()
    assert {r.url: (r.rule, r.verdict) for r in got} == urls


def test_reputation_shrinks_and_blocks(spark):
    urls = [f"http://bad.example.com/de/{k}" for k in range(40)] + ["http://bad.example.com/en/1"]
    urls += [f"http://good{k % 9}.fine.com/fr/{k}" for k in range(90)] + ["http://new.fine.com/en/1", "http://unseen.net/x", None]
    got = {r.page_id: r for r in U.judge_urls(pages(spark, urls)).collect()}
    assert got[40].verdict == "block" and got[40].rule is None
    assert [got[k].verdict for k in (131, 132, 133)] == ["allow"] * 3


def test_empty_repeated_and_sql(spark, tmp_path):
    assert U.judge_urls(pages(spark, [])).count() == 0
    urls = ["http://a.co.uk/fr/", "http://1.2.3.4:80/x", "http://1.2.3.4:80/x", "http://q.com/de/1", "http://q.com/en/1", "zz"] * 3
    df = pages(spark, urls)
    df.write.parquet(f"{tmp_path}/pages.parquet")
    con = connect("/root/testdata/sf0.001")
    con.execute(f"CREATE OR REPLACE VIEW pages AS SELECT page_id, url, html FROM '{tmp_path}/pages.parquet/*.parquet'")
    got, cur = U.judge_urls(df), con.execute(U.ORACLE)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of([d[0] for d in cur.description], cur.fetchall())


@pytest.mark.parametrize("host, want", [("a.b.co.uk", ("b.co.uk", "co.uk")), ("a.b.org", ("b.org", "org")), ("x", ("x", "x")), ("10.0.0.1", ("10.0.0.1", ""))])
def test_levels(spark, host, want):
    d, s = U.host_levels(F.lit(host))
    assert tuple(spark.range(1).select(d, s).first()) == want
