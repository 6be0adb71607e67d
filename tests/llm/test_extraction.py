import itertools
import random
import time

import pytest

from gridspark.llm import extraction as X


@pytest.mark.parametrize("seed", range(20))
def test_cut_is_the_least_labelling(seed):
    rng = random.Random(seed)
    n = rng.randint(1, 9)
    odds = [rng.choice([0.0, rng.uniform(-5, 5)]) for _ in range(n)]
    edges = [(a, b, rng.uniform(0, 3)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.4]

    def cost(keep):
        return sum(-x if x < 0 and k else x if x > 0 and not k else 0 for x, k in zip(odds, keep)) + sum(w for a, b, w in edges if keep[a] != keep[b])

    best = min(cost(k) for k in itertools.product([True, False], repeat=n))
    assert cost(X.minimum_cut(odds, edges)) == pytest.approx(best)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar">
<header><h1>Site name</h1><nav><ul><li><a href=/>Home</a><li><a href=/x>News and views</a></ul></nav></header>
<div class="cookie-notice">We use cookies to improve things, and to count our visitors every day.</div>
<div id="content"><h1>Title   here</h1><p><b>First paragraph &eacute;&amp;&#228;&#x41;&copy, with
 many words, and it goes<br>on for a while.<p>Short.<p>Second long paragraph of the story, with many words in it.</p>
<blockquote>A quotation that belongs to the story as well, says the author.</blockquote>
<div class="ad">Buy this thing now, it is great and cheap for everybody who reads this.</div>
<p>Last paragraph of the story, which ends here after some more words.</div>
<section id="comments"><article class="comment"><p>I liked to read this very much, thank you for writing it, it was long.</p></article></section>
<aside><p>A long paragraph of the side column with many words, and it goes on and on.</p></aside>
<form><label>Mail</label><input><button>Subscribe</button></form><footer>&copy; 2020 Site &middot; all of it</footer></body></html>"""


def test_whole_page():
    assert X.main_text(PAGE) == "\n".join(
        [
            "Title here",
            "First paragraph é&äA©, with many words, and it goes on for a while.",
            "Short.",
            "Second long paragraph of the story, with many words in it.",
            "A quotation that belongs to the story as well, says the author.",
            "Last paragraph of the story, which ends here after some more words.",
        ]
    )


def test_head_without_end_tag_and_formulas():
    text = "The whole article is in this paragraph, and it has many words."
    for start in ("<body><p>", "<p>", "<div><p>", ""):
        assert X.main_text(f"<html><head><title>x</title><meta charset=utf-8><script>var a;</script>{start}{text}") == text
    assert X.main_text(PAGE.replace("</head>", "")) == X.main_text(PAGE)
    assert X.main_text("<article><p>So <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds for all of them.</p></article>") == "So x=2 holds for all of them."


def test_article_with_short_blocks_and_broken_markup():
    page = "<nav><a href=/>x</a></nav><div class=ad>Ad text.</div><article><h1>A b.</h1><p><b>A b.<br><p>C.<p>D &am e</article><footer>&copy; z"
    assert X.main_text(page) == "A b.\nA b.\nC.\nD &am e"


def test_table(spark):
    long = "<article>" + "<p>word word word, word.</p>" * 20_000 + "</article>"
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "v", ""), (4, "w", long), (5, "x", "<nav>menu</nav>"), (None, "y", "<p>Only this sentence, which is long enough.")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' AS text", "1 AS n_chars")
    got = X.extract(df).collect()
    assert len(got) == 7 and all(r.n_chars == len(r.text) for r in got)
    by = {r.url: r.text for r in got}
    assert by[None] == by["v"] == by["x"] == "" and by["y"].startswith("Only")
    assert by["w"] == "\n".join(["word word word, word."] * 20_000)
    assert X.extract(df.limit(0)).count() == 0


def test_depth_does_not_cost_time():
    """Four times the depth takes about four times as long, not sixteen times."""
    took = []
    for depth in (3000, 12000):
        began = time.perf_counter()
        text = X.main_text("<div><p>" * depth + "Deep words that stay, and more of them. " * 5 + "</i>" * depth)
        took.append(time.perf_counter() - began)
        assert text.startswith("Deep words that stay")
    assert took[1] < 10 * took[0]
