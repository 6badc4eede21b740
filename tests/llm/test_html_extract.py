import numpy as np
import pytest
from pyspark.sql import functions as F

from stintlab.llm import html_extract
from stintlab.llm.dom import FEATURES, Page

PAGES = "/root/testdata/sf0.01/pages.parquet"


@pytest.fixture(scope="module")
def trees(spark):
    from stintlab.llm.frames import prepare
    prepare(spark)
    return html_extract.fit(spark.read.parquet(PAGES).select(F.col("page_id").alias("id"), "html"))


def test_tree_and_text_of_broken_html():
    page = Page('<!doctype html><title>a &lt;p></title><p><b>One &amp; <br>two<p>Three<ul><li>x<li>y</ul><script>"</p>"</script><!-- no <p>--><div a="1>2">&eacute;&#33;&nbsp; z</div')
    assert page.text([True] * len(page.tags)) == "One & two\nThree\nx\ny\né! z"
    assert page.features().shape == (len(page.tags), len(FEATURES))
    assert Page("").text([True]) == "" and Page("<p").features().shape[1] == len(FEATURES)


def test_siblings_count_at_every_number():
    """The share of equal tags and the mean text of siblings follow one definition from few to many."""
    same, mean = FEATURES.index("same_siblings"), FEATURES.index("sibling_chars")
    for k in (3, 63, 64, 200):
        page = Page("<div>" + "".join(f"<p>{'x' * (j % 5 + 1)}</p><b>y</b>" for j in range(k)) + "</div>")
        x = page.features()
        beside = [v for v, t in enumerate(page.tags) if t in "pb"]
        chars = sum(j % 5 + 2 for j in range(k))
        for v in beside:
            assert np.isclose(x[v, same], np.log1p(k)) and np.isclose(x[v, mean], np.log1p(chars / (2 * k)))


def test_a_hundred_thousand_elements():
    source = "<html><body><article>" + "<p>w</p>" * 100_001 + "</article></body></html>"
    variant = next(html_extract._variants(source, 0))
    page = Page(variant)
    assert len(page.tags) > 100_001 and len(list(html_extract._variants(source, 0))) == 5
    assert len(page.features()) == len(page.tags)


def brute_decode(parents, scores, own):
    n, best = len(parents), (-1e18, None)
    for code in range(3 ** n):
        state = [code // 3 ** v % 3 for v in range(n)]
        if any(not {0: (0, 1), 1: (1, 2), 2: (2,)}[state[parents[v]]].__contains__(state[v]) for v in range(1, n)) or state[0] == 2:
            continue
        total = sum((1 if s == 1 else -1) * max(-4, min(4, x)) * (1 + o) for s, x, o in zip(state, scores, own))
        total -= sum(state[v] != state[parents[v]] for v in range(1, n)) + (state[0] == 1)
        best = max(best, (total, [s == 1 for s in state]))
    return best


def test_decoding_is_the_best_labelling():
    r = np.random.default_rng(2)
    for _ in range(40):
        n = int(r.integers(1, 8))
        parents = [-1] + [int(r.integers(0, v)) for v in range(1, n)]
        scores, own = r.normal(0, 2, n), r.random(n)
        assert html_extract.decode(parents, ["p"] * n, scores, own) == brute_decode(parents, scores, own)[1]


def test_arrays_score_like_the_fitted_model(spark, trees):
    assert len(trees.roots) == html_extract.TREES
    x = Page(spark.read.parquet(PAGES).first()["html"]).features()
    odds = trees.log_odds(x)
    assert np.isfinite(odds).all() and (odds > 0).any() and (odds < 0).any()


def plain(source):
    """The marked article of a page of the given table, by its fixed layout."""
    import html
    import re

    inner = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
    return "\n".join(b for b in blocks if b)


def test_all_given_pages(spark, trees):
    pages = spark.read.parquet(PAGES)
    out = {r["page_id"]: r for r in html_extract.extract(pages, trees=trees).collect()}
    for p in pages.collect():
        assert out[p["page_id"]]["text"] == plain(p["html"])
        assert out[p["page_id"]]["n_chars"] == len(out[p["page_id"]]["text"])


def test_other_layouts_held_out(spark, trees):
    """Unseen words in layouts without an article element: blocks kept and dropped, by share."""
    r = np.random.default_rng(11)
    say = lambda n: " ".join("".join(chr(97 + c) for c in r.integers(0, 26, r.integers(2, 9))) for _ in range(n)).capitalize() + "."
    kept = dropped = wrong_kept = wrong_dropped = 0
    for k in range(40):
        good, bad = [say(int(n)) for n in r.integers(8, 60, 6)], [say(int(n)) for n in r.integers(2, 14, 9)]
        body = "".join(f"<p>{g}</p>" for g in good[1:])
        container = ("div class='post-content'", "main", "div id='article-body'", "section class='entry-content'")[k % 4]
        page = (f"<html><head><style>p{{}}</style></head><body><header><a href='/'>{bad[0]}</a></header><nav><a href='/a'>{bad[1]}</a> <a href='/b'>{bad[2]}</a></nav>"
                f"<div class='cookie-banner'>{bad[3]}</div><{container}><h1>{good[0]}</h1>{body}</{container.split()[0]}>"
                f"<aside><h3>{bad[4]}</h3></aside><div class='advert'><p>{bad[5]}</p></div><div class='comments'><p>{bad[6]}</p></div>"
                f"<form><label>{bad[7]}</label><input></form><script>var x = '{bad[8]}'</script><footer>{bad[8]}</footer></body></html>")
        blocks = html_extract.main_text(page, trees).split("\n")
        kept, dropped = kept + len(good), dropped + len(bad)
        wrong_dropped += sum(g not in blocks for g in good)
        wrong_kept += sum(any(b in x for x in blocks) for b in bad)
    assert wrong_dropped <= 0.05 * kept and wrong_kept <= 0.1 * dropped, (wrong_dropped, kept, wrong_kept, dropped)


def test_nulls_ties_and_empty_tables(spark, trees):
    data = [(1, "u", None), (1, "u", None), (2, None, ""), (None, None, "<p>only text that has no marks at all, but some length.</p>"), (3, "v", "x" * 200_000)]
    df = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("id", F.lit(2))
    out = html_extract.extract(df, trees=trees).collect()
    assert len(out) == 5 and sum(r["text"] == "" and r["n_chars"] == 0 for r in out) >= 3
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract(empty).count() == 0
    assert html_extract.extract(df.where("page_id is null")).first()["text"].startswith("only text")
