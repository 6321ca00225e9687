import html
import itertools
import random
import re
import time

from pyspark.sql import functions as F

from ruleloom.llm.html_extract import extract, main_text
from ruleloom.llm.mincut import minimum_cut
from ruleloom.llm.registry import QUERIES

SENTENCE = "The council adopted the measure after a long debate, and it takes effect next spring."


def test_cut_against_all_labellings():
    r = random.Random(6)
    for _ in range(300):
        n = r.randrange(0, 8)
        source, sink = [r.randrange(9) for _ in range(n)], [r.randrange(9) for _ in range(n)]
        edges = [(r.randrange(n), r.randrange(n), r.randrange(6)) for _ in range(r.randrange(12))] if n else []

        def cost(labels):
            return sum(t if x else s for x, s, t in zip(labels, source, sink, strict=True)) + sum(c for i, j, c in edges if labels[i] != labels[j])  # noqa: B023

        assert cost(minimum_cut(source, sink, edges)) == min(map(cost, itertools.product([False, True], repeat=n)))


def test_article_without_the_rest():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="post-page">
    <header><a href="/">Home</a> <h2>Site name</h2></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>
    <div class="cookie-notice"><p>{SENTENCE}</p></div><div class="sidebar"><p>{SENTENCE}</p></div>
    <article><header><h1>A &amp; B&nbsp;title</h1></header><!-- x --><p>First <b>par</b>agraph:
      {SENTENCE}<p>Second<br>one &lt;i&gt; &#233; &amp. <div class="ad">{SENTENCE}</div><p>{SENTENCE}</p>
      <ul><li>Point one<li>Point two</ul><aside>{SENTENCE}</aside><p>Ok.</p>
      <form><p>{SENTENCE}</p></form>
      <section id="comments"><article><p>Reader: {SENTENCE}</p></article></section></article>
    <footer>&copy; site. {SENTENCE}</footer>"""
    want = ["A & B title", f"First paragraph: {SENTENCE}", "Second one <i> é &.", SENTENCE, "Point one", "Point two", "Ok."]
    assert main_text(page).split("\n") == want


def test_plain_divisions_are_told_apart_by_text_and_links():
    page = f'<body><div><a href=1>Home</a> | <a href=2>News</a> | <a href=3>Sport</a></div><div><h1>Council adopts measure</h1><div>{SENTENCE} {SENTENCE}</div><div>{SENTENCE}</div></div><div><a href=4>Imprint</a> <a href=5>Contact</a></div></body>'
    assert main_text(page).split("\n") == ["Council adopts measure", f"{SENTENCE} {SENTENCE}", SENTENCE]


def test_broken_and_empty_pages():
    assert [main_text(x) for x in (None, "", "   ", "<", "<p", "<!--", "<script>x", "</p></div>", "<article>")] == [""] * 9
    assert main_text(f"<article><p>{SENTENCE}</p><p>cut off <a hre").split("\n") == [SENTENCE, "cut off"]
    deep = "<div>" * 3000 + f"<p>{SENTENCE}</p>"
    assert main_text(deep) == SENTENCE
    assert main_text("<article>" + f"<p>{SENTENCE}</p>" * 5000).count("\n") == 4999


def test_attributes_hide_only_by_name_and_names_only_hint_beside_other_words():
    for page in (
        f'<article><p title="the hidden cost">{SENTENCE}</p></article>',
        f'<article><div class="text hidden md:block">{SENTENCE}</div></article>',
        f'<div class="text hidden md:block">{SENTENCE}</div>',
        f'<main><div class="article-share-intro">{SENTENCE}</div></main>',
        f'<body><p class="notice-of-change">{SENTENCE}</p></body>',
        f"<article><p data-x=a\"b title='a > b'>{SENTENCE}</p></article>",
        f'<article><p title="never closed>{SENTENCE}</p></article>'.replace('"', '"'),
        f"<article><b><p>{SENTENCE}</b></p></article>",
    ):
        assert main_text(page) == SENTENCE, page
    for page in (f"<article><p hidden>{SENTENCE}</p></article>", f'<article><p style="color:red; display: none">{SENTENCE}</p></article>', f'<div class="cookie-notice">{SENTENCE}</div>', f'<div class="related-posts">{SENTENCE}</div>', f'<main><div id="commentList">{SENTENCE}</div></main>'):
        assert main_text(page) == "", page
    assert main_text(f"<article><p>2 < 3 & 4 > 1, {SENTENCE}</p></article>") == f"2 < 3 & 4 > 1, {SENTENCE}"


def test_hostile_pages_take_time_in_proportion():
    begin = time.process_time()
    n = 100_000
    for page in ("<a" * n, '<a "' * n, '<a b="' * n, "<!--" * n, "<script>" * n, "</script x" * n, "<div>" * n + "</p>" * n, "<div>" * n + "<li>x" * n, "<p><b>" * n + "x", "<ul><li>" * n, "<![CDATA[" * n, "<div>x" * n, "&" * n, "<" * n, "<a b" + " " * n, "<b><p>x</b>" * n):
        main_text(page)
    assert time.process_time() - begin < 120


def test_rows_of_every_kind(spark):
    rows = [(1, "u", f"<article><p>{SENTENCE} 😀</p>", "x"), (1, "u", f"<article><p>{SENTENCE} 😀</p>", "x"), (None, None, None, None), (2, "v", "", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string").withColumn("n_chars", F.lit(1)).withColumn("id", F.lit(1))
    got = sorted((str(r.page_id), r.url, r.text, r.n_chars) for r in extract(df).where("page_id IS NOT NULL").collect())
    assert got == [("1", "u", f"{SENTENCE} 😀", len(SENTENCE) + 2)] * 2 + [("2", "v", "", 0)]
    assert extract(df).count() == 4 and extract(df.limit(0)).count() == 0


def test_query_against_the_pages_own_layout(spark, sf_dir):
    """The generated pages all have one article; its blocks end at p and h1 tags."""
    got = {r.page_id: r for r in QUERIES["op2_main_text"](spark, sf_dir).collect()}
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    assert len(got) == len(pages)
    for page in pages:
        article = re.search(r"<article>(.*?)</article>", page.html, re.S).group(1)
        parts = [" ".join(html.unescape(re.sub(r"<br>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", re.sub(r"</?b>", "", article))]
        assert got[page.page_id].text == "\n".join(x for x in parts if x), page.page_id
        assert got[page.page_id].n_chars == len(got[page.page_id].text) and got[page.page_id].url == page.url
