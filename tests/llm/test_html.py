import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import html_text

PAGES = "page_id long, url string, html string"
FIRST = "A long first paragraph of the article tells " + "what happened on the day and why it matters " * 3
SECOND = "The second paragraph goes on with the story " + "and names the people who were there at noon " * 4


@pytest.fixture(scope="module")
def tree():
    return html_text.train()


def test_article_alone_stays(tree):
    page = f"""<html><head><title>Title</title><style>p {{ color: red }}</style></head><body>
    <header><a href="/">Home</a></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
    <article><h1>The  head&shy;line</h1><p>{FIRST} &amp; <b>more</b>&nbsp;&#8364;</p><!-- <p>gone</p> --><p>Short.</p>
    <p>{SECOND}</p><script>var a = "<p>no</p>";</script></article>
    <div class="ad-banner"><p>Buy this now, it is cheap and good for you and all your friends today</p></div>
    <div id="comments"><p>I have read it and do not agree with a single word of what was said here.</p></div>
    <form><p>Leave your address here</p><textarea>x</textarea></form>
    <footer><p>All rights kept</p></footer></body></html>"""
    want = ["The head­line", " ".join(FIRST.split()) + " & more €", "Short.", " ".join(SECOND.split())]
    assert html_text.main_text(page, tree) == "\n".join(want)


#: Pages of plain elements, written and marked by hand: a plus before each block of the article.
PLAIN = [
    """-<div>Harbour Weekly</div>
-<div>Today is Friday and the tide is low</div>
-<div><a href="/">Home</a> <a href="/f">Fishing</a> <a href="/w">Weather</a></div>
+<h1>Old pier opens again</h1>
+<div>After four years of work the old pier on the north side of the harbour opened again on Saturday morning, and more than two hundred people came.</div>
+<div>The pier had been closed since a storm broke nine of its posts; the town first wanted to pull it down, but a group of neighbours asked for time.</div>
+<div>They got it.</div>
+<div>Over two winters they found the money for new posts, and a yard in the next bay gave the timber for the deck without asking a price for it.</div>
+<div>Boats may land there from next week on, and the first ferry to the island is to leave at half past eight in the morning every day.</div>
-<div>Please log in to see more of this site</div>
-<div>Sign up now</div>
-<div>All rights reserved by the owner of the site</div>""",
    """-<p>You are not signed in</p>
-<p><a href="/a">Recipes</a> | <a href="/b">Shops</a></p>
+<h1>Bread without kneading</h1>
+<p>This bread needs almost no work, only time: mix the dough in the evening, let it stand in a cool place over night and bake it before lunch.</p>
+<p>You need the following for one loaf of about a pound, and a heavy pot with a lid that may go into a very hot oven for an hour.</p>
+<ul><li>three cups of flour</li>
+<li>a little yeast</li>
+<li>salt</li></ul>
+<p>Stir everything with a cup and a half of water until no dry flour is left, cover the bowl, and do not touch it again until the next morning.</p>
+<p>Heat the pot in the oven, turn the dough into it, put on the lid and bake it for thirty minutes, then for fifteen more without the lid.</p>
-<p>Tell a friend about this page</p>
-<p>Print version</p>
-<p>Our shop is closed on Sundays</p>""",
]


@pytest.mark.parametrize("marked", PLAIN)
def test_neighbours_decide_where_nothing_is_announced(tree, marked):
    lines = marked.split("\n")
    page = "<html><body>" + "\n".join(line[1:] for line in lines) + "</body></html>"
    want = [b[0] for line in lines if line[0] == "+" for b in html_text.blocks(line[1:])]
    assert html_text.main_text(page, tree).split("\n") == want


def test_tree_uses_words_and_neighbours(tree):
    def used(node):
        return {html_text.FEATURES[node[0]], *used(node[2]), *used(node[3])} if isinstance(node, list) else set()

    assert used(tree) >= {"words", "link_density", "words_before", "words_after"}


def test_odd_pages(spark, tree):
    long = "<article>" + "<p>" + "word " * 40 + "</p>" + ("<p>" + "more words of text here " * 8 + "</p>") * 5000 + "</article>"
    pages = [None, "", "<", "<!-- open", "<script>never closed", "</div></p>", "<p", "&#0;&bogus;", long, long]
    rows = [(k, f"u{k}", p) for k, p in enumerate(pages)] + [(None, None, long)]
    df = spark.createDataFrame(rows, PAGES).withColumn("text", F.lit("clash"))
    got = {}
    for r in html_text.extracted(df).collect():
        assert r.n_chars == len(r.text)
        got.setdefault(r.page_id, []).append(r.text)
    assert {k: len(v) for k, v in got.items()} == {**dict.fromkeys(range(10), 1), None: 1}
    assert all(got[k] == [""] for k in (0, 1, 3, 4, 5))
    assert got[8] == got[9] == got[None] and got[8][0].count("\n") == 5000
    assert html_text.extracted(spark.createDataFrame([], PAGES)).count() == 0


def test_unclosed_tags_take_time_in_proportion():
    begin = time.perf_counter()
    for part in ("<a ", "<script ", "<!--", "<a '", "x <b>y</b> "):
        html_text.blocks(part * (1_000_000 // len(part)))
    assert time.perf_counter() - begin < 10
    assert [b[0] for b in html_text.blocks("<p>a</p>b <!-- c <p")] == ["a", "b"]
    assert [b[0] for b in html_text.blocks("<p>a</p><script>b</i> c")] == ["a"]
    assert [b[0] for b in html_text.blocks("<p>a</p><script>b</script> c <i")] == ["a", "c <i"]


def test_whole_table(spark, sf, tree):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = sorted((r.page_id, r.url, html_text.main_text(r.html or "", tree)) for r in pages.collect())
    got = html_text.extracted(pages.repartition(5)).collect()
    assert sorted((r.page_id, r.url, r.text) for r in got) == want
    assert all(r.n_chars == len(r.text) for r in got)
    # No markup is left, and no block carries white space of its own.
    assert not any(tag in r.text for r in got for tag in ("</p>", "<div", "<script", "</a>"))
    assert all(line == " ".join(line.split()) and line for r in got if r.text for line in r.text.split("\n"))
