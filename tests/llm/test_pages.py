"""Main text of pages: exact marginals, the given pages against the documents they were made from, and odd markup."""

import itertools
import re
import time
from collections import Counter

import numpy as np
import pytest

from stitchwork.llm import main_text, page_tree, queries


@pytest.fixture(scope="module")
def model():
    return main_text.usual_model()


def _text(model, html):
    return main_text.texts_of_pages(model, [html])[0]


def test_marginals_equal_a_sum_over_all_states():
    """Messages against the sum over all assignments of small trees."""
    r = np.random.default_rng(2)
    html = "<div class=ad>a b</div><article><h1>x</h1><p>Some text here. <a href=x>y</a><ul><li>one<li>two</ul></article>tail"
    trees = [page_tree.parse(html), page_tree.parse("<p>only"), page_tree.parse("")]
    woods = main_text.forest(trees)
    model = main_text.Model(r.normal(size=main_text.FEATURES), r.normal(size=(len(page_tree.KIND_NAMES), 2, 2)))
    got, joint = main_text.marginals(model, woods)
    score, n = woods.features @ model.weights, len(woods.parent)
    total, node, edge = 0.0, np.zeros(n), np.zeros((4, n))
    for state in itertools.product((0, 1), repeat=n):
        weight = sum(s * x for s, x in zip(state, score))
        weight += sum(model.pairs[woods.kind[v], state[p], state[v]] for v, p in enumerate(woods.parent) if v != p)
        weight = np.exp(weight)
        total += weight
        for v, p in enumerate(woods.parent):
            node[v] += weight * state[v]
            if v != p:
                edge[2 * state[p] + state[v], v] += weight
    assert np.allclose(got, node / total) and np.allclose(joint, edge / total)


def test_unseen_labelled_pages(model):
    pages = page_tree.labelled_pages(150, seed=77)
    hit = found = wanted = 0
    for (_, want), got in zip(pages, main_text.texts_of_pages(model, [h for h, _ in pages])):
        a, b = Counter(want.split("\n\n")), Counter(got.split("\n\n"))
        hit, found, wanted = hit + sum((a & b).values()), found + sum(b.values()), wanted + sum(a.values())
    assert hit / wanted > 0.97 and hit / found > 0.94


def test_given_pages_hold_their_documents(spark, sf_dir, corpus):
    """The article of a page is a document, whose id its address names; it must come out whole, and nothing else but its title."""
    rows = queries.op13_main_text(spark, sf_dir).collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/pages.parquet").count()
    seen = 0
    for r in rows:
        assert r.n_chars == len(r.text)
        doc = int(re.search(r"/(\d+)", r.url.split("//")[1])[1])
        if doc in corpus:
            title, _, body = r.text.partition("\n\n")
            assert " ".join(body.split()) == " ".join(corpus[doc].split()), r.page_id
            assert len(title) <= 60 and corpus[doc].replace("\n", " ").startswith(title[:5])
            seen += 1
    assert seen > 0


LAYOUTS = [
    "<header><a href=/>Site</a><p>We write about many things.</p></header><nav><a href=a>Home</a> <a href=b>News</a></nav><main><h1>Title of it</h1>"
    "<p>{a}</p><aside class='related'><h3>See also</h3><ul><li><a href=c>Other story</a></ul></aside><p>{b}</p></main>"
    "<section id=comments><h2>2 comments</h2><div class=comment><p>I liked this. Thank you for it, it was good.</p></div></section>"
    "<footer><p>&copy; 2024 All rights reserved by us. Terms and privacy.</p></footer>",
    "<div id=page><div class='site-header'>My site</div><div class=menu><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div>"
    "<div class='cookie-consent'><p>We use cookies to make it better. Accept them all.</p><button>Accept</button></div>"
    "<div class='entry-content'><h1>Title of it</h1><div class='ad-slot'>Buy this now! It is cheap and good. Hurry up.</div><p>{a}</p><p>{b}</p></div>"
    "<div class='sidebar'><h3>Popular</h3><p>Some other text that is here to read for you.</p></div><div id=footer>Copyright 2024 us</div></div>",
    "<BODY><FORM action=/s><LABEL>Search the site</LABEL><INPUT name=q></FORM><ARTICLE><H1>Title of it</H1><P>{a}<P>{b}</ARTICLE>"
    "<SECTION class='reader-comments'><OL><LI>First of all, this is wrong. I say so.<LI>No, it is not.</OL></SECTION>",
]


@pytest.mark.parametrize("html", LAYOUTS)
def test_layouts_that_no_labelled_page_has(model, html):
    a = "The town lies by a river &amp; a wood, and its people <i>fish</i>\n there. They have done so for a long time, as old papers tell."
    b = "In spring the water rises.<br>Then the lower streets are closed to all, and boats are the only way to go from house to house."
    want = ["Title of it", "The town lies by a river & a wood, and its people fish there. They have done so for a long time, as old papers tell.",
            "In spring the water rises. Then the lower streets are closed to all, and boats are the only way to go from house to house."]
    assert _text(model, html.format(a=a, b=b)).split("\n\n") == want


def test_blocks_of_odd_markup():
    blocks = lambda html: [b for _, b in page_tree.parse(html).blocks]
    assert blocks("") == blocks("<!-- x") == blocks("<script>var a = '</p>'") == blocks(" \n&nbsp;") == blocks("<a href='") == []
    assert blocks("just text") == ["just text"]
    assert blocks("a < b & c &lt; d &#65;&eacute;&nope; 1<2") == ["a < b & c < d Aé&nope; 1<2"]
    assert blocks("<p>a<p>b<div>c</p>d</div>e") == ["a", "b", "c", "d", "e"]
    assert blocks("<ul><li>a<ul><li>b</ul><li>c</ul><dl><dt>x<dd>y</dl>") == ["a", "b", "c", "x", "y"]
    assert blocks("<table><tr><td>a<td>b<tr><td>c</table>") == ["a", "b", "c"]
    assert blocks('<p title="a > b">x</p><p class=it\'s>y</p>') == ["x", "y"]
    assert blocks("<p>a<br>b<img src=x>c  d<wbr>e</p>") == ["a b c de"]
    assert blocks("<STYLE>p{}</STYLE><Title>t</tItle><p>a<button>no</button>b<svg><text>no</text></svg></p>") == ["ab"]
    assert blocks("<p>a<button>b") == ["ab"]
    assert blocks("<!DOCTYPE html><![CDATA[x]]><?php y ?><p>a</p></nothing></p>") == ["a"]
    assert blocks("<p>a</p><p>b <") == ["a", "b <"] and blocks("<p>a</p>b <i") == ["a", "b"]


@pytest.mark.parametrize("piece", ["<div>", "<", "<a ", "<a =\"", "<!--", "</p>", "<p>x", "<button>", "<script>", "&", "<b>a</b> ", "<li>", "a" * 50, "<ul><li>x"])
def test_long_pages_take_time_in_proportion(model, piece):
    start = time.perf_counter()
    _text(model, piece * 20_000 + "<p>end of the page</p>")
    assert time.perf_counter() - start < 10


def test_deep_pages_keep_their_text():
    depth = 5 * page_tree.MOST_DEPTH
    tree = page_tree.parse("".join(f"<div>{k} " for k in range(depth)) + "</div>" * depth + "<p>after</p>")
    assert [b for _, b in tree.blocks] == [str(k) for k in range(depth)] + ["after"]
    assert max(tree.depth) <= page_tree.MOST_DEPTH + 1


def test_table_of_odd_pages(spark):
    schema = "page_id long, url string, html string, text string, n_chars string"
    article = "<nav><a href=x>y</a></nav><article><p>This is what it says. It is short.</p></article>"
    rows = [(1, "u", None, "x", "x"), (2, None, "", "x", "x"), (None, "u", article, "x", "x"), (3, "u", article, "x", "x"),
            (3, "u", article, "x", "x"), (4, "u", "<p>" + "Many words of a long text. " * 40_000, "x", "x"), (5, "u", "\x00 <p>\x00</p>", "x", "x")]
    got = main_text.extract(spark.createDataFrame(rows, schema).repartition(2))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    texts = {(r.page_id, r.url): r.text for r in got.collect()}
    assert got.count() == len(rows)
    assert texts[1, "u"] == texts[2, None] == ""
    assert texts[None, "u"] == texts[3, "u"] == "This is what it says. It is short."
    assert len(texts[4, "u"]) == 40_000 * 27 - 1
    assert main_text.extract(spark.createDataFrame([], schema)).count() == 0


def test_labelled_table_changes_the_model(spark):
    """Pages whose article has an odd name are learned from a table of pages and texts."""
    make = lambda k: (f"<div class='zone'><p>Thing number {k} is sold here. Buy it today.</p></div><div class='content'><p>It says {k} of the text.</p></div>",
                      f"It says {k} of the text.")
    labelled = spark.createDataFrame([make(k) for k in range(30)] + [(None, "x"), ("", None)], "html string, text string")
    learned = main_text.learned(labelled)
    assert learned.weights.shape == main_text.usual_model().weights.shape
    assert not np.array_equal(learned.weights, main_text.usual_model().weights)
    assert _text(learned, make(99)[0]) == make(99)[1]
