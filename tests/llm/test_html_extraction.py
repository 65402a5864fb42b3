import html
import re

import numpy as np
import pytest

from paperlake.llm import html_extraction as H
from paperlake.llm.boosting import fit
from paperlake.llm.html_pages import labelled_pages
from tests.llm.conftest import MIDDLE


@pytest.fixture(scope="module")
def model():
    return H.fitted()


def article_of(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    inner = re.sub(r"<[^>]+>", "", re.sub(r"</?(p|h1|br)[^>]*>", " ", inner))
    return " ".join(html.unescape(inner).split())


def test_every_page_of_the_table(spark):
    from paperlake.llm.queries import QUERIES

    pages = {r.page_id: r for r in spark.read.parquet(f"{MIDDLE}/pages.parquet").collect()}
    rows = QUERIES["op1_html_extraction"](spark, MIDDLE).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == article_of(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_held_out_pages(model):
    exact = 0
    for page in labelled_pages(200, 4711):
        nodes = H.nodes_of(H.parse(page))
        kept = H.decode(nodes, model.scores(H.features(nodes)))
        truth = np.array([x.main for x in nodes])
        truth[0] = True
        exact += H.text_of(nodes[0], kept) == H.text_of(nodes[0], truth)
    assert exact >= 180


def test_comments_sidebars_and_forms_go(model):
    page = """<body><header class="site-header"><a href="/">Home</a></header><div class="cookie-notice"><p>We use cookies.</p></div>
    <div id="content"><h1>A title</h1><p>First   paragraph, with <b>bold</b>ness &amp; more words to read, and more.</p>
    <p>Second paragraph of the article, long enough to look like text.</p><p>Third one, also with a few words in it.</p></div>
    <aside><h3>Related</h3><ul><li><a href="x">One</a></li><li><a href="y">Two</a></li></ul></aside>
    <section id="comments"><h3>Comments</h3><div class="comment"><p>I agree, a very good text.</p></div></section>
    <form class="newsletter"><p>Sign up</p><input type="text"><button>Go</button></form><footer>&copy; me</footer></body>"""
    assert H.main_texts([page], model) == [
        "A title First paragraph, with boldness & more words to read, and more. "
        "Second paragraph of the article, long enough to look like text. Third one, also with a few words in it."
    ]


def test_parsing_repairs_nesting():
    root = H.parse("<div><p>a<p>b<ul><li>c<li>d</ul><script>if (a<b) '<p>'</script><!-- x > y --><p title='>'>e</div>f")
    nodes = H.nodes_of(root)
    assert [x.tag for x in nodes] == ["html", "div", "p", "p", "ul", "p", "li", "li"]
    assert H.text_of(root, np.ones(len(nodes), bool)) == "a b c d e f"


@pytest.mark.parametrize("page", ["", "<", "<p", "a < b", "<p>x</q></p>", "<title>t", "<!-- open", "<a href='", "<script>", "</p>", "\0"])
def test_odd_pages_do_not_fail(page, model):
    assert isinstance(H.main_texts([page], model)[0], str)


def test_decoding_never_contradicts():
    nodes = H.nodes_of(H.parse("<div><p>a</p><div><p>b</p></div></div><div><p>c</p></div>"))
    random = np.random.default_rng(1)
    for _ in range(50):
        kept = H.decode(nodes, random.normal(0, 3, len(nodes)))
        assert kept[0] and all(kept[x.parent.index] for x in nodes[1:] if kept[x.index])


def test_nulls_repeats_clashes_and_empty_table(spark):
    rows = [(1, None, "old", "kept"), (2, "", "old", None), (3, "<p>Ein Text, der bleibt.</p>", "old", "x"), (3, "<p>Ein Text, der bleibt.</p>", "old", "x")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string, extra string")
    got = sorted((r.page_id, r.text, r.n_chars) for r in H.extract_text(df).collect())
    assert got == [(1, "", 0), (2, "", 0), (3, "Ein Text, der bleibt.", 21), (3, "Ein Text, der bleibt.", 21)]
    assert H.extract_text(df).columns == ["page_id", "extra", "text", "n_chars"]
    assert H.extract_text(df.limit(0)).count() == 0


def test_boosting_learns_an_interaction():
    random = np.random.default_rng(3)
    x = random.random((2000, 6))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    assert ((fit(x, y, trees=60).scores(x) > 0) == y).mean() > 0.95


@pytest.mark.parametrize(
    "before",
    [
        "<form><input list=s><datalist id=s><option value=a><option value=b></datalist></form>",
        "<div><option value=a>A<option value=b>B</div>",
        "<option>A<optgroup label=x></optgroup>",
        "<div><button>Go</div>",
        "<button>Go",
        "<button><b>Go",
        "<p><label></p>",
        "<label><input>",
        "<noscript><img src=x>",
        "<iframe src=x>",
        "<textarea rows=2>draft",
        "<noscript><i>a</i><div><noscript><img></noscript></div>",
        "<title>no end",
        "<style>.x { color: red }",
        "<script>var a = 1;",
        "<img alt=\"5\" disc\">",
        "<div class=it's></div>",
        "<![CDATA[ a > b ]]>",
        "<!-->",
        "<!---->",
        "<div><object data=x><param name=y></div>",
        "<object data=x>",
        "<audio src=x><source src=y>",
        "<select><option>A<option>B",
    ],
)
def test_what_follows_an_unclosed_control_is_read(before):
    article = "<article><p>First words.</p><div><button><div>no</div>no</button>Last words.</div></article>"
    root = H.parse(f"<body>{before}{article}</body>")
    assert H.text_of(root, np.ones(len(H.nodes_of(root)), bool)) == "First words. Last words."


def test_closed_controls_are_left_out_whole():
    page = """<div><button><div>a</div><p>b</button>c<object><object>d</object><p>e</p></object>f<label><b>g</b></i>h</label>i
    <svg><style>.x > y { </style><title>j</title><g><text>k</g></svg>l<select><option>m<option>n</select>o</div>"""
    root = H.parse(page)
    assert H.text_of(root, np.ones(len(H.nodes_of(root)), bool)).split() == ["cfghi", "lo"]


def test_many_unclosed_controls_take_linear_time():
    for unit in ("<button>", "<object><p>", "<label><b>", "<svg><style>", "<option>a", "<datalist><p>"):
        H.parse(unit * 20_000)


@pytest.mark.parametrize(
    "page,text",
    [
        ("<p>See <label>the figure</label> and <math><mi>x</mi><mo>=</mo><mn>2</mn></math> now.</p>", "See the figure and x=2 now."),
        ('<p>A <img alt="5" disc"> B <a href="x" title="a > b">C</a> D</p>', "A B C D"),
        ("<p class=it's>One</p><p title='it is > two'>Two</p>", "One Two"),
        ('<p>Run <a "one</a> <a "two</a> three</p><p>Four</p>', "Run three Four"),
        ('<p>Open <a href="x>link</a> and more</p><p>Last</p>', "Open link and more Last"),
        ("<p>a<![CDATA[ x > y ]]>b</p><p>c <![CDATA[ d > e", "ab c e"),
        ("<p>Words</p><p>cut <a href=", "Words cut"),
        ("<p>1 < 2 and 3 > 2</p>", "1 < 2 and 3 > 2"),
        ("<p>k <math><semantics><mi>E</mi><annotation encoding=tex>E</annotation></semantics></math></p>", "k E"),
    ],
)
def test_broken_markup_neither_leaks_nor_swallows(page, text):
    root = H.parse(page)
    assert H.text_of(root, np.ones(len(H.nodes_of(root)), bool)) == text


def test_broken_markup_takes_linear_time():
    for unit in ('<a "', "<a b='", '<a b="', "<noscript>", "<textarea>x", "<![CDATA[", "<!--", "<a =", "<script><script "):
        H.parse(unit * 20_000)
