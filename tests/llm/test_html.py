import itertools
import math

import numpy as np
import pytest

from factsieve.llm import html


@pytest.fixture(scope="module")
def model():
    return html.train(html.labelled_pages())


def enumerate_labels(page, node, edge):
    """Marginals by summing over all labellings."""
    n = len(page.parent)
    total, one = 0.0, np.zeros(n)
    for y in itertools.product((0, 1), repeat=n):
        s = sum(y[i] * sum(node[k] for k in page.active[i]) for i in range(n)) + sum(edge[page.kind[i]][y[page.parent[i]]][y[i]] for i in range(1, n))
        total += math.exp(s)
        one += np.array(y) * math.exp(s)
    return one / total, math.log(total)


def test_messages_give_exact_marginals():
    rng = np.random.default_rng(3)
    page = html.Page("<div class=ad>x y<p>one. two</div><article><h1>t</h1><p>long text here.<ul><li>a<li>b</ul></article><footer>z</footer>")
    assert len(page.parent) == 17
    node, edge = rng.normal(size=len(html._FEATURES)), rng.normal(size=(html.EDGES, 2, 2))
    belief, joint, log_z = html.marginals(page, node, edge)
    want, z = enumerate_labels(page, node, edge)
    assert np.allclose(belief, want) and math.isclose(log_z, z)
    assert np.allclose(joint[1:].sum((1, 2)), 1) and np.allclose(joint[1:, :, 1].sum(1), belief[1:])


def runs(markup):
    return [t for t in html.Page(markup).text if t is not None]


@pytest.mark.parametrize("markup, want", [
    ("<p>a<p>b<div>c</div>d", ["a", "b", "c", "d"]),
    ("<p>a &amp; b&nbsp;&eacute;&#8364;&#x41; <b>bold</b>er\n\t x", ["a & b é€A bolder x"]),
    ("<script>if (a<b) '</p>'</script>x<style>p{}</style><!-- <p>no --> y <![CDATA[z]]>", ["x y"]),
    ("a<br>b<hr>c<wbr>d", ["a b", "cd"]),
    ("<head><title>t</title><p>body", ["body"]),
    ("1 < 2 and <3 > 0 </nope> <b", ["1 < 2 and <3 > 0 <b"]),
    ("<ul><li>a<ul><li>b</ul><li>c</ul><table><tr><td>1<td>2<tr><td>3</table>", ["a", "b", "c", "1", "2", "3"]),
    ('<p title="a > b">x</p><p title="no end>y</p><p>z', ["x", "y", "z"]),
    ("<template><p>no</p></template><svg><text>no</text></svg>yes", ["yes"]),
    ("", []), ("<", ["<"]), ("<script>never ends", []), ("<!-- never ends", []),
])
def test_reading_markup(markup, want):
    assert runs(markup) == want


def test_unseen_layouts(model):
    pages = html.labelled_pages(200, seed=101)
    right = total = 0
    for p in pages:
        page = html.Page(p)
        belief = html.marginals(page, *model)[0]
        for t, b, y in zip(page.text, belief, page.label, strict=True):
            if t is not None:
                right, total = right + ((b >= 0.5) == y), total + 1
    assert right > 0.98 * total
    story = "<p>The first paragraph says what happened, and where. It is long enough.</p><p>Short one.</p><ul><li>point</li></ul>"
    page = f"""<body><header><a href=/>Site</a></header><nav><a href=a>Home</a> <a href=b>News</a></nav><div id="cookie-consent">We use cookies. Please accept them all.</div>
        <form><label>Mail</label><input><button>Send</button></form><article><h1>Title</h1>{story}<div class="advert">Buy now!</div></article>
        <aside><h3>Related</h3><p>Another story that you may like to read.</p></aside><section class="comments"><p>I liked this text very much. Thanks.</p></section><footer>(c) 2020</footer>"""
    assert html.main_text(page, model) == "Title\nThe first paragraph says what happened, and where. It is long enough.\nShort one.\npoint"
    assert html.main_text(page.replace("article>", "main>"), model) == html.main_text(page, model)


def test_awkward_pages(spark, model):
    deep = "<div>" * 3000 + "<p>deep text. And more of it here.</p>"
    rows = [(1, "u", None, 1), (2, None, "", 2), (None, "u", "<article><p>Hello there, this is the text.</p></article>", 3), (4, "u", deep, None), (5, "u", "<p>x" * 20000, None), (6, "u", "<" * 5000 + '"' * 5000, None)]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int"), model).collect()}
    assert got[1].text == got[2].text == "" and got[None].text == "Hello there, this is the text." and got[None].n_chars == 30
    assert len(got) == 6 and got[5].n_chars in (0, 39999)
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0
