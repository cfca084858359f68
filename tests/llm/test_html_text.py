from __future__ import annotations

import numpy as np
import pytest

from tallyline.llm import html_text as H


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.01/pages.parquet")


@pytest.fixture(scope="module")
def model(pages):
    return H.fit(pages)


def texts(page):
    return [b.text for b in H.blocks(page)]


def test_blocks():
    assert texts("<p>a  b<br>c <b>d</b><p>e &amp; f&nbsp;g &am") == ["a b c d", "e & f g &am"]
    assert texts("<!-- <p>no</p> --><script>if (a<b) x='</p>'</script><style>p{}</style>x<!-- open") == ["x"]
    assert texts('<div title="a > b">1 < 2</div><p class=x>3</p><SCRIPT>t') == ["1 < 2", "3"]
    assert texts("") == [] and texts("< >") == ["< >"]
    assert [b.path for b in H.blocks('<div id="main" class="a-b"><ul><li>x<li>y</ul>z</div>')] == [("div.main.a.b", "ul", "li"), ("div.main.a.b", "ul", "li"), ("div.main.a.b",)]


def test_article_of_every_page(pages, model):
    want = {r["page_id"]: "\n\n".join(b.text for b in H.blocks(r["html"]) if H.teacher(b)) for r in pages.collect()}
    rows = H.main_text(pages, model).collect()
    assert {r["page_id"]: r["text"] for r in rows} == want
    assert all(r["n_chars"] == len(r["text"]) for r in rows)


def test_other_layouts(model):
    page = (
        '<html><head><title>t</title></head><body><header><h1>Site</h1></header><div class="sidebar"><p>side words here</p></div><main><h2>Head line</h2>'
        "<p>One para of text. With more.</p><div class=ad>Buy now</div><p>Second para &amp; more.</p><section class=comments><p>I think so.</p></section></main>"
        "<form><label>Name</label></form><div class=cookie-banner>We use cookies.</div><footer>c</footer></body></html>"
    )
    found = H.blocks(page)
    firsts = np.array([0, len(found)])
    good = model.pages(H.Features()(found, firsts), firsts) >= 0.5
    assert [b.text for b, g in zip(found, good, strict=True) if g] == ["Head line", "One para of text. With more.", "Second para & more."]


def test_odd_pages(spark, model):
    long = "<article>" + "".join(f"<p>Paragraph {i} of a long page.</p>" for i in range(3000)) + "</article>"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "<nav><a>m</a></nav>", None), (3, "u", "<nav><a>m</a></nav>", None), (None, "u", long, "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.main_text(df, model).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in got)[1:] == [(1, 0), (2, 0), (3, 0), (3, 0)]
    assert next(r["text"] for r in got if r["page_id"] is None).count("\n\n") == 2999
    assert H.main_text(df.where("false"), H.fit(df.where("false"))).count() == 0


def test_gradients():
    """Back-propagation through both directions against differences."""
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(7, H.INPUTS)), rng.integers(0, 2, 7).astype(float)
    firsts = np.array([0, 3, 7])
    lstm = lambda: H.Lstm(rng.normal(0, 0.3, (H.INPUTS, 4 * H.HIDDEN)), rng.normal(0, 0.3, (H.HIDDEN, 4 * H.HIDDEN)), rng.normal(0, 0.3, 4 * H.HIDDEN))
    net = H.Labeller(lstm(), lstm(), rng.normal(0, 0.3, 2 * H.HIDDEN + H.INPUTS), np.zeros(1))
    padded, alive, where = H.batch_of(x, firsts, np.array([0, 1]))

    def loss():
        p = net.scores(padded, alive)[0]
        return -np.sum(np.where(alive, np.where(y[where] == 1, np.log(p), np.log(1 - p)), 0))

    p, _ = net.scores(padded, alive, keep=True)
    states = np.where(alive, p - y[where], 0)[:, :, None] * net.out
    grads = net.ahead.backward(padded, states[:, :, : H.HIDDEN]) + net.back.backward(padded[::-1], states[::-1, :, H.HIDDEN : 2 * H.HIDDEN])
    for w, g in zip(net.params()[:6], grads, strict=True):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old = w[at]
        w[at] = old + 1e-5
        up = loss()
        w[at] = old - 1e-5
        down = loss()
        w[at] = old
        assert abs((up - down) / 2e-5 - g[at]) < 1e-4 * max(1, abs(g[at]))
