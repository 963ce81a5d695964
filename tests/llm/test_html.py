"""Main text of pages: the reader against the standard library's, the network against plain loops, held-out accuracy."""

import random
import re
from html import unescape
from html.parser import HTMLParser

import numpy as np
import pytest

from vistrack.llm import html


class Plain(HTMLParser):
    """Texts between block elements, by html.parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.parts, self.silent = [], [], 0

    def flush(self):
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            self.out.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in html.SILENT:
            self.silent += 1
        if tag == "br":
            self.parts.append(" ")
        elif tag not in html.INLINE:
            self.flush()

    def handle_endtag(self, tag):
        if tag in html.SILENT:
            self.silent -= 1
        if tag not in html.INLINE and tag != "br":
            self.flush()

    def handle_data(self, data):
        if not self.silent:
            self.parts.append(data)


def plain_leaves(page):
    p = Plain()
    p.feed(page)
    p.close()
    p.flush()
    return p.out


def article(page):
    """Main text of the tables' pages, which have one article with tags that carry no attributes."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return " ".join(unescape(re.sub(r"</?(?:b|i|em)>", "", re.sub(r"<(?:br|/?p|/?h1)>", " ", inner))).split())


@pytest.fixture(scope="module")
def pages(spark, small):
    return spark.read.parquet(f"{small}/pages.parquet")


@pytest.fixture(scope="module")
def sample(pages):
    return html.sampled(pages)


@pytest.fixture(scope="module")
def net(sample):
    return html.train(sample)


def test_reader_against_the_standard_library(pages, sample):
    rng = random.Random(1)
    words = [w for p in sample for x in p for w in x.text.split(" ")]
    texts = [r.html for r in pages.collect()] + [html.Layout(rng, words).html for _ in range(200)]
    for text in texts:
        assert [x.text for x in html.leaves(text)] == plain_leaves(text)


def test_reader_on_odd_pages():
    read = lambda t: [x.text for x in html.leaves(t)]
    assert read(None) == read("") == read("<p> \n</p>") == read("<script>a<b>c</p>") == []
    assert read("a &lt;b&gt; &#228;&nbsp;&amp c&copy") == ["a <b> ä & c©"]
    assert read("<p>one<b>two</b> three<br>four<p>five<li>six<di") == ["onetwo three four", "five", "six"]
    assert read("1 < 2 <p>x <!-- y <p> --> z<!-- w") == ["1 < 2", "x z"]
    assert read('<p title="a>b">c</p><textarea>d') == ["c", "d"]
    assert read("<script>x</scripty></script >y") == ["y"]
    assert read("<div>" * 30_000 + "deep" + "</div>" * 30_000) == ["deep"]
    assert read("<b><p>" * 30_000 + "x") == ["x"]
    assert [x.path for x in html.leaves('<ul class="a-B c"><li>x<li id=y>z</ul>w')] == [(("ul", ("a", "b", "c")), ("li", ())), (("ul", ("a", "b", "c")), ("li", ("y",))), ()]


def test_network_against_plain_loops(net):
    """One page at a time, one step at a time, both directions by the textbook."""
    rng = random.Random(4)
    found = [html.Layout(rng, html.SPARE).labelled()[0] for _ in range(12)] + [[]]
    vectors, squash = html.Vectors(), lambda z: 1 / (1 + np.exp(-z))
    for page, got in zip(found, net.scores(found, html.Vectors()), strict=True):
        x, states = vectors(page, 0, len(page)).astype(float), {}
        for d, order in (("f", range(len(page))), ("b", reversed(range(len(page))))):
            h, c = np.zeros(html.CELLS), np.zeros(html.CELLS)
            for t in order:
                i, f, o, g = np.split(x[t] @ net.w[f"x{d}"] + net.w[f"c{d}"] + h @ net.w[f"h{d}"], 4)
                c = squash(f) * c + squash(i) * np.tanh(g)
                h = squash(o) * np.tanh(c)
                states[d, t] = h
        want = [squash(np.concatenate([states["f", t], states["b", t]]) @ net.w["o"] + net.w["ob"][0]) for t in range(len(page))]
        assert np.allclose(got, want, atol=1e-4)


def test_gradients_against_differences():
    rng = np.random.default_rng(0)
    net = html.Labeller({k: v.astype(float) for k, v in html.Labeller.fresh(1).items()})
    lengths, width = np.array([5, 3, 2]), html.PATHS + html.WORDS + html.NUMBERS
    x, y = np.where(np.arange(5)[:, None] < lengths[:, None, None], rng.normal(size=(3, 5, width)), 0), rng.integers(0, 2, (3, 5)).astype(float)
    _, g = net.gradients(x, y, lengths)
    for name, w in net.w.items():
        at = tuple(rng.integers(0, s) for s in w.shape)
        old, losses = w[at], []
        for step in (1e-3, -1e-3):
            w[at] = old + step
            losses.append(net.gradients(x, y, lengths)[0])
        w[at] = old
        assert abs((losses[0] - losses[1]) / 2e-3 - g[name][at]) < 2e-4 + 0.02 * abs(g[name][at]), name


def test_held_out_layouts(net, sample):
    """Layouts of another seed: blocks told right."""
    rng = random.Random(77)
    words = [w for p in sample for x in p for w in x.text.split(" ")]
    tests = [html.Layout(rng, words).labelled() for _ in range(200)]
    right = np.concatenate([(s >= 0.5) == np.array(y) for s, (_, y) in zip(net.scores([p for p, _ in tests], html.Vectors()), tests, strict=True)])
    assert right.mean() > 0.985


def test_pages_of_the_tables(spark, small, pages):
    got = {r.page_id: r for r in html.query(spark, small).collect()}
    want = {r.page_id: (r.url, article(r.html)) for r in pages.collect()}
    assert set(got) == set(want)
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert sum((got[i].url, got[i].text) == want[i] for i in want) >= 0.98 * len(want)


def test_odd_rows(spark, net, pages):
    page = pages.first().html
    rows = [(1, "u", None), (2, None, ""), (None, "v", page), (None, "v", page), (3, "w", page[:700]), (4, "x", "<nav><a href='/'>Home</a></nav>"), (5, "y", "\x00 <"), (6, "z", page + "<p>word</p>" * 20_000)]
    docs = spark.createDataFrame([(*r, "t", "b") for r in rows], "page_id long, url string, html string, text string, blocks string")
    got = html.main_text(docs, net)
    assert got.columns == ["page_id", "url", "text"]
    out = {(r.page_id, r.url): r.text for r in got.collect()}
    assert got.count() == 8 and out[1, "u"] == out[2, None] == out[4, "x"] == "" and out[None, "v"] == article(page)
    assert html.main_text(docs.limit(0), net).count() == 0
    assert html.sampled(docs.limit(0)) == [] and html.train([], layouts=20, epochs=1).scores([[]], html.Vectors())[0].size == 0
