"""Main text: the scanner on odd pages, the network's slopes, held-out pages, the query on a whole table."""

import html
import re

import numpy as np
import pytest

from parlance.llm import html_extract as H
from parlance.llm.html_blocks import Block, leaf_blocks
from parlance.llm.labelled import sigmoid

SF = "/root/testdata/sf0.01"


def texts_of(page):
    return [b.text for b in leaf_blocks(page)]


def article_text(page):
    """Plain reading of a page that marks its article and closes its elements' blocks (brute force of the table's pages)."""
    inner = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1|br)>", inner)
    return " ".join(" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in parts if x.strip())


@pytest.fixture(scope="module")
def model(spark):
    return H.fit_labeller(spark.read.parquet(f"{SF}/pages.parquet"))


def test_scanner():
    assert texts_of("") == texts_of("<p> \n </p>") == []
    assert texts_of("a<b>b</b> c<br>d<p>e<p>f &amp; &#233;&lt;p&gt; &am") == ["ab c d", "e", "f & é<p> &am"]
    assert texts_of('x<script>if (a<b) "</p>"</script>y<style>p{}</style><!-- <p>no --><textarea>z</textarea>w') == ["xyw"]
    assert texts_of("<p title='a>b'>in</p><p title=\"open>rest</p><p>more") == ["in", "rest", "more"]
    assert texts_of("<ul><li>1<li>2<ul><li>3</ul><li>4</ul>5") == ["1", "2", "3", "4", "5"]
    assert texts_of("1 < 2 and <3> and </> and <p>ok<script>never closed") == ["1 < 2 and <3> and", "ok"] or \
        texts_of("1 < 2 <p>ok<script>never closed") == ["1 < 2", "ok"]
    assert texts_of("a<!-- never closed <p>b") == ["a"]
    assert texts_of("<p>" + "x " * 500_000 + "</p>") == [("x " * 500_000).strip()]
    deep = leaf_blocks("<div>" * 50_000 + "t" + "</p></div></nav>" * 50_000)
    assert [b.text for b in deep] == ["t"] and len(deep[0].path) == 64


def test_paths_and_links():
    (menu, body, after) = leaf_blocks('<nav class="Top-Menu"><a href=x>go</a></nav><article id=a1><div><p>t <a>u</a></article>v')
    assert menu.path == ("t:nav", "c:top", "c:menu") and menu.linked == 1.0 and menu.own == 3
    assert body.path == ("t:article", "c:a", "c:1", "t:div", "t:p") and body.text == "t u" and 0 < body.linked < 1
    assert after.path == ()
    assert [H.distant_label(b.path) for b in (menu, body, after)] == [0, 1, 0]
    assert H.distant_label(("t:article", "t:aside", "t:p")) == 0 and H.distant_label(("c:ad", "t:main", "t:p")) == 1


def plain_scores(m, page):
    """The network one page and one block at a time."""
    p, xs = m.p, []
    f = H.Features([page])
    for i in range(len(page)):
        bag = [p["path"][f.path[f.path_at == i]].sum(axis=0), p["own"][f.own[f.own_at == i]].sum(axis=0),
               p["word"][f.word[f.word_at == i]].sum(axis=0) / max(1, (f.word_at == i).sum())]
        xs.append(np.concatenate([*bag, f.measures[i]]))
    states = {}
    for k, order in (("f", range(len(xs))), ("b", range(len(xs) - 1, -1, -1))):
        h = c = np.zeros(H.HIDDEN)
        for t in order:
            i, g, o, u = np.split(xs[t] @ p["x" + k] + p["c" + k] + h @ p["h" + k], 4)
            c = sigmoid(g) * c + sigmoid(i) * np.tanh(u)
            h = sigmoid(o) * np.tanh(c)
            states[k, t] = h
    return np.array([np.concatenate([states["f", t], states["b", t], xs[t]]) @ p["out"] + p["bias"][0] for t in range(len(xs))])


def some_pages(n, seed):
    rng = np.random.default_rng(seed)
    return [leaf_blocks(H.made_up_page(["one two three. " * 3, "Quatre 5, six", "x"], rng)) for _ in range(n)]


def test_batches_equal_one_block_at_a_time(monkeypatch):
    m, pages = H.Labeller(3), some_pages(12, 1) + [[]]
    for z, page in zip(np.split(m.forward(H.Features(pages)), np.cumsum([len(p) for p in pages])[:-1]), pages):
        assert len(z) == len(page) and (not page or np.allclose(z, plain_scores(m, page), atol=1e-4))
    want = [x.tolist() for x in m.label(pages)]
    monkeypatch.setattr(H, "CELLS", 40)
    assert [x.tolist() for x in m.label(pages)] == want


def test_gradients_are_the_slopes():
    m, pages = H.Labeller(2), some_pages(3, 4)
    for k in m.p:
        m.p[k] = m.p[k].astype(np.float64)
    f = H.Features(pages)
    y = np.arange(len(f.measures)) % 2
    g = m.gradients(f, y)
    loss = lambda: float(np.mean(np.logaddexp(0, (z := m.forward(f).astype(np.float64))) - y * z))
    rng = np.random.default_rng(0)
    for name in ("path", "own", "xf", "hf", "cb", "hb", "out", "bias"):
        live = np.flatnonzero(np.abs(g[name].ravel()) > 1e-3)
        for at in rng.choice(live, min(4, len(live)), replace=False):
            cell = m.p[name].reshape(-1)
            old, step = cell[at], 1e-3
            cell[at] = old + step
            up = loss()
            cell[at] = old - step
            down = loss()
            cell[at] = old
            assert abs((up - down) / (2 * step) - g[name].ravel()[at]) < 2e-3 + 0.05 * abs(g[name].ravel()[at]), name


def test_made_up_layouts_held_out(model):
    rng, wrong, total = np.random.default_rng(12345), 0, 0
    for _ in range(300):
        blocks = leaf_blocks(H.made_up_page(["Some words of a paragraph, as long as they go.", "Short one", "Another text: it says little. " * 5], rng))
        y = np.array([b.text.startswith(H.SIGN) for b in blocks])
        got = model.label([[b._replace(text=b.text.lstrip(H.SIGN)) for b in blocks]])[0]
        wrong, total = wrong + int((got != y).sum()), total + len(y)
    assert total > 4000 and wrong / total < 0.04


def test_all_kinds_of_boilerplate(spark, model):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><a href="/">Site</a></header>
      <nav><ul><li><a href="/a">Menu</a></li><li><a href="/b">Two</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
      <div class="ad">Buy now</div><article><h1>Head &amp; line</h1><p>First  <i>para</i>graph.<br>Next line.</p><div class="ad">Advert inside</div>
      <p>Second one &eacute;.</p></article><section class="comments"><p>Nice post!</p></section><aside class="sidebar">Side</aside>
      <form><label>Mail</label><button>Send</button></form><footer>&copy; me</footer></body></html>"""
    got = H.extract_text(spark.createDataFrame([(1, "u", page)], "page_id long, url string, html string"), model).first()
    assert got.text == "Head & line First paragraph. Next line. Second one é."


def test_odd_rows(spark, model):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<article><p>a b</p></article>"), (3, "v", "<nav>x</nav>"), (3, "v", "<nav>x</nav>"),
            (4, "w", "<article>" + "<p>word</p>" * 30_000 + "</article>"), (5, "x", "<<<>>>&&&"), (6, "y", "\x00<p\x00>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'t' text", "1 n_chars", "2 path", "3 h")
    got = H.extract_text(df, model).collect()
    assert len(got) == len(rows)
    by = {(r.page_id, r.url): r for r in got}
    assert by[1, "u"].text == by[2, None].text == by[3, "v"].text == "" and by[None, "u"].text == "a b"
    assert by[4, "w"].text == " ".join(["word"] * 30_000) and by[4, "w"].n_blocks == by[4, "w"].n_kept == 30_000
    assert H.extract_text(df.limit(0), model).collect() == []


def test_fitting_without_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert H.sample_blocks(none) == []
    model = H.fit_labeller(none)
    assert model.label([leaf_blocks("<nav><a>m</a></nav><article><p>text of some length</p></article><footer>f</footer>")])[0].tolist() == [False, True, False]


def test_sample_is_bounded(spark):
    sample = H.sample_blocks(spark.read.parquet("/root/testdata/sf0.1/pages.parquet"), most=20)
    assert len(sample) == 20 and all(0 < len(p) <= H.SPAN and all(isinstance(b, Block) and len(b.text) <= H.SPAN_CHARS for b in p) for p in sample)


def test_query_reads_every_article(spark):
    got = {r.page_id: r for r in H.op11_html_text(spark, SF).collect()}
    pages = spark.read.parquet(f"{SF}/pages.parquet").collect()
    assert len(got) == len(pages)
    for p in pages:
        r = got[p.page_id]
        assert r.url == p.url and r.text == article_text(p.html) and r.n_chars == len(r.text)
