"""HTML main text by a recurrent block labeller (op11).

A page is a sequence of leaf blocks.  A block's vector is made of embeddings of the hashed words of
its tag path (elements and words of their attributes; the innermost element has a table of its
own), the mean embedding of its hashed words, and a few measures (length, share of link text,
punctuation, place in the page).  A bidirectional LSTM in numpy reads the whole sequence, so that every
block is labelled with the context of the whole page; blocks labelled as main text are joined.

The labeller is fitted on a bounded sample: up to `SAMPLE_PAGES` pages, `SPAN` neighbouring blocks
of each.  Where a page names its article, the elements say what is main text (a distant label); and
pages of many other layouts are made up from the texts of the sample, with menus, headers, footers,
sidebars, notices, adverts, forms and comments around and between the paragraphs, also under
meaningless attribute names, so that the labels do not hang on one way to mark an article.
Extraction reads every whole page: one map pass, no shuffle; the model is a broadcast of fixed size.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parlance.llm.common import read_table, small, text_slices, word_hashes, words
from parlance.llm.html_blocks import Block, leaf_blocks
from parlance.llm.labelled import Adam, sigmoid

SAMPLE_PAGES, SPAN, SPAN_CHARS = 300, 64, 300
PATH_ROWS, WORD_ROWS, PATH_DIM, OWN_DIM, WORD_DIM, HIDDEN, MEASURES = 4096, 4096, 16, 8, 8, 16, 7
EPOCHS, BATCH, RATE = 10, 24, 0.01
#: Blocks (with padding) that are read together.
CELLS = 1 << 13

# Elements and attribute words that name main text, or what does not belong to it.
MAIN = frozenset({"t:article", "t:main"})
OTHER = frozenset({"t:nav", "t:aside", "t:footer", "t:header", "t:form", "t:button", "t:select", "t:noscript", "t:dialog", "t:menu",
                   "c:ad", "c:ads", "c:advert", "c:comment", "c:comments", "c:sidebar", "c:cookie", "c:notice", "c:promo",
                   "c:menu", "c:related", "c:share", "c:newsletter", "c:sponsored", "c:breadcrumb"})


# --- features ---------------------------------------------------------------------------------------

_path_rows: dict[tuple[str, ...], np.ndarray] = {}


def path_rows(path: tuple[str, ...]) -> np.ndarray:
    rows = _path_rows.get(path)
    if rows is None:
        if len(_path_rows) > 20_000:
            _path_rows.clear()
        rows = _path_rows[path] = np.array([zlib.crc32(p.encode("utf-8", "replace")) % PATH_ROWS for p in path], np.int64)
    return rows


class Features:
    """Blocks of several pages, one after the other, as table rows and measures."""

    def __init__(self, pages: list[list[Block]]):
        blocks = [b for p in pages for b in p]
        self.sizes = np.array([len(p) for p in pages], np.int64)
        n = len(blocks)
        lists = [path_rows(b.path) for b in blocks]
        self.path, self.path_at = _flat(lists)
        self.own, self.own_at = _flat([r[len(r) - b.own:] for r, b in zip(lists, blocks)])
        self.word, self.word_at = np.zeros(0, np.int64), np.zeros(0, np.int64)
        marks = np.zeros((n, 2))
        got, at = [], []
        for row, data, off in text_slices(pa.array([b.text for b in blocks], pa.string())):
            starts, ends, first = words(data, off)
            got.append((word_hashes(data, starts, ends) % np.uint64(WORD_ROWS)).astype(np.int64))
            at.append(row + np.repeat(np.arange(len(off) - 1), np.diff(first)))
            for k, ok in enumerate((np.isin(data, list(b".,;:!?")), (data >= 48) & (data <= 57))):
                sums = np.concatenate(([0], np.cumsum(ok)))
                marks[row:row + len(off) - 1, k] = (sums[off[1:]] - sums[off[:-1]]) / np.maximum(np.diff(off), 1)
        if got:
            self.word, self.word_at = np.concatenate(got), np.concatenate(at)
        length = np.array([len(b.text) for b in blocks], float)
        place = np.arange(n) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        total = np.repeat(self.sizes, self.sizes)
        self.measures = np.stack([np.log1p(length) / 5, [b.linked for b in blocks], marks[:, 0] * 10, marks[:, 1] * 10,
                                  place / np.maximum(total, 1), np.log1p(total) / 5, length > 80], axis=1).astype(np.float32) \
            if n else np.zeros((0, MEASURES), np.float32)
        self.n_words = np.maximum(np.bincount(self.word_at, minlength=n), 1)[:, None].astype(np.float32)


def _flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(x) for x in lists], np.int64)
    return (np.concatenate(lists) if lists else np.zeros(0, np.int64)), np.repeat(np.arange(len(lists)), sizes)


def _bag(table: np.ndarray, rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sum of table rows per place; `at` is sorted."""
    out = np.zeros((n, table.shape[1]), np.float32)
    if len(rows):
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        out[at[first]] = np.add.reduceat(table[rows], first, axis=0)
    return out


# --- network ----------------------------------------------------------------------------------------

class Labeller:
    """Embeddings, an LSTM in each direction, and a logistic layer over both states and the block itself."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        d = PATH_DIM + OWN_DIM + WORD_DIM + MEASURES

        def init(*shape, scale=0.1):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.p = {"path": init(PATH_ROWS, PATH_DIM), "own": init(PATH_ROWS, OWN_DIM), "word": init(WORD_ROWS, WORD_DIM, scale=0.02)}
        for k in "fb":
            bias = np.zeros(4 * HIDDEN, np.float32)
            bias[HIDDEN:2 * HIDDEN] = 1  # forget gates start open
            self.p |= {f"x{k}": init(d, 4 * HIDDEN, scale=d ** -0.5), f"h{k}": init(HIDDEN, 4 * HIDDEN, scale=0.25), f"c{k}": bias}
        self.p |= {"out": init(2 * HIDDEN + d, scale=0.1), "bias": np.zeros(1, np.float32)}

    def inputs(self, f: Features) -> np.ndarray:
        n, p = len(f.measures), self.p
        return np.concatenate([_bag(p["path"], f.path, f.path_at, n), _bag(p["own"], f.own, f.own_at, n),
                               _bag(p["word"], f.word, f.word_at, n) / f.n_words, f.measures], axis=1)

    def _pass(self, gates: np.ndarray, mask: np.ndarray, k: str, keep: bool):
        """States of one direction, [step, page, hidden]; gates are [step, page, 4 hidden]."""
        steps, pages, _ = gates.shape
        h = c = np.zeros((pages, HIDDEN), np.float32)
        hs = np.zeros((steps, pages, HIDDEN), np.float32)
        past = [None] * steps
        for t in range(steps) if k == "f" else range(steps - 1, -1, -1):
            a = gates[t] + h @ self.p["h" + k]
            s = 1 / (1 + np.exp(-np.clip(a[:, :3 * HIDDEN], -30, 30)))
            i, f, o = s[:, :HIDDEN], s[:, HIDDEN:2 * HIDDEN], s[:, 2 * HIDDEN:]
            g = np.tanh(a[:, 3 * HIDDEN:])
            c2 = (f * c + i * g) * mask[t]
            tc = np.tanh(c2)
            h2 = o * tc * mask[t]
            if keep:
                past[t] = (h, c, i, f, o, g, tc)
            h, c = h2, c2
            hs[t] = h
        return hs, past

    def forward(self, f: Features, keep: bool = False):
        x = self.inputs(f)
        pages, steps = len(f.sizes), int(f.sizes.max(initial=0))
        row = np.repeat(np.arange(pages), f.sizes)
        step = np.arange(len(row)) - np.repeat(np.cumsum(f.sizes) - f.sizes, f.sizes)
        mask = np.zeros((steps, pages, 1), np.float32)
        mask[step, row] = 1
        states, pasts = [], {}
        for k in "fb":
            gates = np.zeros((steps, pages, 4 * HIDDEN), np.float32)
            gates[step, row] = x @ self.p["x" + k] + self.p["c" + k]
            hs, pasts[k] = self._pass(gates, mask, k, keep)
            states.append(hs[step, row])
        y = np.concatenate([*states, x], axis=1)
        z = y @ self.p["out"] + self.p["bias"]
        return (z, x, y, row, step, mask, pasts) if keep else z

    def gradients(self, f: Features, label: np.ndarray) -> dict[str, np.ndarray]:
        z, x, y, row, step, mask, pasts = self.forward(f, keep=True)
        dz = ((sigmoid(z) - label) / len(label)).astype(np.float32)
        g = {"out": y.T @ dz, "bias": dz.sum(keepdims=True)}
        dy = dz[:, None] * self.p["out"]
        dx = dy[:, 2 * HIDDEN:].copy()
        for n, k in enumerate("fb"):
            steps, pages = mask.shape[:2]
            dh_in = np.zeros((steps, pages, HIDDEN), np.float32)
            dh_in[step, row] = dy[:, n * HIDDEN:(n + 1) * HIDDEN]
            da_all = np.zeros((steps, pages, 4 * HIDDEN), np.float32)
            dh, dc = np.zeros((pages, HIDDEN), np.float32), np.zeros((pages, HIDDEN), np.float32)
            g["h" + k] = np.zeros_like(self.p["h" + k])
            for t in range(steps - 1, -1, -1) if k == "f" else range(steps):
                h0, c0, i, fg, o, gg, tc = pasts[k][t]
                dh = (dh + dh_in[t]) * mask[t]
                dc = (dc + dh * o * (1 - tc * tc)) * mask[t]
                da = np.concatenate([dc * gg * i * (1 - i), dc * c0 * fg * (1 - fg), dh * tc * o * (1 - o), dc * i * (1 - gg * gg)], axis=1)
                da_all[t] = da
                g["h" + k] += h0.T @ da
                dh, dc = da @ self.p["h" + k].T, dc * fg
            da = da_all[step, row]
            g["x" + k], g["c" + k] = x.T @ da, da.sum(axis=0)
            dx += da @ self.p["x" + k].T
        at = 0
        for name, rows, place in (("path", f.path, f.path_at), ("own", f.own, f.own_at), ("word", f.word, f.word_at)):
            d = self.p[name].shape[1]
            part = dx[:, at:at + d] / (f.n_words if name == "word" else 1)
            flat = rows[:, None] * d + np.arange(d)
            g[name] = np.bincount(flat.ravel(), part[place].ravel(), self.p[name].size).reshape(-1, d).astype(np.float32) \
                + (1e-4 if name == "word" else 1e-6) * self.p[name]
            at += d
        return g

    def fit(self, pages: list[tuple[list[Block], list[int]]], seed: int = 7) -> "Labeller":
        rng, opt = np.random.default_rng(seed), Adam(self.p, RATE)
        pages = sorted((p for p in pages if p[0]), key=lambda p: len(p[0]))
        batches = [pages[a:a + BATCH] for a in range(0, len(pages), BATCH)]
        ready = [(Features([b for b, _ in part]), np.array([y for _, ys in part for y in ys], np.float32)) for part in batches]
        for epoch in range(EPOCHS):
            opt.rate = RATE * (1 - epoch / EPOCHS) ** 0.5
            for k in rng.permutation(len(ready)):
                opt.step(self.gradients(*ready[k]))
        return self

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """For each page, which of its blocks are main text; pages of like length are read together."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        while order:
            group = [order.pop()]
            longest = len(pages[group[0]])
            while order and (len(group) + 1) * longest <= CELLS:
                group.append(order.pop())
            z = self.forward(Features([pages[i] for i in group]))
            for i, part in zip(group, np.split(z, np.cumsum([len(pages[i]) for i in group])[:-1])):
                out[i] = part >= 0
        return out


# --- training pages ---------------------------------------------------------------------------------

def distant_label(path: tuple[str, ...]) -> int:
    """1 below an element that names the main text, if nothing below that one is of another kind."""
    main = max((i for i, p in enumerate(path) if p in MAIN), default=-1)
    return int(main >= 0 and not any(p in OTHER for p in path[main + 1:]))


# Layouts of made-up pages: opening tags by zone (fixed values of the training generator).
LAYOUTS = {
    "main": ['article', 'article class="post"', 'main', 'div class="content"', 'div class="post-content"', 'div id="story"', 'div class="story"',
             'section class="entry"', 'div class="article-body"', 'div itemprop="articleBody"', 'div class="text"', 'td class="main"', 'section'],
    "nav": ['nav', 'div class="menu"', 'ul class="navigation"', 'div class="breadcrumb"', 'div id="nav"', 'div class="navbar"', 'menu'],
    "header": ['header', 'div class="site-header"', 'div id="header"', 'div class="masthead"', 'div class="topbar"'],
    "footer": ['footer', 'div class="footer"', 'div id="footer"', 'div class="copyright"', 'div class="legal"', 'div class="bottom"'],
    "side": ['aside', 'div class="sidebar"', 'div class="related"', 'div class="widget"', 'div id="sidebar"', 'aside class="teaser"', 'div class="recommended"'],
    "ad": ['div class="ad"', 'div class="advert"', 'div class="sponsored"', 'div class="promo"', 'div id="ads"', 'div class="banner"', 'aside class="advertisement"'],
    "notice": ['div class="cookie-notice"', 'div class="notice"', 'div class="alert"', 'div role="dialog"', 'div class="consent"', 'noscript',
               'div class="popup"', 'dialog', 'p class="notice"', 'div class="cookie-banner"', 'div class="gdpr"'],
    "form": ['form', 'form class="search"', 'form class="newsletter"', 'div class="subscribe"', 'form id="login"', 'div class="share"', 'div class="signup"'],
    "comments": ['section class="comments"', 'div id="comments"', 'div class="comment-list"', 'ol class="commentlist"', 'div class="comment"',
                 'section id="responses"', 'div class="discussion"', 'div class="reply"'],
}
FILLER = ["Home", "About us", "Contact", "Read more", "Sign in", "All rights reserved.", "We use cookies.", "Leave a reply", "A short line of text, as such."]
SIGN = "\x01"


def made_up_page(texts: list[str], rng: np.random.Generator) -> str:
    """A page of a random layout; blocks of main text begin with SIGN."""
    def pick(items):
        return items[int(rng.integers(len(items)))]

    def text(short=False):
        t = pick(texts).replace("&", "&amp;").replace("<", "&lt;")
        return " ".join(t.split()[:int(rng.integers(1, 6))]) if short else t

    def wrap(opening: str, inner: str) -> str:
        if rng.random() < 0.15 and " " in opening:  # attribute names without a meaning
            opening = opening.split()[0] + f' class="x{int(rng.integers(1 << 20)):x}"'
        return f"<{opening}>{inner}</{opening.split()[0]}>"

    def paragraph(tag="p"):
        t = text(rng.random() < 0.2)
        if rng.random() < 0.15:
            t = f"<b>{t}<br>" if tag == "p" else f"<b>{t}</b>"
        return f"<{tag}>{t}" + ("" if tag == "p" and rng.random() < 0.1 else f"</{tag}>")

    def zone(kind: str) -> str:
        r = rng.random()
        if kind in ("nav", "header", "side") and r < 0.6:
            inner = "<ul>" + "".join(f'<li><a href="/">{text(True)}</a></li>' for _ in range(int(rng.integers(1, 9)))) + "</ul>"
        elif kind == "form":
            inner = f"<label>{text(True)}</label><input><button>{text(True)}</button>" + (paragraph() if r < 0.4 else "")
        elif kind == "comments":
            inner = "".join(wrap(pick(['div class="comment"', "li", "div", "p"]), f"{text(True)} " + pick(["<p>", "<div>", ""]) + text())
                            for _ in range(int(rng.integers(1, 6))))
        elif r < 0.5:
            inner = text(r < 0.2)
        else:
            inner = "".join(paragraph(pick(["p", "p", "h3", "div"])) for _ in range(int(rng.integers(1, 4))))
        return wrap(pick(LAYOUTS[kind]), inner)

    def some(kinds: list[str], chance: float) -> str:
        return "".join(zone(k) for k in kinds if rng.random() < chance)

    body = []
    style = pick(["p", "p", "p", "div"])
    for k in range(int(rng.integers(1, 14))):
        kind = "h1" if k == 0 and rng.random() < 0.7 else pick([style] * 8 + ["h2", "h3", "blockquote", "ul", "pre", "table", "figcaption"])
        if kind == "ul":
            body.append("<ul>" + "".join(f"<li>{SIGN}{text(rng.random() < 0.5)}</li>" for _ in range(int(rng.integers(1, 5)))) + "</ul>")
        elif kind == "table":
            body.append("<table>" + "".join(f"<tr><td>{SIGN}{text(True)}</td><td>{SIGN}{text(True)}</td></tr>" for _ in range(2)) + "</table>")
        else:
            body.append(paragraph(kind).replace(">", ">" + SIGN, 1))
        body.append(some(["ad", "side", "notice", "form", "nav"], 0.03))
    tail = some(["comments", "side", "form"], 0.12)
    opening = pick(LAYOUTS["main"])
    inner = f"<{opening}>{''.join(body)}{tail}</{opening.split()[0]}>"
    if rng.random() < 0.4:
        inner = wrap(pick(["main", 'div class="container"', 'div id="page"', 'div class="wrapper"']), inner)
    before = some(["notice", "header", "nav", "ad", "side", "form"], 0.4)
    after = some(["comments", "ad", "side", "form", "notice", "nav"], 0.3) + some(["footer"], 0.8)
    return f"<html><head><title>{text(True)}</title></head><body>{before}{inner}{after}" + pick(["</body></html>", ""])


def training_pages(sample: list[list[Block]], seed: int = 5) -> list[tuple[list[Block], list[int]]]:
    """Sampled pages that name their main text, and two made-up pages for each sampled one (100 at least)."""
    rng = np.random.default_rng(seed)
    pages = [(p, y) for p in sample if any(y := [distant_label(b.path) for b in p])]
    texts = [b.text for p in sample for b in p] or FILLER
    texts += FILLER * (1 + len(texts) // 40)
    for _ in range(max(100, 2 * len(sample))):
        blocks = leaf_blocks(made_up_page(texts, rng))
        pages.append(([b._replace(text=b.text.lstrip(SIGN)) for b in blocks], [int(b.text.startswith(SIGN)) for b in blocks]))
    return pages


def sample_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", most: int = SAMPLE_PAGES) -> list[list[Block]]:
    """`SPAN` neighbouring blocks, their texts cut to `SPAN_CHARS` characters, of up to `most` pages drawn by a hash of
    their id and text; read and cut in the tasks, so that the driver gets a bounded amount."""
    rows = pages.select(F.col(html_col).cast("string").alias("html"),
                        F.xxhash64(F.col(id_col).cast("string"), F.col(html_col).cast("string"), F.lit(3)).alias("h")).where(F.length("html") > 0)
    n = rows.count()
    if n > 4 * most:  # a rate first, so that no task gets more than a bounded number of rows to order
        rows = rows.where(F.pmod("h", F.lit(1 << 30)) < F.lit(int((1 << 30) * 4 * most / n)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 64):
            out = []
            for page, h in zip(b.column(0), b.column(1).to_pylist()):
                blocks = leaf_blocks(page.as_py())
                a = (h >> 20) % max(1, len(blocks) - SPAN + 1)
                out.append(json.dumps([(x.path, x.own, x.text[:SPAN_CHARS], x.linked) for x in blocks[a:a + SPAN]]))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(out, pa.string())], ["h", "blocks"])

    got = rows.mapInArrow(run, "h long, blocks string").orderBy("h", "blocks").limit(most).collect()
    return [[Block(tuple(path), own, text, linked) for path, own, text, linked in json.loads(r.blocks)] for r in got]


def fit_labeller(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> Labeller:
    return Labeller().fit(training_pages(sample_blocks(pages, id_col, html_col)))


# --- operator ---------------------------------------------------------------------------------------

def extract_text(pages: DataFrame, model: Labeller, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_blocks, n_kept) of every row, from the whole page.

    A null page is empty; a page without blocks, or without main text, has the empty text.  Null ids
    and urls stay null, repeated rows are read one by one, other columns are not read.
    """
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 256):
            blocks = [leaf_blocks(p.as_py() or "") for p in b.column(2)]
            keep = shared.value.label(blocks)
            texts = [" ".join(x.text for x, k in zip(p, ks.tolist()) if k) for p, ks in zip(blocks, keep)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(p) for p in blocks], pa.int64()),
                 pa.array([int(k.sum()) for k in keep], pa.int64())], ["page_id", "url", "text", "n_blocks", "n_kept"])

    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html")) \
        .mapInArrow(run, "page_id long, url string, text string, n_blocks long, n_kept long")


def op11_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return extract_text(pages, fit_labeller(pages)).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
