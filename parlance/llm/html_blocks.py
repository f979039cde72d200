"""Leaf blocks of an HTML page: text between block-level tags, with the path of open block elements.

The scanner reads any input in one pass: unclosed and unmatched tags, missing quotes, cut-off ends.
Inline elements do not part a block; `br` is white space.  What is never text (comments, scripts,
styles, frames, text fields) is left out here.
"""

from __future__ import annotations

import html
import re
from functools import lru_cache
from typing import NamedTuple


class Block(NamedTuple):
    path: tuple[str, ...]  # t:tag and c:word of class, id, role and itemprop, outermost element first
    own: int  # how many of them belong to the innermost element
    text: str
    linked: float  # share of the characters inside links


#: Elements of a path that are kept, counted from the innermost (a feature of the labeller, not of the text).
DEPTH = 64

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_ATTR = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+))""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Element kinds of the HTML standard.
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search "
    "section select summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style iframe noembed noframes object template textarea xmp".split())
#: An opened element closes these, up to a barrier.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, {"body"}),
}
KEEPS_P = frozenset("button option optgroup title head html body noscript caption".split())


@lru_cache(maxsize=1 << 14)
def _words(attrs: str) -> tuple[str, ...]:
    found = [w.lower() for m in _ATTR.finditer(attrs) for w in _PART.findall(m[1] or m[2] or m[3] or "")]
    return tuple(f"c:{w}" for w in found[:8])


def attribute_words(attrs: str) -> tuple[str, ...]:
    return _words.__wrapped__(attrs) if len(attrs) > 400 else _words(attrs)


def leaf_blocks(page: str) -> list[Block]:
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...], int]] = []
    n_open: dict[str, int] = {}
    parts: list[str] = []
    in_link, link_chars, at, end = False, 0, 0, len(page)

    def add(text: str) -> None:
        nonlocal link_chars
        if text:
            text = html.unescape(text) if "&" in text else text
            parts.append(text)
            if in_link:
                link_chars += len(text)

    def flush() -> None:
        nonlocal link_chars
        if parts:
            raw = "".join(parts)
            text = " ".join(raw.split())
            if text:
                path, own = (stack[-1][1], stack[-1][2]) if stack else ((), 0)
                out.append(Block(path, own, text, min(1.0, link_chars / len(raw))))
            parts.clear()
        link_chars = 0

    def pop(tag: str) -> None:
        while stack:
            last = stack.pop()[0]
            n_open[last] -= 1
            if last == tag:
                return

    def close_before(tag: str) -> None:
        closers, barrier = CLOSES[tag]
        if any(n_open.get(c) for c in closers):
            for name, _, _ in reversed(stack):
                if name in barrier:
                    return
                if name in closers:
                    pop(name)
                    return

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at:m.start()])
        at = m.end()
        closing, tag, attrs = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if tag is None:
            continue
        tag = tag.lower()
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = not closing
        elif tag in RAW:
            if not closing:
                stop = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                at = stop.start() if stop else end
        elif tag in BLOCK:
            flush()
            if closing:
                if n_open.get(tag):
                    pop(tag)
                continue
            if n_open.get("p") and tag not in KEEPS_P:
                pop("p")
            if tag in CLOSES:
                close_before(tag)
            if tag != "hr":
                own = (f"t:{tag}", *(attribute_words(attrs) if attrs else ()))
                stack.append((tag, ((stack[-1][1] if stack else ()) + own)[-DEPTH:], len(own)))
                n_open[tag] = n_open.get(tag, 0) + 1
    flush()
    return out
