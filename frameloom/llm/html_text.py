"""Main-text extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page becomes a sequence of text blocks, each with the open tags above it. Two labels, main text or not, are
scored by features of the tags and of the text and by the labels of neighbours; Viterbi gives the best sequence.
Weights are trained by gradient ascent on labelled pages, by default made from a grammar of common page layouts.
"""

from __future__ import annotations

import html as htmllib
import random
import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed values of HTML: elements that stay inside a block, whose text is not markup and not read, that have no content.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
UNREAD = frozenset("script style textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Formulas stay inside a block, a space before each of their elements.
MATH = frozenset("annotation annotation-xml maction math menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
#: Elements that may be empty inside a paragraph: they end a block only if they hold text.
QUIET = frozenset("audio canvas datalist iframe noscript object select svg template video".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
#: A p ends where one of these begins.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())

_OPEN = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_REST = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
_ATTR = re.compile(r"(?<![\w-])(?:class|id|role)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-z]+")
#: References to numbers beyond all code points; they stand for the replacement character.
_BEYOND = re.compile(r"&#(?:0*[1-9][0-9]{7,}|[xX]0*[1-9A-Fa-f][0-9A-Fa-f]{6,});?")
_ZEROS = re.compile(r"&#([xX]?)0+(?=[0-9A-Fa-f])")


@dataclass(frozen=True, eq=False)
class Node:
    """An open element: the one above it, its depth, its tag, and the features that no element above it has."""

    above: Node | None
    depth: int
    tag: str
    fresh: tuple[str, ...]

    def features(self) -> list[str]:
        out = ["depth:" + str(min(self.depth, 6)), "leaf:" + self.tag]
        node = self
        while node:
            out += node.fresh
            node = node.above
        return out


class _Ends:
    """Where tags end, in time linear in the page.

    A tag ends at the first ``>`` outside quotes. Once a tag has none, its quotes and those of all later tags are
    taken for ordinary characters, and once no ``>`` is left, a ``<`` is text.
    """

    def __init__(self, page: str):
        self.page, self.last, self.quotes = page, page.rfind(">"), True

    def __call__(self, at: int) -> int:
        if at > self.last:
            return -1
        if self.quotes:
            m = _REST.match(self.page, at)
            if m:
                return m.end()
            self.quotes = False
        return self.page.find(">", at) + 1


def _decoded(text: str) -> str:
    if "&" not in text:
        return text
    return htmllib.unescape(_BEYOND.sub("\ufffd", _ZEROS.sub(r"&#\1", text)))


def blocks(page: str) -> list[tuple[str, Node | None, int]]:
    """(text, innermost open block element, characters inside links) of each leaf block in page order.

    Comments, scripts, styles, text areas and titles are left out; one that is never closed ends with the page. All
    other text is kept, that of fallbacks (``noscript``, ``object``) and choices too: labels tell them from the
    article. References are decoded once, white space is made one space, empty blocks go. The time is linear in the
    page whatever its markup.
    """
    out: list[tuple[str, Node | None, int]] = []
    stack: list[Node] = []
    open_tags: Counter[str] = Counter()
    shown: Counter[str] = Counter()  # features of the open elements
    piece: list[str] = []
    home: Node | None = None  # the element that the piece began in
    linked, in_link = 0, False
    closers: dict[str, re.Pattern] = {}

    def flush():
        nonlocal linked
        if piece:
            text = " ".join(_decoded("".join(piece)).split())
            if text:
                out.append((text, home, linked))
            piece.clear()
        linked = 0

    def read(text: str):
        nonlocal home, linked
        if not text.isspace():
            here = stack[-1] if stack else None
            if piece and home is not here:
                flush()
            home = here
            linked += len(text) * in_link
            piece.append(text)
        elif piece:
            piece.append(" ")

    def pop():
        node = stack.pop()
        open_tags[node.tag] -= 1
        for f in node.fresh:
            del shown[f]

    tag_end = _Ends(page)
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            read(page[at:lt])
        if lt == n:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _OPEN.match(page, lt) if lt < tag_end.last else None
        at = tag_end(m.end()) if m else -1
        if at < 0:
            read("<")
            at = lt + 1
            continue
        closing, tag, rest = m[1], m[2].lower(), page[m.end() : at - 1]
        if tag in INLINE:
            if tag == "a":
                in_link = not closing
            continue
        if tag in MATH or tag in VOID and tag != "hr":
            if piece and not (closing and tag in MATH):
                piece.append(" ")
            continue
        if tag in UNREAD:
            if not closing:
                end = closers.setdefault(tag, re.compile(rf"</{tag}(?=[\s/>])[^>]*+>", re.I)).search(page, at)
                at = end.end() if end else n
            if piece:
                piece.append(" ")
            continue
        if tag not in QUIET:
            flush()
        elif piece:
            piece.append(" ")
        if closing:
            while open_tags[tag]:
                last = stack[-1].tag
                pop()
                if last == tag:
                    break
            continue
        if tag in ENDS_P and stack and stack[-1].tag == "p":
            pop()
        while stack and stack[-1].tag in CLOSES.get(tag, ()):
            pop()
        if tag not in VOID and not rest.endswith("/"):
            names = [w for g in _ATTR.findall(rest) for w in _NAME.findall("".join(g).lower())] if rest else []
            fresh = tuple(f for f in dict.fromkeys(["in:" + tag, *("name:" + w for w in names)]) if f not in shown)
            shown.update(fresh)
            open_tags[tag] += 1
            stack.append(Node(stack[-1] if stack else None, len(stack) + 1, tag, fresh))
    flush()
    return out


def _path_features(node: Node | None) -> list[str]:
    return node.features() if node else ["depth:0"]


_SAYS = re.compile("cookie|subscribe|newsletter|advert|sponsor|javascript|browser", re.I)


def _text_features(text: str, linked: int) -> list[str]:
    """Texts of 64 words and more share one feature of length; cue words are looked for in the whole text."""
    n = len(text)
    words = text.count(" ") + 1
    out = ["bias", "words:" + str(min(words.bit_length(), 7)), "link:" + str(min(4, linked * 4 // max(n, 1)))]
    if text[-1] in ".!?\"'”»…:;":
        out.append("stop")
    if "©" in text or "(c)" in text:
        out.append("copyright")
    said = len(_SAYS.findall(text))
    if said:
        out.append("says" if words < 40 * said else "says:rarely")
    return out


class Crf:
    """Binary chain: ``weights`` by feature name, ``step`` the scores of (previous, next) labels."""

    def __init__(self):
        self.weights: dict[str, float] = {}
        self.step = np.zeros((2, 2))
        self._tags: dict[tuple, float] = {}

    def _fresh(self, node: Node) -> float:
        key = node.fresh
        s = self._tags.get(key)
        if s is None:
            if len(self._tags) > 50_000:
                self._tags.clear()
            s = self._tags[key] = sum(self.weights.get(f, 0.0) for f in key)
        return s

    def scores(self, page_blocks) -> np.ndarray:
        w = self.weights
        out = np.empty(len(page_blocks))
        sums: dict[int, float] = {}  # of the features of a node and of all above it
        for i, (text, node, linked) in enumerate(page_blocks):
            s = sum(w.get(f, 0.0) for f in _text_features(text, linked))
            if node:
                way = []
                above = node
                while above and id(above) not in sums:
                    way.append(above)
                    above = above.above
                total = sums[id(above)] if above else 0.0
                for step in reversed(way):
                    total = sums[id(step)] = total + self._fresh(step)
                s += total + w.get("depth:" + str(min(node.depth, 6)), 0.0) + w.get("leaf:" + node.tag, 0.0)
            else:
                s += w.get("depth:0", 0.0)
            out[i] = s
        return out

    def decode(self, page_blocks) -> list[bool]:
        """Viterbi over labels (0 other, 1 main); the emission of label 0 is 0. Ties go to label 0."""
        back, zero, one = [], 0.0, 0.0
        (s00, s01), (s10, s11) = self.step.tolist()
        for i, e in enumerate(self.scores(page_blocks).tolist()):
            if i == 0:
                zero, one = 0.0, e
                continue
            a, b, c, d = zero + s00, one + s10, zero + s01, one + s11
            back.append((b > a, d > c))
            zero, one = max(a, b), max(c, d) + e
        labels = [one > zero]
        for from_zero, from_one in reversed(back):
            labels.append(from_one if labels[-1] else from_zero)
        return labels[::-1]

    def fit(self, pages, epochs: int = 15, rate: float = 0.3, decay: float = 1e-4, seed: int = 1) -> Crf:
        """Stochastic gradient ascent of the log-likelihood, gradients by forward and backward sums."""
        data = [([(*_path_features(p), *_text_features(t, k)) for t, p, k in bs], ys) for bs, ys in pages if bs]
        rng = random.Random(seed)
        square: dict[str, float] = {}
        step_square = np.full((2, 2), 1e-6)
        for _ in range(epochs):
            rng.shuffle(data)
            for feats, ys in data:
                e = np.zeros((len(feats), 2))
                e[:, 1] = [sum(self.weights.get(f, 0.0) for f in fs) for fs in feats]
                fwd, bwd = np.zeros_like(e), np.zeros_like(e)
                fwd[0] = e[0]
                for i in range(1, len(e)):
                    fwd[i] = e[i] + np.logaddexp(*(fwd[i - 1][:, None] + self.step))
                for i in range(len(e) - 2, -1, -1):
                    bwd[i] = np.logaddexp(*(self.step + e[i + 1] + bwd[i + 1]).T)
                z = np.logaddexp(*fwd[-1])
                p = np.exp(fwd + bwd - z)[:, 1]
                g_step = -decay * self.step
                for i in range(1, len(e)):
                    pair = np.exp(fwd[i - 1][:, None] + self.step + e[i] + bwd[i] - z)
                    g_step -= pair
                    g_step[ys[i - 1], ys[i]] += 1
                step_square += g_step**2
                self.step += rate * g_step / np.sqrt(step_square)
                grad: dict[str, float] = {}
                for fs, y, q in zip(feats, ys, p, strict=True):
                    for f in fs:
                        grad[f] = grad.get(f, 0.0) + y - q
                for f, g in grad.items():
                    g -= decay * self.weights.get(f, 0.0)
                    square[f] = square.get(f, 1e-6) + g * g
                    self.weights[f] = self.weights.get(f, 0.0) + rate * g / square[f] ** 0.5
        self._tags.clear()
        return self


def labelled_pages(n: int = 300, seed: int = 3) -> list[tuple[list, list[int]]]:
    """Pages made from a grammar of layouts, each block with its label; main text carries a mark that is then removed."""
    rng = random.Random(seed)
    own = random.Random(f"options {seed}")
    mark = "⁣"

    def word(rng=rng):
        return "".join(rng.choice(("a", "e", "i", "o", "st", "re", "th", "on", "is", "ch", "ü", "é")) for _ in range(rng.randint(1, 5)))

    def say(lo, hi, stop=True):
        return (" ".join(word() for _ in range(rng.randint(lo, hi))) + "." * stop).capitalize()

    def links(k):
        return [f'<a href="/{word()}">{say(1, 3, False)}</a>' for _ in range(k)]

    def wrap(tag, name, inner):
        key = rng.choice(("class", "class", "id"))
        return f'<{tag} {key}="{name}">{inner}</{tag}>' if name else f"<{tag}>{inner}</{tag}>"

    def options():
        if own.random() < 0.5:
            return ""
        last, tag = own.choice(("", "</option>")), own.choice(("datalist", "select"))
        return f"<{tag}>" + "".join(f"<option>{word(own)}{last}" for _ in range(own.randint(1, 5))) + f"</{tag}>"

    def own_say(lo, hi):
        return " ".join(word(own) for _ in range(own.randint(lo, hi))).capitalize() + "."

    def fallback():
        """What a browser shows in place of something: no part of the article."""
        return own.choice((
            f"<noscript>{own.choice(('Please enable JavaScript. ', 'This site needs JavaScript. ', ''))}{own_say(2, 9)}</noscript>",
            f"<video src=x><p>{own_say(3, 8)} Your browser is too old.</p></video>", f"<audio>Your browser can not play this. {own_say(1, 4)}</audio>",
            f"<object data=x>{own_say(2, 6)}</object>", f"<iframe src=x>{own_say(2, 6)}</iframe>", f"<canvas>{own_say(2, 6)}</canvas>",
            f"<svg><title>x</title><text>{word(own)}</text></svg>", f"<template><p>{own_say(3, 20)}</p></template>",
        ))

    def formula():
        return "<math><mi>x</mi><mo>=</mo><mn>2</mn></math>"

    def para(main=True):
        text = (mark if main else "") + say(*rng.choice(((2, 6), (8, 30), (20, 90))), stop=rng.random() < 0.9)
        if rng.random() < 0.15:
            text = f"<b>{text}<br>"
        if rng.random() < 0.1:
            text += f' <a href="/x">{say(1, 3, False)}</a> {say(3, 9)}'
        return text

    pages = []
    for _ in range(n):
        menu = rng.choice(("nav", "nav", "div", "ul"))
        head = [wrap(menu, rng.choice(("", "menu", "navbar", "nav")) if menu != "div" else rng.choice(("menu", "nav", "navigation")), "<ul>" + "".join(f"<li>{a}</li>" for a in links(rng.randint(3, 8))) + "</ul>")]
        if rng.random() < 0.5:
            head.insert(0, wrap(rng.choice(("header", "div")), rng.choice(("header", "masthead", "banner", "site-header")), rng.choice(("<h1>{}</h1>", "<p>{}</p>", "<div>{}</div>")).format(say(1, 6, False))))
        ad = lambda: wrap(rng.choice(("div", "aside", "section")), rng.choice(("ad", "ads", "advert", "sponsored", "promo", "ad-banner")), rng.choice(("{}", "<p>{}</p>")).format(say(4, 40)))
        notice = lambda: wrap("div", rng.choice(("notice", "cookie", "cookie-consent", "alert", "gdpr", "popup")), rng.choice(("{}", "<p>{}</p>")).format(say(6, 30)))
        form = lambda: wrap("form", rng.choice(("", "search", "subscribe", "login")), f"<label>{say(1, 4, False)}</label><input>{options()}<button>{say(1, 2, False)}</button><p>{say(5, 15)}</p>")
        side = lambda: wrap(rng.choice(("aside", "div")), rng.choice(("sidebar", "related", "widget", "side")), f"<h3>{say(1, 4, False)}</h3>" + "".join(rng.choice((f"<p>{say(6, 40)}</p>", f"<ul><li>{links(1)[0]}</li></ul>")) for _ in range(rng.randint(1, 4))))
        comments = lambda: wrap(rng.choice(("section", "div", "ol")), rng.choice(("comments", "comment-list", "replies", "discussion-comments")), "".join(wrap(rng.choice(("div", "article", "li")), rng.choice(("comment", "reply", "comment-body")), f"<p>{say(4, 60)}</p>") for _ in range(rng.randint(1, 5))))
        body = [f"<h1>{mark}{say(2, 12, False)}</h1>"] if rng.random() < 0.85 else []
        for _ in range(rng.choice((1, 2, 3, 5, 9))):
            kind = rng.random()
            body.append(
                f"<p>{para()}</p>" if kind < 0.7 else f"<p>{para()}" if kind < 0.8 else f"<h2>{mark}{say(1, 7, False)}</h2><p>{para()}</p>" if kind < 0.87
                else f"<blockquote>{para()}</blockquote>" if kind < 0.91 else "<ul>" + "".join(f"<li>{mark}{say(2, 20)}</li>" for _ in range(3)) + "</ul>" if kind < 0.96 else f"<pre>{mark}{say(3, 20)}</pre>"
            )
        if rng.random() < 0.2:
            body.insert(rng.randint(0, len(body)), ad())
        if rng.random() < 0.1:
            body.append(form())
        if own.random() < 0.2:
            body.insert(own.randint(0, len(body)), f"<p>{mark}{own_say(4, 9)} {formula()}, {own_say(5, 20)}</p>")
        if own.random() < 0.2:  # main text that only readers without scripts see: a paragraph of its own
            body.insert(own.randint(0, len(body)), f"<noscript><p>{mark}{own_say(8, 60)}</p></noscript>")
        if own.random() < 0.25:
            body.insert(own.randint(0, len(body)), fallback())
        tag, name = rng.choice((("article", ""), ("article", ""), ("article", ""), ("main", ""), ("div", "content"), ("div", "post"), ("section", "article-body"), ("div", "entry")))
        loose = mark + say(10, 40) if rng.random() < 0.1 else ""
        middle = [*([ad()] if rng.random() < 0.6 else []), *([notice()] if rng.random() < 0.3 else []), wrap(tag, name, loose + "".join(body)), *([ad()] if rng.random() < 0.2 else []), *([side()] if rng.random() < 0.4 else []), *([comments()] if rng.random() < 0.3 else []), *([form()] if rng.random() < 0.2 else [])]
        if rng.random() < 0.2:
            middle.insert(0, side())
        if own.random() < 0.3:
            middle.insert(own.choice((0, len(middle))), fallback())
        foot = [wrap(rng.choice(("footer", "footer", "div")), rng.choice(("footer", "site-footer", "copyright")), rng.choice(("{}", "<p>{}</p>")).format(rng.choice(("&copy; ", "")) + say(3, 25)))] if rng.random() < 0.95 else []
        page = f"<!DOCTYPE html><html><head><title>{say(2, 9, False)}</title></head><body>" + "".join([*head, *middle, *foot]) + "</body></html>"
        found = blocks(page)
        pages.append(([(t.replace(mark, ""), p, k) for t, p, k in found], [int(mark in t) for t, _, _ in found]))
    return pages


@lru_cache(maxsize=4)
def trained(pages: int = 300, seed: int = 3) -> Crf:
    return Crf().fit(labelled_pages(pages, seed))


def main_text(crf: Crf, page: str | None) -> str:
    found = blocks(page or "")
    return "\n".join(b[0] for b, y in zip(found, crf.decode(found), strict=True) if y) if found else ""


def extract(pages: DataFrame, *, html_col: str = "html", model: Crf | None = None, training_pages: int = 300) -> DataFrame:
    """``pages`` without the html, with text and n_chars (columns of such names are replaced).

    Null or empty html gives an empty text. Pages are judged one by one: repeated rows give equal rows, an empty
    table stays empty. ``training_pages`` bounds the labelled pages that the model is trained on.
    """
    crf = model or trained(training_pages)
    kept = [c for c in pages.columns if c not in ("text", "n_chars", html_col)]
    rows = pages.select(*kept, html_col)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*kept).schema), "text string", "n_chars long"])

    def apply(batches):
        for b in batches:
            texts = [main_text(crf, page) for page in b.column(html_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in kept), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*kept, "text", "n_chars"]
            )

    return rows.mapInArrow(apply, schema)
