"""Main text of web pages by gradient-boosted trees over DOM nodes.

A page is parsed to its block elements; inline elements belong to the block around them. Each block has features of its
subtree (text, link, sign and tag densities), its tag and attribute tokens, its depth and its siblings. Boosted trees give
it three probabilities: all of its text is article, none is, or some is. Decoding takes the most likely
labelling of the whole tree in which everything below "all" is article and everything below "none" is not, so an ancestor and
a descendant can't contradict each other.

The model is trained on pages made by ``training_page``: articles in many layouts with menus, headers, footers, sidebars,
notices, adverts, forms and reader comments, whose blocks are labelled by construction. The number of pages is a parameter.

Text: character references decoded, white space (and line breaks) within a block made one space, trimmed; blocks in page order,
joined by an empty line. Null or empty html gives an empty text. Broken markup: end tags that are missing are implied by the next block or the end; a script,
style or text field that isn't closed lasts to the end of the page, any other such element has no content; nesting may be of any depth; a quote that isn't
closed is part of its attribute. Pages of any length are read whole. They are extracted one by one: repeated rows give
repeated results, an empty table an empty result, and columns other than page_id, url and html, whatever their names, are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .boosting import Trees
from .common import read

BLOCKS = frozenset("html body div p h1 h2 h3 h4 h5 h6 ul ol li table tbody thead tfoot tr td th section article main aside nav header footer form figure figcaption blockquote pre dl dt dd fieldset details summary address center hgroup caption legend dialog menu search".split())
#: Their content is never text.
SILENT = frozenset("script style head noscript template textarea select button svg iframe object canvas audio video option".split())
#: Of those, the ones whose content runs to their end tag; without one, that of the first kind is the rest of the page, that of the others nothing.
_TO_END = frozenset("script style textarea title".split())
_RAW = _TO_END | frozenset("noscript iframe template svg select button object canvas audio video".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"})}
#: A comment, a tag with its attributes (values in quotes, or up to a blank), a declaration. A quote without its partner is a sign like others.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>=]++(?:\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+'|[^\s>\"'][^\s>]*+|(?=>)))?+|=)*+)>|<[!?][^>]*>", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
SPACE = re.compile(r"\s+")
PART = re.compile(r"[a-z]+")

TAGS = ["p", "div", "h1", "h2", "h3", "ul", "li", "article", "main", "section", "aside", "nav", "header", "footer", "form", "table", "td", "blockquote", "figure", "body"]
ALL, NONE, SOME = 0, 1, 2


class Page:
    """Blocks of a page, parents first, and its pieces of text in page order."""

    def __init__(self, source: str):
        self.parent, self.tag, self.attributes, self.depth = [-1], ["html"], [""], [0]
        self.pieces: list[tuple[int, str]] = []
        self.links, self.inline = [0], [0]
        self._parse(source)

    def _parse(self, source: str) -> None:
        stack, link, run, linked = [0], 0, [], []
        silent, silent_depth, at = "", 0, 0

        def flush() -> None:
            nonlocal run, linked
            if run:
                text = SPACE.sub(" ", entities.unescape("".join(run))).strip()
                if text:
                    self.pieces.append((stack[-1], text))
                    self.links[stack[-1]] += min(len(text), sum(linked))
                run, linked = [], []

        for m in TOKEN.finditer(source):
            if m.start() < at:
                continue
            if not silent and m.start() > at:
                run.append(source[at : m.start()])
                if link:
                    linked.append(m.start() - at)
            at = m.end()
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            closing = m[1] == "/"
            if silent:
                if name == silent:
                    silent_depth += -1 if closing else not m[3].endswith("/")
                    if silent_depth <= 0:
                        silent = ""
                elif silent == "head" and name == "body":
                    silent = ""
                elif name in _RAW and not closing:
                    at = self._after_raw(source, at, name)
                if silent or name == "head":
                    continue
            if name in _RAW or name in SILENT:
                if not closing:
                    if name == "head":
                        flush()
                        silent, silent_depth = name, 1
                    elif name in _RAW and not m[3].endswith("/"):
                        at = self._after_raw(source, at, name)
                        run.append(" ")
                continue
            if name in BLOCKS:
                flush()
                if closing:
                    self._close(stack, {name}, set())
                else:
                    self._close(stack, {"p"}, set(), name)
                    if name in _CLOSES:
                        self._close(stack, *_CLOSES[name], name)
                    if name == "html" or name == "body" and "body" in (self.tag[i] for i in stack):
                        continue
                    self.parent.append(stack[-1])
                    self.tag.append(name)
                    self.attributes.append(m[3])
                    self.depth.append(len(stack))
                    self.links.append(0)
                    self.inline.append(0)
                    stack.append(len(self.tag) - 1)
                link = link if link and link <= len(stack) else 0
            elif name == "a":
                link = 0 if closing else len(stack)
            else:
                if name in ("br", "hr"):
                    run.append(" ")
                if not closing:
                    self.inline[stack[-1]] += 1
        if not silent:
            rest = source[at:]
            cut = rest.rfind("<")  # a tag that the page's end cuts off
            if cut >= 0 and re.match(r"</?[a-zA-Z!][^>]*\Z", rest[cut:]):
                rest = rest[:cut]
            run.append(rest)
        flush()

    @staticmethod
    def _after_raw(source: str, at: int, name: str) -> int:
        m = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(source, at)
        return m.end() if m else len(source) if name in _TO_END else at

    def _close(self, stack: list[int], names: set[str], stops: set[str], opening: str | None = None) -> None:
        for i in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[i]]
            if tag in names:
                del stack[i:]
                return
            if tag in stops or opening and names == {"p"} and tag in ("td", "th", "table", "blockquote", "div", "li", "article", "section", "main"):
                return


def features(page: Page) -> np.ndarray:
    n = len(page.tag)
    parent = np.array(page.parent)
    own = np.zeros((n, 8))  # text, link text, pieces, sentence signs, blocks, inline, paragraphs, long pieces
    own[:, 4] = 1
    own[:, 1], own[:, 5] = page.links, page.inline
    for i, text in page.pieces:
        own[i, 0] += len(text)
        own[i, 2] += 1
        own[i, 3] += text.count(".") + text.count(",") + text.count("!") + text.count("?")
        own[i, 7] += len(text) > 80
    own[:, 6] = [t in ("p", "blockquote", "pre") for t in page.tag]
    total = own.copy()
    for i in range(n - 1, 0, -1):
        total[parent[i]] += total[i]
    up = np.maximum(parent, 0)
    children = np.bincount(parent[1:], minlength=n)
    index, seen, before, last = np.zeros(n), [0] * n, np.zeros(n), [-1] * n
    for i in range(1, n):
        p = page.parent[i]
        index[i] = seen[p]
        seen[p] += 1
        before[i] = total[last[p], 0] if last[p] >= 0 else 0
        last[p] = i
    after = np.zeros(n)
    nxt = [-1] * n
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        after[i] = total[nxt[p], 0] if nxt[p] >= 0 else 0
        nxt[p] = i
    text = total[:, 0]
    page_text = max(1.0, text[0])
    order = np.arange(n) / n
    columns = [
        np.log1p(text), total[:, 1] / np.maximum(1, text), total[:, 3] / np.maximum(1, text), text / total[:, 4], np.log1p(total[:, 4]), total[:, 6], total[:, 7], np.log1p(own[:, 0]),
        text / page_text, text / np.maximum(1, text[up]), np.array(page.depth), children, index, index / np.maximum(1, children[up]), np.log1p(before), np.log1p(after),
        total[:, 5] / np.maximum(1, text), order, text / np.maximum(1, total[:, 2]), children[up], text[up] / page_text, total[up, 1] / np.maximum(1, text[up]),
    ]
    tags = {t: k for k, t in enumerate(TAGS)}
    own_tag, parent_tag = np.zeros((n, len(TAGS))), np.zeros((n, len(TAGS)))
    attribute, inherited = np.zeros((n, TOKENS)), np.zeros((n, TOKENS))
    for i in range(n):
        k = tags.get(page.tag[i])
        if k is not None:
            own_tag[i, k] = 1
        if i:
            parent_tag[i] = own_tag[page.parent[i]]
            inherited[i] = np.maximum(inherited[page.parent[i]], attribute[page.parent[i]])
        if page.attributes[i]:
            for a in ATTRIBUTE.finditer(page.attributes[i]):
                for token in PART.findall((a[2] or a[3] or a[4] or "").lower()):
                    attribute[i, place(token)] = 1
    return np.column_stack([*columns, own_tag, parent_tag, attribute, inherited]).astype(np.float32)


#: Attribute tokens that name a part of a page (fixed values); each has a place of its own, all others share the last.
KNOWN = "ad ads advert advertisement sponsor sponsored promo banner cookie consent notice alert popup newsletter subscribe nav menu navbar breadcrumb header masthead footer copyright sidebar aside widget related recommended share social comment comments reply form search login article content post entry story main body text page".split()
_PLACES = {t: i for i, t in enumerate(KNOWN)}
TOKENS = len(KNOWN) + 1


def place(token: str) -> int:
    return _PLACES.get(token, _PLACES.get(token.rstrip("s"), TOKENS - 1))


def decode(parent: list[int], p: np.ndarray) -> np.ndarray:
    """The most likely consistent labelling: below ALL only ALL, below NONE only NONE."""
    logs = np.log(np.maximum(p, 1e-6))
    best = logs.copy()
    n = len(parent)
    best[:, SOME] = logs[:, SOME]
    for i in range(n - 1, 0, -1):
        best[parent[i], ALL] += best[i, ALL]
        best[parent[i], NONE] += best[i, NONE]
        best[parent[i], SOME] += best[i].max()
    out = np.zeros(n, int)
    for i in range(n):
        above = out[parent[i]] if i else SOME
        out[i] = best[i].argmax() if above == SOME else above
    return out


_S = "ba be bi bo da de di do ka ke ki ko la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so ta te ti to va ve é ö ñ ch st tion ing er".split()


def training_page(seed: int) -> tuple[str, set[int]]:
    """A page, and the numbers of its article's pieces of text. Each piece has its own number as its first word: ``q12q``."""
    r = random.Random(seed)
    count, article = [0], set()

    def sentence(lo: int, hi: int) -> str:
        w = ["".join(r.choice(_S) for _ in range(r.randint(1, 4))) for _ in range(r.randint(lo, hi))]
        return (" ".join(w)).capitalize() + r.choice([".", ".", ".", "!", "?", ""])

    def piece(lo: int, hi: int, n: int = 1, inside: bool = False) -> str:
        count[0] += 1
        if inside:
            article.add(count[0])
        return f"q{count[0]}q " + " ".join(sentence(lo, hi) for _ in range(n))

    def links(n: int, wrap: str = "li") -> str:
        items = "".join(f"<{wrap}><a href='/x'>{piece(1, 3)}</a></{wrap}>" if r.random() < 0.9 else f"<{wrap}>{piece(1, 3)}</{wrap}>" for _ in range(n))
        return f"<ul>{items}</ul>" if wrap == "li" else items

    def inline(text: str) -> str:
        """Some words in inline elements."""
        w = text.split(" ")
        for _ in range(r.choice([0, 0, 0, 1, 2])):
            i = r.randrange(1, len(w)) if len(w) > 1 else 0
            t = r.choice(["em", "b", "i", "strong", "span", "code", "q", "math", "a", "sup"])
            w[i] = f"<{t}>{w[i]}</{t}>"
        return " ".join(w)

    def named(*tokens: str) -> str:
        if r.random() < 0.2:
            return ""
        t = r.choice(tokens)
        return r.choice([f' class="{t}"', f' id="{t}"', f' class="{t} {r.choice(["box", "wrap", "inner", "col"])}"', f' class="site-{t}"'])

    def junk() -> str:
        k = r.choice([*range(14), 1, 3, 8])
        if k == 12:  # without a name
            return r.choice([lambda: links(r.randint(2, 7)), lambda: "<div>" + " | ".join(f"<a href='/x'>{piece(1, 2)}</a>" for _ in range(r.randint(2, 5))) + "</div>", lambda: f"<ul>{links(r.randint(3, 8), 'li')[4:-5]}</ul>"])()
        if k == 13:
            return f"<{(t := r.choice(['div', 'div', 'p', 'center']))}>{r.choice(['&copy; ', '© ', 'Copyright ', ''])}{r.choice(['2019 ', '2024 ', ''])}{piece(1, 6)}{r.choice(['', ' All rights reserved.'])}</{t}>"
        if k == 0:
            return f"<nav{named('nav', 'menu', '')}>{links(r.randint(2, 9))}</nav>"
        if k == 1:
            return f"<div class=\"{r.choice(['ad', 'ads', 'advert', 'advertisement', 'sponsored', 'ad-box'])}\">{piece(3, 14, r.randint(1, 3))}</div>"
        if k == 2:
            return f"<aside{named('sidebar', 'widget', 'related')}><h3>{piece(1, 3)}</h3>{links(r.randint(2, 6))}<p>{piece(4, 15)}</p></aside>"
        if k == 3:
            return f"<div class=\"{r.choice(['cookie-notice', 'cookie', 'consent', 'notice', 'alert', 'banner'])}\">" + r.choice(["<p>{}</p>", "{}"]).format(piece(5, 20, r.randint(1, 2))) + "<button>ok</button></div>"
        if k == 4:
            return f"<form{named('search', 'newsletter', 'subscribe', 'login')}><label>{piece(1, 5)}</label><input type=text><p>{piece(3, 10)}</p></form>"
        if k == 5:
            return f"<div class=\"{r.choice(['sidebar', 'widget', 'related', 'share', 'social', 'promo', 'menu', 'breadcrumb'])}\">" + r.choice([links(r.randint(1, 5)), f"<p>{piece(4, 20)}</p>", links(r.randint(2, 5), "p")]) + "</div>"
        if k == 6:
            return f"<header{named('header', 'masthead')}><h1>{piece(1, 4)}</h1>{links(r.randint(0, 5))}<p>{piece(2, 8)}</p></header>" if r.random() < 0.6 else f"<div class=\"header\"><div>{piece(1, 4)}</div></div>"
        if k == 7:
            return comments()
        if k == 8:
            return f"<footer>&copy; {piece(1, 6)} &middot; {sentence(2, 12)}</footer>"
        if k == 9:
            return f"<div class=\"footer\"><p>{piece(2, 12)}</p>{links(r.randint(0, 4))}</div>"
        if k == 10:
            return f"<section class=\"{r.choice(['related', 'recommended', 'newsletter', 'comments', 'share'])}\"><h2>{piece(1, 3)}</h2>" + "".join(f"<p>{piece(3, 12)}</p>" for _ in range(r.randint(1, 3))) + "</section>"
        return f"<div><ul>{links(r.randint(3, 8))}</ul></div>"

    def comments() -> str:
        items = "".join(f"<{t}{named('comment', 'reply')}><p>{piece(3, 25, r.randint(1, 3))}</p></{t}>" for t in [r.choice(["li", "div"])] for _ in range(r.randint(1, 5)))
        return f"<{'section' if r.random() < 0.4 else 'div'} {r.choice(['class', 'id'])}=\"{r.choice(['comments', 'comment-list', 'reader-comments', 'responses comments'])}\">" + (f"<h3>{piece(1, 3)}</h3>" if r.random() < 0.7 else "") + items + "</div>"

    def block() -> str:
        k = r.random()
        if k < 0.72:
            text = piece(2, 25, r.choice([1, 1, 2, 3, 6]), True)
            return r.choice(["<p>{}</p>", "<p>{}</p>", "<p>{}", "<p><b>{}<br>", "<p>{} <a href='#'>link</a></p>"]).format(inline(text) if r.random() < 0.3 else text)
        if k < 0.8:
            return f"<h{(h := r.randint(2, 3))}>{piece(1, 5, 1, True)}</h{h}>"
        if k < 0.87:
            return "<ul>" + "".join(f"<li>{piece(2, 12, 1, True)}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        if k < 0.92:
            return f"<blockquote><p>{piece(5, 20, 1, True)}</p></blockquote>"
        if k < 0.95:
            return "<table>" + "".join("<tr>" + "".join(f"<td>{piece(1, 3, 1, True)}</td>" for _ in range(2)) + "</tr>" for _ in range(r.randint(1, 4))) + "</table>"
        if k < 0.96:
            return f"<pre>{piece(2, 12, 2, True)}</pre>"
        if k < 0.97:
            return f"<figure><img src=x><figcaption>{piece(3, 12, 1, True)}</figcaption></figure>"
        if k < 0.98:
            return f"<dl><dt>{piece(1, 3, 1, True)}<dd>{piece(4, 15, 1, True)}</dl>"
        return f"<div>{piece(4, 25, 2, True)}</div>"

    def bare() -> str:
        """An article without a wrapper that names it."""
        k = r.randrange(9)
        if k >= 7:  # blocks in blocks, none of them named
            inner = "".join(f"<div>{inline(piece(2, 25, r.choice([1, 1, 2, 4]), True))}</div>" if r.random() < 0.7 else block() for _ in range(r.randint(1, 6)))
            head = f"<{(t := r.choice(['h1', 'h1', 'h2']))}>{piece(1, 7, 1, True)}</{t}>" if r.random() < 0.7 else ""
            return f"<div>{head}{r.choice(['{}', '<div>{}</div>']).format(inner)}</div>"
        if k == 0:
            return f"<p>{inline(piece(1, 20, r.choice([1, 1, 2]), True))}</p>"
        if k == 1:
            return f"<div>{piece(2, 20, r.choice([1, 2]), True)}" + "".join(f"<p>{inline(piece(2, 20, r.choice([1, 2, 4]), True))}</p>" for _ in range(r.randint(1, 4))) + "</div>"
        if k == 2:  # a layout table
            beside = "<br>".join(f"<a href='/x'>{piece(1, 2)}</a>" for _ in range(r.randint(2, 6))) if r.random() < 0.4 else links(r.randint(2, 6), r.choice(["li", "p"]))
            side = f"<td>{beside}</td>" if r.random() < 0.7 else ""
            return f"<table><tr>{side}<td>" + "".join(block() for _ in range(r.randint(2, 8))) + "</td></tr></table>"
        if k == 3:
            return "".join(f"<div>{inline(piece(3, 25, r.choice([1, 2, 4]), True))}</div>" for _ in range(r.randint(1, 8)))
        if k == 4:
            return f"<section{named('x', 'col', 'part')}>" + "".join(block() for _ in range(r.randint(1, 6))) + "</section>"
        if k == 5:
            return "".join(f"<section><h2>{piece(1, 5, 1, True)}</h2>" + "".join(f"<p>{piece(3, 20, 2, True)}</p>" for _ in range(r.randint(1, 3))) + "</section>" for _ in range(r.randint(1, 4)))
        return (f"<h1>{piece(1, 8, 1, True)}</h1>" if r.random() < 0.5 else "") + "".join(block() for _ in range(r.randint(1, 10)))

    kind = "bare" if r.random() < 0.35 else "named"
    inner = []
    if r.random() < 0.8:
        h = r.choice(["h1", "h1", "h2"])
        inner.append(f"<{h}>{piece(2, 9, 1, True)}</{h}>")
    for _ in range(r.choice([0, 1, 1, 2, 4, 8, 14])):
        inner.append(block())
        if r.random() < 0.06:
            inner.append(r.choice([lambda: f"<div class=\"{r.choice(['ad', 'advert', 'promo', 'share', 'related', 'newsletter'])}\">{piece(2, 15)}</div>", lambda: f"<aside>{piece(3, 15)}</aside>", lambda: f"<form><p>{piece(2, 8)}</p></form>", lambda: f"<form><label>{piece(1, 3)}</label><input>{r.choice(['', '<p>' + piece(2, 9) + '</p>'])}</form>"])())
    if r.random() < 0.15:
        inner.append(comments())
    body = "".join(inner) or f"<p>{piece(3, 20, 1, True)}</p>"
    k = r.random()
    if k < 0.5:
        body = f"<article{named('post', 'entry', 'article') if r.random() < 0.4 else ''}>{body}</article>"
    elif k < 0.65:
        body = f"<main>{body}</main>"
    else:
        body = f"<div {r.choice(['class', 'id'])}=\"{r.choice(['content', 'post', 'entry-content', 'story', 'article-body', 'main', 'post-body', 'text', 'main-content'])}\">{body}</div>"
    if kind == "bare":
        count[0], body = 0, ""
        article.clear()
        body = bare()
    if r.random() < 0.3 and kind != "bare":
        body = f"<div class=\"{r.choice(['wrapper', 'container', 'page', 'row'])}\">{junk() if r.random() < 0.5 else ''}{body}{junk() if r.random() < 0.5 else ''}</div>"
    most = r.choice([0, 0, 2, 4]) if kind == "bare" else 4
    before, after = "".join(junk() for _ in range(r.randint(0, most))), "".join(junk() for _ in range(r.randint(0, most)))
    if kind == "bare" and r.random() < 0.4:
        return f"{before}{body}{after}", article
    return f"<!DOCTYPE html><html><head><title>t</title></head><body>{before}<!-- c -->{body}{after}" + r.choice(["</body></html>", ""]), article


def train(pages: int = 1200, seed: int = 1) -> Trees:
    xs, ys = [], []
    for k in range(pages):
        source, article = training_page(seed * 100_000 + k)
        page = Page(source)
        n = len(page.tag)
        inside, all_text = np.zeros(n), np.zeros(n)
        for i, text in page.pieces:
            m = re.match(r"\W*q(\d+)q", text)
            weight = len(text)
            all_text[i] += weight
            inside[i] += weight * bool(m and int(m[1]) in article)
        for i in range(n - 1, 0, -1):
            inside[page.parent[i]] += inside[i]
            all_text[page.parent[i]] += all_text[i]
        y = np.where(inside == 0, NONE, np.where(inside >= all_text, ALL, SOME))
        used = all_text > 0
        xs.append(features(page)[used])
        ys.append(y[used])
    return Trees(3).fit(np.concatenate(xs), np.concatenate(ys))


def in_forms(page: Page) -> np.ndarray:
    """Blocks in a form, unless it has half of the page's text or more: then it is one around the page."""
    text = np.zeros(len(page.tag))
    for i, t in page.pieces:
        text[i] += len(t)
    for i in range(len(page.tag) - 1, 0, -1):
        text[page.parent[i]] += text[i]
    out = np.zeros(len(page.tag), bool)
    for i in range(1, len(page.tag)):
        out[i] = out[page.parent[i]] or page.tag[i] == "form" and 2 * text[i] < text[0]
    return out


def extract_many(sources: list[str | None], model: Trees) -> list[str]:
    pages = [Page(s) if s else None for s in sources]
    full = [p for p in pages if p is not None and p.pieces]
    out = []
    if full:
        x = [features(p) for p in full]
        probabilities = model.probabilities(np.concatenate(x))
        ends = np.cumsum([len(a) for a in x])
    k = 0
    for p in pages:
        if p is None or not p.pieces:
            out.append("")
            continue
        own = probabilities[ends[k] - len(p.tag) : ends[k]]
        k += 1
        forms = in_forms(p)
        own[forms] = (0, 1, 0)
        above = np.zeros(len(p.tag), bool)  # what has a form in it isn't all article
        for i in np.flatnonzero(forms)[::-1]:
            above[p.parent[i]] = True
        for i in range(len(p.tag) - 1, 0, -1):
            above[p.parent[i]] |= above[i]
        own[above & ~forms, ALL] = 0
        label = decode(p.parent, own)
        # text that stands by itself in a block of which only some is article goes with what is likelier of the block's own text
        take = [t for i, t in p.pieces if label[i] == ALL or label[i] == SOME and own[i, ALL] > own[i, NONE]]
        out.append("\n\n".join(take))
    return out


def extract(pages: DataFrame, model: Trees) -> DataFrame:
    """page_id, url and text of every page."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                yield pa.RecordBatch.from_pydict({"page_id": part.column(0), "url": part.column(1), "text": pa.array(extract_many(part.column(2).to_pylist(), shared.value), pa.string())})

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(read(spark, sf_dir, "pages"), train())
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
