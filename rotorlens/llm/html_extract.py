"""Main text of web pages by boosted trees over DOM nodes and hierarchical decoding.

A page becomes a tree of block elements; a stretch of inline text inside a block is a leaf. Each node has
features of its subtree (text, links, tags, density), its attributes' tokens, depth and siblings. What a token of
a class, id or role tells is learnt: the log odds that training nodes which have it hold main text; no token decides
alone. Boosted trees, trained here on synthetic layouts with known main text, give the log odds that a node holds main
text. Decoding picks the best consistent set: what lies under a dropped node is dropped, and a kept node
has a kept way up to the root, so that no ancestor contradicts its descendants.

Defined cases: a null or empty page, and one without text, give ''; unclosed and stray tags are repaired
as browsers roughly do; characters after an unfinished tag are text; rows that repeat are extracted each on
its own; an empty table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .gbt import BoostedTrees

# Elements of HTML by kind.
RAW = "script style noscript template svg math iframe textarea select object canvas audio video title".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img".split())
ENDS_P = frozenset("address article aside blockquote body center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu", "dir")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
SECTIONS = {**dict.fromkeys("nav header footer aside form menu button dialog".split(), -1), "article": 1, "main": 1}
TAGS = "article main section div p h1 h2 h3 ul ol li table td nav header footer aside form blockquote pre figure dl #text".split()

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(" + "|".join(RAW) + r")(?=[\s/>])(?:(?:(?<=<svg)|(?<=<math))[^>]*/>|[^>]*>.*?(?:</\1\s*>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'<]|\"[^\"<]*\"|'[^'<]*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b|display\s*:\s*none", re.I)
SPLIT = re.compile(r"[^a-z]+|(?<=[a-z])(?=[A-Z])")


@lru_cache(maxsize=20_000)
def attribute_tokens(attributes: str) -> tuple[str, ...]:
    """The words of class, id, role and label."""
    tokens = set()
    for m in ATTRIBUTE.finditer(attributes):
        value = next((v for v in m.groups()[1:4] if v), None)
        if value is None:
            if m.group(1) is None:
                tokens.add("hidden")
            continue
        tokens |= {t.lower() for t in SPLIT.split(value) if t}
    return tuple(sorted(tokens))


class Page:
    """Nodes in page order: parent, tag, attribute tokens and, for leaves, text and linked characters."""

    __slots__ = ("parent", "tag", "tokens", "text", "linked")

    def __init__(self, html: str):
        self.parent, self.tag, self.tokens, self.text, self.linked = [-1], ["#page"], [()], [""], [0]
        stack = [(0, "#page")]  # block elements that are open
        opened: Counter[str] = Counter()  # how often each tag stands in the stack, so that stray tags cost nothing
        parts: list[str] = []
        anchors = linked = place = 0

        def flush() -> None:
            nonlocal linked
            if parts:
                text = " ".join("".join(parts).split())
                parts.clear()
                if text:
                    self._add(stack[-1][0], "#text", "", text, min(linked, len(text)))
            linked = 0

        def cut(k: int) -> None:
            for _, gone in stack[k:]:
                opened[gone] -= 1
            del stack[k:]

        for m in TOKEN.finditer(html):
            begin = m.start()
            if begin > place:
                piece = html[place:begin]
                if "&" in piece:
                    piece = unescape(piece)
                parts.append(piece)
                if anchors:
                    linked += len(piece)
            place = m.end()
            closing, tag, attributes = (m.group(2), m.group(3), m.group(4)) if m.group(3) else (m.group(5), m.group(6), m.group(7))
            if not tag:
                if m.group(1):  # a raw element may part two words
                    parts.append(" ")
                continue
            tag = tag.lower()
            if tag in INLINE:
                if tag == "br":
                    parts.append(" ")
                elif tag == "a":
                    anchors = max(0, anchors - 1) if closing else anchors + (not attributes.endswith("/"))
                continue
            flush()
            anchors = 0
            if closing:
                if opened[tag]:
                    cut(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][1] == tag))
                continue
            if tag in ENDS_P and stack[-1][1] == "p":
                cut(len(stack) - 1)
            if tag in CLOSES:
                own, limits = CLOSES[tag]
                if any(opened[x] for x in own.split()):
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][1] in own.split():
                            cut(k)
                            break
                        if stack[k][1] in limits:
                            break
            if tag in VOID:
                continue
            at = self._add(stack[-1][0], tag, attributes, "", 0)
            if not attributes.endswith("/"):
                stack.append((at, tag))
                opened[tag] += 1
        if place < len(html):
            parts.append(unescape(html[place:]))
        flush()

    def _add(self, parent: int, tag: str, attributes: str, text: str, linked: int) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.tokens.append(attribute_tokens(attributes) if attributes else ())
        self.text.append(text)
        self.linked.append(linked)
        return len(self.parent) - 1


TAG_AT = {t: i for i, t in enumerate(TAGS)}
MARKS = re.compile(r"[.!?。]")
RIGHTS = re.compile(r"©|\(c\)|\bcopyright\b", re.I)


def features(page: Page, evidence: dict[str, float]) -> np.ndarray:
    """One row of numbers per node. evidence: what each attribute token tells."""
    n = len(page.parent)
    parent = page.parent
    chars, linked, marks, nodes, leaves = [len(t) for t in page.text], list(page.linked), [len(MARKS.findall(t)) for t in page.text], [1] * n, [1 if t else 0 for t in page.text]
    digits, rights = [sum(map(t.count, "0123456789")) if t else 0 for t in page.text], [1 if t and RIGHTS.search(t) else 0 for t in page.text]
    headings = [1 if t in ("h1", "h2") else 0 for t in page.tag]
    for i in range(n - 1, 0, -1):  # children come after their parents
        p = parent[i]
        for sums in (chars, linked, marks, nodes, leaves, digits, rights, headings):
            sums[p] += sums[i]
    depth, index, siblings = [0] * n, [0] * n, [0] * n
    told = [[evidence.get(t, 0.0) for t in tokens] for tokens in page.tokens]
    low, high = [min(x, default=0.0) for x in told], [max(x, default=0.0) for x in told]
    low_above, high_above, nearest, furniture, matter = list(low), list(high), [0] * n, [0] * n, [0] * n
    for i in range(1, n):
        p = parent[i]
        depth[i] = depth[p] + 1
        index[i] = siblings[p]
        siblings[p] += 1
        low_above[i] = min(low_above[p], low[i])
        high_above[i] = max(high_above[p], high[i])
        kind = SECTIONS.get(page.tag[i], 0)
        nearest[i] = kind or nearest[p]
        furniture[i] = furniture[p] or kind < 0
        matter[i] = matter[p] or kind > 0
    up = np.array(parent)
    up[0] = 0
    number = lambda x: np.array(x, np.float32)
    c, size, leaf, brood, place = map(number, (chars, nodes, leaves, siblings, index))
    link = number(linked) / np.maximum(c, 1)
    low_own, high_own = number(low), number(high)
    after = np.concatenate((c[1:], [0])) * (np.concatenate((up[1:], [-1])) == up)  # the next node, if a sibling
    columns = [
        c, np.log1p(c), link, number(marks) / np.maximum(c, 1) * 100, c / size, c / np.maximum(leaf, 1), size, leaf,
        number(depth), place, place / np.maximum(brood[up], 1), brood[up] - place, brood[up], brood,
        c / np.maximum(c[up], 1), c / max(c[0], 1), link[up], c[up] / np.maximum(leaf[up], 1), brood[up[up]], link[up[up]], c[up[up]],
        low_own, high_own, low_own[up], high_own[up], number(low_above), number(high_above), number(nearest), number(furniture), number(matter),
        number(digits) / np.maximum(c, 1), number(rights), number(headings), number(headings)[up], after,
    ]
    tag = np.array([TAG_AT.get(t, len(TAGS)) for t in page.tag])
    onehot = np.zeros((2, n, len(TAGS) + 1), np.float32)
    onehot[0, np.arange(n), tag] = 1
    onehot[1, np.arange(n), tag[up]] = 1
    return np.hstack([np.stack(columns, 1), onehot[0], onehot[1]])


def decode(page: Page, logits: np.ndarray) -> list[str]:
    """Texts of the leaves in the best consistent choice: each node is kept or dropped, below a dropped node all is.

    A node's score counts for it if kept and against it if dropped; keeping a node lets each child choose.
    """
    n = len(page.parent)
    logits = np.clip(logits, -6, 6).tolist()
    keep, drop = list(logits), [-s for s in logits]
    holds = [bool(t) for t in page.text]
    for i in range(n - 1, 0, -1):
        p = page.parent[i]
        if not holds[i]:  # nothing to decide under it
            continue
        holds[p] = True
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
    kept = [False] * n
    kept[0] = True
    out = []
    for i in range(1, n):
        kept[i] = kept[page.parent[i]] and keep[i] > drop[i]
        if kept[i] and page.text[i]:
            out.append(page.text[i])
    return out


# -- training pages -----------------------------------------------------------------------------------------
def _pool(rng, n: int = 3000) -> list[str]:
    letters = rng.integers(0, 12, (n, 8))
    return ["".join("etaoinshrdlu"[c] for c in row[:k]) for row, k in zip(letters, rng.integers(2, 9, n))]


#: Names that training layouts give to parts of a page, by role, and to anything. They are drawn from at random; what
#: they tell is learnt from where they stand.
NAMES = {
    "nav": "nav navbar navigation menu menus main-menu site-nav breadcrumb breadcrumbs topnav toolbar skip-links pagination pager tabs".split(),
    "header": "header masthead banner site-header topbar logo branding top".split(),
    "footer": "footer foot site-footer copyright legal colophon bottom credits".split(),
    "side": "sidebar aside widget widgets related recommended rail secondary most-read trending tags".split(),
    "ad": "ad ads advert adverts advertisement sponsored sponsor promo promotion ad-slot promo-banner".split(),
    "notice": "cookie cookies cookie-notice cookie-consent consent notice notices alert popup modal overlay gdpr toast".split(),
    "form": "form search newsletter subscribe signup login search-form contact-form".split(),
    "comments": "comments comment-list comment respond replies disqus discussion responses reader-comments".split(),
    "share": "share social sharing share-bar follow".split(),
    "main": "article content main post entry story body text page-content main-content post-body entry-content article-body prose hentry single blog-post news".split(),
    "head": "story-header article-header entry-header post-header headline title-block article-head".split(),
    "any": "row col wrap wrapper container inner outer grid block box page site layout section module clearfix panel area region flex".split(),
}
ROLES = {"nav": "navigation", "header": "banner", "footer": "contentinfo", "side": "complementary", "form": "search", "main": "main", "notice": "dialog"}


def _training_page(rng, pool: list[str]) -> tuple[str, set[str]]:
    """A synthetic page and the texts of its main blocks, all distinct."""
    serial = [0]
    chance = lambda p: bool(rng.random() < p)
    pick = lambda *a: a[int(rng.integers(len(a)))]

    def words(low: int, high: int, stops: bool = True) -> str:
        serial[0] += 1
        n = int(rng.integers(low, high + 1))
        ends = ("", ".", ",") if stops else ("", "", "")
        w = [pool[k] + ends[(e < 12) + 2 * (12 <= e < 20)] for k, e in zip(rng.integers(0, len(pool), n).tolist(), rng.integers(0, 100, n).tolist())]
        return f"{' '.join(w)} {serial[0]}" + ("." if stops else "")

    def number() -> str:
        serial[0] += 1
        return pick(f"{serial[0]}", f"{int(rng.integers(1900, 2030))}{serial[0]}", f"{serial[0]}.{int(rng.integers(100))}", f"{serial[0]} %")

    main: set[str] = set()
    style = pick("named", "named", "named", "tags", "bare")  # how much the page says about its parts

    def utility() -> str:
        """Names that tell what a page has or lacks, and not what an element is."""
        role = pick(*[r for r in NAMES if r != "any"])
        name = pick(*NAMES[role])
        return pick(f"{name}-enabled", f"has-{name}", f"no-{name}", f"with-{name}", f"{name}-open", f"is-{name}-visible")

    def attributes(role: str, sure: float = 0.85) -> str:
        names = []
        if style == "named" and chance(sure):
            names.append(pick(*NAMES[role]))
        if style != "bare" and chance(0.3):
            names.append(pick(*NAMES["any"]))
        if role in ("main", "any") and style != "bare" and chance(0.25):
            names.append(utility())
        out = f' {pick("class", "class", "id")}="{" ".join(names)}"' if names else ""
        if role in ROLES and style != "bare" and chance(0.15):
            out += f' role="{ROLES[role]}"'
        return out

    def own(tag: str, text: str) -> str:
        main.add(text)
        if tag == "p":
            return f"<p>{pick('', '', '<b>')}{text}{pick('</p>', '</p>', '<br>')}"
        return f"<{tag}>{text}</{tag}>"

    def links(n: int, low: int = 1, high: int = 3) -> str:
        return "<ul>" + "".join(f'<li><a href="/x">{words(low, high, False)}</a></li>' for _ in range(n)) + "</ul>"

    def loose(n: int) -> str:
        return " | ".join(f'<a href="/x">{words(1, 3, False)}</a>' for _ in range(n))

    def main_links(n: int) -> str:
        items = []
        for _ in range(n):
            text = words(1, 8, False)
            main.add(text)
            items.append(f'<li><a href="/y">{text}</a></li>')
        return "<ul>" + "".join(items) + "</ul>"

    def table() -> str:
        cell = lambda tag: own(tag, number() if chance(0.6) else words(1, 2, False))
        width = int(rng.integers(2, 5))
        rows = [f"<tr>{''.join(cell('th' if k == 0 and chance(0.7) else 'td') for _ in range(width))}</tr>" for k in range(int(rng.integers(2, 6)))]
        return f"<table>{''.join(rows)}</table>"

    para = "div" if style == "bare" and chance(0.6) else "p"
    advert = lambda: f"<div{attributes('ad', 1.0)}>{pick('', '<p>')}{words(2, 25)}</div>" if style == "named" else f"<aside>{words(2, 25)}</aside>"
    article = []
    if chance(0.9):
        title = own(pick("h1", "h1", "h1", "h2") if para == "p" or chance(0.7) else "div", words(3, 14, chance(0.3)))
        r = rng.random()
        if r < 0.2 and style != "bare":
            below = own("p", words(4, 20)) if chance(0.4) else ""
            title = f"<header{attributes('head', 0.5)}>{title}{below}</header>"
        elif r < 0.4 and style != "bare":
            title = f"<div{attributes('head', 1.0)}>{title}</div>"
        article.append(title)
    for _ in range(int(rng.integers(1, 16))):
        article.append(own(para, words(1, int(pick(6, 20, 60, 150)))))
        r = rng.random()
        if r < 0.08:
            article.append(own(pick("h2", "h3"), words(2, 8, False)))
        elif r < 0.13:
            article.append("<ul>" + "".join(own("li", words(2, 20)) for _ in range(int(rng.integers(2, 5)))) + "</ul>")
        elif r < 0.17:
            article.append("<blockquote>" + own("p", words(6, 30)) + "</blockquote>")
        elif r < 0.21 and style != "bare":
            article.append(advert())
        elif r < 0.26:
            article.append(table())
        elif r < 0.31:
            article.append(main_links(int(rng.integers(2, 6))))
    inner = "".join(article)
    if chance(0.05):  # a page without parts, as mail archives and text exports are
        if chance(0.4):
            text = words(1, 40)
            return text, {text}
        return pick(inner, f"<html><body>{inner}</body></html>", f"<div>{inner}</div>"), main
    if style != "bare" and chance(0.2):
        inner += f"<div{attributes('share', 1.0)}>{links(3)}</div>" if style == "named" else f"<nav>{links(3)}</nav>"
    if style == "bare":
        body = f"<div>{inner}</div>"
    elif style == "tags":
        body = pick(f"<article>{inner}</article>", f"<main>{inner}</main>", f"<main><article{attributes('main', 0)}>{inner}</article></main>", f"<article{attributes('any')}>{inner}</article>")
    else:
        body = pick(f"<article{attributes('main', 0.5)}>{inner}</article>", f"<main><article{attributes('main')}>{inner}</article></main>", f"<div{attributes('main', 1.0)}>{inner}</div>", f"<section{attributes('main', 1.0)}>{inner}</section>", f"<div{attributes('main', 1.0)}><div{attributes('any')}>{inner}</div></div>")
    if style == "named" and chance(0.25):
        remark = lambda: f"<div{attributes('comments', 0.8)}>{pick('<p>', '')}{words(3, 40)}</div>"
        body += f"<{(tag := pick('div', 'section'))}{attributes('comments', 1.0)}><h3>{words(1, 2, False)}</h3>{''.join(remark() for _ in range(int(rng.integers(1, 5))))}</{tag}>"
    if style == "bare":
        side = f"<div>{pick(links(4), loose(4))}</div>"
    elif style == "tags" or chance(0.4):
        side = f"<aside{attributes('side', 0.5)}>{pick('', f'<h3>{words(1, 3, False)}</h3>')}{links(4)}<p>{words(3, 20)}</p></aside>"
    else:
        side = f"<div{attributes('side', 1.0)}><h3>{words(1, 3, False)}</h3>{links(5)}{pick('', f'<p>{words(3, 25)}</p>')}</div>"
    parts = []
    menu = pick(links(int(rng.integers(3, 9))), links(5, 1, 1), loose(5))
    if style == "bare":
        parts.append(f"<div>{menu}</div>" if chance(0.9) else "")
    else:
        if chance(0.45):
            brand = f"<a href='/'>{words(1, 3, False)}</a><p>{words(2, 8, False)}</p>" + (f"<nav>{menu}</nav>" if chance(0.3) else "")
            parts.append(f"<header{attributes('header', 0.4)}>{brand}</header>" if style == "tags" or chance(0.6) else f"<div{attributes('header', 1.0)}>{brand}</div>")
        if chance(0.85):
            parts.append(f"<nav{attributes('nav', 0.4)}>{menu}</nav>" if style == "tags" or chance(0.5) else f"<div{attributes('nav', 1.0)}>{menu}</div>")
        if chance(0.3):
            text = f"<p>{words(5, 30)}</p>{pick('', f'<button>{words(1, 2, False)}</button>')}"
            parts.append(f'<div{attributes("notice", 1.0)}>{text}</div>' if style == "named" and chance(0.6) else pick(f'<div role="{pick("dialog", "alert", "alertdialog")}"{pick("", " aria-label=cookies")}>{text}</div>', f"<dialog>{text}</dialog>"))
        if chance(0.5):
            parts.append(advert())
        if chance(0.2):
            parts.append(f"<form{attributes('form', 0.5)}><label>{words(1, 3, False)}</label><p>{words(2, 10)}</p><input></form>")
    middle = [body, side] if chance(0.4) else [side, body] if chance(0.3) else [body]
    joined = "".join(middle)
    for _ in range(int(rng.integers(0, 3))):
        joined = f"<div{attributes('any')}>{joined}</div>"
    parts.append(joined)
    if style != "bare" and chance(0.3):
        parts.append(advert())
    if style != "bare" and chance(0.2):
        parts.append(f"<form{attributes('form', 0.7)}><p>{words(3, 15)}</p></form>" if chance(0.5) or style == "tags" else f"<div{attributes('form', 1.0)}><p>{words(3, 15)}</p><input></div>")
    if chance(0.9):
        foot = pick(f"&copy; {int(rng.integers(1999, 2030))} {words(1, 12)}", f"&copy; site &middot; {words(2, 25)}", f"Copyright {int(rng.integers(1999, 2030))} {words(1, 8)}", f"(c) {words(1, 8)}")
        if style == "bare":
            parts.append(f"<div>{foot}</div>")
        else:
            foot = foot if chance(0.8) else words(2, 20)
            inside = pick(foot, f"<p>{foot}</p>", f"{links(3)}<p>{foot}</p>")
            parts.append(f"<footer{attributes('footer', 0.4)}>{inside}</footer>" if style == "tags" or chance(0.6) else f"<div{attributes('footer', 1.0)}>{inside}</div>")
    text = "".join(parts)
    if style == "bare" and chance(0.6):
        text = f"<div>{text}</div>"
    return f"<html><head><title>x</title></head><body{attributes('any') if style != 'bare' else ''}>{text}</body></html>", main


class Model:
    """What attribute tokens tell, and the trees."""

    def __init__(self, evidence: dict[str, float], trees: BoostedTrees):
        self.evidence, self.trees = evidence, trees


@lru_cache(maxsize=4)
def trained(pages: int = 1100, seed: int = 11) -> Model:
    """A model from `pages` synthetic layouts; a node is positive if its subtree holds main text."""
    rng = np.random.default_rng(seed)
    pool = _pool(rng)
    made, ys = [], []
    with_token, main_with = Counter(), Counter()
    for _ in range(pages):
        html, main = _training_page(rng, pool)
        page = Page(html)
        y = [t in main if t else False for t in page.text]
        for i in range(len(y) - 1, 0, -1):
            y[page.parent[i]] = y[page.parent[i]] or y[i]
        for tokens, good in zip(page.tokens, y):
            with_token.update(tokens)
            if good:
                main_with.update(tokens)
        made.append(page)
        ys.append(np.array(y, float))
    evidence = {t: float(np.log((main_with[t] + 1) / (n - main_with[t] + 1))) for t, n in with_token.items()}
    return Model(evidence, BoostedTrees(rounds=60, depth=5).fit(np.vstack([features(p, evidence) for p in made]), np.concatenate(ys)))


#: Nodes whose features are held at a time, unless one page has more.
NODES = 20_000


def main_texts(pages: list[str | None], model: Model) -> list[str]:
    out, held, size = [], [], 0

    def decide() -> None:
        rows = [features(p, model.evidence) for p in held]
        logits, at = model.trees.logits(np.vstack(rows)), 0
        for page, r in zip(held, rows):
            out.append("\n".join(decode(page, logits[at : at + len(r)])))
            at += len(r)
        held.clear()

    for html in pages:
        held.append(Page(html or ""))
        size += len(held[-1].parent)
        if size >= NODES:
            decide()
            size = 0
    if held:
        decide()
    return out


def extract(pages: DataFrame, model: Model | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, one row per page."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.iloc[at : at + 256]
                yield pd.DataFrame({"page_id": part["page_id"], "url": part["url"], "text": main_texts(part["html"].tolist(), shared.value)})

    kind = dict(pages.dtypes)[id_col]
    chosen = pages.select(F.col(id_col).cast("string").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    done = chosen.mapInPandas(run, "page_id string, url string, text string")
    return done.select(F.col("page_id").cast(kind).alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))
