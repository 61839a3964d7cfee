"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM.

A page's leaf blocks are its runs of text between the starts and ends of block elements, with the elements that hold
them. Each block has features of its ancestors (tags, words of their class, id and role) and of its text (length, share in links, marks). The
field's states are main text and anything else; it is trained (penalised likelihood by forward and backward sums, whole batch) on labelled pages
and decoded by Viterbi's algorithm. The labelled pages are made by rule, in `labelled_pages`: layouts of many kinds with
invented words, so no word of a page, but its form, counts.

Scripts, styles, titles, form controls and comments of markup are no text. Character references are decoded; white space inside a block is one
space (so is a line break element); the blocks that stay are joined by one newline, none dropped or cut.

Given results: null or empty html, or html without text, gives empty text; broken markup is read as browsers do in the
main (missing ends, stray ends, unquoted values); repeated rows and null page_id each get their row; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import in_batches, slices, table

#: Labelled pages that the field is trained on, and steps of training.
PAGES, STEPS, SEED = 800, 200, 7

#: Elements by kind (fixed values of HTML).
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img math mi mo mn ms mtext mrow mfrac msup msub msubsup msqrt mroot mover munder munderover mstyle mspace semantics".split())
#: Elements that hold no markup, to the page's end if they have none, and others without text, if they have an end.
RAW = "script|style|noscript|textarea|title|iframe"
SILENT = set("template svg select button object canvas audio video".split())
#: Elements inside each other that count, as many as in browsers.
DEPTH = 512
CLOSES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}, "option": {"select"}}
SECTIONS = {"article", "aside", "footer", "form", "header", "main", "nav"}
SCOPES = {"article", "aside", "blockquote", "body", "div", "footer", "form", "header", "html", "main", "nav", "section", "table", "td", "th", "li", "ul", "ol", "figure", "fieldset", "details"}

#: Within a tag; a quote that nothing closes is a character like others.
_ATTRS = r"(?:\"[^\"]*\"|'[^']*'|[^>\"']|\"(?![^\"]*\")|'(?![^']*'))*"
#: Up to a page's last '>' each of these matches where it starts, so that a page is scanned once.
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})(?=[\s/>]){_ATTRS}>(?:.*?</(?P=raw)\s*>|.*\Z)"
    rf"|<[!?][^>]*>|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>{_ATTRS})>|</[^>]*>",
    re.S | re.I,
)
END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in SILENT}
CLOSED = re.compile(r"</[a-z]+\s*>\Z", re.I)
OPEN = re.compile(r"<[a-zA-Z/!?]")
ATTR = re.compile(r"(?<![\w:-])([\w:-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    linked: int
    path: list[tuple[str, tuple[str, ...]]]
    features: list[str] = field(default_factory=list)


def names_of(attrs: str) -> tuple[str, ...]:
    """Words of the class, id and role of an element, and whether it is hidden."""
    if not attrs or attrs.isspace():
        return ()
    out: list[str] = []
    for m in ATTR.finditer(attrs):
        k, v = m[1].lower(), m[2] or m[3] or m[4] or ""
        if k in ("class", "id", "role", "itemprop"):
            out += WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", v).lower())
        elif k == "style" and "none" in v and "display" in v or k == "aria-hidden" and v == "true":
            out.append("hidden")
    if re.search(r"\bhidden\b(?!\s*=|-)", attrs):
        out.append("hidden")
    return tuple(dict.fromkeys(out))


def leaf_blocks(page: str) -> list[Block]:
    stack: list[tuple[str, tuple[str, ...]]] = []
    blocks: list[Block] = []
    parts: list[str] = []
    linked, links, spoken = 0, 0, False
    path: list[tuple[str, tuple[str, ...]]] = []

    def flush() -> None:
        nonlocal parts, linked, spoken
        text = " ".join("".join(parts).split())
        if text:
            blocks.append(Block(text, linked, path))
        parts, linked, spoken = [], 0, False

    def say(raw: str) -> None:
        nonlocal linked, path, spoken
        if not raw:
            return
        raw = html.unescape(raw)
        if not spoken and raw.strip():
            path, spoken = list(stack), True
        parts.append(raw)
        if links:
            linked += len(raw.strip())

    def pop(k: int) -> None:
        nonlocal links
        for tag, _ in stack[k:]:
            links -= tag == "a"
        del stack[k:]

    at, stop, deeper = 0, page.rfind(">") + 1, 0
    no_end: set[str] = set()
    while m := TOKEN.search(page, at, stop):
        say(page[at : m.start()])
        at = m.end()
        tag = m["tag"]
        if not tag:
            if at == stop and (m["raw"] and not CLOSED.search(m[0]) or m[0].startswith("<!--") and not m[0].endswith("-->")):
                at = len(page)
            continue
        tag = tag.lower()
        if tag == "head" or tag == "svg" and m["attrs"].endswith("/"):
            continue
        if tag in SILENT and not m["end"] and tag not in no_end:
            end = END[tag].search(page, at, stop)
            if end:
                at = end.end()
                continue
            no_end.add(tag)
        if deeper and tag not in VOID:
            if tag not in INLINE:
                flush()
            deeper += -1 if m["end"] else not m["attrs"].endswith("/")
            continue
        if m["end"]:
            if tag not in INLINE:
                flush()
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    pop(k)
                    break
                if tag in INLINE and stack[k][0] not in INLINE or tag == "p" and stack[k][0] in SCOPES:
                    break
            continue
        if tag == "br":
            say(" ")
            continue
        if tag not in INLINE:
            flush()
            for k in range(len(stack) - 1, -1, -1):  # a paragraph ends where a block starts
                if stack[k][0] == "p":
                    pop(k)
                    break
                if stack[k][0] in SCOPES:
                    break
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag and tag in CLOSES or tag in ("dt", "dd") and stack[k][0] in ("dt", "dd") or tag in ("td", "th") and stack[k][0] in ("td", "th"):
                    pop(k)
                    break
                if stack[k][0] in CLOSES.get(tag, SCOPES):
                    break
        if tag not in VOID and not m["attrs"].endswith("/"):
            if len(stack) == DEPTH:
                deeper = 1
                continue
            stack.append((tag, names_of(m["attrs"])))
            links += tag == "a"
    # After the last '>', a tag or comment that has no end is dropped.
    cut = OPEN.search(page, max(at, stop))
    say(page[at : cut.start() if cut else None])
    flush()
    return blocks


def bucket(x: float, edges: tuple[float, ...]) -> int:
    return sum(x >= e for e in edges)


def described(blocks: list[Block]) -> list[list[str]]:
    """The features of each block."""
    out = []
    for i, b in enumerate(blocks):
        n, words = len(b.text), b.text.count(" ") + 1
        tags = {t for t, _ in b.path}
        own = next((t for t, _ in reversed(b.path) if t not in INLINE), "")
        f = ["1", f"own:{own}", f"len:{bucket(n, (15, 40, 80, 160, 400))}", f"link:{bucket(b.linked / n, (0.05, 0.3, 0.8))}"]
        f += [f"in:{t}" for t in sorted(tags) if t not in ("html", "body")]
        f += [f"name:{w}" for w in sorted({w for _, ws in b.path for w in ws})]
        f.append(f"near:{next((t for t, _ in reversed(b.path) if t in SECTIONS), '')}")
        f += [f"last:{w}" for w in next((ws for _, ws in reversed(b.path) if ws), ())]
        f.append(f"own:{own}|len:{bucket(n, (40, 160))}")
        f.append(f"end:{b.text[-1] in '.!?…。！？:;\"”»'}|{bucket(words, (4, 12))}")
        f.append(f"commas:{bucket((b.text.count(',') + b.text.count('.')) / words, (0.02, 0.1))}")
        if "©" in b.text or "copyright" in b.text.lower():
            f.append("copyright")
        if "|" in b.text or "·" in b.text or "»" in b.text:
            f.append("bars")
        f.append(f"place:{bucket(i / max(1, len(blocks) - 1), (0.1, 0.9))}")
        if not tags & {"article", "main"} and not any(ws for _, ws in b.path):
            f.append("bare")
        out.append(f)
    return out


@dataclass
class Field:
    """Weights of features for the state of main text, of neighbouring states, and of the first and last one."""

    weights: dict[str, float]
    pairs: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def decode(self, features: list[list[str]]) -> list[bool]:
        """The likeliest states, by Viterbi's algorithm."""
        if not features:
            return []
        w, ((nn, nm), (mn, mm)) = self.weights, self.pairs.tolist()
        scores = [sum(w.get(k, 0.0) for k in f) for f in features]
        no, yes = float(self.first[0]), float(self.first[1]) + scores[0]
        back = []
        for s in scores[1:]:
            from_no, from_yes = no + nn >= yes + mn, no + nm > yes + mm
            back.append((not from_no, not from_yes))
            no, yes = max(no + nn, yes + mn), max(no + nm, yes + mm) + s
        state = yes + float(self.last[1]) > no + float(self.last[0])
        out = [state]
        for b in reversed(back):
            state = b[state]
            out.append(state)
        return out[::-1]


def train(pages: list[tuple[list[list[str]], list[bool]]], steps: int = STEPS, penalty: float = 0.1, rate: float = 0.15) -> Field:
    """A field fitted to pages (features and labels of blocks) by gradient steps of Adam on the whole batch."""
    names = sorted({k for fs, _ in pages for f in fs for k in f})
    place = {k: i for i, k in enumerate(names)}
    wide, deep = len(pages), max(len(y) for _, y in pages)
    cell, feature = [], []
    y, mask = np.zeros((wide, deep), np.int64), np.zeros((wide, deep), bool)
    for p, (fs, labels) in enumerate(pages):
        for i, (f, label) in enumerate(zip(fs, labels, strict=True)):
            y[p, i], mask[p, i] = label, True
            cell += [p * deep + i] * len(f)
            feature += [place[k] for k in f]
    cell, feature = np.array(cell), np.array(feature)
    ends = mask.sum(1) - 1
    rows = np.arange(wide)
    seen = np.bincount(feature, y.reshape(-1)[cell].astype(float), len(names))
    seen_first, seen_last = np.bincount(y[:, 0], minlength=2), np.bincount(y[rows, ends], minlength=2)
    both = mask[:, 1:]
    seen_pairs = np.bincount((y[:, :-1] * 2 + y[:, 1:])[both], minlength=4).reshape(2, 2)
    theta = np.zeros(len(names) + 8)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        w, pairs, first, last = theta[:-8], theta[-8:-4].reshape(2, 2), theta[-4:-2], theta[-2:]
        s = np.bincount(cell, w[feature], wide * deep).reshape(wide, deep)
        node = np.stack([np.zeros_like(s), s], 2)
        fwd, bwd = np.zeros_like(node), np.zeros_like(node)
        fwd[:, 0] = node[:, 0] + first
        for i in range(1, deep):
            fwd[:, i] = np.logaddexp(fwd[:, i - 1, :1] + pairs[0], fwd[:, i - 1, 1:] + pairs[1]) + node[:, i]
        for i in range(deep - 1, -1, -1):
            bwd[:, i] = last
            if i + 1 < deep:
                nxt = bwd[:, i + 1] + node[:, i + 1]
                inner = np.logaddexp(pairs[:, 0] + nxt[:, :1], pairs[:, 1] + nxt[:, 1:])
                bwd[:, i] = np.where((i < ends)[:, None], inner, bwd[:, i])
        total = np.logaddexp(*(fwd[rows, ends] + last).T)
        p = np.exp(fwd + bwd - total[:, None, None]) * mask[:, :, None]
        pp = np.exp(fwd[:, :-1, :, None] + pairs + (bwd + node)[:, 1:, None, :] - total[:, None, None, None]) * both[:, :, None, None]
        grad = np.concatenate([np.bincount(feature, p[:, :, 1].reshape(-1)[cell], len(names)) - seen, (pp.sum((0, 1)) - seen_pairs).reshape(-1), p[:, 0].sum(0) - seen_first, p[rows, ends].sum(0) - seen_last])
        grad = grad / wide + penalty / wide * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(dict(zip(names, theta[:-8].tolist(), strict=True)), theta[-8:-4].reshape(2, 2), theta[-4:-2], theta[-2:])


class Maker:
    """Pages by rule, each leaf block labelled: whether it is main text."""

    MAIN = ["content", "article", "article-body", "post", "post-content", "entry", "entry-content", "story", "story-body", "main", "main-content", "text", "body-text", "page-content", "articleBody"]
    NAV = ["nav", "menu", "navbar", "navigation", "main-menu", "breadcrumb", "breadcrumbs", "topnav", "toc", "pagination", "tabs", "skip-link"]
    AD = ["ad", "ads", "advert", "advertisement", "ad-banner", "banner", "promo", "sponsored", "sponsor", "adsense", "commercial", "ad-slot"]
    SIDE = ["sidebar", "side", "widget", "related", "recommended", "popular", "trending", "more", "social", "share", "sharing", "tags", "author-box", "aside", "recent-posts", "rail"]
    NOTICE = ["notice", "cookie", "cookies", "consent", "alert", "newsletter", "subscribe", "subscription", "popup", "modal", "gdpr", "cookie-banner", "message", "paywall", "login", "signup", "toast", "announcement", "disclaimer"]
    COMMENTS = ["comments", "comment-list", "comment", "replies", "responses", "disqus", "discussion", "reader-comments", "commentlist", "feedback", "reviews"]
    FOOT = ["footer", "foot", "copyright", "legal", "bottom", "site-footer", "colophon", "credits", "imprint"]
    HEAD = ["header", "masthead", "site-header", "top", "logo", "branding", "page-header", "topbar", "hero", "tagline"]

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        letters = self.r.choice(["aeioubcdfglmnprstv", "aeiouäöüßnrstchdgl", "éèaeiouçlmnprst", "áéíóúñaeiolrsntd", "аеиоунтсрвлкмд", "αειουντσρκλμπ"])
        self.words = ["".join(self.r.choice(letters) for _ in range(self.r.randint(1, 9))) for _ in range(80)]
        self.out: list[str] = []
        self.labels: list[bool] = []

    def some(self, low: int, high: int) -> str:
        ws = [self.r.choice(self.words) + (self.r.choice(["", "", "", "###", "$$$", "***", "&amp;&amp;&amp;", "%%%"]) if self.noisy else "") for _ in range(self.r.randint(low, high))]
        return " ".join(ws).capitalize()

    def sentences(self, low: int, high: int) -> str:
        one = lambda: ", ".join(self.some(1, 9) if i == 0 else self.some(1, 6).lower() for i in range(self.r.randint(1, 3))) + self.r.choice("...!?")
        return " ".join(one() for _ in range(self.r.randint(low, high)))

    def block(self, tag: str, text: str, main: bool, attrs: str = "", close: bool = True) -> None:
        self.labels.append(main)
        self.out.append(f"<{tag}{attrs}>{text}" + (f"</{tag}>" if close else ""))

    def named(self, names: list[str]) -> str:
        k = self.r.choice(["class", "class", "class", "id"])
        n = self.r.choice(names)
        if self.r.random() < 0.2:
            n += f" {self.r.choice(['col', 'row', 'box', 'inner', 'block', 'x', 'container', 'clearfix', 'wrap'])}-{self.r.randint(1, 12)}"
        return f' {k}="{n}"' if self.r.random() < 0.85 else f" {k}={n.split()[0]}"

    def outer(self, tags: list[str], names: list[str], named: float, inside) -> None:
        tag = self.r.choice(tags)
        attrs = self.named(names) if tag in ("div", "section", "ul") or self.r.random() < named else ""
        self.out.append(f"<{tag}{attrs}>")
        inside()
        self.out.append(f"</{tag}>")

    def links(self) -> None:
        style = self.r.choice(["li", "li", "a", "p"])
        if style == "li":
            self.out.append("<ul>")
        for _ in range(self.r.randint(2, 9)):
            t = f'<a href="/{self.r.randint(1, 999)}">{self.some(1, 4)}</a>'
            self.block(style, t, False) if style != "a" else self.block("div", t, False)
        if style == "li":
            self.out.append("</ul>")

    def nav(self) -> None:
        self.outer(["nav", "nav", "div", "ul", "header"], self.NAV, 0.3, self.links)

    def ad(self) -> None:
        self.outer(["div", "div", "aside", "section"], self.AD, 1, lambda: self.block(self.r.choice(["p", "div", "span"]), self.sentences(1, 3) if self.r.random() < 0.7 else self.some(2, 6), False) if self.r.random() < 0.5 else self.text(self.sentences(1, 3)))

    def text(self, text: str) -> None:
        self.labels.append(False)
        self.out.append(text)

    def side(self) -> None:
        def inside() -> None:
            self.block(self.r.choice(["h2", "h3", "h4", "div"]), self.some(1, 4), False)
            if self.r.random() < 0.6:
                self.links()
            if self.r.random() < 0.6:
                for _ in range(self.r.randint(1, 3)):
                    self.block("p", self.sentences(1, 4), False)

        self.outer(["aside", "aside", "div", "section"], self.SIDE, 0.4, inside)

    def notice(self) -> None:
        def inside() -> None:
            if self.r.random() < 0.3:
                self.block("h3", self.some(1, 5), False)
            self.block("p", self.sentences(1, 3), False) if self.r.random() < 0.6 else self.text(self.sentences(1, 3))

        self.outer(["div", "div", "section", "aside"], self.NOTICE, 1, inside)

    def form(self) -> None:
        self.out.append("<form" + (self.named(self.NOTICE + ["search", "contact", "form"]) if self.r.random() < 0.4 else "") + ">")
        for _ in range(self.r.randint(1, 3)):
            self.block(self.r.choice(["p", "div", "legend", "fieldset"]), self.some(1, 6) + ' <input type="text">' if self.r.random() < 0.6 else self.sentences(1, 2), False)
        self.out.append("</form>")

    def comments(self) -> None:
        def inside() -> None:
            self.block(self.r.choice(["h2", "h3", "div"]), self.some(1, 3), False)
            for _ in range(self.r.randint(1, 5)):
                self.out.append(f"<{(t := self.r.choice(['div', 'li', 'article']))}" + (self.named(["comment", "reply", "comment-body", "review"]) if t != "article" or self.r.random() < 0.7 else "") + ">")
                if self.r.random() < 0.5:
                    self.block(self.r.choice(["div", "h4", "p"]), self.some(1, 3), False)
                for _ in range(self.r.randint(1, 2)):
                    self.block("p", self.sentences(1, 6), False)
                self.out.append(f"</{t}>")

        self.outer(["section", "div", "ul", "aside"], self.COMMENTS, 1, inside)

    def foot(self) -> None:
        def inside() -> None:
            if self.r.random() < 0.5:
                self.links()
            self.block(self.r.choice(["p", "div", "small"]), ("&copy; " if self.r.random() < 0.6 else "") + (self.some(1, 5) if self.r.random() < 0.5 else self.sentences(1, 2)), False) if self.r.random() < 0.5 else self.text("&copy; " + self.some(1, 4) + " &middot; " + self.sentences(1, 2))

        self.outer(["footer", "footer", "footer", "div"], self.FOOT, 0.3, inside)

    def head(self) -> None:
        def inside() -> None:
            self.block(self.r.choice(["div", "p", "h1", "h2"]), self.some(1, 4), False)
            if self.r.random() < 0.5:
                self.block("p", self.sentences(1, 1), False)

        self.outer(["header", "header", "div"], self.HEAD, 0.3, inside)

    def main(self) -> None:
        tag = self.r.choice(["article", "article", "article", "main", "div", "div", "section", "td"])
        attrs = self.named(self.MAIN) if self.r.random() < (0.35 if tag in ("article", "main") else 0.8) else ""
        depth = self.r.choice([0, 0, 1, 2])
        self.out.append(("<table><tr>" if tag == "td" else "") + f"<{tag}{attrs}>" + "<div>" * depth)
        if self.r.random() < 0.85:
            self.block("h1", self.some(2, 9), True)
        for _ in range(self.r.randint(1, 14)):
            k = self.r.random()
            if k < 0.06:
                self.block(self.r.choice(["h2", "h3"]), self.some(1, 7), True)
            elif k < 0.10:
                self.out.append("<ul>")
                for _ in range(self.r.randint(1, 4)):
                    self.block("li", self.some(1, 12), True)
                self.out.append("</ul>")
            elif k < 0.13:
                self.out.append("<blockquote>")
                self.block("p", self.sentences(1, 4), True)
                self.out.append("</blockquote>")
            elif k < 0.15 and tag != "td":
                self.out.append("<table><tr>")
                for _ in range(self.r.randint(1, 4)):
                    self.block("td", self.some(1, 4), True)
                self.out.append("</tr></table>")
            elif k < 0.17:
                self.block(self.r.choice(["pre", "figcaption", "dd", "div"]), self.some(3, 12), True)
            elif k < 0.22:
                self.r.choice([self.ad, self.ad, self.side, self.notice])()
            elif k < 0.45:
                self.block("p", self.some(1, 3) + ".", True)
            elif k < 0.55:
                self.block("p", f"<b>{self.sentences(1, 5)}<br>", True, close=False)
            elif k < 0.62:
                self.block("p", f'{self.sentences(1, 2)} <a href="/x">{self.some(1, 4)}</a> {self.sentences(1, 3)}', True)
            else:
                self.block("p", self.sentences(1, 12), True)
        self.out.append("</div>" * depth + f"</{tag}>" + ("</tr></table>" if tag == "td" else ""))

    def page(self) -> tuple[str, list[bool]]:
        self.noisy = self.r.random() < 0.15
        r = self.r.random
        self.out.append(f"<!DOCTYPE html><html><head><title>{self.some(2, 8)}</title><script>var a='</p>';</script></head><body>")
        before = [f for f, p in ((self.head, 0.5), (self.nav, 0.8), (self.notice, 0.3), (self.ad, 0.5), (self.form, 0.2), (self.side, 0.2)) if r() < p]
        after = [f for f, p in ((self.side, 0.5), (self.comments, 0.45), (self.ad, 0.3), (self.form, 0.3), (self.notice, 0.3), (self.nav, 0.15)) if r() < p]
        self.r.shuffle(before)
        self.r.shuffle(after)
        wrap = r() < 0.3
        if wrap:
            self.out.append(f'<div class="{self.r.choice(["wrapper", "container", "page", "site", "layout"])}">')
        for f in before:
            f()
        if r() < 0.97:
            self.main()
        for f in after:
            f()
        if r() < 0.85:
            self.foot()
        self.out.append("</div>" * wrap + "</body></html>")
        return "".join(self.out), self.labels


def labelled_pages(n: int = PAGES, seed: int = SEED) -> list[tuple[str, list[bool]]]:
    return [Maker(seed * 1_000_003 + i).page() for i in range(n)]


def trained(n: int = PAGES, steps: int = STEPS, seed: int = SEED) -> Field:
    """The field of n labelled pages; pages whose blocks are not those that were labelled take no part."""
    rows = [(described(blocks), labels) for page, labels in labelled_pages(n, seed) if len(blocks := leaf_blocks(page)) == len(labels)]
    return train(rows, steps)


def main_text(page: str, model: Field) -> str:
    blocks = leaf_blocks(page)
    return "\n".join(b.text for b, stays in zip(blocks, model.decode(described(blocks)), strict=True) if stays)


def extracted(pages: DataFrame, model: Field) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages (page_id, url, html)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(p or "", model) for p in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    out = T.StructType([pages.schema["page_id"], pages.schema["url"], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return pages.select("page_id", "url", F.col("html").cast("string").alias("html")).transform(in_batches, run, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages"), trained())
