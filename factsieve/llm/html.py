"""Main text of HTML pages by a tree-structured graphical model over the DOM.

Block elements and the runs of text in them are nodes with a hidden label, content or not. A node has a log-linear
potential of its features (tag, role, words of class and id, length, links, punctuation), an edge one of the labels of
parent and child by the kind of the child. Sum-product messages go up from the leaves and down from the root, two
passes whatever the page, and give every node's exact marginal; runs of text with a content marginal of a half or more
are the main text, in page order. Weights maximise the regularised likelihood of labelled pages: the gradient is
observed less expected features, with expectations from the same message passing.

A labelled page is HTML whose elements carry ``data-label="content"`` or ``"other"``, inherited by what they hold.
:func:`labelled_pages` makes such pages from layouts common on the web; any others can be given to :func:`train`.

Defined results: null and empty pages, and pages without content, have empty text; broken markup is read as it comes
(implied ends, stray ends ignored); repeated rows are read alike; other columns pass through.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factsieve.llm.common import col, map_batches

BLOCKS = frozenset(
    "html body article main section div nav header footer aside form fieldset p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot caption tr td th blockquote pre figure figcaption "
    "address details summary dialog hgroup search center button label legend menu".split()
)
#: Elements whose content never is text of the page; the first group is raw text up to its end tag.
RAW = frozenset("script style title textarea noscript iframe xmp noframes noembed".split())
UNSEEN = frozenset("template svg math select datalist object audio video canvas head".split())
HEAD_ONLY = frozenset("meta link base basefont".split())
ENDS_P = BLOCKS - {"html", "body", "button", "label", "legend", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "summary"}
#: A start tag ends open elements of the first set, but not beyond the second.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "tfoot": ({"thead", "tbody", "tr", "td", "th"}, {"table"}),
}
#: Words of class, id and role by what they tell.
LEXICON = {
    "ad": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion promoted banner adsense dfp taboola outbrain",
    "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs toc pagination pager tabs skip skiplink sitemap dropdown",
    "head": "header masthead topbar logo branding siteheader toolbar",
    "foot": "footer foot copyright legal colophon contentinfo siteinfo imprint",
    "side": "sidebar side aside widget widgets rail related recommended recommendations popular trending teaser teasers more complementary archive tags tagcloud",
    "notice": "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription paywall dialog toast message disclaimer",
    "comment": "comment comments commentlist disqus respond reply replies discussion reactions feedback reviews",
    "social": "share sharing social follow likes tweet facebook",
    "form": "form forms search searchbox login signup register signin contactform",
    "meta": "byline meta author date timestamp dateline postmeta",
    "body": "article content post entry story main body articlebody maincontent text prose blog news",
}
_CATEGORY = {w: k for k, ws in LEXICON.items() for w in ws.split()}
_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++))|\bhidden\b", re.S)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_TAGS = ("article", "main", "section", "div", "nav", "header", "footer", "aside", "form", "p", "heading", "item", "list", "cell", "table", "quote", "figure", "control", "dialog", "address", "body", "text")
_GROUP = {
    **{t: t for t in ("article", "main", "section", "div", "nav", "header", "footer", "aside", "form", "p", "dialog", "address")}, **{f"h{k}": "heading" for k in range(1, 7)}, "hgroup": "heading",
    "li": "item", "dt": "item", "dd": "item", "ul": "list", "ol": "list", "dl": "list", "menu": "nav", "td": "cell", "th": "cell", "tr": "table", "table": "table", "thead": "table", "tbody": "table", "tfoot": "table",
    "caption": "table", "blockquote": "quote", "pre": "quote", "figure": "figure", "figcaption": "figure", "fieldset": "form", "search": "form", "button": "control", "label": "control", "legend": "control",
    "details": "section", "summary": "heading", "center": "div", "html": "body", "body": "body", "#text": "text",
}
_FEATURES = [*(f"tag:{t}" for t in _TAGS), *(f"word:{k}" for k in LEXICON), "hidden", "words:1", "words:4", "words:11", "words:31", "links", "sentence", "short item",
             "zone:content", "zone:other", "zone:none", "share:50", "share:20", "share:5", "share:0"]
_AT = {f: i for i, f in enumerate(_FEATURES)}
#: Tags and words that name a zone of the page: what holds the article, what surrounds it.
_INNER, _OUTER = frozenset(("article", "main")), frozenset(("nav", "header", "footer", "aside", "form", "control", "dialog"))
_OUTER_WORDS = frozenset(LEXICON) - {"body", "meta"}
#: Kinds of edges by the child: text, plain element, element that names a part of the page.
EDGES = 3


class Page:
    """The nodes of one page in document order: parents, features, edge kinds, texts of runs and labels where given."""

    def __init__(self, html: str):
        self.parent: list[int] = []
        self.active: list[list[int]] = []
        self.kind: list[int] = []
        self.text: list[str | None] = []
        self.label: list[int] = []
        self._stack: list[tuple[str, int, int, str]] = []
        self._run: list[str] = []
        self._links: list[int] = [0, 0]
        self._anchor = 0
        self._open("body", "")
        self._read(html)
        self._flush()
        self._weigh()

    def _open(self, tag: str, attributes: str) -> None:
        words, label, active = set(), None, [_AT[f"tag:{_GROUP[tag]}"]]
        for m in _ATTRIBUTE.finditer(attributes) if attributes else ():
            name = (m[1] or m[0]).lower()
            value = next((v for v in m.groups()[1:] if v is not None), "")
            if name in ("class", "id", "role"):
                words |= {_CATEGORY[w.lower()] for part in re.split(r"[^A-Za-z0-9]+", value) for w in (part, *_PARTS.findall(part)) if w.lower() in _CATEGORY}
            elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
                active.append(_AT["hidden"])
            elif name == "data-label":
                label = int(value == "content")
        above = self._stack[-1] if self._stack else ("", -1, 0, "none")
        group = _GROUP[tag]
        zone = "content" if group in _INNER else "other" if group in _OUTER or words & _OUTER_WORDS else "content" if "body" in words else above[3]
        active.append(_AT[f"zone:{zone}"])
        self._add(above[1], active + [_AT[f"word:{w}"] for w in sorted(words)], 2 if words or group in _INNER or group in _OUTER else 1, None, above[2] if label is None else label)
        self._stack.append((tag, len(self.parent) - 1, self.label[-1], zone))

    def _add(self, parent: int, active: list[int], kind: int, text: str | None, label: int) -> None:
        self.parent.append(parent)
        self.active.append(active)
        self.kind.append(kind)
        self.text.append(text)
        self.label.append(label)

    def _flush(self) -> None:
        words = unescape("".join(self._run)).split() if self._run else ()
        if words:
            n, linked = self._links
            text = " ".join(words)
            active = [_AT["tag:text"], _AT[f"zone:{self._stack[-1][3]}"], _AT[f"words:{next(k for k in (31, 11, 4, 1) if len(words) >= k)}"]]
            if linked > 0.5 * max(1, n):
                active.append(_AT["links"])
            if text[-1] in ".!?…:;\"”»)。" or ". " in text:
                active.append(_AT["sentence"])
            elif len(words) < 6:
                active.append(_AT["short item"])
            self._add(self._stack[-1][1], active, 0, text, self._stack[-1][2])
        self._run, self._links = [], [0, 0]

    def _weigh(self) -> None:
        """Adds to every element the share of the page's words that it holds."""
        words = [t.count(" ") + 1 if t is not None else 0 for t in self.text]
        for i in range(len(words) - 1, 0, -1):
            words[self.parent[i]] += words[i]
        for i, n in enumerate(words):
            if self.text[i] is None:
                self.active[i].append(_AT[f"share:{next(k for k in (50, 20, 5, 0) if 100 * n >= k * words[0])}"])

    def _close(self, tags: set[str], within: set[str]) -> None:
        """Ends the innermost open element of ``tags``, with all inside it, unless one of ``within`` is further in."""
        for at in range(len(self._stack) - 1, 0, -1):
            if self._stack[at][0] in tags:
                self._flush()
                del self._stack[at:]
                self._anchor = 0
                return
            if self._stack[at][0] in within:
                return

    def _read(self, html: str) -> None:
        at, n, find, unseen = 0, len(html), _TOKEN.search, 0
        unseen_tag = ""
        while at < n:
            m = find(html, at)
            text = html[at : m.start() if m else n]
            if text and not unseen:
                self._run.append(text)
                size = len(text) - text.count(" ")
                self._links[0] += size
                self._links[1] += size if self._anchor else 0
            if not m:
                return
            at = m.end()
            ending, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
            if not tag:
                continue
            tag = tag.lower()
            if unseen:
                if tag == unseen_tag:
                    unseen += -1 if ending else 0 if attributes.endswith("/") else 1
                elif unseen_tag == "head" and (tag in BLOCKS or tag == "body"):
                    unseen = 0  # a head without its end
                elif tag in RAW and not ending:
                    at = self._raw(html, tag, at)
                if unseen or tag not in BLOCKS or ending:
                    continue
            if tag in RAW:
                if not ending and not attributes.endswith("/"):
                    at = self._raw(html, tag, at)
            elif tag in UNSEEN:
                if not ending and not attributes.endswith("/"):
                    unseen, unseen_tag = 1, tag
            elif tag in BLOCKS:
                if ending:
                    if tag in ("html", "body"):
                        continue
                    self._close({tag}, {"td", "th", "table"} - {tag} if tag in ("p", "li", "div") else set())
                elif tag in ("html", "body"):
                    if "class" in attributes or "data-label" in attributes:
                        self._flush()
                        self._open("div", attributes)
                else:
                    if tag in ENDS_P:
                        self._close({"p"}, {"td", "th", "table", "button", "div", "article", "section"} - {tag} if tag != "p" else {"td", "th", "table", "button"})
                    if tag[0] == "h" and tag in _GROUP and _GROUP[tag] == "heading" and self._stack[-1][0] in ("h1", "h2", "h3", "h4", "h5", "h6"):
                        self._close({self._stack[-1][0]}, set())
                    if tag in IMPLIED:
                        self._close(*IMPLIED[tag])
                    self._flush()
                    self._open(tag, attributes)
            elif tag == "a":
                self._anchor = 0 if ending else 1
            elif tag in ("br", "hr", "wbr", "img"):
                self._run.append(" " if tag != "wbr" else "")
                if tag == "hr":
                    self._flush()

    @staticmethod
    def _raw(html: str, tag: str, at: int) -> int:
        end = re.compile(f"</{tag}[^>]*>", re.I).search(html, at)
        return end.end() if end else len(html)


def marginals(page: Page, node: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Content marginals, joint marginals of each edge (parent label, child label) and the log partition sum.

    ``node`` has the log odds weights of the features, ``edge[kind]`` the log potentials of label pairs.
    """
    n = len(page.parent)
    odds = [sum(node[i] for i in a) for a in page.active]
    psi = np.exp(edge).tolist()
    own = [(1.0, math.exp(min(30.0, max(-30.0, o)))) for o in odds]
    inner = [[a, b] for a, b in own]  # own potential times the messages from below
    up = [(1.0, 1.0)] * n
    scale = 0.0
    for c in range(n - 1, 0, -1):
        a, b = inner[c]
        (p00, p01), (p10, p11) = psi[page.kind[c]]
        m0, m1 = p00 * a + p01 * b, p10 * a + p11 * b
        z = m0 + m1
        up[c] = (m0 / z, m1 / z)
        scale += math.log(z)
        above = inner[page.parent[c]]
        above[0] *= up[c][0]
        above[1] *= up[c][1]
        s = above[0] + above[1]
        if s < 1e-100 or s > 1e100:
            above[0], above[1] = above[0] / s, above[1] / s
            scale += math.log(s)
    total = scale + math.log(inner[0][0] + inner[0][1])
    belief = np.empty(n)
    belief[0] = inner[0][1] / (inner[0][0] + inner[0][1])
    joint = np.zeros((n, 2, 2))
    for c in range(1, n):
        p = page.parent[c]
        b1 = float(belief[p])
        a, b = inner[c]
        (p00, p01), (p10, p11) = psi[page.kind[c]]
        r0, r1 = p00 * a + p01 * b, p10 * a + p11 * b
        q0, q1 = (1 - b1) / r0, b1 / r1
        j00, j01, j10, j11 = q0 * p00 * a, q0 * p01 * b, q1 * p10 * a, q1 * p11 * b
        joint[c] = (j00, j01), (j10, j11)
        belief[c] = (j01 + j11) / (j00 + j01 + j10 + j11)
    return belief, joint, total


def train(pages: list[str], steps: int = 60, rate: float = 0.5, penalty: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Feature weights and edge potentials that maximise the regularised likelihood of labelled pages."""
    read = [Page(p) for p in pages]
    node, edge = np.zeros(len(_FEATURES)), np.zeros((EDGES, 2, 2))
    grad_n, grad_e = np.zeros_like(node), np.zeros_like(edge)
    size_n, size_e = np.full_like(node, 1e-6), np.full_like(edge, 1e-6)
    for _ in range(steps):
        grad_n[:], grad_e[:] = -penalty * len(read) * node, -penalty * len(read) * edge
        for page in read:
            belief, joint, _ = marginals(page, node, edge)
            for i, active in enumerate(page.active):
                grad_n[active] += page.label[i] - belief[i]
                if i:
                    grad_e[page.kind[i]] -= joint[i]
                    grad_e[page.kind[i], page.label[page.parent[i]], page.label[i]] += 1
        size_n += grad_n**2
        size_e += grad_e**2
        node += rate * grad_n / np.sqrt(size_n)
        edge += rate * grad_e / np.sqrt(size_e)
    return node, edge


def main_text(html: str, model: tuple[np.ndarray, np.ndarray]) -> str:
    """The runs of text whose content marginal is a half or more, one a line."""
    page = Page(html)
    belief, _, _ = marginals(page, *model)
    return "\n".join(t for t, b in zip(page.text, belief.tolist(), strict=True) if t is not None and b >= 0.5)


def labelled_pages(n: int = 120, seed: int = 7) -> list[str]:
    """Labelled pages in layouts common on the web, with made-up words: each part is drawn with its tag and names."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioulnrstmdbk") for _ in range(rng.randrange(2, 9)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randrange(a, b)))
    sentence = lambda: words(4, 20).capitalize() + rng.choice(".!?.")
    para = lambda: " ".join(sentence() for _ in range(rng.randrange(1, 6)))
    odd = lambda: rng.choice([para(), words(1, 40), words(1, 4), words(5, 60).upper(), "; ".join(words(1, 4) for _ in range(6))])
    name = lambda kind: rng.choice(LEXICON[kind].split()) + rng.choice(["", "-box", "_inner", "-wrapper", "-1", " block"])
    attr = lambda kind: f'{rng.choice(["class", "class", "id"])}="{name(kind)}"'
    other = lambda tag, inner, extra="": f'<{tag} {extra} data-label="other">{inner}</{tag}>'
    links = lambda: "".join(f'<li><a href="/{word()}">{words(1, 4)}</a></li>' for _ in range(rng.randrange(2, 8)))

    def around(kind: str) -> str:
        if kind == "menu":
            return other(rng.choice(["nav", "nav", "div", "ul"]), f"<ul>{links()}</ul>" if rng.random() < 0.8 else " | ".join(f'<a href="#">{word()}</a>' for _ in range(5)), attr("menu") if rng.random() < 0.6 else "")
        if kind == "head":
            return other(*(("header", f"<h1>{words(1, 4)}</h1><p>{words(2, 9)}</p>") if rng.random() < 0.4 else ("div", f"{words(1, 6)}", attr("head"))))
        if kind == "foot":
            text = rng.choice([f"&copy; {words(1, 5)}", f"<p>{sentence()}</p><ul>{links()}</ul>", para()])
            return other("footer", text) if rng.random() < 0.6 else other("div", text, attr("foot"))
        if kind == "side":
            text = f"<h3>{words(1, 3)}</h3>" + rng.choice([f"<ul>{links()}</ul>", f"<p>{para()}</p>"])
            return other("aside", text) if rng.random() < 0.5 else other("div", text, attr("side"))
        if kind == "form":
            return other("form", f"<label>{words(1, 3)}</label><input><p>{words(2, 12)}</p><button>{word()}</button>", attr("form") if rng.random() < 0.5 else "")
        if kind == "comment":
            one = lambda: rng.choice([f'<div class="comment"><p>{odd()}</p></div>', f"<li><b>{word()}</b> <p>{para()}</p></li>", f"<p>{para()}</p>"])
            return other(rng.choice(["section", "div", "ol"]), f"<h3>{words(1, 3)}</h3>" + "".join(one() for _ in range(rng.randrange(1, 5))), attr("comment"))
        return other(rng.choice(["div", "div", "section", "p", "aside"]), rng.choice([odd(), f"<p>{para()}</p>", f"<p>{odd()}</p><p>{sentence()}</p>"]), attr(kind))

    def article() -> str:
        body = []
        for _ in range(rng.randrange(1, 9)):
            body.append(rng.choice([f"<p>{odd()}</p>"] * 6 + [f"<h2>{words(1, 6)}</h2>", f"<ul>{''.join(f'<li>{words(1, 14)}</li>' for _ in range(3))}</ul>", f"<blockquote><p>{para()}</p></blockquote>", f"<p><b>{odd()}<br>", f"<pre>{odd()}</pre>", f"<table><tr><td>{word()}<td>{words(1, 5)}</table>"]))
            if rng.random() < 0.12:
                body.append(around(rng.choice(["ad", "side", "social", "notice", "form"])))
        top = f"<h1>{words(1, 9)}</h1>" if rng.random() < 0.7 else ""
        top = f"<header>{top}</header>" if top and rng.random() < 0.1 else top
        tag, extra = rng.choice([("article", ""), ("article", ""), ("main", ""), ("div", attr("body")), ("section", attr("body")), ("div", "")])
        return f'<{tag} {extra} data-label="content">{top}{"".join(body)}</{tag}>'

    out = []
    for _ in range(n):
        before = [around(k) for k in ("menu", "head", "ad", "notice", "form", "side") if rng.random() < 0.45]
        after = [around(k) for k in ("comment", "side", "ad", "social", "notice", "foot", "form") if rng.random() < 0.45]
        rng.shuffle(before)
        inner = "".join(before) + article() + "".join(after)
        out.append(f"<html><head><title>{words(1, 5)}</title></head><body>{inner if rng.random() < 0.7 else f'<div>{inner}</div>'}</body></html>")
    return out


def extract(pages: DataFrame, model: tuple[np.ndarray, np.ndarray], html: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (its code points) in place of the html."""
    kept = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    source = pages.select(*[col(c) for c in kept], F.coalesce(col(html), F.lit("")).alias("html"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = [main_text(h, model) for h in part.column(len(kept)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=[*kept, "text", "n_chars"])

    return map_batches(source, step, schema)
