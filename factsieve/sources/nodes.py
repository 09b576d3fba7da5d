"""HTML bodies to element rows: the one Python step, a partition-wise Arrow map over the corpus.

Each element becomes one row with interval ids (``node_id`` is its pre-order number, ``last_desc`` the
largest number inside it), its text, and the innermost enclosing element of each kind later operators ask
about (``a_chrome``, ``a_section``, ...; 0 when there is none). Everything else is relational.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from factsieve.sources.staging import spread

# Executors get this module with the task, so nothing has to be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# ---- fixed values ---------------------------------------------------------------------------
NON_CONTENT = frozenset("script style noscript template svg iframe object embed".split())
CHROME_TAGS = frozenset("nav header footer aside".split())
CHROME_ROLES = frozenset("navigation banner contentinfo".split())
CHROME_CLASSES = frozenset(
    "nav navbar navigation menu site-header site-footer footer header breadcrumb breadcrumbs cookie cookie-banner "
    "newsletter sidebar widget-area".split()
)
NAV_CLASSES = frozenset("nav navbar menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul".split()
)
# start tag -> (open tags it ends, tags that stop the search)
IMPLIED_END = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
HEAD_TAGS = frozenset("title base link meta style script noscript template".split())
MICRODATA_ATTR = {
    "meta": "content", "audio": "src", "embed": "src", "iframe": "src", "img": "src", "source": "src",
    "track": "src", "video": "src", "a": "href", "area": "href", "link": "href", "object": "data",
    "data": "value", "time": "datetime",
}
LABEL_TAGS = frozenset("label strong b dt h3 h4 h5 h6".split())
LABEL_LENGTH = 50  # longest text that may label the element after it
TEXT_LIMIT = 5000  # longer texts of elements that hold blocks keep their length only: the blocks have the text
BOXES = CLOSES_P | frozenset("body li dt dd tbody thead tfoot tr td th".split())
# ---------------------------------------------------------------------------------------------

_WS = re.compile("[\\s\u00a0\u1680\u2000-\u200b\u2028\u2029\u202f\u205f\u3000\ufeff]+")


def _single_spaced(text: str) -> str:
    """Every run of white space as one space; a text of words with single spaces is only split and joined."""
    if "\u200b" in text or "\ufeff" in text:  # white space to the page model, not to Python
        return _WS.sub(" ", text)
    words = text.split()
    if not words:
        return " " if text else ""
    return f"{' ' if text[0].isspace() else ''}{' '.join(words)}{' ' if text[-1].isspace() else ''}"


def _joined(pieces: list[str]) -> str:
    """Single-spaced pieces as one trimmed text: runs of white space arise only where two of them meet."""
    text = "".join(pieces)
    return (_WS.sub(" ", text) if "  " in text else text).strip()


_SCHEMA_ORG = re.compile(r"^https?://schema\.org/", re.I)
ANCESTORS = (
    "chrome", "nav", "fnh", "aside", "listskip", "section", "secdiv", "idsection", "classsection", "class", "figure",
    "picture", "item",
)

NODE_SCHEMA = pa.schema(
    [
        ("page_id", pa.int64()), ("node_id", pa.int32()), ("last_desc", pa.int32()), ("parent_id", pa.int32()),
        ("depth", pa.int32()), ("tag", pa.string()), ("attrs", pa.map_(pa.string(), pa.string())),
        ("own_text", pa.string()), ("full_text", pa.string()), ("text_len", pa.int32()), ("raw_text", pa.string()),
        ("content", pa.bool_()), ("n_kids", pa.int32()), ("n_all_kids", pa.int32()),
        ("child_tags", pa.list_(pa.string())), ("lead_tag", pa.string()), ("lead_text", pa.string()),
        ("parent_tag", pa.string()), ("parent_class", pa.string()), ("parent_html_id", pa.string()),
        ("item_json", pa.string()), ("near_class", pa.string()), ("near_id", pa.string()), ("box_class", pa.string()),
        ("near_heading", pa.string()), ("caption", pa.string()), ("prev_text", pa.string()), ("prev_at", pa.int32()),
        ("parent_prev_text", pa.string()), ("parent_prev_at", pa.int32()),
        ("term", pa.string()), ("next_text", pa.string()), ("next_tag", pa.string()), ("next_class", pa.string()),
        ("next_id", pa.string()),
        *[(f"a_{a}", pa.int32()) for a in ANCESTORS],
    ]
)
NODE_DDL = (
    "page_id bigint, node_id int, last_desc int, parent_id int, depth int, tag string, attrs map<string,string>, "
    "own_text string, full_text string, text_len int, raw_text string, content boolean, n_kids int, "
    "n_all_kids int, child_tags array<string>, lead_tag string, lead_text string, parent_tag string, "
    "parent_class string, parent_html_id string, item_json string, "
    "near_class string, near_id string, box_class string, near_heading string, caption string, prev_text string, "
    "prev_at int, parent_prev_text string, parent_prev_at int, "
    "term string, next_text string, next_tag string, next_class string, next_id string, " + ", ".join(f"a_{a} int" for a in ANCESTORS)
)


MARKED_TAGS = CHROME_TAGS | frozenset("section article div figure picture".split())
_OUTSIDE = dict.fromkeys(ANCESTORS, 0)


def _tag_marks(tag: str) -> frozenset:
    """The kinds of enclosing element that a tag alone makes."""
    own = {
        "chrome": tag in CHROME_TAGS,
        "nav": tag == "nav",
        "fnh": tag in ("footer", "nav", "header"),
        "aside": tag in ("footer", "nav", "header", "aside"),
        "listskip": tag in ("nav", "footer", "header"),
        "section": tag in ("section", "article", "div"),
        "secdiv": tag in ("section", "div"),
        "classsection": tag in ("section", "figure"),
        "figure": tag == "figure",
        "picture": tag == "picture",
    }
    return frozenset(k for k, is_one in own.items() if is_one)


_TAG_MARKS = {tag: _tag_marks(tag) for tag in MARKED_TAGS}


#: Marks of the attributes met in this process, a bounded number of them.
_KNOWN_MARKS: dict[tuple, frozenset] = {}


def _attr_marks(tag: str, of_class: str | None, role: str | None, has_id: bool) -> frozenset:
    """The kinds of enclosing element that a tag with such attributes is."""
    own = set(_TAG_MARKS.get(tag, ()))
    if of_class is not None:
        classes = of_class.split()
        own.add("class")
        if tag == "div":
            own.add("classsection")
        if not CHROME_CLASSES.isdisjoint(classes):
            own.add("chrome")
        if not NAV_CLASSES.isdisjoint(classes):
            own.add("nav")
    if role in CHROME_ROLES:
        own.add("chrome")
    if role == "navigation":
        own.update(("nav", "listskip"))
    if has_id and tag in ("section", "div"):
        own.add("idsection")
    return frozenset(own)


def _marks(tag: str, attrs: dict) -> frozenset:
    """The kinds of enclosing element that an element is."""
    key = (tag, attrs.get("class"), attrs.get("role"), "id" in attrs)
    marks = _KNOWN_MARKS.get(key)
    if marks is None:
        if len(_KNOWN_MARKS) >= 4096:
            _KNOWN_MARKS.clear()
        marks = _KNOWN_MARKS[key] = _attr_marks(*key)
    return marks


# Plain markup, which most is, is cut up here; every other token is left to the standard parser's own methods.
_START = re.compile(r'<([a-z][a-z0-9]*)((?: +[a-z][a-z0-9_:-]*(?:="[^"&]*")?)*+) *(/?)>')
_ATTR = re.compile(r' +([a-z][a-z0-9_:-]*)(?:="([^"&]*)")?')
_ENDING = re.compile("</([a-z][a-z0-9]*)>")
_P_STOPS = frozenset("button table td th body".split())
_OWN_TEXT = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())


class _Node:
    __slots__ = (
        "node_id", "last_desc", "parent", "depth", "tag", "attrs", "own", "start", "raw", "content", "kids",
        "all_kids", "anc", "text", "length", "props", "end", "heads", "last_kid", "last_heading", "prev", "prev_heading",
        "caption", "boxed", "next", "term", "last_term",
    )


class _Tree(HTMLParser):
    """Element rows of one page, with the implied end tags an HTML parser supplies."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes: list[_Node] = []
        self.open: list[_Node] = []
        self.pieces: list[str] = []
        self.sizes = [0]
        self.swallow: _Node | None = None  # open element whose markup is plain text or not part of the tree
        self.nested = 0  # same-named elements open inside it
        self.open_p = 0  # open paragraphs

    def updatepos(self, i: int, j: int) -> int:
        return j  # nobody asks for line numbers

    def feed(self, data: str) -> None:
        """The whole page, with the standard parser's calls for it."""
        self.rawdata = data
        i = 0
        while True:
            j = data.find("<", i)
            if j < 0:
                break
            if i < j:
                piece = data[i:j]
                self.handle_data(unescape(piece) if "&" in piece else piece)
            i = j
            if data.startswith("/", i + 1):
                ending = _ENDING.match(data, i)
                if ending is not None:
                    self.handle_endtag(ending[1])
                    i = ending.end()
                    continue
            start = _START.match(data, i)
            if start is not None and self.swallow is None and start[1] not in _OWN_TEXT:
                tag, attrs, closed = start.groups()
                handle = self.handle_startendtag if closed else self.handle_starttag
                handle(tag, _ATTR.findall(attrs) if attrs else [])
                i = start.end()
                continue
            k = self._one_token(i)
            if k < 0:
                break
            i = k
            if self.cdata_elem is not None:
                break
        self.rawdata = data[i:]
        self.goahead(0)

    def _one_token(self, i: int) -> int:
        """The end of the markup at ``i``, read by the standard parser; -1 where it has to go on by itself."""
        data = self.rawdata
        after = data[i + 1:i + 2]
        if after == "/":
            return self.parse_endtag(i)
        if data.startswith("<!--", i):
            return self.parse_comment(i)
        if after == "!":
            return self.parse_html_declaration(i)
        if after == "?":
            return self.parse_pi(i)
        if not (after.isascii() and after.isalpha()):
            if not after:
                return -1
            self.handle_data("<")
            return i + 1
        k = self.parse_starttag(i)
        ending = self.interesting.search(data, k) if k >= 0 and self.cdata_elem in ("script", "style") else None
        if ending is None:
            return k
        if k < ending.start():
            self.handle_data(data[k:ending.start()])
        k = self.parse_endtag(ending.start())
        return k if k >= 0 else ending.start()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if self.swallow is not None:
            if self.swallow.tag == "noscript":
                self.swallow.raw.append(self.get_starttag_text() or "")
            if tag == self.swallow.tag and tag not in VOID:
                self.nested += 1
            return
        if tag == "html" and self.nodes:
            return
        if tag == "body" and any(n.tag == "body" for n in self.open):
            return
        if not self.nodes or tag in ("head", "body") or (self.open and self.open[-1].tag in ("html", "head")):
            self._skeleton(tag)
        if self.open_p and tag in CLOSES_P:
            self._end("p", _P_STOPS)
        if tag in IMPLIED_END:
            ends, stops = IMPLIED_END[tag]
            while True:
                hit = next((n for n in reversed(self.open) if n.tag in ends or n.tag in stops), None)
                if hit is None or hit.tag in stops:
                    break
                self._pop_to(hit)
        if tag == "tr" and self.open and self.open[-1].tag == "table":
            self._push("tbody", {})
        node = self._push(tag, {k: v or "" for k, v in reversed(attrs)} if attrs else {})
        if tag in VOID:
            self._pop_to(node)
        elif tag in ("noscript", "svg", "template"):
            self.swallow = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and (tag == "svg" or any(n.tag == "svg" for n in self.open)):
            self.handle_endtag(tag)

    def _skeleton(self, tag: str) -> None:
        if tag == "html":
            return
        if not self.nodes:
            self._push("html", {})
        top = self.open[-1].tag if self.open else ""
        if tag in ("head", "body"):
            if tag == "body":
                while self.open and self.open[-1].tag != "html":
                    self._pop_to(self.open[-1])
            return
        if top == "html":
            self._push("head" if tag in HEAD_TAGS and not any(n.tag in ("head", "body") for n in self.nodes) else "body", {})
        elif top == "head" and tag not in HEAD_TAGS:
            self._pop_to(self.open[-1])
            self._push("body", {})

    def _push(self, tag: str, attrs: dict) -> _Node:
        parent = self.open[-1] if self.open else None
        node = _Node()
        node.node_id = len(self.nodes) + 1
        node.parent, node.tag, node.attrs = parent, tag, attrs
        node.depth = parent.depth + 1 if parent else 0
        node.own, node.raw, node.kids, node.all_kids = [], [], [], []
        node.start = len(self.pieces)
        node.content = (parent.content if parent else True) and tag not in NON_CONTENT
        node.props = {} if "itemscope" in attrs else None
        node.text = node.last_kid = node.last_heading = node.caption = node.next = node.term = node.last_term = None
        node.heads = [None, None]  # first h1-h3 and first h1-h4 inside a section
        node.prev, node.prev_heading = (parent.last_kid, parent.last_heading) if parent else (None, None)
        inherited = parent.anc if parent else _OUTSIDE
        # the enclosing item is always a proper ancestor
        item = (parent.node_id if parent.props is not None else inherited["item"]) if parent else 0
        marks = _marks(tag, attrs) if attrs or tag in MARKED_TAGS else ()
        if marks or item != inherited["item"]:
            node.anc = {**inherited, **dict.fromkeys(marks, node.node_id), "item": item}
        else:
            node.anc = inherited  # most elements enclose what their parent does: the dict is shared, and never changed
        if parent is not None:
            parent.last_kid = node
            if tag in HEADINGS:
                parent.last_heading = node
            parent.all_kids.append(tag)
            if node.content:
                if parent.kids:
                    parent.kids[-1].next = node
                parent.kids.append(node)
                if parent.tag == "dl":  # the term that holds at each of its children
                    if tag == "dt":
                        parent.last_term = node
                    node.term = parent.last_term
        if tag in ("h1", "h2", "h3", "h4"):
            for box in self.open:
                if box.tag in ("section", "article", "div"):
                    for i, stop in enumerate(("h4", "")):
                        if box.heads[i] is None and tag != stop:
                            box.heads[i] = node
        elif tag == "figcaption" and inherited["figure"]:
            figure = self.nodes[inherited["figure"] - 1]
            figure.caption = figure.caption or node
        if tag == "p":
            self.open_p += 1
        self.nodes.append(node)
        self.open.append(node)
        return node

    def text_of(self, node: _Node | None) -> str:
        if node and node.end - node.start == 1:  # a piece has no runs of white space
            return self.pieces[node.start].strip()
        return _joined(self.pieces[node.start:node.end]) if node else ""

    def _close(self, node: _Node) -> None:
        node.last_desc, node.end = len(self.nodes), len(self.pieces)
        node.length = self.sizes[-1] - self.sizes[node.start]
        node.boxed = False
        for k in node.kids:
            if k.tag in BOXES or getattr(k, "boxed", False):
                node.boxed = True
                break
        keep = (
            not node.boxed or node.length <= TEXT_LIMIT + 2 or node.anc["chrome"] == node.node_id or "itemprop" in node.attrs
            or node.tag in ("body", "title", "figcaption")
        )
        if keep:
            node.text = self.text_of(node)
            node.length = len(node.text)
        name = node.attrs.get("itemprop")
        if name and node.anc["item"]:
            owner = self.nodes[node.anc["item"] - 1]
            value = self._item(node) if node.props is not None else self._item_value(node)
            if value != "" and owner.props is not None:
                owner.props.setdefault(name, []).append(value)

    def _item_value(self, node: _Node) -> str:
        attr = MICRODATA_ATTR.get(node.tag)
        return _WS.sub(" ", (node.attrs.get(attr) if attr else None) or node.text or "").strip()

    @staticmethod
    def _item(node: _Node) -> dict:
        types = [_SCHEMA_ORG.sub("", t) for t in node.attrs.get("itemtype", "").split()]
        return {"@type": types, **{k: v if len(v) > 1 else v[0] for k, v in node.props.items()}}

    def _pop_to(self, target: _Node) -> None:
        while self.open:
            node = self.open.pop()
            if node.tag == "p":
                self.open_p -= 1
            self._close(node)
            if node is target:
                return

    def _end(self, tag: str, stops: set) -> None:
        for node in reversed(self.open):
            if node.tag == tag:
                self._pop_to(node)
                return
            if node.tag in stops:
                return

    def handle_endtag(self, tag: str) -> None:
        if self.swallow is not None:
            if tag != self.swallow.tag:
                if self.swallow.tag == "noscript":
                    self.swallow.raw.append(f"</{tag}>")
                return
            if self.nested:
                self.nested -= 1
                return
            node, self.swallow = self.swallow, None
            self._pop_to(node)
            return
        if tag in VOID or tag in ("html", "body"):
            return
        for node in reversed(self.open):
            if node.tag == tag:
                self._pop_to(node)
                return
            if node.tag in ("td", "th", "table") and tag not in ("tr", "tbody", "thead", "tfoot", "table"):
                return

    def handle_data(self, data: str) -> None:
        if self.swallow is not None:
            if self.swallow.tag == "noscript":
                self.swallow.raw.append(data)
            return
        if not self.open or self.open[-1].tag in ("html", "head"):
            if not data.strip():
                return
            self._skeleton("#text")
        node = self.open[-1]
        if node.content:
            piece = _single_spaced(data)
            node.own.append(piece)
            self.pieces.append(piece)
            self.sizes.append(self.sizes[-1] + len(piece))
        else:
            node.raw.append(data)

    def rows(self) -> list[_Node]:
        self.close()
        while self.open:
            self._pop_to(self.open[-1])
        return self.nodes


def _keeps_raw(node: _Node, raw: str) -> bool:
    if node.tag != "script":
        return node.tag == "noscript"
    kind = node.attrs.get("type", "").lower()
    lowered = raw.lower()
    return kind == "application/ld+json" or ("lat" in lowered and ("lng" in lowered or "lon" in lowered))


_IMAGE_FILE = re.compile(r"\.(jpe?g|png|webp|avif|gif)(\?|$)", re.I)
_NO_SURROUNDINGS = (None,) * 9
SURROUNDED_TAGS = frozenset("img source video a p ul ol".split())


def _surroundings(tree: _Tree, n: _Node) -> tuple:
    """Words around the few kinds of element whose meaning depends on their neighbourhood."""
    def attr_of(kind: str, name: str) -> str | None:
        return tree.nodes[n.anc[kind] - 1].attrs.get(name) if n.anc[kind] else None

    def heading(kind: str, deep: int) -> str | None:
        return tree.text_of(tree.nodes[n.anc[kind] - 1].heads[deep]) if n.anc[kind] else None

    href = n.attrs.get("href", "")
    if n.tag in ("img", "source", "video") or "background" in n.attrs.get("style", "") or (
        n.tag == "a" and _IMAGE_FILE.search(href)
    ):
        figure = tree.nodes[n.anc["figure"] - 1] if n.anc["figure"] else None
        return (
            attr_of("classsection", "class"), attr_of("idsection", "id"), attr_of("class", "class"),
            heading("section", 1), tree.text_of(figure.caption) if figure else None, None, None, None, None,
        )
    if n.tag == "p":
        return (None, attr_of("idsection", "id"), None, heading("section", 0), *_NO_SURROUNDINGS[4:])
    if n.tag in ("ul", "ol"):
        before, above = n.prev_heading, n.parent.prev_heading if n.parent else None
        return (
            None, None, None, heading("secdiv", 1), None, tree.text_of(before), before and before.node_id,
            tree.text_of(above), above and above.node_id,
        )
    if n.tag == "a" and re.match(r"(?i)(tel|callto|sms|mailto):", href):
        above = n.parent.prev if n.parent else None
        return (*_NO_SURROUNDINGS[:7], tree.text_of(above), above and above.node_id)
    return _NO_SURROUNDINGS


_UNLABELLED = (None,) * 4


def _labelled(n: _Node) -> tuple:
    """Text, tag, class and id of the element a short label-like one stands before."""
    after = n.next
    if after is None or not n.text or len(n.text) > LABEL_LENGTH or not after.text:
        return _UNLABELLED
    if n.tag not in LABEL_TAGS:
        named = n.attrs.get("class", "")
        if "label" not in named and "title" not in named:
            return _UNLABELLED
    return after.text, after.tag, after.attrs.get("class"), after.attrs.get("id")


def _rows(page_id: int, tree: _Tree, out: list[tuple]) -> None:
    for n in tree.rows():
        parent, lead = n.parent, n.kids[0] if n.kids else None
        raw = "".join(n.raw) if n.raw else ""
        out.append((
            page_id, n.node_id, n.last_desc, parent.node_id if parent else 0, n.depth, n.tag, list(n.attrs.items()),
            (_joined(n.own) or None) if n.kids and n.own else None,
            n.text, n.length, raw if raw and _keeps_raw(n, raw) else None, n.content, len(n.kids), len(n.all_kids),
            n.all_kids[:8], lead.tag if lead else None, lead.text if lead and lead.length <= 60 else None,
            parent.tag if parent else None, parent.attrs.get("class") if parent else None,
            parent.attrs.get("id") if parent else None,
            json.dumps(_Tree._item(n), ensure_ascii=False) if n.props is not None else None,
            *(_surroundings(tree, n) if n.attrs or n.tag in SURROUNDED_TAGS else _NO_SURROUNDINGS),
            n.term.text if n.tag == "dd" and n.term is not None else None, *(_labelled(n) if n.next is not None else _UNLABELLED),
            *n.anc.values(),  # in the order of ANCESTORS
        ))


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values, f.type) for f, values in zip(NODE_SCHEMA, zip(*rows))], schema=NODE_SCHEMA)

    out: list[tuple] = []
    for batch in batches:
        for page_id, html in zip(batch.column(0), batch.column(1)):
            tree = _Tree()
            tree.feed(html.as_py() or "")
            _rows(page_id.as_py(), tree, out)
            if len(out) >= 20_000:  # keep outgoing batches small whatever the page size
                yield packed(out)
                out = []
    if out:
        yield packed(out)


def explode_nodes(pages: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per element of every page (``page_id``, ``html`` are the only columns read).

    The pages are dealt out by ``page_id``, to ``partitions`` tasks if given: their element rows then lie as a table of as
    many buckets wants them, and need not be moved, being several times the size of the pages.
    """
    bodies = pages.select("page_id", "html")
    placed = spread(bodies, "page_id") if partitions is None else bodies.repartition(partitions, "page_id")
    return placed.mapInArrow(_explode, NODE_DDL)
