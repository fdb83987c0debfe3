"""Main text of web pages by wrapper induction.

Each page becomes a tree of its block elements, and that tree a skeleton: per parent one node for
each kind of child, so that lists of any length look alike. Per host the skeleton of most different
pages is the reference; every other skeleton of the host is aligned with it by simple tree matching
(the heaviest order-keeping match of equal tags, weights summed from the leaves up), which gives the
nodes of all pages of a host common slots. A slot whose text is the same on nearly all of at least
``MIN_PAGES`` different pages belongs to the template; what varies is content. Of the content only
what lies in the article counts (failing that in ``main``, failing that anywhere), and never what an
element's name, role or class says to be a menu, header, footer, sidebar, notice, advert, form or comment.

Skeletons, references, slots and their texts' counts are Spark tables over all pages; pages that
read alike count once, so copies of an article do not make it a template. Should all of a page's
content be template, nothing tells the two apart and it stays.

Defined results: null html is empty, an empty page gives an empty text, null or odd urls share
the host '', repeated rows are returned each, extra columns are ignored, and an empty table gives an
empty result. Elements nested deeper than ``MAX_DEPTH`` count to the element at that depth; their text stays.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from scrubline.llm.common import written

#: A slot is template if its commonest text is on this share of its pages, these being at least so many.
SHARE, MIN_PAGES = 0.9, 8
MAX_DEPTH = 150

BLOCKS = set(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot "
    "th thead tr ul caption".split()
)
#: Elements whose content is no markup, up to their end tag; none of it is text to read.
RAW = set("script style title textarea iframe noembed noframes noscript xmp template svg math".split())
#: Boilerplate by name.
FURNITURE = set("nav footer aside form menu dialog search button select object canvas audio video datalist".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Boilerplate by a word of class or id.
CLASSES = set(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr "
    "notice notices popup modal overlay newsletter subscribe signup sidebar nav navbar navigation menu breadcrumb "
    "breadcrumbs footer masthead toolbar share sharing social related recommended widget pagination pager".split()
)
COMMENTS = set("comment comments reply replies disqus respond".split())
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: What an element's start tag ends if open: itself or its like, up to a border.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}),
    **{h: (set(HEADINGS), BLOCKS - set(HEADINGS)) for h in HEADINGS},
}
PARAGRAPH_BORDERS = {"td", "th", "caption", "table", "button", "object"}

_MARK = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|([!?/]))")
_ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/]|$)""", re.I)
_QUOTED = re.compile(r"""=\s*(?:"[^"]*"|'[^']*')""")
_OPEN_QUOTE = re.compile(r"""=\s*(["'])""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HOST = re.compile(r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", re.I)


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


class Element:
    __slots__ = ("children", "items", "kind", "label", "node", "tag")

    def __init__(self, tag: str, label: str, kind: str):
        self.tag, self.label, self.kind = tag, label, kind
        self.items: list = [[]]  # lists of text pieces, with an element between two of them
        self.node = None

    def add(self, element: Element) -> None:
        self.items += [element, []]


def _kind(tag: str, attributes: dict) -> str:
    """'' for content, else why not: 'comment', 'header' or 'furniture'."""
    words = {w.lower() for c in ("class", "id") for w in _WORD.findall(attributes.get(c, ""))}
    if words & COMMENTS:
        return "comment"
    hidden = "hidden" in attributes or re.search(r"display\s*:\s*none", attributes.get("style", ""))
    if hidden or tag in FURNITURE or attributes.get("role", "").lower() in ROLES:
        return "furniture"
    if tag in ("article", "main"):
        return ""
    if words & CLASSES:
        return "furniture"
    return "header" if tag == "header" or "header" in words else ""


def _tag_end(page: str, at: int) -> int:
    """Where the tag that starts before ``at`` ends: at a '>' outside of quoted values."""
    end = page.find(">", at)
    while end >= 0:
        open_quote = _OPEN_QUOTE.search(_QUOTED.sub("", page[at:end]))
        if open_quote is None:
            return end
        closing = page.find(open_quote[1], end)
        if closing < 0:
            return end
        end = page.find(">", closing)
    return len(page)


def _attributes(text: str) -> dict:
    if not text.strip(" /"):
        return {}
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)}


def _label(tag: str, attributes: dict) -> str:
    """The tag with its first class, without digits."""
    first = re.sub(r"\d+", "", (attributes.get("class") or " ").split(" ")[0])
    return f"{tag}.{first}" if first else tag


class _Builder:
    """Makes the tree of one page; inline elements are no nodes unless they are boilerplate."""

    def __init__(self):
        self.root = Element("body", "body", "")
        self.stack, self.beyond = [self.root], 0

    def text(self, piece: str) -> None:
        self.stack[-1].items[-1].append(piece)

    def _leave(self, tags: set, borders: set) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in tags:
                del self.stack[k:]
                return
            if self.stack[k].tag in borders:
                return

    def start(self, tag: str, attributes: dict) -> None:
        if tag == "br":
            return self.text(" ")
        block = tag in BLOCKS
        kind = _kind(tag, attributes)
        within = any(e.tag == tag for e in self.stack) and not block
        if not (block or kind or within) or tag in ("html", "body", "head", "input", "img"):
            return None
        if block:
            self._leave({"p"}, PARAGRAPH_BORDERS)
            if tag in ENDS:
                tags, borders = ENDS[tag]
                self._leave(tags, borders)
                if tag in ("tr", "tbody", "tfoot"):  # a row ends the cell and the row before it
                    for _ in range(2):
                        self._leave(tags, borders)
        if len(self.stack) > MAX_DEPTH:
            self.beyond += tag != "hr"
            self.stack[-1].items.append([]) if block else None
            return None
        element = Element(tag, _label(tag, attributes), kind)
        self.stack[-1].add(element)
        if tag != "hr":
            self.stack.append(element)
        return None

    def end(self, tag: str) -> None:
        if self.beyond and tag in BLOCKS:
            self.beyond -= 1
            self.stack[-1].items.append([])
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                del self.stack[k:]
                return


def parse(page: str) -> Element:
    """The tree of a page's block elements."""
    tree, at = _Builder(), 0
    while at < len(page):
        mark = _MARK.search(page, at)
        if mark is None:
            tree.text(html.unescape(page[at:]))
            break
        if mark.start() > at:
            tree.text(html.unescape(page[at : mark.start()]))
        if mark[1]:
            end = page.find("-->", mark.start() + 2)
            at = end + 3 if end >= 0 else len(page)
        elif mark[4]:
            end = page.find(">", mark.end())
            at = end + 1 if end >= 0 else len(page)
        else:
            tag, end = mark[3].lower(), _tag_end(page, mark.end())
            at = end + 1
            if mark[2]:
                tree.end(tag)
            elif tag in RAW:
                closing = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
                if not page[mark.end() : end].endswith("/"):
                    at = _tag_end(page, closing.end()) + 1 if closing else len(page)
            else:
                tree.start(tag, _attributes(page[mark.end() : end]))
    return tree.root


def _elements(top: Element, inside=lambda e: True) -> Iterator[Element]:
    """``top`` and what is in it, in page order, without what lies in elements not ``inside``."""
    yield top
    for item in top.items:
        if isinstance(item, Element) and inside(item):
            yield from _elements(item, inside)


def _shown(top: Element, in_article: bool = False) -> Iterator[Element]:
    """The elements that are no boilerplate by name, role or class."""
    yield top
    in_article = in_article or top.tag in ("article", "main")
    for item in top.items:
        if isinstance(item, Element) and (not item.kind or item.kind == "header" and in_article):
            yield from _shown(item, in_article)


def _own_blocks(element: Element) -> list[str]:
    blocks = (" ".join("".join(item).split()) for item in element.items if isinstance(item, list))
    return [b for b in blocks if b]


def _has_text(elements: list) -> bool:
    return any(_own_blocks(e) for e in elements)


def region(root: Element) -> list[Element]:
    """The roots of the main content: articles, or else ``main``, or else the page."""
    shown = list(_shown(root))
    if not any(e.tag == "article" for e in shown):  # boilerplate round the only articles is a frame
        framed = [e for e in _elements(root, lambda e: e.kind != "comment") if e.tag == "article" and not e.kind]
        if framed and _has_text([x for e in framed for x in _shown(e)]):
            return _outermost(framed)
    for tag in ("article", "main"):
        found = [e for e in shown if e.tag == tag]
        if found and _has_text([x for e in found for x in _shown(e)]):
            return _outermost(found)
    return [root]


def _outermost(found: list[Element]) -> list[Element]:
    within = {id(x) for e in found for x in _elements(e) if x is not e}
    return [e for e in found if id(e) not in within]


def _skeleton(root: Element) -> list:
    """Nested [label, children] with one node per kind of child; elements learn their node's number."""
    count = 0

    def merge(elements: list[Element]) -> list:
        nonlocal count
        for e in elements:
            e.node = count
        count += 1
        kinds: dict[str, list] = {}
        for e in elements:
            for item in e.items:
                if isinstance(item, Element):
                    kinds.setdefault(item.label, []).append(item)
        return [elements[0].label, [merge(k) for k in kinds.values()]]

    return merge([root])


def _blocks(root: Element) -> list[tuple[int, str]]:
    """Node and text of each block of the main content, in page order."""

    def walk(element: Element, in_article: bool) -> Iterator[tuple[int, str]]:
        in_article = in_article or element.tag in ("article", "main")
        for item in element.items:
            if isinstance(item, list):
                text = " ".join("".join(item).split())
                if text:
                    yield element.node, text
            elif not item.kind or item.kind == "header" and in_article:
                yield from walk(item, in_article)

    return [b for top in region(root) for b in walk(top, False)]


def _texts(root: Element, n_nodes: int) -> list:
    """A hash of all text that each node holds itself; none for nodes without."""
    digests: list = [None] * n_nodes
    for e in _elements(root):
        for block in _own_blocks(e):
            digests[e.node] = digests[e.node] or blake2b(digest_size=8)
            digests[e.node].update(block.encode("utf-8", "replace") + b"\n")
    return [d and int.from_bytes(d.digest(), "big", signed=True) for d in digests]


def _flat(skeleton: list) -> tuple[list, list, list]:
    """Labels, children and parents of a skeleton's nodes, by number."""
    labels, children, parents = [], [], []

    def visit(node: list, parent: int) -> int:
        number = len(labels)
        labels.append(node[0]), children.append([]), parents.append(parent)
        for child in node[1]:
            children[number].append(visit(child, number))
        return number

    visit(skeleton, -1)
    return labels, children, parents


def align(reference: list, skeleton: list) -> dict[int, int]:
    """Simple tree matching: the nodes of ``skeleton`` that the heaviest match ties to one of ``reference``."""
    (labels, below, _), (others, under, _) = _flat(reference), _flat(skeleton)
    tables: dict = {}

    def weight(i: int, j: int) -> int:
        if labels[i].split(".")[0] != others[j].split(".")[0]:
            return 0
        rows, columns = below[i], under[j]
        table = [[0] * (len(columns) + 1) for _ in range(len(rows) + 1)]
        for a, row in enumerate(rows):
            for b, column in enumerate(columns):
                table[a + 1][b + 1] = max(table[a][b + 1], table[a + 1][b], table[a][b] + weight(row, column))
        tables[i, j] = table
        return table[-1][-1] + 1 + (labels[i] == others[j])

    matched: dict[int, int] = {}

    def trace(i: int, j: int) -> None:
        matched[j] = i
        table, a, b = tables[i, j], len(below[i]), len(under[j])
        while a and b:
            if table[a][b] == table[a - 1][b]:
                a -= 1
            elif table[a][b] == table[a][b - 1]:
                b -= 1
            else:
                a, b = a - 1, b - 1
                trace(below[i][a], under[j][b])

    if weight(0, 0):
        trace(0, 0)
    return matched


def slots(reference: list, skeleton: list) -> list[str]:
    """A slot per node: the reference's node, or a path from the last one that has a node there."""
    matched = align(reference, skeleton)
    labels, _, parents = _flat(skeleton)
    names: list[str] = []
    for j, label in enumerate(labels):
        parent = names[parents[j]] if parents[j] >= 0 else ""
        names.append(str(matched[j]) if j in matched else f"{parent}/{label}")
    return names


def _mark(skeleton: str) -> str:
    return blake2b(skeleton.encode("utf-8", "replace"), digest_size=16).hexdigest()


def _pages(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Host, tree and skeleton of each page, one at a time."""
    for url, page in zip(batch.column("url"), batch.column("html")):
        root = parse(page.as_py() or "")
        yield host_of(url.as_py()), root, json.dumps(_skeleton(root), ensure_ascii=False)


def _survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [(c, pa.string()) for c in ("host", "mark", "skeleton")] + [("texts", pa.list_(pa.int64()))]
    )
    for batch in batches:
        rows = []
        for host, root, skeleton in _pages(batch):
            rows.append((host, _mark(skeleton), skeleton, _texts(root, 1 + max(e.node for e in _elements(root)))))
        yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)


def _name_slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("host", pa.string()), ("mark", pa.string()), ("slots", pa.list_(pa.string()))])
    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("host", "mark", "skeleton", "reference"))
        yield _batch([(h, m, slots(json.loads(r), json.loads(s))) for h, m, s, r in zip(*columns)], schema)


def induce(pages: DataFrame, share: float = SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """The wrappers: host, mark of a skeleton, and the numbers of its nodes that are template."""
    surveyed = pages.select(F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    schema = "host string, mark string, skeleton string, texts array<long>"
    seen = written(surveyed.mapInArrow(_survey, schema).distinct(), "page-shapes")
    kinds = seen.groupBy("host", "mark").agg(F.count("*").alias("pages"), F.first("skeleton").alias("skeleton"))
    best = F.max(F.struct("pages", "mark", "skeleton"))["skeleton"]
    reference = kinds.groupBy("host").agg(best.alias("reference"))
    named = written(
        kinds.join(reference, "host")
        .select("host", "mark", "skeleton", "reference")
        .mapInArrow(_name_slots, "host string, mark string, slots array<string>"),
        "page-slots",
    )
    texts = seen.select("host", "mark", F.posexplode("texts").alias("node", "text")).filter("text IS NOT NULL")
    places = named.select("host", "mark", F.posexplode("slots").alias("node", "slot"))
    counts = texts.groupBy("host", "mark", "node", "text").count().join(places, ["host", "mark", "node"])
    by_text = counts.groupBy("host", "slot", "text").agg(F.sum("count").alias("n"))
    by_slot = by_text.groupBy("host", "slot").agg(F.sum("n").alias("pages"), F.max("n").alias("most"))
    constant = by_slot.filter((F.col("pages") >= min_pages) & (F.col("most") >= share * F.col("pages")))
    fixed = places.join(constant.select("host", "slot"), ["host", "slot"])
    return fixed.groupBy("host", "mark").agg(F.collect_set("node").alias("template"))


def _storable(text: str) -> str:
    """Lone surrogates, which only broken references make, become question marks."""
    return text.encode("utf-8", "replace").decode()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages with their host, skeleton mark and main blocks; html goes."""
    block = pa.list_(pa.struct([("node", pa.int32()), ("text", pa.string())]))
    for batch in batches:
        hosts, marks, blocks = [], [], []
        for host, root, skeleton in _pages(batch):
            hosts.append(host), marks.append(_mark(skeleton))
            blocks.append([{"node": n, "text": _storable(t)} for n, t in _blocks(root)])
        columns = [pa.array(hosts, pa.string()), pa.array(marks, pa.string()), pa.array(blocks, block)]
        columns = [batch.column("page_id"), batch.column("url"), *columns]
        yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "host", "mark", "blocks"])


def extract(pages: DataFrame, share: float = SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url and main text of every page of ``pages`` (page_id, url, html).

    Texts are joined with the wrapper of their host and skeleton: a broadcast where Spark finds the
    wrappers small, else a shuffle whose large groups adaptive execution splits.
    """
    wrappers = written(induce(pages, share, min_pages), "wrappers")
    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    schema = StructType([StructField(c, rows.schema[c].dataType) for c in ("page_id", "url")])
    schema = schema.add("host", StringType()).add("mark", StringType())
    schema = schema.add("blocks", ArrayType(StructType().add("node", "integer").add("text", "string")))
    read = rows.mapInArrow(_read, schema).join(wrappers, ["host", "mark"], "left")
    varying = F.filter("blocks", lambda b: ~F.array_contains("template", b["node"]))
    kept = F.when(F.size(varying) > 0, varying).otherwise(F.col("blocks"))
    return read.select("page_id", "url", F.array_join(F.transform(kept, lambda b: b["text"]), "\n\n").alias("text"))
