"""Reading html pages: their text without navigation, and their links."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fojas.functions.urls import DOCUMENT_ENDINGS, NO_LINKS

# --- fixed values: elements that go, classes that mark navigation, containers of the content, elements that start a line ---
DROPPED = frozenset("script style nav header footer form noscript iframe svg aside button".split())
NOISE = re.compile(
    "menu|nav|breadcrumb|sidebar|skip|region-header|region-footer|region-navigation|region-services|region-sidebar|block-search"
    "|panel|pager|tabs|social|banner|cookie|submenu|dhtml", re.I,
)
CONTAINERS = ("main", "article", ".region-content", "#content", ".view-content", ".main-container")
BLOCKS = frozenset("p div section article li tr br h1 h2 h3 h4 h5 h6 table td th".split())
# --- end of fixed values ---
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_NO_LINKS = re.compile(NO_LINKS)


class _Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []


class _Tree(HTMLParser):
    """A light tree; end tags that match nothing are ignored, open elements end with their parent."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = _Node("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(_Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


def _kept(node: _Node) -> bool:
    ident = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}".strip()
    return node.tag not in DROPPED and not (ident and NOISE.search(ident))


def _walk(node: _Node) -> Iterator[_Node]:
    todo = [node]
    while todo:
        n = todo.pop()
        yield n
        todo += [c for c in reversed(n.children) if isinstance(c, _Node) and _kept(c)]


def _matches(n: _Node, selector: str) -> bool:
    if selector[0] == ".":
        return selector[1:] in n.attrs.get("class", "").split()
    if selector[0] == "#":
        return n.attrs.get("id") == selector[1:]
    return n.tag == selector


def page_text(html: str) -> str:
    """The text of a page's content: one line a block, single spaces, no blank lines."""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    nodes = list(_walk(tree.root))
    top = next((n for s in CONTAINERS for n in nodes if _matches(n, s)), None) or next((n for n in nodes if n.tag == "body"), tree.root)
    out: list[str] = []
    todo: list = [top]
    while todo:
        n = todo.pop()
        if isinstance(n, str):
            out.append(n)
            continue
        if n.tag in BLOCKS:
            out.append("\n")
        todo += [c for c in reversed(n.children) if isinstance(c, str) or _kept(c)]
    lines = (re.sub("[ \t\u00a0]+", " ", x).strip() for x in " ".join(out).split("\n"))
    return "\n".join(x for x in lines if x)


def page_links(html: str, base: str) -> tuple[list[str], list[str]]:
    """Addresses of pages and of documents on the page's host, each sorted and once."""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    host, pages, documents = urlparse(base).netloc, set(), set()
    todo = [tree.root]
    while todo:
        n = todo.pop()
        todo += [c for c in n.children if isinstance(c, _Node)]
        href = n.attrs.get("href", "").strip() if n.tag == "a" else ""
        if not href or _NO_LINKS.match(href):
            continue
        url = urljoin(base, href)
        if host and host not in urlparse(url).netloc:
            continue
        (documents if urlparse(url).path.lower().endswith(DOCUMENT_ENDINGS) else pages).add(url)
    return sorted(pages), sorted(documents)


def html_texts(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id_col, texto): the content of every page; null html gives null."""
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if h is None else page_text(h) for h in b.column("html").to_pylist()]
            yield pa.record_batch({"id": b.column("id"), "texto": pa.array(texts, pa.string())})

    return pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInArrow(run, f"id {kind}, texto string").withColumnRenamed("id", id_col)


def html_links(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(desde, hasta, documento boolean): the links of every page; pages without html or address have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for u, h in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True):
                found = page_links(h, u)
                rows += [(u, x, False) for x in found[0]] + [(u, x, True) for x in found[1]]
            a, c, d = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch({"desde": pa.array(a, pa.string()), "hasta": pa.array(c, pa.string()), "documento": pa.array(d, pa.bool_())})

    base = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).filter("url IS NOT NULL AND html IS NOT NULL")
    return base.mapInArrow(run, "desde string, hasta string, documento boolean")
