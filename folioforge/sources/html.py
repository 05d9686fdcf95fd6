"""HTML pages to content items, with the standard library's parser in Arrow batches.

The parser needs whole pages and keeps state, which no expression can; everything after it works
on flat items (page, sec_idx, item_idx, type, ..).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.shipping import ship

#: Pages whose items a worker holds at once.
SLICE = 64

#: (pattern, text) of character references, read in this order.
References = tuple[tuple[str, str], ...]

_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


@dataclass(frozen=True)
class Selectors:
    """Where a page keeps its parts: (tag, class), class None for any.

    references: None for HTML's, which take a name without its semicolon as well; else the only ones, any other & is text.
    """

    containers: tuple[tuple[str, str | None], ...] = (("div", "chapter"), ("div", "document"))
    chapter_title: str = "h2"
    section: tuple[str, str | None] = ("div", "section")
    section_title: str = "h3"
    paragraph: tuple[str, str | None] = ("div", "para")
    paragraph_text: tuple[str, str | None] = ("p", "p")
    figure: tuple[str, str | None] = ("div", "figure")
    caption: tuple[str, str | None] = ("div", "caption")
    equation: tuple[str, str | None] = ("div", "equation")
    references: References | None = None


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def fits(self, selector: tuple[str, str | None]) -> bool:
        tag, name = selector
        return self.tag == tag and (name is None or name in self.attrs.get("class", "").split())

    def walk(self) -> Iterator[Node]:
        """All elements below, in page order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def first(self, selector: tuple[str, str | None]) -> Node | None:
        return next((n for n in self.walk() if n.fits(selector)), None)

    def texts(self, without: frozenset[str] = frozenset()) -> list[str]:
        out: list[str] = []
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in without:
                stack.extend(reversed(x.children))
        return out


class TreeBuilder(HTMLParser):
    """A forgiving tree: unknown end tags are ignored, open elements end with their parents."""

    def __init__(self, references: References | None = None):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("", {}, None)
        self.references = references

    def read(self, page: str) -> None:
        # With references of its own a page's & pass the parser as &amp;, so that it reads none itself.
        self.feed(page if self.references is None else page.replace("&", "&amp;"))
        self.close()

    def decoded(self, text: str) -> str:
        if self.references is None or "&" not in text:
            return text
        return reduce(lambda t, rule: re.sub(*rule, t), self.references, text)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: self.decoded(v or "") for k, v in attrs}, self.now)
        if tag == "p":
            up = self.now
            if up.tag == "p":
                node.parent = self.now = up.parent or self.root
        self.now.children.append(node)
        if tag not in _VOID:
            self.now = node

    def handle_startendtag(self, tag, attrs):
        self.now.children.append(Node(tag, {k: self.decoded(v or "") for k, v in attrs}, self.now))

    def handle_endtag(self, tag):
        up: Node | None = self.now
        while up is not None and up.tag != tag:
            up = up.parent
        if up is not None and up.parent is not None:
            self.now = up.parent

    def handle_data(self, data):
        if self.references is not None:
            # Scripts and styles have no references, so there the parser leaves &amp;.
            data = data.replace("&amp;", "&") if self.cdata_elem else self.decoded(data)
        self.now.children.append(data)


def parse_tree(page: str, references: References | None = None) -> Node:
    builder = TreeBuilder(references)
    builder.read(page or "")
    # A parent counts while the tree grows only; without it a tree is no cycle and goes with its page.
    for node in builder.root.walk():
        node.parent = None
    return builder.root


def math_text(node: Node) -> str:
    """Text with math kept: inline scripts as $..$, display ones as $$..$$, rendered math skipped."""
    parts: list[str] = []
    stack: list[Node | str] = list(reversed(node.children))
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            flat = " ".join(x.split())
            if flat:
                parts.append(flat)
        elif x.tag == "script":
            source = "".join(x.texts()).strip()
            kind = x.attrs.get("type", "")
            if kind == "math/tex":
                parts.append(f"${source}$")
            elif kind == "math/tex; mode=display":
                parts.append(f"$${source}$$")
            elif source:
                parts.append(" ".join(source.split()))
        elif not (x.tag == "span" and "MathJax" in x.attrs.get("class", "")):
            stack.extend(reversed(x.children))
    return " ".join(parts)


def bare_title(node: Node | None) -> str:
    """A heading's text without the bodies of span, sup and a."""
    return "".join(node.texts(frozenset(("span", "sup", "a")))).strip() if node is not None else ""


FIELDS = ("sec_idx", "item_idx", "section_title", "type", "text", "src", "caption", "latex")


def page_items(page: str, s: Selectors) -> tuple[str, list[tuple]]:
    """(chapter title, items) of a page; no container, no items."""
    root = parse_tree(page, s.references)
    top = next((n for c in s.containers if (n := root.first(c)) is not None), None)
    if top is None:
        return "", []
    title, out = bare_title(top.first((s.chapter_title, None))), []
    seen: dict[int, int] = {}

    def content(holder: Node, sec_idx: int, section_title: str) -> None:
        for child in holder.children:
            if not isinstance(child, Node):
                continue
            item: tuple | None = None
            if child.fits(s.paragraph):
                found = child if s.paragraph == s.paragraph_text else child.first(s.paragraph_text)
                text = math_text(found) if found is not None else ""
                item = ("paragraph", text, None, None, None) if text.strip() else None
            elif child.fits(s.figure):
                img, caption = child.first(("img", None)), child.first(s.caption)
                src = (img.attrs.get("src") or img.attrs.get("data-src")) if img is not None else None
                if src:
                    cap = "".join(x.strip() for x in caption.texts()) if caption is not None else ""
                    item = ("figure", None, "images/" + src.rsplit("/", 1)[-1], cap, None)
            elif child.fits(s.equation):
                script = next((n for n in child.walk() if n.tag == "script" and "math/tex" in n.attrs.get("type", "")), None)
                latex = "".join(script.texts()).strip() if script is not None else ""
                latex = latex or "".join(x.strip() for x in child.texts())
                item = ("equation", None, None, None, latex) if latex else None
            if item is not None:
                out.append((sec_idx, seen.get(sec_idx, 0), section_title, *item))
                seen[sec_idx] = seen.get(sec_idx, 0) + 1

    content(top, 0, "")
    sections = [c for c in top.children if isinstance(c, Node) and c.fits(s.section)]
    for k, sec in enumerate(sections, 1):
        content(sec, k, bare_title(sec.first((s.section_title, None))))
    return title, out


_ITEMS = "id string, chapter_title string, sec_idx int, item_idx int, section_title string, type string, text string, src string, caption string, latex string"


def content_items(pages: DataFrame, id_col: str, html_col: str, selectors: Selectors | None = None) -> DataFrame:
    """(id, chapter_title, sec_idx, item_idx, section_title, type, text, src, caption, latex) of each page's content."""
    ship(pages.sparkSession)
    chosen = selectors or Selectors()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.string(), pa.string(), pa.int32(), pa.int32(), *[pa.string()] * 6)
        for batch in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            rows = [(i.as_py(), t, *r) for i, h in zip(batch.column(0), batch.column(1)) for t, items in [page_items(h.as_py() or "", chosen)] for r in items]
            columns = list(zip(*rows)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["id", "chapter_title", *FIELDS])

    source = pages.select(F.col(id_col).cast("string").alias("id"), F.col(html_col).cast("string").alias("html"))
    out = source.mapInArrow(parse, _ITEMS)
    return out.withColumn("id", F.col("id").cast(pages.schema[id_col].dataType)).withColumnRenamed("id", id_col)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, html) of HTML files, one row each."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("html"))


def page_url(base: str, volume, chapter):
    """URL of a chapter's page: {base}/{volume}_{chapter, two digits}.html."""
    return F.format_string("%s/%s_%02d.html", F.lit(base.rstrip("/")), volume, chapter)
