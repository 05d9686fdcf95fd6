"""Main-text extraction with a tree-structured graphical model.

The block elements of a page and its runs of text form a tree. Each node is content or not; node
potentials come from its tag, names and shape, and a potential on each parent-child edge says how
labels go together, by kind of child. Sum-product messages, upward from the leaves and downward
from the root, give each run's exact marginal of being content; runs above one half are the text.
Weights are fitted by maximum likelihood on labelled pages, with the same messages.

Names tell most where authors give them. A page is bare if little of its text lies in an element
whose tag or name tells that it holds content; there the shape of each run (size, links, ending,
share of the page) speaks too, and edges have potentials of their own.

Scale: a map over pages without any exchange. The parser looks at no character more than a fixed
number of times; the trees of a batch are laid into arrays and the messages of one depth are passed
at once, so the cost is linear in the characters and nodes, however deep a page.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.shipping import ship

from .common import slices, tidied
from .html_pages import CONTENT_SIGN, labelled_pages

_BLOCKS = frozenset(
    "html body article section main div nav aside header footer form fieldset p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption "
    "thead tbody tfoot tr td th blockquote pre figure figcaption address details summary hr center dialog menu search legend "
    "button label select option optgroup noscript".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no tags and no text of the page: they end at the first end tag, or with the page.
_RAW = frozenset("script style textarea title iframe noembed noframes".split())
#: Elements that hold tags but nothing that a page shows; without an end tag the start tag means nothing.
_SKIPPED = frozenset("template annotation annotation-xml".split())
_HEADED = frozenset(
    "address article aside blockquote center details dialog div dl dt dd fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav "
    "ol p pre search section table ul".split()
)
#: Start tags that end open elements of the given tags, up to the nearest of the ancestors that stop the search.
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "tbody": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "td", "th"), ("table",)),
    "option": (("option",), ("select",)),
}
#: End tags of other elements, and start tags that end a paragraph, do not reach beyond these.
_SCOPES = ("td", "th", "caption", "button")
_TABLES = frozenset("table thead tbody tfoot tr td th caption button html body".split())
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+)*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_NAME = re.compile(r"""\b(class|id|role)\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"']++))""", re.I)
_WORD = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_LONG_NUMBER = re.compile(r"&#[0-9]{8,};?")

# Tags and words of names by which authors tell what an element holds.
_CONTENT_TAGS = frozenset(["article", "main"])
_CONTENT_NAMES = frozenset(["article", "content", "entry", "main", "post", "story"])
_JUNK_TAGS = frozenset(["aside", "button", "dialog", "footer", "form", "header", "menu", "nav", "noscript", "search", "select"])
_JUNK_ROLES = frozenset(["alert", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "navigation", "search"])
_JUNK_NAMES = frozenset([
    "ad", "ads", "adv", "advert", "advertisement", "advertising", "aside", "banner", "breadcrumb", "colophon", "comment", "comments", "consent", "cookie", "copyright",
    "discussion", "disqus", "foot", "footer", "form", "gdpr", "header", "legal", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter",
    "notice", "notification", "overlay", "pager", "pagination", "paywall", "popup", "privacy", "promo", "promotion", "recommended", "related", "replies", "responses",
    "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subnav", "subscribe", "tabs", "tags", "toc", "topbar", "topnav", "trending",
    "widget",
])
_FREE, _JUNK, _CONTENT = 0, 1, 2

_FEATURES = 1 << 13
_KINDS = {"run": 0, "p": 1, "heading": 2, "list": 3, "container": 4, "other": 5}
#: Nodes of bare pages that nothing names have kinds of their own: those above, plus this.
_BARE = len(_KINDS)
N_KINDS = 2 * _BARE


class Tree:
    """Nodes of one page, parents before children."""

    __slots__ = ("parent", "depth", "features", "kind", "told", "texts", "signed", "bare")

    def __init__(self):
        self.parent: list[int] = []
        self.depth: list[int] = []
        self.features: list[list[str]] = []
        self.kind: list[int] = []
        #: What the tags and names of a node and those above it tell: nothing, junk or content.
        self.told: list[int] = []
        self.texts: dict[int, str] = {}
        self.signed: set[int] = set()
        self.bare = False

    def add(self, parent: int, kind: str, features: list[str], told: int = _FREE) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1 if parent >= 0 else 0)
        self.kind.append(_KINDS[kind])
        self.features.append(features)
        self.told.append(told)
        return len(self.parent) - 1


def _kind(tag: str) -> str:
    if tag in ("p", "pre", "blockquote"):
        return "p"
    if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
        return "heading"
    if tag in ("ul", "ol", "li", "dl", "dt", "dd", "table", "tr", "td", "th", "thead", "tbody", "tfoot"):
        return "list"
    if tag in ("div", "section", "article", "main", "body", "html", "center"):
        return "container"
    return "other"


def _element(tag: str, attributes: str, told: int) -> tuple[list[str], int]:
    """Features of an element, and what it and those above it (told) tell."""
    # What paragraphs, headings and lists are, their parents decide: evidence that all children
    # of an element share would otherwise count once for each of them.
    out = ["tag=" + tag] if _kind(tag) in ("container", "other") else []
    if tag in _CONTENT_TAGS:
        told = told or _CONTENT
    elif tag in _JUNK_TAGS:
        told = told or _JUNK
    # The names of a whole page tell what kind of page it is.
    if attributes and tag not in ("html", "body"):
        for m in _NAME.finditer(attributes):
            value = m[2] or m[3] or m[4] or ""
            if m[1].lower() == "role":
                role = value.strip().lower()
                out.append("role=" + role)
                told = told or (_CONTENT if role in _CONTENT_TAGS else _JUNK if role in _JUNK_ROLES else _FREE)
                continue
            # Capitals part words in names, as hyphens do.
            words = set(_WORD.findall(_CAMEL.sub(" ", value).lower()))
            out += ["name=" + (w[:-1] if len(w) > 3 and w[-1] == "s" else w) for w in words]
            if not told:
                told = _JUNK if words & _JUNK_NAMES else _CONTENT if words & _CONTENT_NAMES else _FREE
    return out, told


def _link(text: str, linked: int) -> str:
    share = linked / max(1, len(text))
    return "none" if not linked else "all" if share > 0.9 else "most" if share > 0.5 else "some"


def _run_features(tag: str, text: str, linked: int) -> list[str]:
    out = [f"link={_link(text, linked)}"]
    if _kind(tag) in ("container", "other"):
        n = text.count(" ") + 1
        size = "1" if n == 1 else "4" if n < 5 else "12" if n < 13 else "30" if n < 31 else "big"
        out += [f"in={tag}", f"in={tag}|size={size}"]
    if "©" in text:
        out.append("copyright")
    return out


def _shape(tag: str, text: str, linked: int, total: int) -> list[str]:
    """What the shape of a run on a bare page says, total being the words of the page."""
    kind, link, n = _kind(tag), _link(text, linked), text.count(" ") + 1
    size = "1" if n == 1 else "4" if n < 5 else "12" if n < 13 else "30" if n < 31 else "big"
    part = n / max(1, total)
    share = "most" if part > 0.5 else "much" if part > 0.15 else "some" if part > 0.03 else "little"
    end = "end" if text[-1] in ".!?:…\"”»'’)。" else "open"
    return ["bare", f"bare|{kind}|link={link}", f"bare|{kind}|size={size}", f"bare|share={share}", f"bare|{end}|size={size}", f"bare|link={link}|size={size}"] + ["bare|h1"] * (tag == "h1")


def _ends(page: str, tag: str) -> dict[int, int]:
    """Where each element of the tag that has an end tag ends, by its start; elements may be nested."""
    out: dict[int, int] = {}
    opened: list[int] = []
    for m in re.compile(rf"<(/?){tag}(?![\w:-])([^<>]*+)>?", re.I).finditer(page):
        if m[1]:
            if opened:
                out[opened.pop()] = m.end()
        elif not m[2].endswith("/"):
            opened.append(m.start())
    return out


def _decoded(chunk: str) -> str:
    """One text node with its character references decoded."""
    if "&" not in chunk:
        return chunk
    return html.unescape(_LONG_NUMBER.sub("�", chunk) if "&#" in chunk else chunk)


class _Stack:
    """Open elements, with the places of each tag, so that every search is one look at a list's end."""

    def __init__(self, root: int):
        self.tags, self.nodes = ["html"], [root]
        self.at: dict[str, list[int]] = {"html": [0]}

    def push(self, tag: str, node: int) -> None:
        self.at.setdefault(tag, []).append(len(self.tags))
        self.tags.append(tag)
        self.nodes.append(node)

    def nearest(self, tags: tuple[str, ...]) -> int:
        """The place of the innermost open element of the tags, or 0."""
        return max([found[-1] for t in tags if (found := self.at.get(t))], default=0)

    def outermost_after(self, tags: tuple[str, ...], place: int) -> int:
        """The place of the outermost open element of the tags beyond a place, or 0."""
        found = [places[k] for t in tags if (places := self.at.get(t)) and (k := bisect.bisect_right(places, place)) < len(places)]
        return min(found, default=0)

    def cut(self, place: int) -> None:
        for tag in self.tags[place:]:
            self.at[tag].pop()
        del self.tags[place:], self.nodes[place:]


def parse(page: str) -> Tree:
    """The tree of a page, in time linear in its length. Never fails: whatever is no tag is text, an unfinished tag at the end is dropped."""
    tree = Tree()
    stack = _Stack(tree.add(-1, "container", ["tag=html"]))
    parts: list[str] = []
    shapes: list[tuple[int, str, int]] = []
    linked, in_link = 0, False
    pos, end = 0, len(page)
    ends: dict[str, dict[int, int]] = {}
    pattern = _TAG

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                tag, node = stack.tags[-1], stack.nodes[-1]
                told = tree.told[node]
                run = tree.add(node, "run", _run_features(tag, text, linked), told)
                tree.texts[run] = text
                shapes.append((run, tag, linked))
        linked = 0

    while pos < end:
        lt = page.find("<", pos)
        if lt < 0:
            lt = end
        if lt > pos:
            chunk = _decoded(page[pos:lt])
            parts.append(chunk)
            if in_link:
                linked += len(chunk)
        if lt == end:
            break
        if page.startswith("<!--", lt):
            close = page.find("-->", lt + 2)
            pos = end if close < 0 else close + 3
            continue
        following = page[lt + 1 : lt + 2]
        if following in ("!", "?"):
            close = page.find(">", lt)
            pos = end if close < 0 else close + 1
            continue
        m = pattern.match(page, lt) if following == "/" or following.isalpha() else None
        if m is None:
            if following == "/" or following.isascii() and following.isalpha():
                # Quotes that hide all later ends of tags are none: from here on a tag ends at its first >.
                pattern = _PLAIN_TAG
                m = pattern.match(page, lt)
                if m is None:
                    close = page.find(">", lt)
                    pos = end if close < 0 else close + 1
                    continue
            else:
                parts.append("<")
                pos = lt + 1
                continue
        pos = m.end()
        closing, tag, attributes = m[1], m[2].lower(), m[3]
        if tag in _RAW:
            if not closing and not attributes.endswith("/"):
                done = re.compile(rf"</{tag}\s*>?", re.I).search(page, pos)
                pos = end if done is None else done.end()
            continue
        if tag in _SKIPPED:
            if not closing and not attributes.endswith("/"):
                if tag not in ends:
                    ends[tag] = _ends(page, tag)
                pos = ends[tag].get(lt, pos)
            continue
        if tag == "a":
            in_link = not closing
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in _BLOCKS:
            continue
        if closing:
            place = stack.nearest((tag,))
            if place and (tag in _TABLES or place > stack.nearest(_SCOPES)):
                flush()
                stack.cut(place)
            elif tag == "p":
                flush()  # it stands for an empty paragraph
            in_link = False
            continue
        if tag == "html":
            continue
        flush()
        in_link = False
        if tag not in ("option", "optgroup", "hr"):
            place = stack.nearest(("select",))  # one that nothing ended holds no other blocks
            if place:
                stack.cut(place)
        if tag in _HEADED:
            place = stack.nearest(("p",))
            if place > stack.nearest(_SCOPES):
                stack.cut(place)
        if tag in _CLOSES:
            closed, stop = _CLOSES[tag]
            place = stack.outermost_after(closed, stack.nearest(stop))
            if place:
                stack.cut(place)
        if tag in _VOID:
            continue
        node = stack.nodes[-1]
        features, told = _element(tag, attributes, tree.told[node])
        stack.push(tag, tree.add(node, _kind(tag), features, told))
        if CONTENT_SIGN in attributes:
            tree.signed.add(stack.nodes[-1])
    flush()
    words = [0, 0, 0]
    for run, text in tree.texts.items():
        words[tree.told[run]] += text.count(" ") + 1
    tree.bare = 3 * words[_CONTENT] < words[_FREE]
    if tree.bare:
        for i, told in enumerate(tree.told):
            if not told:
                tree.kind[i] += _BARE
        for run, tag, n in shapes:
            if not tree.told[run]:
                tree.features[run] += _shape(tag, tree.texts[run], n, sum(words))
    return tree


def _slot(name: str) -> int:
    import zlib

    return zlib.crc32(name.encode()) % _FEATURES


_slots: dict[str, int] = {}


def _feature_slot(name: str) -> int:
    found = _slots.get(name)
    if found is None:
        if len(_slots) > 100_000:
            _slots.clear()
        found = _slots[name] = _slot(name)
    return found


class Forest:
    """Trees of many pages in arrays, with the nodes of each depth together."""

    def __init__(self, trees: list[Tree]):
        parent, depth, kind, owner, slot, self.first = [], [], [], [], [], []
        for t in trees:
            base = len(parent)
            self.first.append(base)
            parent += [p + base if p >= 0 else -1 for p in t.parent]
            depth += t.depth
            kind += t.kind
            for i, features in enumerate(t.features):
                owner += [base + i] * len(features)
                slot += map(_feature_slot, features)
        self.n = len(parent)
        self.parent, self.kind = np.array(parent, dtype=np.int64), np.array(kind, dtype=np.int64)
        self.owner, self.slot = np.array(owner, dtype=np.int64), np.array(slot, dtype=np.int64)
        depths = np.array(depth, dtype=np.int64)
        order = np.argsort(depths, kind="stable")
        edges = np.searchsorted(depths[order], np.arange(1, (depths.max() if self.n else 0) + 2))
        self.levels = [order[a:b] for a, b in zip(edges, edges[1:])]

    def marginals(self, weights: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each node and P(parent label, own label) of each edge, by sum-product in the log domain."""
        unary = np.zeros((self.n, 2))
        unary[:, 1] = np.bincount(self.owner, weights[self.slot], self.n)
        pair = edge[self.kind]
        inward, up = unary.copy(), np.zeros((self.n, 2))
        for level in reversed(self.levels):
            up[level] = np.logaddexp(pair[level, :, 0] + inward[level, None, 0], pair[level, :, 1] + inward[level, None, 1])
            np.add.at(inward, self.parent[level], up[level])
        belief, joint = inward.copy(), np.full((self.n, 2, 2), -np.inf)
        for level in self.levels:
            outside = belief[self.parent[level]] - up[level]
            both = outside[:, :, None] + pair[level] + inward[level][:, None, :]
            joint[level] = both
            belief[level] = np.logaddexp(both[:, 0], both[:, 1])
        p = 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -500, 500)))
        total = joint.reshape(self.n, 4).max(axis=1)
        total = np.where(np.isfinite(total), total, 0)[:, None, None]
        joint = np.exp(joint - total)
        return p, joint / np.maximum(joint.sum(axis=(1, 2), keepdims=True), 1e-300)


def _labels(tree: Tree) -> list[int]:
    """Labels of all nodes of a labelled page. An element is content if it holds content and lies in
    a signed element or is one, is a block of its own (a paragraph, list, heading) without any junk,
    or, where nothing names it on a bare page, most of its text is content."""
    n = len(tree.parent)
    good, bad, label = [0] * n, [0] * n, [0] * n
    good_words, words = [0] * n, [0] * n
    for i in range(n - 1, -1, -1):
        if i in tree.texts:
            good[i] = int("\ue001" in tree.texts[i])
            bad[i] = 1 - good[i]
            words[i] = tree.texts[i].count(" ") + 1
            good_words[i] = words[i] * good[i]
        if (p := tree.parent[i]) >= 0:
            good[p] += good[i]
            bad[p] += bad[i]
            good_words[p] += good_words[i]
            words[p] += words[i]
    for i in range(n):
        inside = tree.parent[i] >= 0 and label[tree.parent[i]] and tree.kind[i] < _BARE
        whole = not bad[i] and tree.kind[i] != _KINDS["container"]
        mostly = tree.kind[i] >= _BARE and 2 * good_words[i] > words[i]
        label[i] = int(good[i] > 0 and (i in tree.texts or i in tree.signed or inside or whole or mostly))
    return label


def _edges(odds: np.ndarray) -> np.ndarray:
    """Log of P(own label | parent's label) from log odds by kind and parent's label."""
    return np.stack([-np.logaddexp(0, odds), -np.logaddexp(0, -odds)], axis=2)


def train(pages: int = 800, steps: int = 200, seed: int = 7) -> dict[str, np.ndarray]:
    """Weights by maximum likelihood (with a small L2 penalty) over labelled pages."""
    trees = [parse(p) for p in labelled_pages(pages, seed)]
    label = np.array([y for t in trees for y in _labels(t)])
    for t in trees:
        for i, text in t.texts.items():
            t.texts[i] = text.replace("\ue000", "").replace("\ue001", "")
    forest = Forest(trees)
    own = np.bincount(forest.slot, label[forest.owner], _FEATURES)
    child = np.flatnonzero(forest.parent >= 0)
    flat = forest.kind[child] * 4 + label[forest.parent[child]] * 2 + label[child]
    seen = np.bincount(flat, minlength=4 * N_KINDS).reshape(-1, 2, 2)
    # An edge's potential is P(own label | parent's label), by kind: a child without evidence has no say.
    weights, odds = np.zeros(_FEATURES), np.zeros((N_KINDS, 2))
    m = [np.zeros_like(weights), np.zeros_like(odds)]
    v = [np.zeros_like(weights), np.zeros_like(odds)]
    for step in range(1, steps + 1):
        edge = _edges(odds)
        p, joint = forest.marginals(weights, edge)
        expected = np.stack([np.bincount(forest.kind[child], joint[child, a, b], N_KINDS) for a in (0, 1) for b in (0, 1)], axis=1).reshape(-1, 2, 2)
        left, one = seen - expected, np.exp(edge[:, :, 1])
        gradients = (
            own - np.bincount(forest.slot, p[forest.owner], _FEATURES) - 0.3 * weights,
            left[:, :, 1] * (1 - one) - left[:, :, 0] * one - 0.3 * odds,
        )
        for k, (x, g) in enumerate(zip((weights, odds), gradients)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            x += 0.2 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return {"weights": weights, "edge": _edges(odds)}


_model: dict[str, np.ndarray] = {}


def model() -> dict[str, np.ndarray]:
    """The model, trained once per driver process."""
    if not _model:
        _model.update(train())
    return _model


def main_texts(pages: list[str], fitted: dict[str, np.ndarray]) -> list[str]:
    trees = [parse(p) for p in pages]
    if not trees:
        return []
    forest = Forest(trees)
    p, _ = forest.marginals(fitted["weights"], fitted["edge"])
    return ["\n".join([text for i, text in t.texts.items() if p[first + i] >= 0.5]) for t, first in zip(trees, forest.first)]


def _extract(fitted: dict[str, np.ndarray]):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = main_texts(batch.column(2).to_pylist(), fitted)
            sizes = pa.array(map(len, texts), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], ["id", "url", "text", "n_chars"])

    return extract


def extract_main_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", fitted: dict[str, np.ndarray] | None = None
) -> DataFrame:
    """One row per row of pages: id, url, text, n_chars (code points).

    A null or empty page, or one without content, has the empty text. Rows are independent: repeated
    and null ids are returned as they come. Other columns are not read.
    """
    ship(pages.sparkSession)
    source = pages.select(
        F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")
    )
    out = source.mapInArrow(tidied(_extract(fitted or model())), "id bigint, url string, text string, n_chars bigint")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
