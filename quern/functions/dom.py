"""The main content of an HTML page: a tree of its elements, scored candidates, and typed blocks of the best one.

The tree needs a parser and so a Python function, in Arrow batches; only the blocks come back.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Elements and words of attributes that count for or against a candidate.
SKIPPED = {"script", "style", "noscript", "template"}
NOISE_TAGS = SKIPPED | {"nav", "footer", "aside"}
CANDIDATES = {"main": 120, "article": 100, "section": 60, "body": 20, "div": 0}
POSITIVE = {"content", "article", "main", "post", "entry", "body", "markdown", "readme"}
NEGATIVE = {"nav", "menu", "sidebar", "footer", "comment", "breadcrumb", "advert", "ads"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {"p", "div", "section", "article", "main", "body", "ul", "ol", "blockquote", "pre", "figure", "header", "form", "dl", "dd", "dt"}
SCHEMA = "struct<title:string,root_tag:string,score:int,chars:int,blocks:array<struct<kind:string,text:string,level:int,section_path:string>>>"


class Node:
    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def tokens(self) -> set[str]:
        return set(filter(None, re.split(r"[^a-z0-9_-]+", " ".join(self.attrs.get(k) or "" for k in ("class", "id", "role", "aria-label", "title")).lower())))

    def noise(self) -> bool:
        if self.tag in NOISE_TAGS:
            return True
        words = self.tokens()
        return self.tag not in ("main", "article") and not words & POSITIVE and bool(words & NEGATIVE)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("document", {}, None)
        self.title: list[str] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("p", "li", "tr", "td", "th") and self.at.tag == tag:
            self.at = self.at.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        if self.at.tag == "title":
            self.title.append(data)
        elif self.at.tag not in SKIPPED:
            self.at.children.append(data)


def _texts(root: Node) -> str:
    """What is visible in an element, with single blanks."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            out.append(node)
        elif node is root or not node.noise():
            stack += reversed(node.children)
    return " ".join(" ".join(out).split())


def score(node: Node, visible: int, linked: int) -> int:
    """The score of a candidate, of its visible characters and those in links."""
    words = node.tokens()
    found = CANDIDATES[node.tag] + 35 * len(words & POSITIVE) - 80 * len(words & NEGATIVE) + min(120, visible // 80)
    return found - 60 * (linked > max(40, 0.6 * visible))


def _nodes(root: Node):
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]


def lengths(root: Node) -> dict[int, tuple[int, int]]:
    """Visible characters of each element below root (by id), and those in its links, with single blanks: added up once, from the leaves."""
    sums: dict[int, tuple[int, int, int, int]] = {}  # characters and words, all and in links
    for node in reversed(list(_nodes(root))):
        c = w = lc = lw = 0
        for x in node.children:
            if isinstance(x, str):
                words = x.split()
                c, w = c + sum(map(len, words)), w + len(words)
            elif not x.noise():
                xc, xw, xlc, xlw = sums[id(x)]
                c, w = c + xc, w + xw
                lc, lw = (lc + xc, lw + xw) if x.tag == "a" else (lc + xlc, lw + xlw)
        sums[id(node)] = (c, w, lc, lw)
    return {k: (c + max(0, w - 1), lc + max(0, lw - 1)) for k, (c, w, lc, lw) in sums.items()}


def pick(root: Node) -> tuple[Node, int, int]:
    """The best candidate with its score and characters; the body if none is above nothing."""
    body = next((n for n in _nodes(root) if n.tag == "body"), root)
    size = lengths(body)
    best, key = body, (0, 0)
    for node in _nodes(body):
        if node.tag in CANDIDATES and not node.noise():
            visible, linked = size[id(node)]
            own = (score(node, visible, linked), visible)
            if own > key:
                best, key = node, own
    return best, *(key if key > (0, 0) else (0, size[id(body)][0]))


def _inline(node: Node) -> str:
    """The text of a block: links as `text (target)`, breaks as line ends, without the blocks inside."""
    out = []
    for c in node.children:
        if isinstance(c, str):
            out.append(re.sub(r"\s+", " ", c))
        elif c.tag == "br":
            out.append("\n")
        elif c.tag == "a" and c.attrs.get("href"):
            text = _inline(c).strip()
            out.append(f"{text} ({c.attrs['href']})" if text else "")
        elif c.tag not in BLOCKS and c.tag not in ("table", "li") and not re.fullmatch("h[1-6]", c.tag) and not c.noise():
            out.append(_inline(c))
    return "".join(out)


def blocks(root: Node) -> list[dict]:
    """Headings, paragraphs, list items and tables in their order, each under the titles that are open."""
    out: list[dict] = []
    path: list[tuple[int, str]] = []

    def add(kind: str, text: str, level: int = 0) -> None:
        text = "\n".join(x for x in (" ".join(y.split()) for y in text.split("\n")) if x)
        if not text:
            return
        if kind == "heading":
            del path[next((i for i, (n, _) in enumerate(path) if n >= level), len(path)) :]
            path.append((level, text))
        out.append({"kind": kind, "text": text, "level": level, "section_path": " / ".join(t for _, t in path)})

    stack: list[tuple[Node, int]] = [(root, 0)]
    while stack:
        node, depth = stack.pop()
        if node is not root and node.noise():
            continue
        if re.fullmatch("h[1-6]", node.tag):
            add("heading", _texts(node), int(node.tag[1]))
            continue
        if node.tag == "table":
            rows = [" | ".join(_texts(c) for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")) for r in _nodes(node) if r.tag == "tr"]
            add("table", "\n".join(rows))
            continue
        if node.tag == "li":
            depth += 1
            add("list_item", _inline(node), depth)
        elif node.tag in BLOCKS or node is root:
            add("paragraph", _inline(node))
        stack += [(c, depth) for c in reversed(node.children) if isinstance(c, Node)]
    return out


def _parse(pages: pd.Series) -> pd.DataFrame:
    rows = []
    for page in pages:
        builder = _Builder()
        builder.feed(page or "")
        builder.close()
        root, points, chars = pick(builder.root)
        rows.append({"title": " ".join("".join(builder.title).split()), "root_tag": root.tag, "score": points, "chars": chars, "blocks": blocks(root)})
    return pd.DataFrame(rows, columns=["title", "root_tag", "score", "chars", "blocks"])


def main_content(html: Column) -> Column:
    """struct<title, root_tag, score, chars, blocks> of a page; a null page is an empty one."""
    return F.pandas_udf(_parse, SCHEMA)(html)
