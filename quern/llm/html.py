"""HTML extraction (operator 7): line-block distribution.

Markup is stripped into lines, one per block element, scripts and styles with it. A line weighs the
characters of its text that are no links; one that is mostly links weighs nothing, nor does one that
its element, role, class or id hints to be a menu, header, footer, sidebar, notice, advert, form or
comment. Over the lines slides a window that adds up weights. Where the sum rises from nothing a
block of the page begins, where it falls back to nothing it ends; within it the text surges where the
sum first reaches a threshold and dives where it last does. The block with the most weight holds the
article. Lines between surge and dive are kept, however short or linked, and so are the short ones
before and after that lie in the same parent as they. A block that surges in an article or main
element stands for all of that element. Blocks of one parent are one block, whatever lies between
them and however they are wrapped.

A class or id decides by itself only if all of its words say what part of a page a container is (a
comment list, an advert box, a cookie notice). With any other word in it, or on an element of text,
it needs the text's consent: what has a sentence of its own outside links is kept, and none of them
makes an article noise.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from os.path import commonprefix
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import arrow_map, read

#: Lines in a window, and empty lines round what is hinted to be no part of the article.
WINDOW = 3
GAP = WINDOW
#: Characters of a window at which text surges and dives; on a page of short lines a share of its largest window.
SURGE, SHARE = 40, 0.2
#: Layout elements further down belong to the last one that counts.
DEEPEST = 512
#: Characters outside links from which an element stays that is noise by a vague hint alone, and the share of the largest article's weight from which another one of the same main element belongs to it.
ENOUGH = 60
PART = 0.25

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>"']|"[^"]*"|'[^']*')*+)>""", re.S)
_MAIN_TAG = re.compile(r"<(?:article|main)[\s/>]", re.I)
_RAW = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "noscript", "template", "svg", "textarea", "iframe", "select", "title", "canvas", "audio", "video")}
_DROP = {"nav", "header", "footer", "aside", "form", "dialog", "menu", "head", "fieldset"}
_INLINE = {x: re.compile(rf"(?:(?!<(?:p|div|article|section|main|h[1-6]|ul|ol|table)\b).)*?</{x}\s*>", re.I | re.S) for x in ("button", "label")}
_MAIN = {"article", "main"}
_BLOCK = {"p", "div", "br", "hr", "h1", "h2", "h3", "h4", "h5", "h6", "li", "ul", "ol", "dl", "dt", "dd", "table", "tr", "td", "th", "thead", "tbody", "tfoot", "caption", "section", "article", "main", "blockquote", "pre", "figure", "figcaption", "header", "footer", "nav", "aside", "form", "address", "details", "summary", "body", "html", "dialog", "fieldset", "center", "title"}
_NESTED = {"div", "section", "ul", "ol", "dl", "table", "tr", "td", "span", "p", "li", "figure", "details", "blockquote"} | _DROP | _MAIN
_GAPPED = {"div", "section", "table"} | _MAIN
_ATTRIBUTE = re.compile(r"""([A-Za-z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Words in a class or id that say what isn't the article, and words that only make it likely.
_NOISE = frozenset(
    "ad ads advert advertisement advertising adsense sponsor sponsored comment comments disqus reply replies respond sidebar menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr popup modal newsletter subscribe subscription footer masthead pagination pager toolbar topbar".split()
)
_VAGUE = frozenset("promo promotion banner notice alert overlay share sharing social related recommended widget login signup skip".split())
#: Words that say nothing more beside a word of noise, and elements of which a class says what part of a page they are.
_STRUCTURE = frozenset(
    "list lists section sections box area wrapper wrap container bar block form thread content body item items row col column inner outer header top bottom left right main panel slot unit feed group holder page site global primary secondary text image img label link links title heading count button icon module region zone user users reader readers visitor guest the".split()
)
_CONTAINERS = frozenset("div section ul ol dl table tr td li details article main".split())
#: Classes or ids of the article's container where the page has no element for it.
_CONTENT = frozenset("content main article post story main-content maincontent page-content post-content post-body article-content article-body articlebody entry-content story-body".split())
#: First parts of a class that keep an article, or what holds one, from being the page's article.
_ASIDE = frozenset("comment comments disqus reply replies respond".split())
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())


class Line(NamedTuple):
    text: str  # empty for a gap
    linked: int  # characters in links
    noise: bool  # hinted to be no part of the article
    vague: tuple[int, ...]  # numbers of the open elements that a vague word hints at
    main: int  # number of the article or main element, or 0
    within: int  # number of the main element round that article, or 0
    path: tuple[int, ...]  # open layout elements


def _holds(page: str, at: int, name: str, last: int) -> str:
    """main or article if the element that opens before at is one or holds one, else nothing. last: where the page's last one begins."""
    found = name if name in _MAIN else ""
    if found == "main" or last < at:
        return found
    depth, end = 1, len(page)
    while depth and at <= last and (m := _TOKEN.search(page, at)):
        at, x = m.end(), (m[2] or "").lower()
        if x in _RAW and not m[1] and not m[3].endswith("/"):
            e = _RAW[x].search(page, at)
            at = e.end() if e else end
        elif x == name:
            depth += -1 if m[1] else not m[3].endswith("/")
        if x in _MAIN and not m[1] and depth:
            found = x
            if x == "main":
                break
    return found


def _hint(name: str, attributes: str, inside: bool, holds=lambda: "") -> str:
    """noise or vague if the element is hinted to be no part of the article, else nothing.

    holds: whether the element is or holds the page's main or article, which a class doesn't make noise.
    """
    if name in _DROP and not (inside and name == "header"):
        return "noise"
    if not attributes or name in ("html", "body"):
        return ""
    plain, vague = [], False
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        if key == "hidden" or (key == "role" and value in _NOISE_ROLES):
            return "noise"
        if key in ("class", "id"):
            for token in value.split():
                parts = [x for x in re.split(r"[-_]+", token) if x]
                if not parts or parts[0] in ("has", "no", "with", "without") or _NOISE.isdisjoint(parts) and _VAGUE.isdisjoint(parts):
                    continue
                own = parts[1:] if parts[0] in ("post", "entry", "article") else parts
                said = all(x in _NOISE or x in _VAGUE or x in _STRUCTURE or x[0].isdigit() for x in own)
                if name in _CONTAINERS and said and not _NOISE.isdisjoint(own):
                    plain.append(own)
                else:
                    vague = True
    if not plain and not vague:
        return ""
    held = holds()
    if held == "main" or (held == "article" and all(parts[1:] and parts[0] not in _ASIDE for parts in plain)):
        return ""
    return "noise" if plain else "" if held == "article" else "vague"


def _marked(attributes: str) -> bool:
    """Whether a class or id names the article's container."""
    return bool(attributes) and any(key.lower() in ("class", "id", "itemprop") and not _CONTENT.isdisjoint("".join(values).lower().split()) for key, *values in _ATTRIBUTE.findall(attributes))


def lines_of(page: str) -> list[Line]:
    """A line for each block, with its hints; empty texts are gaps."""
    lines: list[Line] = []
    text: list[str] = []
    linked = 0
    stack: list[tuple[str, bool, bool, bool]] = []  # open elements: whether each starts a part hinted at, a main one, a vague one
    vague: list[int] = []
    dropped = mains = in_link = 0
    head = False
    main: list[int] = []
    layout: list[int] = []  # for each open element its number if it is of the layout, or 0
    parts = 0
    opened: Counter[str] = Counter()  # open elements by name
    gapped = articles = 0  # open parts of the layout, and articles that stand for themselves

    def add(line: str, n: int = 1) -> None:
        path = tuple(filter(None, layout[:DEEPEST])) if line else ()
        lines.extend([Line(line, linked, dropped > 0, tuple(vague), main[-1] if main else 0, main[-2] if len(main) > 1 else 0, path)] * n)

    def close() -> None:
        nonlocal linked
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            if line:
                add(line)
            text.clear()
        linked = 0

    def gap(n: int) -> None:
        close()
        add("", n)

    def outermost() -> bool:
        """Whether no part of the page's layout is open: what is taken out here isn't amid a text."""
        return not gapped

    def shut(name: str) -> None:
        """Closes the innermost open element of that name, and all that it holds."""
        nonlocal dropped, gapped, articles
        if opened[name]:
            while stack:
                x, was, top, hinted = stack.pop()
                opened[x] -= 1
                gapped -= x in _GAPPED
                articles -= x == "article" and top
                if was or top or hinted:
                    close()
                layout.pop()
                dropped -= was
                if top:
                    main.pop()
                if hinted:
                    vague.pop()
                if x == name:
                    break

    at, end = 0, len(page)
    last_main = max((m.start() for m in _MAIN_TAG.finditer(page)), default=-1)
    while at < end:
        m = _TOKEN.search(page, at)
        if not m:
            text.append(page[at:])
            linked += (len(page) - at) * bool(in_link)
            break
        if m.start() > at and not head:
            part = page[at : m.start()]
            text.append(part)
            linked += len(part) * bool(in_link)
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if name in _INLINE:
            e = None if m[1] else _INLINE[name].match(page, at)  # its text goes, the line around it stays whole
            at = e.end() if e else at
            continue
        if not m[1] and name in _RAW and not m[3].endswith("/"):
            e = _RAW[name].search(page, at)
            at = e.end() if e else end
            if name in ("noscript", "title", "iframe"):
                close()
            continue
        if name == "a":
            in_link = 0 if m[1] else 1
        if name == "head":
            head = not m[1]
        elif name == "body":
            head = False
        if name in _BLOCK:
            close()
        if m[1]:
            was = dropped
            shut(name)
            if was and not dropped and not main:
                if outermost():
                    gap(GAP)
            elif not dropped and not main and name in _GAPPED:
                gap(1)
            continue
        if name not in _NESTED or m[3].endswith("/"):
            continue
        if name == "p":
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    shut("p")
                    break
                if stack[k][0] != "span":
                    break
        elif name == "li" and stack and stack[-1][0] in ("li", "p"):
            shut("li")
        if name in _MAIN and dropped and [x for x, was, *_ in stack if was] == ["form"]:  # a form round the whole page
            close()
            stack = [(x, False, top, hinted) for x, _, top, hinted in stack]
            dropped = 0
        lone = not articles
        hint = "" if dropped else _hint(name, m[3], bool(main), lambda at=at, name=name, lone=lone: _holds(page, at, name, last_main) if lone else "")
        noisy = hint == "noise"
        if noisy and not main and outermost():
            gap(GAP)
        elif hint:
            close()
        if dropped or hint:
            top = False
        elif main:  # an article in main stands for itself; other parts belong to what holds them
            top = name == "article" and lone
        else:
            top = name in _MAIN or (name in ("div", "section", "td") and _marked(m[3]))
        stack.append((name, noisy, top, hint == "vague"))
        opened[name] += 1
        gapped += name in _GAPPED
        articles += name == "article" and top
        parts += 1
        layout.append(parts if name in _GAPPED else 0)
        dropped += noisy
        if hint == "vague":
            vague.append(parts)
        if top:
            if not main:
                gap(GAP)
            mains += 1
            main.append(mains)
        elif name in _GAPPED and not dropped and not main:
            gap(1)
    close()
    return lines


def blocks(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(surge, dive) line numbers: maximal runs over which the windows' length sums stay above nothing."""
    found, start, total = [], None, 0
    for i, n in enumerate(lengths):
        total += n - (lengths[i - window] if i >= window else 0)
        if total and start is None:
            start = i
        elif not total and start is not None:
            found.append((start, i - window + 1))
            start = None
    if start is not None:
        found.append((start, len(lengths)))
    return found


def _joined(found: list[tuple[int, int]], lines: list[Line]) -> list[tuple[int, int]]:
    """Neighbouring blocks of the same parent as one; a menu in a layout element of its own stays a border.

    A wrapper with nothing but one block isn't that block's parent.
    """
    reach: dict[int, tuple[int, int]] = {}  # first and last text line of each layout element
    for i, x in enumerate(lines):
        if x.text:
            for part in x.path:
                reach[part] = (reach.get(part, (i, i))[0], i)

    def parent(surge: int, dive: int, path: tuple[int, ...]) -> tuple[int, ...]:
        while path and surge <= reach[path[-1]][0] and reach[path[-1]][1] < dive:
            path = path[:-1]
        return path

    open_blocks = [(a, b, parent(a, b, tuple(commonprefix([x.path for x in lines[a:b] if x.text])))) for a, b in found]
    while True:
        done: list[tuple[int, int, tuple[int, ...]]] = []
        for a, b, path in open_blocks:
            if done and done[-1][2] == path and all(x.path == path for x in lines[done[-1][1] : a] if x.text):
                a = done.pop()[0]
                path = parent(a, b, path)
            done.append((a, b, path))
        if len(done) == len(open_blocks):
            return [x[:2] for x in done]
        open_blocks = done


def weighed(lines: list[Line]) -> tuple[list[int], list[bool]]:
    """The weight of each line, and whether it is noise."""
    own: dict[int, int] = {}  # characters outside links of each element that a vague word hints at
    for x in lines:
        for part in x.vague:
            own[part] = own.get(part, 0) + (len(x.text) - x.linked if not x.noise else 0)
    noise = [x.noise or any(own[part] < ENOUGH for part in x.vague) for x in lines]
    return [0 if n or x.linked * 5 > len(x.text) * 3 else len(x.text) - x.linked for x, n in zip(lines, noise, strict=True)], noise


def core(weights: list[int], window: int = WINDOW) -> tuple[int, int]:
    """The lines from the surge to the dive: from the first to behind the last that stands in a window of enough weight."""
    sums = [sum(weights[i : i + window]) for i in range(max(1, len(weights) - window + 1))]
    least = min(SURGE, SHARE * max(sums))
    dense = [i for i, n in enumerate(sums) if n >= least > 0]
    if not dense:
        return 0, 0
    ahead = next(i for i in range(dense[0], len(weights)) if weights[i])
    return ahead, dense[-1] + window


def extract(page: str | None) -> str:
    """The article's blocks in page order, joined by line ends; empty if there is no text."""
    if not page:
        return ""
    lines = lines_of(page)
    weights, noise = weighed(lines)
    found = _joined(blocks(weights), [x._replace(text="") if n else x for x, n in zip(lines, noise, strict=True)])
    if not found:
        return ""
    surge, dive = _densest(found, weights, lines)
    first, last = core(weights[surge:dive])
    first, last = surge + first, surge + last
    at: dict[int, int] = {}
    within: dict[int, int] = {}  # the main element round an article
    for x, n in zip(lines[first:last], weights[first:last], strict=True):
        if n:
            at[x.main] = at.get(x.main, 0) + n
    for x in lines:
        within[x.main] = x.within
    best = max(at, key=lambda k: (at[k], -k))
    if best:
        outer = within[best] or best
        kept_in = {outer, *_articles(outer, weights, lines)}
        return "\n".join(x.text for x, n in zip(lines, noise, strict=True) if x.text and not n and x.main in kept_in)
    parent = tuple(commonprefix([x.path for x, n in zip(lines[first:last], weights[first:last], strict=True) if n]))
    kept = lambda i: not noise[i] and (first <= i < last or lines[i].path[: len(parent)] == parent)
    return "\n".join(lines[i].text for i in range(surge, dive) if lines[i].text and kept(i))


def _articles(outer: int, weights: list[int], lines: list[Line]) -> set[int]:
    """The articles of a main element: the one with the most weight, and others that aren't teasers beside it."""
    held: dict[int, int] = {}
    for x, n in zip(lines, weights, strict=True):
        if x.within == outer:
            held[x.main] = held.get(x.main, 0) + n
    most = max(held, key=lambda k: (held[k], -k), default=outer)
    return {most} | {k for k, n in held.items() if n >= max(ENOUGH, PART * held[most])}


def _densest(found: list[tuple[int, int]], weights: list[int], lines: list[Line]) -> tuple[int, int]:
    """The block with the most weight; of lines in main elements only the largest one counts."""

    def weight(block: tuple[int, int]) -> int:
        of: dict[int, int] = {}
        for x, n in zip(lines[slice(*block)], weights[slice(*block)], strict=True):
            of[x.main] = of.get(x.main, 0) + n
        return max(of.values())

    return max(found, key=lambda b: (weight(b), -b[0]))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars (code points) for every row of pages.

    A null or empty page gives an empty text. Null ids and urls are kept, repeated rows each give a
    row, an empty table gives none, other columns are ignored.
    """
    small = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return arrow_map(small, rows, f"page_id {small.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(read(spark, sf_dir, "pages"))


QUERIES = {"op7_html_text": op7_html_text}
ORACLE: dict[str, str] = {}
