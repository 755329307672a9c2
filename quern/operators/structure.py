"""Chunkers that walk a text once with a stack or with prefix sums: token budgets, programs, YAML, JSON.

Each is a small function of one text, run over Arrow batches; no depth is bounded.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

Counter = Callable[[str], int]
#: Characters to either side of its due place in which the start of a chunk looks for a boundary.
SNAP = 80
_STOPS = np.array([ord(c) for c in "。！？!?；;:."], np.uint32)


def walked(docs: DataFrame, of: Callable[[str], list[tuple]], schema: str) -> DataFrame:
    """doc_id and the columns of schema for each row that of makes of a text; null texts make none."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                found = [(k, *row) for k, t in enumerate(part.column("text").to_pylist()) if t is not None for row in of(t)]
                cols = list(zip(*found, strict=True)) if found else [[] for _ in range(len(names) + 1)]
                ids = part.column("doc_id").take(pa.array(cols[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols[1:], kinds, strict=True))], ["doc_id", *names])

    arrow = {"int": pa.int32(), "string": pa.string()}
    names, kinds = zip(*((n, arrow[t]) for n, t in (x.split() for x in schema.split(", "))), strict=True)
    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {schema}")


# Token budgets


_SPACES = np.array([c for c in range(0x3001) if chr(c).isspace()], np.uint32)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Estimate:
    """Words of any part of a text, or half its characters where it has no blank, at least 1: from sums over the text's beginnings."""

    def __init__(self, text: str) -> None:
        x = _codes(text)
        space = np.isin(x, _SPACES)
        begins = ~space
        begins[1:] &= space[:-1]
        self.space = space
        self.words = np.concatenate([[0], np.cumsum(begins)])
        self.blanks = np.concatenate([[0], np.cumsum(x == 32)])
        solid = np.flatnonzero(~space)
        at = np.searchsorted(solid, np.arange(len(text) + 1))
        self.next = np.append(solid, len(text))[at]
        self.last = np.append(0, solid + 1)[at]

    def __call__(self, start: int, end: int) -> int:
        a, b = int(self.next[start]), int(self.last[end])
        if a >= b:
            return 0
        if self.blanks[b] == self.blanks[a]:
            return max(1, (b - a) // 2)
        return int(self.words[b] - self.words[a]) + int(a > 0 and not self.space[a - 1])


def boundaries(text: str) -> np.ndarray:
    """The places of a text, both ends included, that may part chunks: behind white space, or behind a mark before white space or Han."""
    x = _codes(text)
    space = np.isin(x, _SPACES)
    inner = space[:-1] | (np.isin(x[:-1], _STOPS) & (space[1:] | ((x[1:] >= 0x4E00) & (x[1:] <= 0x9FFF))))
    return np.concatenate([[0], np.flatnonzero(inner) + 1, [len(x)]])


def budget_windows(text: str, size: int, overlap: int, budget: int | None, counter: Counter | None = None) -> list[tuple[int, int]]:
    """(start, end) of chunks of at most size characters and budget tokens.

    An end goes back to the last boundary nearby; beyond the budget it goes, by halving, to the last
    place that keeps it, and from there back to a boundary again. The next start is overlap characters
    back, at the nearest boundary within SNAP characters, forwards first, but never behind the last
    end: chunks cover the text. One character is a chunk even if it costs more than the budget.
    """
    n = len(text)
    parts = boundaries(text)
    slack = min(120, max(20, size // 4))
    cost = Estimate(text) if counter is None else lambda a, b: counter(text[a:b].strip()) if text[a:b].strip() else 0

    def back(start: int, end: int) -> int:
        at = int(parts[np.searchsorted(parts, end, "right") - 1])
        return at if end < n and at >= max(start + 1, end - slack) else end

    out, start = [], 0
    while start < n:
        end = back(start, min(n, start + size))
        if budget is not None and cost(start, end) > budget:
            low, high = start + 1, end
            while low < high:
                mid = (low + high + 1) // 2
                low, high = (mid, high) if cost(start, mid) <= budget else (low, mid - 1)
            end = back(start, low)
        out.append((start, end))
        if end >= n:
            break
        due = max(start + 1, end - overlap) if overlap > 0 else end
        ahead = int(parts[np.searchsorted(parts, due)])
        behind = int(parts[np.searchsorted(parts, due, "right") - 1])
        start = ahead if ahead <= min(end, due + SNAP) else behind if behind >= max(start + 1, due - SNAP) else due
    return out


def budget_chunks(docs: DataFrame, size: int = 1000, overlap: int = 100, budget: int | None = 256, counter: Counter | None = None) -> DataFrame:
    """doc_id, chunk_index, start_char, end_char, tokens, content (trimmed; blank chunks are left out and take no index).

    counter: tokens of a text, for instance of a tokenizer; the estimate of words if there is none. It
    should not fall when a text grows. Null and empty texts give no chunks.
    """

    def of(text: str) -> list[tuple]:
        own = Estimate(text) if counter is None else None
        found = [(a, b, c) for a, b in budget_windows(text, size, overlap, budget, counter) if (c := text[a:b].strip())]
        return [(i, a, b, own(a, b) if own else counter(c), c) for i, (a, b, c) in enumerate(found)]

    return walked(docs, of, "chunk_index int, start_char int, end_char int, tokens int, content string")


# Sheets


def packed(columns: list[str], rows: list[list[str | None]], budget: int) -> list[tuple[int, str, int]]:
    """(chunk_index, content, rows) of a sheet, in one pass."""
    out: list[tuple[int, list[str]]] = []
    held: list[str] = []
    used = 0
    for i, row in enumerate(rows, 1):
        cells = "; ".join(f"{c}: {v}" for c, v in zip(columns, row or [], strict=False) if c is not None and v)
        text = f"row {i}: {cells}"
        n = len([x for x in re.split(r"[ \t\n\x0b\f\r]+", text) if x])
        if held and used + n > budget:
            out.append((len(out), held))
            held, used = [], 0
        held.append(text)
        used += n
    if held:
        out.append((len(out), held))
    return [(k, "\n".join(texts), len(texts)) for k, texts in out]


def packed_rows(sheets: DataFrame, budget: int = 480) -> DataFrame:
    """Rows of sheets packed into chunks of at most a token budget: doc_id, chunk_index, content, rows.

    sheets: doc_id, columns (names), rows (arrays of cells). A row reads `row 3: name: x; size: 2`,
    without blank cells and those beyond the names; one above the budget is a chunk of its own.
    """

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):  # a sheet at a time
                part = b.slice(k, 1)
                found = packed(part.column("columns")[0].as_py() or [], part.column("rows")[0].as_py() or [], budget)
                cols = list(zip(*found, strict=True)) if found else [[], [], []]
                ids = part.column("doc_id").take(pa.array([0] * len(found), pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["doc_id", "chunk_index", "content", "rows"])

    return sheets.select("doc_id", "columns", "rows").mapInArrow(rows, f"doc_id {sheets.schema['doc_id'].dataType.simpleString()}, chunk_index int, content string, rows bigint")


# Programs

#: How a definition begins, in the usual languages; the first group is its name.
SYMBOL = re.compile(r"^\s*(?:export\s+|default\s+|public\s+|private\s+|protected\s+|internal\s+|static\s+|final\s+|abstract\s+|async\s+|unsafe\s+|pub(?:\([a-z]+\))?\s+)*(?:def|class|function|func|fn|interface|struct|enum|trait|impl|type|module|namespace)(?:\s*<[^>]*>)?\s+(?:\([^)]*\)\s*)?([A-Za-z_][A-Za-z0-9_]*)")
_QUOTED = re.compile(r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'|`[^`]*`|//.*$|#.*$|/\*.*?\*/')


def code_parts(text: str) -> list[tuple[int, str | None, int | None, str, str]]:
    """(section, title, level, section_path, content): lines gathered under the definition they follow.

    A definition is inside those that are still open: by braces, from the first one behind it until
    they are closed; else by indent, until a line stands no further in. Braces in strings and comments
    of one line don't count.
    """
    out: list[tuple[int, str | None, int | None, str, list[str]]] = [(0, None, None, "", [])]
    open_: list[list] = []  # name, indent, depth before it, whether a brace has opened it
    depth = 0
    for line in text.split("\n"):
        bare, indent = line.strip(), len(line.expandtabs(4)) - len(line.expandtabs(4).lstrip())
        code = _QUOTED.sub("", line)
        if bare:
            while open_ and (depth <= open_[-1][2] if open_[-1][3] else indent <= open_[-1][1] and not bare.startswith("{")):
                open_.pop()
        if m := SYMBOL.match(line):
            path = [x[0] for x in open_] + [m[1]]
            out.append((len(out), m[1], len(path), " / ".join(path), [line]))
            open_.append([m[1], indent, depth, False])
        else:
            out[-1][4].append(line)
        peak = depth
        for c in code:
            depth += (c == "{") - (c == "}")
            peak = max(peak, depth)
        for x in open_:
            x[3] = x[3] or peak > x[2]
    return [(k, title, level, path, "\n".join(lines)) for k, title, level, path, lines in out if title or any(x.strip() for x in lines)]


def code_sections(docs: DataFrame) -> DataFrame:
    """doc_id, section, title, level, section_path, content of programs; what comes before the first definition is section 0."""
    return walked(docs, code_parts, "section int, title string, level int, section_path string, content string")


# YAML

_KEY = re.compile(r"""("(?:\\.|[^"\\])*"|'(?:''|[^'])*'|[^\s#\[\]{},&*!|>'"%@`-][^#]*?|-[^\s#:][^#]*?)\s*:(?=\s|$)(.*)$""")
_COMMENT = re.compile(r"""^((?:"(?:\\.|[^"\\])*"|'(?:''|[^'])*'|[^"'#]|(?<=\S)#|["'])*?)(?:(?:^|\s)#.*)?$""")


def yaml_lines(text: str) -> list[tuple[int, str]]:
    """(pos, block): `path.to.key: value`, `path.list[0]: value`, and `path:` for keys that hold others, by the line they begin at.

    Quoted keys are bare, a block scalar is its key's value with its lines joined by line ends, other
    values stay as they are written; comments and document marks are left out.
    """
    out: list[tuple[int, str]] = []
    stack: list[list] = []  # indent, key or None, number of a list's item
    lines = text.split("\n")
    at = 0

    def path() -> str:
        made = ""
        for _, key, item in stack:
            made += f"[{item}]" if key is None else f".{key}" if made else key
        return made

    while at < len(lines):
        pos, line = at, lines[at]
        at += 1
        rest = line.strip()
        if not rest or rest[0] == "#" or rest == "---" or rest == "...":
            continue
        indent = len(line) - len(line.lstrip(" "))
        while rest == "-" or rest.startswith("- "):
            while stack and stack[-1][0] > indent:
                stack.pop()
            if stack and stack[-1][0] == indent and stack[-1][1] is None:
                stack[-1][2] += 1
            else:
                stack.append([indent, None, 0])
            inner = rest[1:].lstrip()
            indent += len(rest) - len(inner)
            rest = inner
        item = bool(stack) and stack[-1][1] is None and stack[-1][0] < indent
        found = _KEY.match(rest)
        if not found:
            value = _COMMENT.match(rest)
            if item and (shown := (value[1] if value else rest).strip()):
                out.append((pos, f"{path()}: {shown}"))
            continue
        while stack and (stack[-1][0] > indent or stack[-1][0] == indent):
            stack.pop()
        key = found[1]
        if key[0] in "\"'":
            key = key[1:-1].replace("''", "'") if key[0] == "'" else key[1:-1].replace('\\"', '"')
        value = _COMMENT.match(found[2])
        value = (value[1] if value else found[2]).strip()
        stack.append([indent, key, 0])
        if re.fullmatch(r"[|>][-+0-9]*", value):
            held = []
            while at < len(lines) and (not lines[at].strip() or len(lines[at]) - len(lines[at].lstrip(" ")) > indent):
                held.append(lines[at].strip())
                at += 1
            value = "\n".join(held).rstrip("\n")
        out.append((pos, f"{path()}: {value}" if value else f"{path()}:"))
        if value:
            stack.pop()
    return out


def yaml_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, pos, block of YAML texts."""
    return walked(docs, yaml_lines, "pos int, block string")


# JSON


class _Number(str):
    """A number as it is written."""


def _refused(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def _scalar(x: object) -> str:
    return x if isinstance(x, _Number) else json.dumps(x, ensure_ascii=False)


def json_leaves(text: str) -> list[tuple[str, str]]:
    """(path, value): strings as they are, other leaves as JSON; arrays of scalars and empty containers stay whole. Other texts have none."""
    try:
        root = json.loads(text, parse_float=_Number, parse_int=_Number, parse_constant=_refused)
    except (ValueError, RecursionError):
        return []
    out: list[tuple[str, str]] = []
    todo: list[tuple[str, object]] = [("", root)]
    while todo:
        path, x = todo.pop()
        if isinstance(x, dict) and x:
            todo += reversed([(f"{path}.{k}" if path else k, v) for k, v in x.items()])
        elif isinstance(x, list) and any(isinstance(v, dict | list) for v in x):
            todo += reversed([(f"{path}[{i}]", v) for i, v in enumerate(x)])
        elif isinstance(x, list):
            out.append((path, f"[{','.join(map(_scalar, x))}]"))
        else:
            out.append((path, "{}" if isinstance(x, dict) else x if isinstance(x, str) else _scalar(x)))
    return out


def json_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, path, value of JSON texts."""
    return walked(docs, json_leaves, "path string, value string")
