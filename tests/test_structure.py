"""Chunkers that walk with a stack or sums: golden texts, and texts made from known structures."""

import json
import random

import pytest

from quern.operators.structure import Estimate, boundaries, budget_windows, code_parts, json_leaves, yaml_lines


def paths(text):
    return [x[3] for x in code_parts(text) if x[1]]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("import x\nclass A:\n    def f(self):\n        def g():\n            pass\n        return g\n\n    async def h(self):\n        pass\ndef top():\n    d = {1: '}'}\nclass B(A):\n  def two(self): pass", ["A", "A / f", "A / f / g", "A / h", "top", "B", "B / two"]),
        ("export class A {\n  // } no end\n  x = '}';\n}\nfunction f() {\n  function g() { return {}; }\n  class C {\n  }\n}\nasync function h() {}\nfunction k()\n{\n}\nfunction l() {}", ["A", "f", "f / g", "f / C", "h", "k", "l"]),
        ("namespace n\n{\npublic class A {\n    public enum E { X, Y }\n    private static class B {\n        interface I {\n        }\n    }\n}\n}\nclass Z {}", ["n", "n / A", "n / A / E", "n / A / B", "n / A / B / I", "Z"]),
        ("pub mod m;\npub struct S<T> {\n    a: T,\n}\nimpl<T> S<T> {\n    pub fn new() -> Self {\n        S { a: 1 }\n    }\n    pub(crate) fn b(&self) {}\n}\ntrait T {\n    fn c(&self);\n}\nfn main() {\n}", ["S", "S", "S / new", "S / b", "T", "T / c", "main"]),
        ("package p\ntype S struct {\n\tA int\n}\nfunc (s *S) M() {\n\tif true {\n\t}\n}\nfunc f() {\n}", ["S", "M", "f"]),
        ("\n".join(f"{'  ' * k}class K{k}:" for k in range(12)), [" / ".join(f"K{i}" for i in range(k + 1)) for k in range(12)]),
    ],
)
def test_code_containers(text, want):
    assert paths(text) == want
    assert "\n".join(x[4] for x in code_parts(text)) == text


def leaves(x, path=""):
    """What yaml_lines says of a structure of maps, lists and scalars."""
    if isinstance(x, dict):
        for k, v in x.items():
            p = f"{path}.{k}" if path else k
            if isinstance(v, dict | list):
                yield f"{p}:"
                yield from leaves(v, p)
            else:
                yield f"{p}: {v}"
    elif isinstance(x, list):
        for i, v in enumerate(x):
            if isinstance(v, dict | list):
                yield from leaves(v, f"{path}[{i}]")
            else:
                yield f"{path}[{i}]: {v}"


def dumped(x, indent, rng):
    """Lines of a structure, with comments, quoted keys and lists at their key's own indent now and then."""
    pad, out = " " * indent, []
    if isinstance(x, dict):
        for k, v in x.items():
            shown = rng.choice([k, f'"{k}"', f"'{k}'"])
            if rng.random() < 0.1:
                out.append(pad + "# a comment: of it")
            if isinstance(v, dict):
                out += [f"{pad}{shown}:", *dumped(v, indent + rng.choice([1, 2, 4]), rng)]
            elif isinstance(v, list):
                out += [f"{pad}{shown}:  # why", *dumped(v, indent + rng.choice([0, 2, 3]), rng)]
            else:
                out.append(f"{pad}{shown}: {v}" + rng.choice(["", "   # note"]))
        return out
    for v in x:
        if isinstance(v, dict | list):
            inner = dumped(v, indent + 2, rng)
            out += [f"{pad}- {inner[0].strip()}" if not inner[0].strip().startswith("#") else f"{pad}-", *(inner[1:] if not inner[0].strip().startswith("#") else inner)]
        else:
            out.append(f"{pad}- {v}")
    return out


def made(rng, depth):
    if depth and rng.random() < 0.7:
        n = rng.randint(1, 3)
        if rng.random() < 0.5:
            return [made(rng, depth - 1) for _ in range(n)]
        return {f"k{rng.randint(0, 99)}x{i}": made(rng, depth - 1) for i in range(n)}
    return rng.choice(["1", "true", "a b", "x#y", "http://u/v", '"q: r # s"', "[1, 2]", "'it''s'"])


def test_yaml_of_any_depth_equals_its_structure():
    rng = random.Random(31)
    for _ in range(400):
        x = {"root": made(rng, 10), "tail": "end"}
        text = "\n".join(dumped(x, 0, rng))
        assert [b for _, b in yaml_lines(text)] == list(leaves(x)), text


def test_yaml_lists_block_scalars_and_marks():
    text = "---\nl:\n- x\n- y  # two\n- n: 1\n  m: 2\n- - deep\n  - er\ntext: |\n  line one\n\n    line # two\nafter: >-\n  folded\n\"a: b\": 'c'\nempty:\nurl: http://x/#y\n"
    assert yaml_lines(text) == [
        (1, "l:"), (2, "l[0]: x"), (3, "l[1]: y"), (4, "l[2].n: 1"), (5, "l[2].m: 2"), (6, "l[3][0]: deep"), (7, "l[3][1]: er"), (8, "text: line one\n\nline # two"),
        (12, "after: folded"), (14, "a: b: 'c'"), (15, "empty:"), (16, "url: http://x/#y"),
    ]
    assert yaml_lines("a:\n b:\n  c:\n   d:\n    e:\n     f:\n      g: 1\n h: 2")[-2:] == [(6, "a.b.c.d.e.f.g: 1"), (7, "a.h: 2")]
    assert yaml_lines("") == [] and yaml_lines("just words\n# no") == []


def test_json_leaves_of_any_depth():
    assert json_leaves(json.dumps({"a\"b": "x\"y\nz", "e": {}, "l": [], "s": ["a", 1, None], "m": ["a", {"b": 1.50}], "n": 10**30})) == [("a\"b", "x\"y\nz"), ("e", "{}"), ("l", "[]"), ("s", '["a",1,null]'), ("m[0]", "a"), ("m[1].b", "1.5"), ("n", str(10**30))]
    deep = '{"a":' * 300 + "[1.250, true]" + "}" * 300
    assert json_leaves(deep) == [(".".join(["a"] * 300), "[1.250,true]")]
    assert json_leaves("7") == [("", "7")] and json_leaves('"é"') == [("", "é")]
    assert json_leaves("{broken") == [] and json_leaves("") == [] and json_leaves("NaN") == [] and json_leaves("[" * 100_000) == []


def plain_estimate(part):
    part = part.strip()
    return 0 if not part else max(1, len(part) // 2) if " " not in part else len(part.split())


def test_estimate_from_sums_equals_counting():
    rng = random.Random(32)
    for _ in range(100):
        t = "".join(rng.choice(["ab", " ", "  ", "\n", "é", "x.", "知", "\t"]) for _ in range(rng.randint(0, 40)))
        e = Estimate(t)
        for _ in range(30):
            a = rng.randint(0, len(t))
            b = rng.randint(a, len(t))
            assert e(a, b) == plain_estimate(t[a:b]), (t, a, b)


def test_budget_windows_cover_the_text_within_their_budget():
    rng = random.Random(33)
    for _ in range(150):
        t = " ".join("".join(rng.choice("abc.;知\n") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 200)))
        size, overlap, budget = rng.choice([30, 100, 400]), rng.choice([0, 10, 90]), rng.choice([3, 10, 40, None])
        counter = rng.choice([None, lambda x: len(x.split()), len])
        found = budget_windows(t, size, overlap, budget, counter)
        assert [x for x in (set(range(len(t))) - {i for a, b in found for i in range(a, b)})] == []
        for (a, b), (c, d) in zip(found, found[1:], strict=False):
            assert a < c <= b and d > c
            due = max(a + 1, b - overlap) if overlap else b
            assert abs(c - due) <= 80
        for a, b in found:
            assert b - a <= size
            cost = plain_estimate(t[a:b]) if counter is None else counter(t[a:b].strip())
            assert budget is None or cost <= budget or b - a == 1 or counter is None and " " not in t[a:b].strip()
        parts = set(boundaries(t).tolist())
        assert all(t[i - 1].isspace() or t[i - 1] in ".;" for i in parts - {0, len(t)})


def test_budget_chunks_with_a_counter(spark):
    from quern.operators.structure import budget_chunks

    docs = spark.createDataFrame([(1, "one two three four five six seven"), (2, None), (3, ""), (4, " \n ")], "doc_id bigint, text string")
    got = sorted((r.doc_id, r.chunk_index, r.content, r.tokens) for r in budget_chunks(docs, 100, 0, 3, lambda t: len(t.split())).collect())
    assert got == [(1, 0, "one two three", 3), (1, 1, "four five six", 3), (1, 2, "seven", 1)]
