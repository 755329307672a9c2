"""The shared helpers and the pipeline as a whole."""

import random
import zlib

import numpy as np
import pytest

from tests.llm.test_operators import DOCS, brute_budget, brute_components, brute_discovery, frame, sf_dir


def test_scratch_tables_can_be_removed(spark):
    from pathlib import Path

    from quern.llm import common

    with common.scratch(spark):
        t = common.materialise(spark.range(5), "own")
        path = Path(t.inputFiles()[0].removeprefix("file:")).parent
        assert t.count() == 5 and path.exists()
    assert not path.exists()


def test_no_folder_of_one_machine_on_a_cluster():
    from types import SimpleNamespace

    from quern.llm.common import shared_dir

    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://x:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(cluster)


def test_sides_are_sized_by_rows_and_bytes(spark):
    from quern.llm.common import sized

    hinted = lambda df: "broadcast" in df._jdf.queryExecution().analyzed().toString().lower()
    small = spark.createDataFrame([("x" * 100,)] * 10, "t string")
    assert hinted(sized(small)) and not hinted(sized(small, rows=9)) and not hinted(sized(small, size=900))


def test_session_settings_stay_as_they_are(spark):
    from quern.llm.tokens import token_counts

    import public_tokenizers as P

    names = ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = [spark.conf.get(n) for n in names]
    token_counts(frame(spark, [(1, "a b", None, None, None)]), P.path("byte_bpe_50k.json")).collect()
    assert [spark.conf.get(n) for n in names] == before


def corpus(rng):
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(900)]
    prose = lambda n: ". ".join(" ".join(rng.choice(vocabulary) for _ in range(8)).capitalize() for _ in range(n)) + "."
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(20))) for k in range(4)]
    rows, labels = [], []
    for i in range(260):
        text = prose(rng.randint(3, 9))
        if i % 5 == 0:
            text = " ".join(w.upper() + "!!! ###" for w in text.split())
        elif i % 13 == 1:
            text = rows[-1][1] if i % 2 else rows[-1][1] + " more"
        elif i % 17 == 2:
            text += " " + items[i % 4][1]
        elif i % 7 == 3:
            text += f" mail person{i}@example.org or 10.0.0.{i % 200}"
        labels.append((i, int(i % 5 > 0), 0))
        rows.append((i, text, rng.choice(["en", "de", None]), f"src{rng.randint(0, 16)}", len(text)))
    rows += [(300, None, None, None, None), (301, "", "en", "src1", 0), (None, prose(4), "en", "src2", 9), (7, prose(5), "en", "src9", 1), (7, rows[7][1], "en", "src9", 1)]
    return rows, labels, items


def test_pipeline_equals_plain_loops(spark, tmp_path):
    import hashlib
    import re

    import corpus_pipeline
    from quern.llm import quality
    from quern.llm.mixing import Mix

    rows, labels, items = corpus(random.Random(21))
    d = sf_dir(spark, tmp_path, frame(spark, rows), items, labels)
    got = sorted(((r.doc_id, r.text, r.lang, r.source, r.n_chars, r.mix_domain, r.mix_epoch) for r in corpus_pipeline.run(spark, d).collect()), key=str)

    # The classifier: fitted again on the rows that may be learnt from, in the order of their ids.
    known = {(i, q) for i, q, _ in labels}
    learnt = sorted(((i, q, t) for i, t, *_ in rows if i is not None and zlib.crc32(str(i).encode()) % 4 != 2 for j, q in known if j == i), key=lambda x: x[:2])
    model = quality.fit(np.array([quality.features(t) for _, _, t in learnt]), np.array([q for _, q, _ in learnt]))
    kept = [r for r in rows if model.score(quality.features(r[1])[None])[0] >= 0.7]
    assert len(kept) < len(rows)

    # Near copies: the smallest id of each group; of rows with one id the first in the order of their columns.
    group, _ = brute_components(kept, 5, 80)
    packed = lambda r: __import__("json").dumps({k: v for k, v in zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True) if v is not None}, separators=(",", ":"))
    left = [r for r in kept if r[0] is None or group[r[0]] == r[0]]
    left = [r for r in left if r[0] is None or r == min((x for x in left if x[0] == r[0]), key=packed)]
    left = [r for k, r in enumerate(left) if r[0] is None or r not in left[:k]]
    assert len(left) < len(kept)

    # Benchmark passages.
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]

    def holds(doc, item):
        n = min(13, len(item))
        for shift in range(-len(item), len(doc)):
            same = [0 <= i + shift < len(doc) and doc[i + shift] == w for i, w in enumerate(item)]
            if any(100 * sum(same[s : s + n]) >= 80 * n for s in range(len(item) - n + 1)):
                return True
        return False

    clean = [r for r in left if not any(holds(words(r[1]), words(t)) for _, t in items)]
    assert len(clean) < len(left)

    # Personal data.
    spans = brute_discovery([r[1] for r in clean])
    out = []
    for k, (i, text, lang, source, n) in enumerate(clean):
        found = [(int(a), int(b), kind) for kind, a, b in (x.split(":") for x in spans[k].split(",") if x)]
        at, parts = 0, []
        for a, b, kind in found:
            if a >= at:
                parts += [text[at:a], f"<{kind.upper()}>"]
            at = max(at, b)
        new = "".join(parts) + text[at:] if found else text
        out.append((i, new, lang, source, len(new) if found else n))
    assert sum("<EMAIL>" in (r[1] or "") for r in out) > 5

    # Mixing.
    mix = Mix()
    domain = lambda s: next((name for name, pattern in mix.domains if re.search(pattern, s or "(none)")), mix.other)
    leaf = lambda r: (domain(r[3]), r[2] or "(none)", r[3] or "(none)")
    size = lambda r: len((r[1] or "").split())
    tokens = {}
    for r in out:
        tokens[leaf(r)] = tokens.get(leaf(r), 0) + size(r)
    weight = lambda level, k: (mix.weights.get(level) or {}).get(k, min(mix.weights.get(level, {}).values(), default=1.0))
    cap = lambda *k: sum(4.0 * n for x, n in tokens.items() if x[: len(k)] == k)
    top = brute_budget({x[0]: weight("domain", x[0]) for x in tokens}, {x[0]: cap(x[0]) for x in tokens}, int(sum(tokens.values()) * mix.share))
    want = []
    for a in top:
        mid = {x[1] for x in tokens if x[0] == a}
        mid = brute_budget({g: weight("language", g) for g in mid}, {g: cap(a, g) for g in mid}, top[a])
        for g in mid:
            low = {x[2] for x in tokens if x[:2] == (a, g)}
            low = brute_budget({s: 1.0 for s in low}, {s: cap(a, g, s) for s in low}, mid[g])
            for s, budget in low.items():
                if not tokens[a, g, s]:
                    continue
                full, part = divmod(int(budget + 1e-6), tokens[a, g, s])
                mine = [r for r in out if leaf(r) == (a, g, s)]
                upto = 0
                key = lambda i, full=full: (hashlib.md5((f"17:{full}" + (f":{i}" if i is not None else "")).encode()).hexdigest(), i if i is not None else -1)
                for i in sorted({r[0] for r in mine}, key=key):
                    same = [r for r in mine if r[0] == i]
                    upto += sum(map(size, same))
                    times = full + (1 if part and upto <= part else 0)
                    want += [(*r, a, e) for r in same for e in range(times)]
    assert got == sorted(want, key=str) and len(got) > 50


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    d = sf_dir(spark, tmp_path, frame(spark, [], DOCS))
    assert corpus_pipeline.run(spark, d).count() == 0
