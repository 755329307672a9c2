"""Indexes: segments, scopes, pruned searches, phrases by their places, and vectors in cells, against plain loops."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

STOP = {"a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is", "of", "on", "or", "that", "the", "this", "to", "was", "were", "with"}
WORDS = [f"w{k}" for k in range(60)] + ["the", "Alpha", "beta", "知识库", "x"]


def texts(rng, n, most=40):
    return [" ".join(rng.choice(WORDS[: rng.choice([8, 65])]) for _ in range(rng.randint(0, most))) for _ in range(n)]


def tokens(text):
    return [t for t in re.findall("[a-z0-9]+", text.lower()) if len(t) > 1 and t not in STOP]


def brute_bm25(docs, queries, k):
    """{query: [(doc, score)]} of documents (id, {weight: text}) by weighted frequencies."""
    tf = {}
    for i, fields in docs:
        c = Counter()
        for w, t in fields:
            for x in tokens(t or ""):
                c[x] += w
        if c:
            tf[i] = c
    dl = {i: sum(c.values()) for i, c in tf.items()}
    avg, df = sum(dl.values()) / max(1, len(dl)), Counter(x for c in tf.values() for x in c)
    out = {}
    for q, text in queries:
        score = Counter()
        for x, n in Counter(tokens(text or "")).items():
            for i, c in tf.items():
                if c[x]:
                    score[i] += n * math.log(1 + (len(tf) - df[x] + 0.5) / (df[x] + 0.5)) * c[x] * 2.5 / (c[x] + 1.5 * (0.25 + 0.75 * dl[i] / avg))
        best = sorted(((-round(s, 6), i) for i, s in score.items()))[:k]
        if best:
            out[q] = [(i, -s) for s, i in best]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.doc_id, r.score_raw))
    return out


def near(got, want):
    assert got.keys() == want.keys()
    for q, rows in want.items():
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in rows], abs=2e-6), q
        sure = [s for _, s in rows]
        assert {i for i, s in got[q] if sure.count(s) == 1 and s > sure[-1]} == {i for i, s in rows if sure.count(s) == 1 and s > sure[-1]}


def frame(spark, docs):
    return spark.createDataFrame(docs, "doc_id bigint, text string")


def test_pruned_search_equals_plain_loops(spark, tmp_path, monkeypatch):
    from quern.operators import inverted

    monkeypatch.setattr(inverted, "BLOCK", 4)
    rng = random.Random(1)
    docs = list(enumerate(latin(rng, 300))) + [(900, None), (901, ""), (902, "the of")]
    queries = [(q, t) for q, t in enumerate([*latin(rng, 25), "w1 w1 w2", "nothing known", None, "w3"])]
    inverted.create(frame(spark, docs).repartition(3), f"file://{tmp_path}/ix", {"text": F.col("text")})
    index, asked = inverted.open_index(spark, f"file://{tmp_path}/ix"), spark.createDataFrame(queries, "query_id bigint, query string")
    p, want = inverted.pruned(asked, index, 5), brute_bm25([(i, [(1.0, t)]) for i, t in docs], queries, 5)
    near(found(inverted.bm25(asked, index, 5)), want)
    near(found(p.best), want)
    work = p.work.agg(F.sum("scored"), F.sum("postings")).first()
    assert work[0] < work[1]


def latin(rng, n):
    return [t.replace("知识库", "lore") for t in texts(rng, n)]


def test_fields_count_by_their_weights(spark, tmp_path):
    from quern.operators import inverted

    rng = random.Random(2)
    weights = {"text": 1.0, "section_title": 2.0, "sheet_name": 0.5, "symbol_name": 0.0}
    rows = [(i, *(latin(rng, 1)[0] for _ in range(3)), "Hidden Name") for i in range(80)] + [(99, None, "w1", None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, section_title string, sheet_name string, symbol_name string")
    inverted.create(df, f"file://{tmp_path}/ix", {f: F.col(f) for f in weights}, weights)
    index = inverted.open_index(spark, f"file://{tmp_path}/ix")
    queries = list(enumerate([*latin(rng, 8), "hidden", "w1"]))
    asked = spark.createDataFrame(queries, "query_id bigint, query string")
    want = brute_bm25([(r[0], list(zip((1.0, 2.0, 0.5), r[1:4], strict=True))) for r in rows], queries, 10)
    near(found(inverted.bm25(asked, index)), want)
    near(found(inverted.bm25_pruned(asked, index)), want)
    assert "hiddenname" in index.forward.where("doc_id = 5").first().source


def test_segments_equal_a_rebuild(spark, tmp_path, monkeypatch):
    from quern.operators import inverted

    rng = random.Random(3)
    now = dict(enumerate(latin(rng, 120)))
    queries = list(enumerate(latin(rng, 10)))
    asked, root = spark.createDataFrame(queries, "query_id bigint, query string"), f"file://{tmp_path}/ix"
    inverted.create(frame(spark, list(now.items())), root, {"text": F.col("text")})
    read = []
    plain = inverted.forward_rows
    monkeypatch.setattr(inverted, "forward_rows", lambda docs, *a, **b: read.append(docs.count()) or plain(docs, *a, **b))

    def check():
        index = inverted.open_index(spark, root)
        place = f"file://{tmp_path}/fresh-{random.random()}"
        inverted.create(frame(spark, list(now.items())), place, {"text": F.col("text")})
        fresh = inverted.open_index(spark, place)
        read.pop()
        terms = lambda x: sorted(map(tuple, x.terms.collect()))
        assert terms(index) == terms(fresh)
        assert index.manifest.n == fresh.manifest.n and index.manifest.avgdl == pytest.approx(fresh.manifest.avgdl)
        want = brute_bm25([(i, [(1.0, t)]) for i, t in now.items()], queries, 10)
        near(found((inverted.bm25_pruned if len(index.manifest.segments) == 3 else inverted.bm25)(asked, index)), want)

    new = {**{i: t for i, t in zip(range(5, 9), latin(rng, 4), strict=True)}, 500: "w1 w2 fresh words", 501: ""}
    inverted.add(frame(spark, list(new.items())), root, {"text": F.col("text")})
    now |= new
    check()
    inverted.delete(spark, root, spark.createDataFrame([(6,), (30,), (9_999,), (None,)], "doc_id bigint"))
    now = {i: t for i, t in now.items() if i not in (6, 30)}
    check()
    inverted.add(frame(spark, [(6, "back again w1")]), root, {"text": F.col("text")})
    now[6] = "back again w1"
    check()
    assert read == [6, 1]  # nothing but new documents became tokens
    before = inverted.manifest_of(spark, root)
    merged = inverted.merge(spark, root, 50)
    assert len(merged.segments) == 2 and len(before.segments) == 3 and read == [6, 1]
    check()
    inverted.merge(spark, root, 10**9)
    assert len(inverted.manifest_of(spark, root).segments) == 1 and not inverted.manifest_of(spark, root).deltas
    check()
    old = inverted.open_index(spark, root, before.version)
    assert old.manifest.n == before.n  # earlier versions can still be read
    assert inverted.expire(spark, root, 1) >= 4
    check()
    assert len(inverted.names_in(spark, f"{root}/segments")) == 1
    with pytest.raises(FileExistsError):
        inverted._publish(spark, root, inverted.manifest_of(spark, root))


def test_scopes_are_derived_from_their_filter(spark, tmp_path, monkeypatch):
    from quern.operators import inverted

    rows = [(i, f"stone w{i}", "en" if i % 3 else "de", i % 2) for i in range(30)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, part int").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    assert inverted.index_of(docs).manifest.n == 30
    assert inverted.index_of(docs, where={"lang": "en"}).manifest.n == 20
    a, b = inverted.index_of(docs, where={"lang": "en", "part": 1}), inverted.index_of(docs, where={"part": 1, "lang": "en", "user": None})
    assert a.manifest.segments == b.manifest.segments and a.manifest.n == 10
    with pytest.raises(ValueError, match="scope"):
        inverted.index_of(docs.where("lang = 'en'"))
    assert inverted.index_of(docs, where={"lang": "en", "part": 1}, ttl=0).manifest.segments != a.manifest.segments  # has expired
    assert inverted.scope_name({"a": 1}) != inverted.scope_name({"a": 2}) and inverted.scope_name({}) == inverted.scope_name(None)


def test_phrases_are_found_by_their_places(spark):
    from quern.operators.grams import grams_of, phrase_hits

    rng = random.Random(4)
    pool = ["ab", "aba", "c", "é", "😀", "知识", " ", "  ", "\n", "Ab", "ﬁ", "xyz"]
    docs = [(i, "".join(rng.choice(pool) for _ in range(rng.randint(0, 80)))) for i in range(80)] + [(None, "ab c"), (3, "other text of the same id"), (200, None), (201, "q")]
    flat = lambda t: "".join((t or "").lower().replace("ﬁ", "fi").split())
    cut = lambda t, n: (lambda s: t[s : s + n])(rng.randint(0, max(0, len(t) - n)))
    phrases = [(k, cut(rng.choice(docs)[1] or "", n)) for k, n in enumerate([1, 1, 2, 2, 3, 4, 5, 7, 10, 16, 17, 18, 30, 60] * 4)] + [(90, "q"), (91, "no such phrase in any text"), (92, ""), (93, None), (94, "zz"), (95, "abc😀")]
    want = {(q, d) for q, p in phrases if flat(p) for d, t in docs if t is not None and flat(p) in flat(t)}
    got = [(r.query_id, r.doc_id) for r in phrase_hits(spark.createDataFrame([*phrases, phrases[0]], "query_id bigint, phrase string"), grams_of(frame(spark, docs))).collect()]
    assert set(got) == want and len(got) == len(want)
    assert phrase_hits(spark.createDataFrame([(1, "abc")], "query_id bigint, phrase string"), grams_of(frame(spark, []))).count() == 0


def clustered(n, d=16, seed=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(12, d))[rng.integers(0, 12, n)] + 0.35 * rng.normal(size=(n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_vectors_in_cells_reach_their_recall_and_read_few(spark, tmp_path, monkeypatch):
    from quern.operators import cells, dense

    monkeypatch.setattr(cells, "PART_ROWS", 100)
    monkeypatch.setattr(cells, "QUERY_ROWS", 8)
    x = clustered(3_000)
    df = spark.createDataFrame([(i, [float(v) for v in r], i % 3) for i, r in enumerate(x)] + [(9_000, None, 0)], "vec_id bigint, embedding array<float>, label int")
    df.write.parquet(f"{tmp_path}/v")
    vectors = spark.read.parquet(f"{tmp_path}/v")
    index = cells.index_of(vectors)
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    for where in (None, F.col("label") == 1):
        got, want = cells.search(asked, index, 10, where), dense.knn(asked, vectors, 10, where)
        assert cells.recall(got, want).first().recall >= 0.9
        exact = {(r.query_id, r.vec_id): r.similarity for r in dense.knn(asked, vectors, 3_000).collect()}
        assert all(abs(exact[r.query_id, r.vec_id] - r.similarity) < 2e-6 for r in got.collect())
    assert index.model.probes < len(index.model.centres) / 2
    assert index.cells.agg(F.sum("n")).first()[0] == 3_000  # every row is in it
    plan = index.vectors.where(F.col("cell").isin([1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan


def test_vectors_in_cells_with_copies_and_nothing(spark, tmp_path):
    from quern.operators import cells

    rows = [(i, [1.0, 0.0]) for i in range(50)] + [(i, [0.0, 1.0]) for i in range(50, 60)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/same")
    spark.createDataFrame([], "vec_id bigint, embedding array<float>").write.parquet(f"{tmp_path}/none")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "query_id bigint, vec array<float>")
    got = cells.search(asked, cells.index_of(spark.read.parquet(f"{tmp_path}/same")), 5).orderBy("rank").collect()
    assert [(r.query_id, r.similarity) for r in got] == [(1, 1.0)] * 5
    assert cells.search(asked, cells.index_of(spark.read.parquet(f"{tmp_path}/none")), 5).collect() == []
