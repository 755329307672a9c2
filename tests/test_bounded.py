"""What searches write and hold stays small beside their input."""

import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F


def written(folder):
    return sum(f.stat().st_size for f in Path(folder).rglob("*") if f.is_file())


def shared(monkeypatch, tmp_path):
    from quern.plans import common

    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}/shared")


def noise(n, size, seed=3):
    rng = np.random.default_rng(seed)
    return [(i, "".join(chr(c) for c in rng.integers(0x61, 0x7B, size))) for i in range(n)]


def test_phrases_write_nothing_but_hits(spark, tmp_path, monkeypatch):
    from quern.operators.sparse import exact_phrases, exact_search, scan_phrases

    shared(monkeypatch, tmp_path)
    texts = noise(200, 5_000)
    spark.createDataFrame(texts, "doc_id bigint, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    asked = spark.createDataFrame([(1, texts[7][1][100:160]), (2, texts[9][1][40:47]), (3, texts[11][1][-9:])], "query_id bigint, phrase string")
    want = {(1, 7), (2, 9), (3, 11)}
    for got in (exact_phrases(asked, docs), exact_search(asked, docs, F.lit("")), scan_phrases(asked, docs, F.lit(""))):
        assert {(r.query_id, r.doc_id) for r in got.collect()} == want
    assert written(f"{tmp_path}/shared") < 100_000 < sum(len(t) for _, t in texts) / 5


def test_phrases_by_blocks_and_in_parts_of_texts(spark, monkeypatch):
    from quern.operators import grams

    monkeypatch.setattr(grams, "BLOCK_BYTES", 60)
    long = "ab" * 3_000 + "end of it" + "ba" * 3_000
    docs = spark.createDataFrame([(1, long), (2, "nothing"), (3, "q" * 40 + "xyz"), (None, None)], "doc_id bigint, text string")
    phrases = [(k, p) for k, p in enumerate(["bendo", "abendofitb", "nothing", "q" * 41, "q" * 40, "qx", "yz", "z", "ab" * 20 + "b", "abab" * 9, "ng", "notthere"])]
    found = {(r.query_id, r.doc_id) for r in grams.phrase_hits(spark.createDataFrame(phrases, "query_id bigint, phrase string"), grams.grams_of(docs)).collect()}
    flat = {1: long.replace(" ", ""), 2: "nothing", 3: "q" * 40 + "xyz"}
    assert found == {(k, d) for k, p in phrases for d, t in flat.items() if p in t}
    monkeypatch.setattr(grams, "BATCH", 64)
    find = grams.Needles.build([p for _, p in phrases]).finder()
    texts = list(flat.values())
    assert set(zip(*find(texts), strict=True)) == {(t, k) for k, p in phrases for t, x in enumerate(texts) if p in x}


def test_bm25_shuffles_and_writes_no_postings(spark, tmp_path):
    from quern.operators import inverted

    docs = spark.createDataFrame([(i, f"stone w{i % 7} w{i % 5} river") for i in range(60)] + [(7, "w1 w1")], "doc_id bigint, text string")
    inverted.create(docs, f"file://{tmp_path}/ix", {"text": F.col("text")})
    index = inverted.open_index(spark, f"file://{tmp_path}/ix")
    asked = spark.createDataFrame([(1, "w1 stone"), (2, "w3 w4"), (None, "river")], "query_id bigint, query string")
    first = sorted(map(tuple, inverted.bm25(asked, index, 5).collect()), key=str)
    assert not list(Path(f"{tmp_path}/ix").rglob("blocks*"))
    ranked = inverted.bm25_ranked(asked, index, 5)
    assert "explode" not in ranked._jdf.queryExecution().optimizedPlan().toString().lower()
    assert {(r.query_id, r.doc_id) for r in inverted.bm25_pruned(asked, index, 5).collect()} == {(r[0], r[1]) for r in first}
    assert list(Path(f"{tmp_path}/ix").rglob("blocks.name"))  # made when a pruned search asks for them


def test_scores_by_blocks_of_queries_and_in_a_matrix(spark, tmp_path, monkeypatch):
    from quern.operators import best, inverted

    rng = np.random.default_rng(8)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.3, 40) if x < 200) for _ in range(150)]
    inverted.create(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), f"file://{tmp_path}/ix", {"text": F.col("text")})
    index = inverted.open_index(spark, f"file://{tmp_path}/ix")
    asked = spark.createDataFrame([(k, t[:60]) for k, t in enumerate(texts[:90])], "query_id bigint, query string")
    weights = inverted.query_weights(asked, index)
    scored = inverted._summed(inverted._postings(inverted._held(index, weights), index, "query_id", "token", "w"), index)
    want = sorted(map(tuple, inverted.ranked_scores(scored.withColumn("score_raw", inverted.r6("bm25")), 4).collect()))
    assert sorted(map(tuple, inverted.bm25_ranked(asked, index, 4).collect())) == want
    monkeypatch.setattr(inverted, "QUERY_ROWS", 300)
    monkeypatch.setattr(inverted, "WIDE", 3)
    assert sorted(map(tuple, inverted.bm25_ranked(asked, index, 4).collect())) == want
    monkeypatch.setattr(best, "HELD", 50)
    kept = best.Best(pa.array([1, 2]), 2, once=True)
    for _ in range(3):
        for at in range(0, 40, 10):
            kept.add(pa.array(range(at, at + 10)), np.repeat([[0.5, 0.1]], 10, axis=0) + (at == 20))
    assert [(r["q"], r["d"]) for b in kept.rows(["q", "d", "s"]) for r in b.to_pylist()] == [(1, 20), (1, 21), (2, 20), (2, 21)]


def most_held(function, batch):
    """Bytes that a function of mapInArrow holds at most beside the batch that it is given."""
    tracemalloc.start()
    try:
        for _ in function(iter([batch])):
            pass
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_vectors_are_scored_and_coded_in_bounded_blocks(spark, tmp_path, monkeypatch):
    from quern.operators import cells, dense

    n, d = 10_000, 8
    x = np.random.default_rng(1).normal(size=(n, d)).astype(np.float32)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.ListArray.from_arrays(pa.array(range(0, n * d + 1, d), pa.int32()), pa.array(x.ravel()))], ["vec_id", "embedding"])
    vectors = spark.createDataFrame([(1, [1.0] * d)], "vec_id bigint, embedding array<float>")
    asked = spark.createDataFrame([(k, [float(v) for v in x[k]]) for k in range(1_000)], "query_id bigint, vec array<float>")
    functions, plain = [], type(vectors).mapInArrow
    monkeypatch.setattr(type(vectors), "mapInArrow", lambda self, f, *a, **b: functions.append(f) or plain(self, f, *a, **b))
    dense.knn(asked, vectors, 10)
    assert most_held(functions.pop(), batch) < 120 << 20  # all scores at once are several times 80 MB
    monkeypatch.setattr(cells, "fit", lambda *_: cells.Model(x[:2_000].astype(np.float64), np.zeros((d // 2, 4, 2)), 1, 1))
    cells.write_index(vectors, f"file://{tmp_path}/cells")
    assert most_held(functions.pop(), batch) < 60 << 20  # all distances at once are several times 160 MB


def test_hits_of_queries_that_ask_the_same_are_ranked_once(spark):
    from quern.operators.grams import grams_of, ranked_hits

    docs = spark.createDataFrame([(i, "Stone River" if i % 2 else "nothing") for i in range(400)] + [(7, "stone river")], "doc_id bigint, text string")
    asked = spark.createDataFrame([("a", "stone river"), ("b", "STONE  river"), ("c", "nothing"), ("d", "absent"), ("e", " "), ("f", "nothing"), ("f", "stone")], "query_id string, phrase string")
    odd, even = list(range(1, 400, 2)), list(range(0, 400, 2))
    want = {(q, d, k + 1, len(ids)) for q, ids in (("a", odd), ("b", odd), ("c", even), ("f", range(400))) for k, d in enumerate(ids)}
    assert {tuple(r) for r in ranked_hits(asked, grams_of(docs)).collect()} == want
    beside = spark.createDataFrame([("a", 399), ("c", 3), ("zz", 1)], "query_id string, doc_id bigint")
    few = {tuple(r) for r in ranked_hits(asked, grams_of(docs), 5, beside).collect()}
    assert few == {r for r in want if r[2] <= 5 or (r[0] in "ab" and r[1] == 399)}


def test_fusion_needs_no_more_of_the_exact_lane(spark, monkeypatch):
    """Every fusion of the lanes as they are cut for it equals that of the whole lanes."""
    from quern.operators import fusion

    monkeypatch.setattr(fusion, "FUSED", 4)
    rng = np.random.default_rng(5)
    whole, cut = [], []
    for q in range(40):
        other = [(lane, sub, int(d), float(rng.integers(1, 100)) / 100, r + 1) for lane, sub in (("keyword", 0), ("keyword", 1), ("vector", 0)) for r, d in enumerate(rng.permutation(80)[: rng.integers(0, 4)])]
        exact = [("exact", 0, int(d), 0.98, r + 1) for r, d in enumerate(np.sort(rng.permutation(80)[: rng.integers(0, 60)]))]
        mixed = {d for _, _, d, _, _ in other}
        whole += [(q, *x) for x in other + exact]
        cut += [(q, *x) for x in other + [x for x in exact if x[4] <= 4 + 3 * 3 or x[2] in mixed]]
    assert len(cut) < len(whole)
    made = lambda rows: spark.createDataFrame(rows, "query_id bigint, lane string, sub int, doc_id bigint, score double, rank int")
    for rrf in (True, False):
        one, two = (sorted(tuple(r) for r in fusion.fuse(fusion.merge_lanes(made(x)), 4, rrf).collect()) for x in (whole, cut))
        assert one == two


def test_only_pairs_that_may_be_alike_get_their_tokens(spark, tmp_path, monkeypatch):
    from quern.operators.rerank import similar_results, text_similarity

    shared(monkeypatch, tmp_path)
    rng = np.random.default_rng(2)
    rows = [(q, 100 * q + r, r, [f"w{x}" for x in range(int(n))] + [f"w{x}" for x in rng.permutation(int(n))[:3]], int(n) * 5, f"s{r % 2}") for q in range(6) for r, n in enumerate(rng.integers(1, 40, 12))]
    ranked = spark.createDataFrame(rows, "query_id bigint, doc_id bigint, rank int, tokens array<string>, len int, source string")
    a, b = ranked.alias("a"), ranked.alias("b")
    alike = F.round(text_similarity(F.col("a.tokens"), F.col("b.tokens"), F.col("a.len"), F.col("b.len")), 6)
    every = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.rank") < F.col("b.rank")) & (F.col("a.source") == F.col("b.source"))).select("a.query_id", "a.doc_id", "b.doc_id", alike.alias("s")).where("s >= 0.9")
    got = {(r.query_id, r.first_id, r.second_id, r.similarity) for r in similar_results(ranked).collect()}
    assert got == {tuple(r) for r in every.collect()} and got
    held = spark.read.parquet(next(str(p) for p in Path(tmp_path).glob("shared/quern/pairs-*")))
    assert "tokens" not in " ".join(held.columns) and held.count() < 6 * 12 * 11 / 4


def test_one_chunking_index_lies_on_disk_at_a_time(spark, sf, tmp_path, monkeypatch):
    from quern.operators import evaluation

    shared(monkeypatch, tmp_path)
    evaluation.q_chunking(spark, sf).collect()
    assert not list(Path(tmp_path).glob("shared/quern/chunk*-index-*")) and not list(Path(tmp_path).glob("shared/quern/chunks-*"))


def test_texts_and_tokens_come_in_small_batches(spark, tmp_path, monkeypatch):
    from quern.operators import inverted

    seen = []
    kept = inverted.small_batches
    monkeypatch.setattr(inverted, "small_batches", lambda s: seen.append(1) or kept(s))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    docs = spark.createDataFrame([(i, f"stone w{i % 7}") for i in range(40)], "doc_id bigint, text string")
    inverted.create(docs, f"file://{tmp_path}/ix", {"text": F.col("text")})
    index = inverted.open_index(spark, f"file://{tmp_path}/ix")
    asked = spark.createDataFrame([(1, "w3 stone")], "query_id bigint, query string")
    assert inverted.bm25_ranked(asked, index, 3).count() == 3
    assert len(seen) == 2 and spark.conf.get(name) == before
    with kept(spark, 2):
        sizes = spark.range(0, 9, 1, 1).mapInArrow(lambda bs: (b for b in bs if not b.num_rows > 2), "id bigint").count()
    assert sizes == 9


def test_reranking_writes_no_texts(spark, sf, tmp_path, monkeypatch):
    from quern.operators import rerank

    shared(monkeypatch, tmp_path)
    ids = [r.query_id for r in rerank.query_set(spark, sf).limit(2).collect()]
    rows = [(q, d, 0.0, 0.5, 0.0, ["keyword"], 1, 0.9 - d / 100, d) for q in ids for d in range(1, 7)]
    fused = spark.createDataFrame(rows, "query_id string, doc_id bigint, vector_score double, keyword_score double, exact_score double, lanes array<string>, hits bigint, score double, rank int").coalesce(1)
    monkeypatch.setattr(rerank, "fused_results", lambda *_: fused)
    tables = lambda: [spark.read.parquet(str(p)).columns for p in Path(tmp_path).glob("shared/quern/*-*")]
    assert rerank.q_features(spark, sf).count() == 12
    assert tables() and not any({"text", "tokens"} & set(c) for c in tables())
    assert rerank.hybrid_search(spark, sf).count() >= 2
    assert any("tokens" in c for c in tables()) and not any("text" in c for c in tables())


def test_tasks_return_only_what_earlier_rounds_do_not_surpass(spark, tmp_path, monkeypatch):
    """The best of the rounds are those of one pass, ties and null ids included, and don't grow with the tasks."""
    from quern.operators import best, dense, inverted

    rng = np.random.default_rng(4)
    texts = [(None if i == 5 else i, " ".join(f"w{x}" for x in rng.integers(0, 30, 12))) for i in range(600)] + [(i, "w1 w2 w3") for i in range(600, 1_400)] + [(700, "w1 w2")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(40)
    inverted.create(docs, f"file://{tmp_path}/ix", {"text": F.col("text")})
    index = inverted.open_index(spark, f"file://{tmp_path}/ix")
    asked = spark.createDataFrame([(k, f"w{k % 30} w{k % 7} w3") for k in range(60)] + [(None, "w1 w2 w3")], "query_id bigint, query string")
    weights = inverted.query_weights(asked, index)
    scored = inverted._summed(inverted._postings(inverted._held(index, weights), index, "query_id", "token", "w"), index)
    # A document is the better one of two rows with its id.
    ranked = inverted.ranked_scores(scored.where("doc_id is null or doc_id <> 700").withColumn("score_raw", inverted.r6("bm25")), 5)
    want = sorted(map(tuple, ranked.collect()), key=str)
    vectors = spark.createDataFrame([(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(900)], "vec_id bigint, embedding array<float>").repartition(40)
    near = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vec"))
    nearest = sorted(map(tuple, dense.knn(near, vectors, 5).collect()))
    returned, plain = [], type(docs).mapInArrow

    def counted(self, *args, **kwargs):
        out = plain(self, *args, **kwargs)
        if {"bm25", "similarity"} & set(out.columns):
            returned.append(out.count())
        return out

    monkeypatch.setattr(type(docs), "mapInArrow", counted)
    monkeypatch.setattr(best, "FIRST", 64)
    assert sorted(map(tuple, inverted.bm25_ranked(asked, index, 5).collect()), key=str) == want
    assert len(returned) > 1 and sum(returned) < 60 * 5 * 12  # 40 tasks have about 60 * 5 each
    returned.clear()
    assert sorted(map(tuple, dense.knn(near, vectors, 5).collect())) == nearest
    assert len(returned) > 1 and sum(returned) < 45 * 5 * 12


def test_equal_searches_are_scored_once(spark):
    from quern.operators.fusion import distinct_searches

    parts = [("a", 0, "Red stone"), ("a", 1, "stone red"), ("b", 0, "the red, Stone."), ("c", 0, "red stone stone"), ("d", 0, "?"), (None, 0, "red stone")]
    of, searches = distinct_searches(spark.createDataFrame(parts, "query_id string, sub int, query string"))
    number = {(r.query_id, r["sub"]): r.search for r in of.collect()}
    assert len(number) == 6 and searches.count() == 3
    assert number["a", 0] == number["a", 1] == number["b", 0] == number[None, 0] != number["c", 0] != number["d", 0]


def test_tokens_that_cannot_reach_the_floor_are_left_out_at_first():
    """Few documents get the gains of frequent tokens once there is a floor, and the best are those of all sums."""
    from quern.operators.best import Best
    from quern.operators.inverted import _gain, _Scores

    rng = np.random.default_rng(6)
    n, words, asked, k = 3_000, 400, 300, 5
    common = 1 / np.arange(1, words + 1)
    tf = rng.binomial(3, np.minimum(0.9, 8 * common), (n, words))
    tf[:, 40:] *= rng.random((n, words - 40)) < 0.1
    dl = tf.sum(axis=1) + 1.0
    w = np.log(1 + (n + 0.5) / ((tf > 0).sum(axis=0) + 0.5))
    wants = np.array([rng.random(words) < np.where(np.arange(words) < 20, 0.4, 0.02) for _ in range(asked)])
    gain = np.where(tf > 0, _gain(tf, dl[:, None], dl.mean()), 0.0)
    sums = np.round(gain @ (wants * w).T, 6)
    term, query = np.nonzero(wants.T)
    ids, doc_ids = pa.array(range(asked)), pa.array(range(n))

    def search(few, floor):
        s = _Scores(ids, pa.array([f"w{i}" for i in range(words)]), query, w[term], np.searchsorted(term, np.arange(words + 1)), Best(ids, k, once=True, floor=floor))
        doc, t = np.nonzero(gain[few])
        s.add(doc_ids.take(pa.array(few)), doc, t, gain[few][doc, t])
        return s, {(r["q"], r["d"]): round(r["s"], 6) for b in s.best.rows(("q", "d", "s")) for r in b.to_pylist()}

    first, rest = np.arange(n // 2), np.arange(n // 2, n)
    _, found = search(first, None)
    held = [sorted(((-s, d) for (q, d), s in found.items() if q == x))[k - 1] for x in range(asked)]
    s, more = search(rest, (np.array([-h[0] for h in held]), pa.array([h[1] for h in held])))
    assert len(s.out_w) > len(s.w) // 2 and len(more) < len(found)
    for q in range(asked):
        every = sorted([(-v, d) for (x, d), v in (found | more).items() if x == q])[:k]
        assert [d for _, d in every] == np.lexsort((np.arange(n), -sums[:, q]))[:k].tolist()


def test_copies_among_results_are_compared_once(spark, tmp_path, monkeypatch):
    from quern.operators.rerank import similar_results

    shared(monkeypatch, tmp_path)
    words = [f"w{x}" for x in range(20)]
    texts = [words, words[:19], [*words, "w1"], [], []]
    rows = [(q, d, d + 1, texts[d % 5], 0 if texts[d % 5] is None else 50, "s") for q in range(8) for d in range(10)]
    ranked = spark.createDataFrame(rows, "query_id bigint, doc_id bigint, rank int, tokens array<string>, len int, source string")
    got = {(r.query_id, r.first_id, r.second_id, r.similarity) for r in similar_results(ranked).collect()}
    alike = {(a, b): 1.0 if {a % 5, b % 5} <= {0, 2} or a % 5 == b % 5 == 1 else 0.9625 for a in range(10) for b in range(a + 1, 10) if a % 5 < 3 and b % 5 < 3}
    assert got == {(q, *pair, s) for q in range(8) for pair, s in alike.items()}
    held = {name: spark.read.parquet(str(next(Path(tmp_path).glob(f"shared/quern/{name}-*")))).count() for name in ("word-sets", "tokens-of-words")}
    assert held == {"word-sets": 1, "tokens-of-words": 2}
