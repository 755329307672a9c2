"""The engine's own operators: golden values and properties that SQL checks don't cover."""

import datetime as dt
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_index_tokens(spark):
    from quern.functions.text import compact, index_tokens, quoted_phrases, rerank_tokens

    df = spark.createDataFrame([("The quick-fox a 知识 知识库检索 库 一二三四五六七八九十一二三",), ("",), (None,)], "t string")
    got = rows(df, index_tokens("t"))
    long = "一二三四五六七八九十一二三"
    assert got[0][0] == ["quick", "fox", "知识", "知识", "识库", "库检", "检索", "知识库检索", "库", *(long[i : i + 2] for i in range(12))]
    assert got[1][0] == [] and got[2][0] is None
    assert set(rows(df, rerank_tokens("t"))[0][0]) >= {"the", "a", "知识", "库"}
    one = spark.createDataFrame([('say "exact phrase" and 《书名》 "x"',)], "t string")
    assert rows(one, quoted_phrases("t"))[0][0] == ["exact phrase", "书名"]
    assert rows(one, compact("t"))[0][0] == 'say"exactphrase"and《书名》"x"'


def test_fixed_and_boundary_chunks(spark):
    from quern.operators.chunking import boundary_chunks, fixed_chunks, heading_sections, key_value_blocks

    df = spark.createDataFrame([(1, "abcdefghij"), (2, ""), (3, None)], "doc_id bigint, text string")
    got = sorted(rows(fixed_chunks(df, 5, 2), "chunk_index", "content", "start_char", "end_char"))
    assert [x[1] for x in got] == ["abcde", "defgh", "ghij"] and got[1][2:] == (3, 8)
    text = "First part.\n\nSecond part here. And more words follow. " * 20
    long = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    chunks = sorted(rows(boundary_chunks(long, 60, 10), "start_char", "end_char"))
    assert chunks[0][0] == 0 and chunks[-1][1] == len(text) and all(b[0] <= a[1] for a, b in zip(chunks, chunks[1:], strict=False))
    md = spark.createDataFrame([(1, "intro\n# One\na\n## Two #\nb")], "doc_id bigint, text string")
    assert [r[0] for r in sorted(rows(heading_sections(md), "section", "title"))] == [0, 1, 2]
    assert [r[1] for r in sorted(rows(heading_sections(md), "section", "title"))] == [None, "One", "Two #"]
    ini = spark.createDataFrame([(1, "top = 1\n[a b]\n# no\nk: v\n")], "doc_id bigint, text string")
    assert sorted(x[0] for x in rows(key_value_blocks(ini), "block")) == ["a b.k: v", "top: 1"]


def test_exact_phrases_equal_containment(spark):
    from quern.operators.sparse import exact_phrases

    texts = ["один длинный текст на русском языке без латиницы", "the dataset is large", "she can handle it", "a long phrase that is bro\nken by line ends somewhere", "x" * 500 + "of the", "", None, "data set and hand", "ünïcödé 😀 text, a phrase of some length 😀", "the of the of"]
    phrases = ["длинный текст на русском", "data set", "hand", "of the", "phrase that is broken by line ends", "a", "😀 text, a phrase of some length", "x" * 300, "not anywhere in the texts at all", " ", None, "текст"]
    docs = spark.createDataFrame([*enumerate(texts), (1, texts[1]), (None, texts[2])], "doc_id bigint, text string")
    given = spark.createDataFrame([*enumerate(phrases), (20, "HAND")], "query_id bigint, phrase string")
    flat = lambda x: "".join((x or "").lower().split())
    want = {(q, d) for q, p in [*enumerate(phrases), (20, "hand")] if flat(p) for d, t in [*enumerate(texts), (None, texts[2])] if flat(p) in flat(t)}
    got = [(r.query_id, r.doc_id) for r in exact_phrases(given, docs).collect()]
    assert set(got) == want and len(got) == len(want)


def test_verdicts_use_every_known_label(spark, tmp_path):
    from quern.operators.assist import combined_verdict, verdicts

    labels = [(3, 1, 1), (4, 1, 1), (6, 1, None), (9, 0, None), (12, 0, 0), (15, 1, 0)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: (r.score, r.flagged) for r in verdicts(spark, str(tmp_path)).collect()}
    assert got == {3: (0.4, True), 4: (0.4, True), 6: (1.0, False), 9: (0.5, True), 12: (0.8, False), 15: (1.0, False)}
    assert rows(spark.range(1), combined_verdict(F.lit(1.0), F.lit(0.9), F.lit(True))[1])[0][0] is True


def test_answer_context_holds_whole_turns(spark, tmp_path):
    from quern.operators.assist import answer_context

    turns = [(1, 0, "user", "a" * 300), (1, 1, "assistant", "no"), (1, 2, "user", "b")]
    spark.createDataFrame(turns, "conv_id bigint, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert rows(answer_context(spark, str(tmp_path)), "context") == [(f"[1] {'a' * 300}\n\n[2] b",)]


def test_metrics_golden(spark):
    from quern.operators.evaluation import ir_metrics

    r = spark.createDataFrame([(1, f"d{i}", i) for i in range(1, 5)], "query_id int, doc_id string, rank int")
    j = spark.createDataFrame([(1, "d2"), (1, "d4"), (2, "d9")], "query_id int, doc_id string")
    got = {x.query_id: x for x in ir_metrics(r, j, (4,)).collect()}
    assert (got[1].rr_4, got[1].recall_4, got[1].precision_4) == (0.5, 1.0, 0.5) and abs(got[1].ndcg_4 - 0.65092) < 1e-4
    assert (got[2].hit_4, got[2].ndcg_4) == (0.0, 0.0)


def test_collapse_golden(spark):
    from quern.operators.fusion import collapse_to_documents

    c = spark.createDataFrame([(1, 1, "doc-1", 0.7), (1, 2, "doc-1", 0.95), (1, 3, "doc-2", 0.4), (1, 4, "doc-3", 0.8)], "query_id int, doc_id int, document string, score double")
    assert sorted(rows(collapse_to_documents(c, "document", 2), "rank", "document", "doc_id", "score")) == [(1, "doc-1", 2, 0.95), (2, "doc-3", 4, 0.8)]


def test_greedy_dedup_keeps_what_a_dropped_one_resembles(spark):
    from quern.operators.rerank import greedy_dedup

    ranked = spark.createDataFrame([(1, d, d) for d in (1, 2, 3)], "query_id bigint, doc_id bigint, rank int")
    pairs = spark.createDataFrame([(1, 1, 2, 1, 2), (1, 2, 3, 2, 3)], "query_id bigint, first_id bigint, second_id bigint, first_rank int, second_rank int")
    assert sorted(r.doc_id for r in greedy_dedup(ranked, pairs).collect()) == [1, 3]


def test_rerank_candidates_are_all_that_fusion_keeps(spark, tmp_path):
    from quern.operators.rerank import q_near_dup_pairs

    text = "river stone walks quiet morning light"
    spark.createDataFrame([(i, text, "src1") for i in range(1, 36)], "doc_id bigint, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, text)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(40, [1.0, 0.0], 1)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert q_near_dup_pairs(spark, str(tmp_path)).count() == 30 * 29 // 2


def test_rate_limit_counts_accepted_calls_only(spark):
    from quern.streaming.events import accepted_calls

    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    e = spark.createDataFrame([(7, i, t(s)) for i, s in enumerate([0, 1, 2, 3, 10, 11, 12])], "user_id bigint, event_id bigint, ts timestamp_ntz")
    assert [r.accepted for r in sorted(accepted_calls(e, 2, 10).collect(), key=lambda r: r.event_id)] == [True, True, False, False, True, True, False]


def test_latest_before_equals_one_window(spark):
    from pyspark.sql import Window

    from quern.streaming.events import latest_before

    e = spark.range(400).select(F.col("id").alias("event_id"), F.when(F.col("id") % 7 > 0, (F.col("id") % 3).cast("string")).alias("event_type"), F.timestamp_seconds(F.xxhash64("id") % 10_000).alias("ts"), F.when(F.col("id") % 50 > 0, F.col("id") * 7919 % 1000).alias("arrival"))
    seen = F.max("ts").over(Window.partitionBy("event_type").orderBy("arrival", "event_id").rowsBetween(Window.unboundedPreceding, -1))
    got = latest_before(e, 30)
    assert sorted(rows(got, "event_id", "seen"), key=lambda r: r[0]) == sorted(rows(e.withColumn("seen", seen), "event_id", "seen"), key=lambda r: r[0])
    ordered = got._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(event_type" in ordered and "range" in ordered.split("windowspecdefinition(event_type", 1)[1][:40]


def test_streams_equal_tables(spark, sf, tmp_path):
    from quern.streaming.events import event_time, start_daily_rollup, windowed_counts

    table = spark.read.parquet(f"{sf}/events.parquet")
    (tmp_path / "in").mkdir()
    table.write.parquet(f"{tmp_path}/in/a")
    stream = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in/*")
    q = start_daily_rollup(stream, f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(120)
    closed = spark.read.parquet(f"{tmp_path}/out")
    batch = windowed_counts(event_time(table), "1 day")
    last = batch.agg(F.max("start")).first()[0]
    assert sorted(rows(closed, "start", "event_type", "n")) == sorted(rows(batch.where(F.col("start") < F.lit(last)), "start", "event_type", "n"))


def test_sources(spark, tmp_path):
    from quern.sources.files import decoded, file_kind, read_binary, read_delimited, read_json_lines

    (tmp_path / "a.txt").write_bytes("检索库 text".encode("gb18030"))
    (tmp_path / "b.TXT").write_bytes("﻿é".encode())
    got = {r.path[-5:]: r.text for r in read_binary(spark, str(tmp_path)).select("path", decoded(F.col("content")).alias("text")).collect()}
    assert got == {"a.txt": "检索库 text", "b.TXT": "é"}
    assert rows(spark.range(1), file_kind(F.lit("x.tar.XLS")))[0][0].file_type == "xlsx" and rows(spark.range(1), file_kind(F.lit("none")))[0][0].parser is None
    (tmp_path / "c.jsonl").write_text('55555# note\n{"q": "x", "k": [1]}\n\n{broken\n# c\n{"q": "y"}\n')
    assert sorted(rows(read_json_lines(spark, f"{tmp_path}/c.jsonl", "q string, k array<int>"), "q")) == [("x",), ("y",)]
    (tmp_path / "d.csv").write_text('name,size\n"a\nb",1\nc,2\n')
    (tmp_path / "e.csv").write_text("a,1\nb,2\n")
    assert read_delimited(spark, f"{tmp_path}/d.csv").columns == ["name", "size"] and read_delimited(spark, f"{tmp_path}/d.csv").count() == 2
    assert read_delimited(spark, f"{tmp_path}/e.csv").columns == ["column_1", "column_2"]


def test_scope_keeps_the_tenant(spark):
    from quern.operators.reporting import scope, select_many

    df = spark.createDataFrame([("u", "k1"), ("u", "k2"), ("v", "k1")], "user_id string, label string")
    assert df.where(scope(("user_id", "u"), "k1", {"user_id": "v", "label": "k2"})).collect() == [("u", "k2")]
    assert df.where(scope(("user_id", "u"), None)).count() == 2
    try:
        select_many(df, ["user_id; drop"])
    except ValueError:
        return
    raise AssertionError


def test_entry_survives_without_the_training_operators(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("broken", [False, True])
def test_entry_imports_where_the_training_operators_do_not(tmp_path, broken):
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "quern", tmp_path / "quern", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    if broken:
        (tmp_path / "quern" / "llm").mkdir()
        (tmp_path / "quern" / "llm" / "__init__.py").write_text("import a_library_that_is_not_there\n")
        shutil.copy(root / "corpus_pipeline.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'hybrid_search' in q and 'pipeline' not in q and not any(x.startswith('op') for x in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=tmp_path, check=True, timeout=120)


def test_folding_and_cleaning(spark):
    from quern.functions.text import clean_prose, clean_structured, index_tokens, marked_phrases, merged_lines, nfkc

    d = spark.createDataFrame([("ＡＢＣ ﬁne e\u0301",), ("plain é",), (None,), ("a\n\n\nbbb\nbbb\n\tx  y",)], "t string")
    assert [r[0] for r in rows(d, nfkc("t"))] == ["ABC fine é", "plain é", None, "a\n\n\nbbb\nbbb\n\tx  y"]
    assert [r[0] for r in rows(d, clean_prose("t"))] == ["ABC fine é", "plain é", None, "a\n\nbbb\nx y"]
    assert rows(d, clean_structured("t"))[3][0] == "a\n\nbbb\nbbb\n    x y"
    assert rows(d, index_tokens(nfkc("t")))[0][0] == ["abc", "fine"]
    long = spark.createDataFrame([("\n".join(f"line {i // 2}" for i in range(40_000)),)], "t string")
    assert len(rows(long, clean_prose("t"))[0][0].split("\n")) == 20_000
    m = spark.createDataFrame([("A line that goes\non, with a hyphen-\nated word (\nin brackets\n).\n\n1.2 Heading\nText ends.\nNew one",)], "t string")
    assert rows(m, merged_lines("t"))[0][0] == "A line that goes on, with a hyphenated word (in brackets).\n\n1.2 Heading\nText ends.\nNew one"
    q = spark.createDataFrame([("it's 'not' “so bad” 《ab》 \"x\" \"yz\"",)], "t string")
    assert rows(q, marked_phrases("t"))[0][0] == ["yz", "so bad", "ab"]


def test_citations_in_all_their_marks(spark):
    from quern.functions.text import citation_indices, json_in, source_name, with_source_names

    c = spark.createDataFrame([("see [1] and 【来源2】, (3) [参考2] [99999999999]", ["A [1]", "B"])], "t string, n array<string>")
    assert rows(c, citation_indices("t"), with_source_names(F.col("t"), F.col("n"))) == [([1, 2, 3], "see 【A [1]】 and 【B】, (3) 【B】 [99999999999]")]
    j = spark.createDataFrame([('x {"a": {"b": 1}} y',), ('```json\n{"a":1}\n```',), ("none",), ("{bad",)], "t string")
    assert [r[0] for r in rows(j, json_in("t"))] == ['{"a": {"b": 1}}', '{"a":1}', None, None]
    assert rows(spark.range(1), source_name(F.lit(" "), F.lit(None), F.lit(" x ")), source_name(F.lit("")))[0] == ("x", "Unknown")


def test_chunkers_by_structure(spark):
    from quern.operators.chunking import chunker_of, code_sections, heading_sections, json_blocks, paragraph_chunks, rst_sections, xml_blocks, yaml_blocks

    doc = lambda t: spark.createDataFrame([(1, t)], "doc_id bigint, text string")
    got = sorted(rows(heading_sections(doc("# A\n## B\nx\n### C\n## D\ny\n# E")), "section", "title", "section_path"))
    assert [g[2] for g in got] == ["A", "A / B", "A / B / C", "A / D", "E"]
    got = sorted(rows(rst_sections(doc("Top\n===\ntext\nSub\n---\nmore\nNext\n====\nend")), "section", "title", "section_path"))
    assert [g[1:] for g in got] == [("Top", "Top"), ("Sub", "Top / Sub"), ("Next", "Next")]
    got = sorted(rows(code_sections(doc("import x\nclass A:\n    def f(self):\n        pass\ndef g():\n    pass")), "section", "section_path"))
    assert [g[1] for g in got] == ["", "A", "A / f", "g"]
    assert [r[0] for r in sorted(rows(yaml_blocks(doc("a:\n  b: 1 # no\n  c:\n    - d: x\n# e: 2\nf: y")), "block", "pos"), key=lambda r: r[1])] == ["a:", "a.b: 1", "a.c:", "a.c[0].d: x", "f: y"]
    assert sorted(rows(json_blocks(doc('{"a": {"b": [1, 2]}, "c": [{"d": "x\\"y"}, {"d": null}], "e": {}}')), "path", "value"))== [("a.b", "[1,2]"), ("c[0].d", 'x"y'), ("c[1].d", "null"), ("e", "{}")]
    assert sorted(rows(xml_blocks(doc('<r k="1">t<c>u</c>v</r>')), "pos", "path", "attributes", "children", "text")) == [(0, "/r", "k=1", "c", "t v"), (1, "/r/c", "", "", "u")]
    assert xml_blocks(doc("<broken")).count() == 0 and json_blocks(doc("{broken")).count() == 0
    got = sorted(rows(paragraph_chunks(doc("first one.\n\nsecond.\n\nthird."), 12, 0), "chunk_index", "chunk_id", "content"))
    assert len(got) >= 2 and got[0][1:] == ("paragraph_12_0::1::0", "first one.")
    assert [r[0] for r in rows(spark.createDataFrame([("MD", ""), ("", '{"a":1}'), ("", "<?xml?>"), ("", "[s]\nk=v"), ("", "words")], "k string, t string"), chunker_of(F.col("k"), F.col("t")))] == ["markdown", "json", "xml", "ini", "text"]


def test_main_content_of_pages(spark):
    from quern.functions.dom import main_content

    page = "<html><head><title>T &amp; U</title></head><body><nav>no</nav><div class='content'><h1>A</h1><p>one <a href='/x'>two</a><br>three</p><h2>B</h2><ul><li>i<ul><li>ii</li></ul></li></ul><table><tbody><tr><th>h</th><td>c</td></tr></tbody></table><div class='comment'>no</div></div><div class='sidebar'>no</div></body></html>"
    m = rows(spark.createDataFrame([(page,)], "h string"), main_content(F.col("h")))[0][0]
    assert (m.title, m.root_tag, m.score) == ("T & U", "div", 35)
    assert [(b.kind, b.text, b.section_path) for b in m.blocks] == [("heading", "A", "A"), ("paragraph", "one two (/x)\nthree", "A"), ("heading", "B", "A / B"), ("list_item", "i", "A / B"), ("list_item", "ii", "A / B"), ("table", "h | c", "A / B")]
    assert rows(spark.createDataFrame([(None,)], "h string"), main_content(F.col("h")))[0][0].blocks == []


def test_index_is_built_once_for_a_tables_content(spark, tmp_path):
    from quern.operators.sparse import bm25, index_of

    path = f"{tmp_path}/docs"
    spark.createDataFrame([(1, "river stone"), (2, "stone stone"), (3, "")], "doc_id bigint, text string").write.parquet(path)
    asked = spark.createDataFrame([(1, "stone river"), (2, "nothing here")], "query_id bigint, query string")
    first = index_of(spark.read.parquet(path))
    assert [r.doc_id for r in bm25(asked, first).orderBy("rank").collect()] == [1, 2]
    assert index_of(spark.read.parquet(path)).blocks.inputFiles() == first.blocks.inputFiles()
    spark.createDataFrame([(4, "river river stone")], "doc_id bigint, text string").write.mode("append").parquet(path)
    assert {r.doc_id for r in bm25(asked, index_of(spark.read.parquet(path))).collect()} == {1, 2, 4}


def test_vectors_are_asked_for_in_blocks(spark, monkeypatch):
    from quern.operators import dense

    v = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(50)], "vec_id bigint, embedding array<float>")
    q = v.where("vec_id % 5 = 0").select(F.concat(F.lit("q"), F.col("vec_id").cast("string")).alias("query_id"), F.col("embedding").alias("vec"))
    one = sorted(map(tuple, dense.knn(q, v, 3).collect()))
    monkeypatch.setattr(dense, "BLOCK", 3)
    assert sorted(map(tuple, dense.knn(q, v, 3).collect())) == one and len(one) == 30


def test_rate_limit_of_nulls_and_large_ids(spark):
    from quern.streaming.events import accepted_calls

    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    e = spark.createDataFrame([(None, i, t(i)) for i in range(5)] + [(2**53 + 1, 10, t(0)), (2**53, 11, t(0))], "user_id bigint, event_id bigint, ts timestamp_ntz")
    got = {r.event_id: (r.user_id, r.accepted) for r in accepted_calls(e, 2, 100).collect()}
    assert [got[i][1] for i in range(5)] == [True, True, False, False, False] and got[10] == (2**53 + 1, True) and got[11] == (2**53, True)


def test_greedy_dedup_in_small_batches(spark):
    from quern.operators.rerank import greedy_dedup

    ranked = spark.createDataFrame([(q, d, d) for q in range(20) for d in (1, 2, 3, 4)], "query_id bigint, doc_id bigint, rank int")
    pairs = spark.createDataFrame([(q, a, b, a, b) for q in range(20) for a, b in ((2, 3), (1, 2), (3, 4))], "query_id bigint, first_id bigint, second_id bigint, first_rank int, second_rank int").repartition(7)
    assert {(r.query_id, r.doc_id) for r in greedy_dedup(ranked, pairs).collect()} == {(q, d) for q in range(20) for d in (1, 3)}


def test_streams_of_usage_and_limits_equal_tables(spark, sf, tmp_path):
    from quern.streaming.events import accepted_calls, accepted_stream, followed, read_usage, start_usage_rollup, usage_of

    table = spark.read.parquet(f"{sf}/events.parquet")
    table.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    start_usage_rollup(stream(), f"{tmp_path}/usage", f"{tmp_path}/cp1").awaitTermination(120)
    key = lambda r: (r.event_type, str(r.user_id), r.day, r.all_users, r.calls)
    assert sorted(map(key, read_usage(spark, f"{tmp_path}/usage").collect())) == sorted(map(key, usage_of(table).collect()))
    table.coalesce(1).write.parquet(f"{tmp_path}/whole")
    whole = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/whole")
    accepted_stream(whole, 3, 86_400).writeStream.format("parquet").option("path", f"{tmp_path}/ok").option("checkpointLocation", f"{tmp_path}/cp2").trigger(availableNow=True).start().awaitTermination(120)
    want = sorted((r.event_id, r.accepted) for r in accepted_calls(table, 3, 86_400).collect())
    assert sorted((r.event_id, r.accepted) for r in spark.read.parquet(f"{tmp_path}/ok").collect()) == want
    a, b = (lambda d: d.where("event_type = 'click'").withColumnRenamed("event_id", "id")), (lambda d: d.where("event_type = 'purchase'").withColumnRenamed("event_id", "id"))
    joined = followed(a(whole), b(whole), "user_id", "2 hours", late="10 days")
    joined.writeStream.format("parquet").option("path", f"{tmp_path}/j").option("checkpointLocation", f"{tmp_path}/cp3").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/j").collect())) == sorted(map(tuple, followed(a(table), b(table), "user_id", "2 hours").collect()))


@pytest.mark.parametrize("encoding", ["gb18030", "big5", "shift_jis", "latin-1"])
def test_legacy_encodings_are_told_apart(encoding):
    from quern.sources.files import detected

    texts = {
        "gb18030": ["你好", "检索", "数据库的查询和更新", "中文abc混合 text 内容，以及标点。", "系统将在今天晚上进行升级，请大家提前保存文件。"],
        "big5": ["資料", "您好嗎", "資料庫的查詢與更新", "中文abc混合 text 內容，以及標點。", "系統將在今天晚上進行升級，請大家提前保存檔案。", "這是繁體"],
        "shift_jis": ["こんにちは", "データ", "日本語のテキストです。", "検索エンジンの更新", "abc とカタカナ"],
        "latin-1": ["café", "Größe", "¿Qué pasa, señor?", "à", "Élève à l'école, été", "naïve façade — no"[:12]],
    }
    for t in texts[encoding]:
        b = t.encode(encoding)
        assert detected(b) == encoding and b.decode(detected(b)) == t, t


def test_files_of_legacy_encodings_are_decoded(spark):
    from quern.sources.files import decoded

    texts = [("資料庫的查詢與更新", "big5"), ("数据库的查询和更新", "gb18030"), ("日本語のテキストです", "shift_jis"), ("Größe", "latin-1"), ("é", "utf-8"), ("", "utf-8")]
    df = spark.createDataFrame([(i, bytearray(t.encode(e))) for i, (t, e) in enumerate(texts)] + [(9, None)], "i int, b binary")
    assert [r[0] for r in df.orderBy("i").select(decoded(F.col("b"))).collect()] == [*(t for t, _ in texts), None]


def test_rows_equal_to_the_header_are_data(spark, tmp_path):
    from quern.sources.files import read_delimited

    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "a.csv").write_text("name,size\nname,size\nb,2\n,\n")
    (tmp_path / "x" / "b.csv").write_text("name,size\nc,3\n")
    got = read_delimited(spark, f"{tmp_path}/x")
    assert got.columns == ["name", "size"] and sorted(map(tuple, got.collect())) == [("b", "2"), ("c", "3"), ("name", "size")]


def test_results_know_where_they_come_from(spark):
    from quern.operators.fusion import provenance

    ranked = spark.createDataFrame([(1, 0, "keyword", 5, 2), (1, 1, "keyword", 5, 1), (1, 0, "exact", 5, 3), (1, 1, "keyword", 6, 4)], "query_id int, sub int, lane string, doc_id int, rank int")
    parts = spark.createDataFrame([(1, 0, "whole query"), (1, 1, "whole")], "query_id int, sub int, query string")
    phrases = spark.createDataFrame([(1, "p b", 5), (1, "a", 5)], "query_id int, phrase string, doc_id int")
    got = {r.doc_id: r for r in provenance(ranked, parts, phrases).collect()}
    assert (got[5].ranks, got[5].matched_queries, got[5].matched_phrases) == ({"exact": 3, "keyword": 1}, ["whole query", "whole"], ["a", "p b"])
    assert (got[6].ranks, got[6].matched_queries, got[6].matched_phrases) == ({"keyword": 4}, ["whole"], [])


def test_corners_of_limits_and_metadata(spark):
    from quern.operators.chunking import METADATA, with_metadata
    from quern.operators.reporting import clamped, select_many

    df = spark.createDataFrame([(1, "t")], "doc_id int, section_title string")
    one = with_metadata(df).first()
    assert one.section_title == "t" and all(one[c] is None for c in METADATA if c != "section_title")
    many = spark.range(50)
    assert select_many(many, ["id"], limit=0).count() == 0 and select_many(many, ["id"], limit=None).count() == 50 and select_many(many, ["id"], limit=clamped(500), offset=45).count() == 5
    assert [clamped(k) for k in (-3, 0, 1, 30, 31)] == [1, 1, 1, 30, 30]


def test_functions_for_sql_and_reports(spark, tmp_path):
    from quern.functions.registry import register
    from quern.sources.files import write_report

    assert "quern_fixed_chunks" in register(spark)
    assert [r.content for r in spark.sql("select content from quern_fixed_chunks('abcdefghij', 5, 2)").collect()] == ["abcde", "defgh", "ghij"]
    assert spark.sql("select quern_nfkc('ＡＢ') as x").first().x == "AB"
    write_report(spark.createDataFrame([(1, "a|b"), (2, None)], "n int, t string"), f"{tmp_path}/r", "Title")
    assert [r.value for r in spark.read.text(f"{tmp_path}/r/markdown").collect()] == ["# Title", "", "| n | t |", "|-|-|", "| 1 | a\\|b |", "| 2 |  |"]
    assert spark.read.json(f"{tmp_path}/r/json").count() == 2 == spark.read.option("header", "true").csv(f"{tmp_path}/r/csv").count()


def test_relevance_floor_without_known_support(spark):
    from quern.operators.fusion import relevance_floor

    df = lambda strong: spark.createDataFrame([(1, 1, 0.9, strong[0]), (1, 2, 0.85, strong[1]), (1, 3, 0.5, strong[2])], "query_id int, doc_id int, score double, strong boolean")
    kept = lambda strong: sorted(r.doc_id for r in relevance_floor(df(strong)).collect())
    assert (kept((None,) * 3), kept((False,) * 3), kept((None, True, None)), kept((True, False, True))) == ([1, 2], [1], [2], [1])


def test_sources_of_many_encodings(spark, tmp_path):
    from quern.sources.files import declared_charset, decoded, is_header, read_delimited, search_type

    page = '<html><head><meta charset="big5"></head>資料'.encode("big5")
    (tmp_path / "p.html").write_bytes(page)
    d = spark.read.format("binaryFile").load(f"{tmp_path}/p.html")
    assert rows(d, declared_charset(F.col("content")), decoded(F.col("content")))[0] == ("big5", page.decode("big5"))
    assert is_header(["Name", "x"], []) and not is_header(["1", "2"], [["3", "4"]]) and is_header(["a", "b"], [["1", "c"]]) and not is_header(["a", "b"], [["c", "d"]])
    (tmp_path / "x.csv").write_text("a,b,\n1,2,3\n,,\n4,5,6\n")
    assert read_delimited(spark, f"{tmp_path}/x.csv").columns == ["a", "b", "column_3"] and read_delimited(spark, f"{tmp_path}/x.csv").count() == 2
    assert [r[0] for r in rows(spark.createDataFrame([("XLS",), (".csv",), ("html",), ("zzz",), (" ",)], "t string"), search_type(F.col("t")))] == ["xlsx", "tabular", "html", "zzz", None]
