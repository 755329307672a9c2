"""Queries and their SQL on what larger tables hold."""

import random
import re

from pyspark.sql import functions as F


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def test_sizes_round_as_printf_does(spark):
    from quern.functions.text import human_size

    rng = random.Random(1)
    n = [850.625 * 1024, 405.625 * 1024, 70.625 * 1024, 70.375 * 1024, 0.125, 0.375, 1.005, 1.015, 0.005, 1023.999, 0.0, -0.5, -2.675, 1e300, *(rng.random() * 10 ** rng.randint(0, 14) for _ in range(300)), *(rng.randint(0, 9_999_999) / 8 for _ in range(300))]

    def want(b):
        for k, unit in enumerate(("B", "KB", "MB", "GB")):
            if b < 1024.0 ** (k + 1):
                return f"{b / 1024.0**k:.2f} {unit}"
        return f"{b / 1024.0**4:.2f} TB"

    got = values(spark, [(i, x) for i, x in enumerate(n)], "i int, n double", "i", human_size("n"))
    few = [(i, s) for i, s in got if abs(n[i]) < 1e20]
    assert few == [(i, want(n[i])) for i, _ in few]
    assert values(spark, [(None,)], "n double", human_size("n")) == [(None,)]


def test_long_addresses_stay_behind_their_redirect(spark, tmp_path):
    from quern.operators.assist import parsed_searches

    urls = [(1, "https://a.example/b"), (2, "https://www.spam-farm.example.org/fr/22487?utm_source=feed"), (3, "http://x.example/" + "long/" * 60)]
    spark.createDataFrame(urls, "page_id bigint, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r.page_id, r.title, r.link) for r in parsed_searches(spark, str(tmp_path)).collect())
    assert got == sorted((i, t, u) for i, u in urls for t in (f"Page {i}", "Other"))


def test_sql_of_quoted_titles_and_open_references(spark, tmp_path):
    import duckdb

    from quern import registry

    docs = [(0, 'one token "abc def" two', None, "s"), (100, 'the «x» 《some lore》 more "q"', None, "s"), (200, "plain words", None, "s")]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 'lists "of things" here')], "item_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    pages = [(1, "<html><head><title>A &amp B&amp</title></head><body><article><h1>A &amp B&amp</h1><p>text &lt with &quot;&quot;&quot; &amp " + "x" * 55 + "</p></article></body></html>", "u")]
    spark.createDataFrame(pages, "page_id bigint, html string, url string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(0, [1.0, 0.0], 1)], "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        c.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    for name in ("search_queries", "html_roots"):
        df = registry.QUERIES[name](spark, str(tmp_path))
        want = c.execute(f"select {', '.join(df.columns)} from ({registry.ORACLE[name]})").fetchall()
        assert sorted(map(tuple, df.collect())) == sorted(want), name


def test_last_lines_equal_their_expressions(spark):
    from quern.operators.assist import last_line

    rng = random.Random(2)
    texts = ["".join(rng.choice(["a", "b c", " ", "\n", "\n\n", "\t", "\r", "\x0b", "7"]) for _ in range(rng.randint(0, 9))) for _ in range(600)]
    rows = values(spark, [(t,) for t in [*texts, "", "\n \n", None]], "t string", "t", *last_line(F.col("t")), F.regexp_extract("t", r"([^\n]+)\s*$", 1), F.regexp_replace("t", r"\n?[^\n]+\s*$", ""))
    assert [r for r in rows if r[1:3] != r[3:]] == []
    long = "word " * 40_000 + "\nlast \n"  # trying each place would take hours
    assert values(spark, [(long,)], "t string", last_line(F.col("t"))[0]) == [("last ",)]
    assert re.search("last", long)
