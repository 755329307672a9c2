"""The sparse lane: an inverted index as tables, BM25 with phrase boosts, and exact phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import STOPWORDS, compact, marked_phrases, normalised, quoted_phrases, section_title, source_text
from quern.operators.grams import Grams, grams_of, phrase_hits
from quern.operators.inverted import Index, best_scores, bm25, bm25_pruned, exact_scores, index_of, pruned, query_weights, ranked_scores, with_terms
from quern.plans.common import materialise, r6, read, sized

# What a query in the source text, a quoted phrase in the content, and one in the source text add.
IN_SOURCE, PHRASE_IN_CONTENT, PHRASE_IN_SOURCE = 0.20, 0.25, 0.15


def phrase_boost(query: Column, phrases: Column, held: Column, source: Column) -> Column:
    """What phrases add to a score: .20 if the whole query stands in the source text; and .25 or .15 for the first quoted phrase that the content or else the source text has.

    All of them are compact forms; phrases is an array, and held are those of them that the content has.
    """
    hit = lambda p: F.when(F.array_contains(held, p), PHRASE_IN_CONTENT).when(F.contains(source, p), PHRASE_IN_SOURCE)
    first = F.get(F.filter(F.transform(phrases, hit), lambda x: x.isNotNull()), 0)
    return F.when((query != "") & F.contains(source, query), IN_SOURCE).otherwise(0.0) + F.coalesce(first, F.lit(0.0))


def bm25_boosted(queries: DataFrame, index: Index, grams: Grams, k: int = 10, min_score: float = 0.0) -> DataFrame:
    """The k best documents of each query by BM25 and phrase boosts.

    A boost stands on a phrase in the content or the source text, so that the documents which have one are
    known by passes over both; all others are ranked by BM25 alone, and of them k are enough.
    """
    asked = materialise(queries.select("query_id", compact("query").alias("whole"), F.transform(quoted_phrases("query"), compact).alias("phrases")), "asked")
    phrases = asked.select("query_id", F.explode("phrases").alias("phrase"))
    found = materialise(phrase_hits(phrases, grams).groupBy("query_id", "doc_id").agg(F.collect_set("phrase").alias("held")), "held-phrases")
    sources = Grams(index.forward.select("doc_id", F.col("source").alias("hay")), compact)
    in_source = phrase_hits(phrases.union(asked.select("query_id", "whole")), sources).select("query_id", "doc_id")
    boosted = materialise(found.select("query_id", "doc_id").union(in_source).distinct(), "boosted")
    weights = query_weights(queries, index)
    about = sized(materialise(boosted.join(found, ["query_id", "doc_id"], "left").join(sized(asked), "query_id"), "boosts").withColumnsRenamed({"query_id": "of_query", "doc_id": "of_doc"}))
    scored = exact_scores(boosted, index, weights).join(index.forward.select("doc_id", "source"), "doc_id")
    scored = scored.join(about, (F.col("query_id") == F.col("of_query")) & (F.col("doc_id") == F.col("of_doc")))
    boost = phrase_boost(F.col("whole"), F.col("phrases"), F.coalesce("held", F.array().cast("array<string>")), F.col("source"))
    scored = scored.select("query_id", "doc_id", r6(F.col("bm25") + boost).alias("score_raw"))
    plain = best_scores(weights, index, k).select("query_id", "doc_id", r6("bm25").alias("score_raw"))
    every = scored.unionByName(plain).groupBy("query_id", "doc_id").agg(F.max("score_raw").alias("score_raw"))
    return with_terms(ranked_scores(every, k, min_score), index, weights)


def exact_phrases(phrases: DataFrame, docs: DataFrame, content_score: float = 0.98) -> DataFrame:
    """(query_id, doc_id, score) of documents that hold a query's phrase."""
    return phrase_hits(phrases, grams_of(docs)).select("query_id", "doc_id").distinct().withColumn("score", F.lit(content_score))


def exact_search(phrases: DataFrame, docs: DataFrame, source: Column, content_score: float = 0.98, source_score: float = 0.35) -> DataFrame:
    """(query_id, doc_id, score, phrases, in_content): phrases in the content count .98, those in the source text alone .35.

    A document's score is that of its best phrase; phrases are all that it holds, in order.
    """
    hits = phrase_hits(phrases, grams_of(docs)).withColumn("score", F.lit(content_score)).union(phrase_hits(phrases, grams_of(docs, source)).withColumn("score", F.lit(source_score)))
    return hits.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("phrase")).alias("phrases")).withColumn("in_content", F.col("score") == content_score)


def scan_phrases(phrases: DataFrame, docs: DataFrame, fields: Column, score: float = 0.98) -> DataFrame:
    """(query_id, doc_id, score): phrases that stand in a text or its fields, marks and blanks alike."""
    index = grams_of(docs, F.concat_ws(" ", F.col("text"), fields), normalised)
    return phrase_hits(phrases, index).select("query_id", "doc_id").distinct().withColumn("score", F.lit(score))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def documents_index(spark: SparkSession, sf_dir: str) -> Index:
    return index_of(read(spark, sf_dir, "documents"))


def q_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25(benchmark_queries(spark, sf_dir), documents_index(spark, sf_dir))


def q_boosted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as queries, their first half quoted; the source text of a document is its section title."""
    half = F.expr("substring(query, 1, cast(length(query) / 2 as int))")
    asked = benchmark_queries(spark, sf_dir).select("query_id", F.concat(F.lit('"'), half, F.lit('" '), "query").alias("query"))
    docs = read(spark, sf_dir, "documents")
    titled = index_of(docs, {"text": F.col("text"), "section_title": section_title("text")}, weights={"section_title": 0.0})
    return bm25_boosted(asked, titled, grams_of(docs), min_score=0.05)


def q_bm25_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_pruned(benchmark_queries(spark, sf_dir), documents_index(spark, sf_dir))


def q_bm25_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each query the postings of its tokens, and whether the search scored no more than these."""
    work = pruned(benchmark_queries(spark, sf_dir), documents_index(spark, sf_dir)).work
    return work.select("query_id", "postings", (F.col("scored") <= F.col("postings")).alias("within"))


#: Fields of documents that the fielded queries search, with what a word in them counts.
FIELDS = {"text": 1.0, "section_title": 2.0, "sheet_name": 0.5, "source_region": 0.5, "structured_terms": 1.5}


def fielded_index(spark: SparkSession, sf_dir: str) -> Index:
    """Documents by their text, title, language (as a sheet's name), source (as a region) and key-like terms of their first line."""
    title = section_title("text")
    terms = F.array_join(F.regexp_extract_all(title, F.lit("[A-Za-z]{3,}"), F.lit(0)), " ")
    return index_of(read(spark, sf_dir, "documents"), {"text": F.col("text"), "section_title": title, "sheet_name": F.col("lang"), "source_region": F.col("source"), "structured_terms": terms}, weights=FIELDS)


def _field_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first six words of each benchmark item, and a language and a source."""
    six = F.array_join(F.slice(F.split("query", " "), 1, 6), " ")
    words = F.concat_ws(" ", six, F.get(F.array(*map(F.lit, ("en", "de", "fr", "es"))), (F.col("query_id") % 4).cast("int")), F.lit("src1"))
    return benchmark_queries(spark, sf_dir).select("query_id", words.alias("query"))


def q_bm25_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25(_field_queries(spark, sf_dir), fielded_index(spark, sf_dir))


def q_bm25_fields_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_pruned(_field_queries(spark, sf_dir), fielded_index(spark, sf_dir))


def q_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_index(spark, sf_dir).terms


def q_doc_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_index(spark, sf_dir).stats.select("n", r6("avgdl").alias("avgdl"), "min_dl", "max_dl")


def q_exact_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_phrases(benchmark_queries(spark, sf_dir).withColumnRenamed("query", "phrase"), read(spark, sf_dir, "documents"))


def q_exact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four words of each benchmark item as phrases, in texts and section titles."""
    four = F.array_join(F.slice(F.split("query", " "), 1, 4), " ")
    asked = benchmark_queries(spark, sf_dir).select("query_id", four.alias("phrase"))
    found = exact_search(asked, read(spark, sf_dir, "documents"), section_title("text"))
    return found.select("query_id", "doc_id", "score", F.array_join("phrases", "|").alias("phrases"), "in_content")


def q_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five words of each benchmark item, in texts, titles and sources."""
    five = F.array_join(F.slice(F.split("query", " "), 1, 5), ", ")
    asked = benchmark_queries(spark, sf_dir).select("query_id", five.alias("phrase"))
    return scan_phrases(asked, read(spark, sf_dir, "documents"), F.concat_ws(" ", source_text({"section_title": section_title("text")}), "source"))


def q_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases in quotation marks of all kinds round words of the benchmark's items."""
    w = lambda i: F.coalesce(F.get(F.split("query", " "), i), F.lit(""))
    text = F.concat(F.lit("'"), w(0), F.lit("' “"), w(1), F.lit(" "), w(2), F.lit("” 《"), w(3), F.lit("》 \""), w(1), F.lit(" "), w(2), F.lit("\" it's"))
    return benchmark_queries(spark, sf_dir).select("query_id", F.array_join(marked_phrases(text), "|").alias("phrases"))


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
TOKENS_SQL = f"list_filter(regexp_extract_all(lower({{}}), '[a-z0-9]+'), lambda x: length(x) > 1 and x not in ({_STOP}))"
COMPACT_SQL = r"regexp_replace(lower({}), '\s+', '', 'g')"
TITLE_SQL = r"substring(trim(regexp_replace(regexp_extract({}, '^\s*([^\n]+)', 1), '^[# ]+', '')), 1, 120)"


def bm25_sql(queries: str, k: int = 10, add: str = "0.0") -> str:
    """CTEs up to bm: the k best of queries (query_id, query), with what a boost adds."""
    return f"""
    d as (select doc_id, {TOKENS_SQL.format("text")} as tk from documents),
    dl as (select doc_id, len(tk) as dl from d where len(tk) > 0),
    st as (select count(*) as n, avg(dl) as avgdl from dl),
    tf as (select doc_id, token, count(*) as tf from (select doc_id, unnest(tk) as token from d) group by all),
    df as (select token, count(*) as df from tf group by all),
    qs as ({queries}),
    q as (select query_id, token, count(*) as qtf from (select query_id, unnest({TOKENS_SQL.format("query")}) as token from qs) group by all),
    sb as (select query_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as bm, list_sort(list(distinct q.token)) as matched_terms
        from q join df using (token) join tf using (token) join dl using (doc_id) cross join st group by query_id, doc_id),
    sc as (select query_id, doc_id, round(bm + {add}, 6) as score_raw, matched_terms from sb join qs using (query_id) join documents dd using (doc_id)),
    bm as (select *, row_number() over (partition by query_id order by score_raw desc, doc_id) as rank from sc qualify rank <= {k})"""


BM25_SQL = bm25_sql("select item_id as query_id, text as query from benchmark")
_FOUND = "select query_id, doc_id, score_raw, round(score_raw / max(score_raw) over (partition by query_id), 6) as score, matched_terms, rank::int as rank from bm"
_HALF = COMPACT_SQL.format("regexp_extract(query, '[\"“](.{2,}?)[\"”]', 1)")
_BOOST = f"""(case when contains({COMPACT_SQL.format(TITLE_SQL.format("dd.text"))}, {COMPACT_SQL.format("query")}) then 0.2 else 0 end
    + case when {_HALF} = '' then 0 when contains({COMPACT_SQL.format("dd.text")}, {_HALF}) then 0.25 when contains({COMPACT_SQL.format(TITLE_SQL.format("dd.text"))}, {_HALF}) then 0.15 else 0 end)"""
_FIELD = {"text": "text", "section_title": TITLE_SQL.format("text"), "sheet_name": "lang", "source_region": "source", "structured_terms": f"array_to_string(regexp_extract_all({TITLE_SQL.format('text')}, '[A-Za-z]{{3,}}'), ' ')"}
_BM25_FIELDS = f"""with t as ({" union all ".join(f"select doc_id, {w}::double as w, unnest({TOKENS_SQL.format(_FIELD[f])}) as token from documents" for f, w in FIELDS.items())}),
    tf as (select doc_id, token, sum(w) as tf from t group by all), dl as (select doc_id, sum(w) as dl from t group by all), st as (select count(*) as n, avg(dl) as avgdl from dl),
    df as (select token, count(*) as df from tf group by all),
    qs as (select item_id as query_id, array_to_string(string_split(text, ' ')[1:6], ' ') || ' ' || (['en', 'de', 'fr', 'es'])[(item_id % 4) + 1] || ' src1' as query from benchmark),
    q as (select query_id, token, count(*) as qtf from (select query_id, unnest({TOKENS_SQL.format("query")}) as token from qs) group by all),
    sb as (select query_id, doc_id, round(sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) as score_raw, list_sort(list(distinct q.token)) as matched_terms
        from q join df using (token) join tf using (token) join dl using (doc_id) cross join st group by query_id, doc_id),
    bm as (select *, row_number() over (partition by query_id order by score_raw desc, doc_id) as rank from sb qualify rank <= 10) {_FOUND}"""
QUERIES = {"bm25_top10": q_bm25, "bm25_pruned": q_bm25_pruned, "bm25_skipped": q_bm25_skipped, "bm25_fields": q_bm25_fields, "bm25_fields_pruned": q_bm25_fields_pruned, "bm25_phrase_boost": q_boosted, "postings_df": q_postings, "doc_length_stats": q_doc_lengths, "exact_phrase": q_exact_phrases, "exact_search": q_exact_search, "scan_phrases": q_scan, "marked_phrases": q_marked}
ORACLE = {
    "bm25_top10": f"with {BM25_SQL} {_FOUND}",
    "bm25_pruned": f"with {BM25_SQL} {_FOUND}",
    "bm25_fields": _BM25_FIELDS,
    "bm25_fields_pruned": _BM25_FIELDS,
    "bm25_skipped": f"with {BM25_SQL} select query_id, sum(df)::bigint as postings, true as within from q join df using (token) group by query_id",
    "bm25_phrase_boost": f"""with {bm25_sql("select item_id as query_id, '\"' || text[1 : length(text) // 2] || '\" ' || text as query from benchmark", add=_BOOST)}, ok as ({_FOUND}) select * from ok where score >= 0.05""",
    "postings_df": f"with t as (select doc_id, unnest({TOKENS_SQL.format('text')}) as token from documents), p as (select doc_id, token, count(*) as tf from t group by all) select token, count(*) as df, sum(tf)::bigint as cf from p group by token",
    "doc_length_stats": f"with t as (select len({TOKENS_SQL.format('text')}) as dl from documents) select count(*) as n, round(avg(dl), 6) as avgdl, min(dl)::int as min_dl, max(dl)::int as max_dl from t where dl > 0",
    "exact_phrase": f"""select item_id as query_id, doc_id, 0.98::double as score from benchmark b join documents d
        on contains({COMPACT_SQL.format("d.text")}, {COMPACT_SQL.format("b.text")})""",
    "scan_phrases": f"""with p as (select item_id as query_id, trim(regexp_replace(lower(array_to_string(string_split(text, ' ')[1:5], ', ')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) as needle from benchmark),
        h as (select doc_id, trim(regexp_replace(lower(coalesce(text, '') || ' ' || coalesce({TITLE_SQL.format("text")}, '') || ' ' || coalesce(source, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) as hay from documents)
        select distinct query_id, doc_id, 0.98::double as score from p join h on needle <> '' and contains(hay, needle)""",
    "marked_phrases": """with w as (select item_id as query_id, coalesce(w[1], '') as a, coalesce(w[2], '') || ' ' || coalesce(w[3], '') as b, coalesce(w[4], '') as c from (select item_id, string_split(text, ' ') as w from benchmark)),
        p as (select query_id, list_filter([trim(b), trim(a), trim(c)], lambda x: length(x) >= 2) as l from w)
        select query_id, array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: list_position(l, l[i]) = i), lambda i: l[i]), '|') as phrases from p""",
    "exact_search": f"""with p as (select item_id as query_id, {COMPACT_SQL.format("array_to_string(string_split(text, ' ')[1:4], ' ')")} as phrase from benchmark),
        h as (select doc_id, {COMPACT_SQL.format("text")} as c, {COMPACT_SQL.format(TITLE_SQL.format("text"))} as s from documents)
        select query_id, doc_id, case when contains(c, phrase) then 0.98 else 0.35 end::double as score, phrase as phrases, contains(c, phrase) as in_content from p join h on contains(c, phrase) or contains(s, phrase)""",
}
