"""Fusion of lanes: queries and their parts, ranks, reciprocal rank fusion, bonuses, diversity, relevance floor, documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.text import compact, index_tokens, nfkc, quoted_phrases, section_title
from quern.operators.dense import distance_to_similarity, knn
from quern.operators.grams import grams_of, ranked_hits
from quern.operators.inverted import bm25_ranked
from quern.operators.sparse import COMPACT_SQL, TITLE_SQL, TOKENS_SQL, bm25_sql, documents_index
from quern.plans.common import materialise, r6, read, sized, top_k

RRF_K = 60
#: Results of a lane, and the least similarity and keyword score of one.
LANE, MIN_SIMILARITY, MIN_KEYWORD = 20, 0.3, 0.05
#: Score of an exact hit, and results of a fusion.
EXACT, FUSED = 0.98, 30


def search_queries(queries: DataFrame, most: int = 10) -> DataFrame:
    """(query_id, sub, query): each query (0) and, where it says something else, its quoted phrases and first keywords (1)."""
    words = F.array_join(F.slice(F.array_distinct(F.concat(quoted_phrases("query"), index_tokens("query"))), 1, most), " ")
    parts = F.array(F.struct(F.lit(0).alias("sub"), F.col("query").alias("query")), F.struct(F.lit(1).alias("sub"), words.alias("query")))
    out = queries.select("query_id", F.col("query").alias("whole"), F.explode(parts).alias("p")).where("trim(p.query) <> '' and (p.sub = 0 or p.query <> whole)")
    return out.select("query_id", "p.sub", "p.query")


def distinct_searches(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Parts (query_id, sub, query) with the number of their search, and the searches (query_id: the number, query): parts of the same index tokens are one.

    Titles repeat, and a part often has the tokens of its whole query; both are scored once.
    """
    tokens = F.array_sort(index_tokens(nfkc("query")))
    asked = materialise(parts.select("query_id", "sub", "query", tokens.alias("tokens")), "parts")
    searches = materialise(asked.groupBy("tokens").agg(F.min("query").alias("query")).withColumn("search", F.monotonically_increasing_id()), "searches")
    of = asked.select("query_id", "sub", "tokens").join(sized(searches.select("tokens", "search")), "tokens")
    return materialise(of.select("query_id", "sub", "search"), "searched"), searches.select(F.col("search").alias("query_id"), "query")


def lane_ranks(hits: DataFrame) -> DataFrame:
    """hits (query_id, sub, lane, doc_id, score) with the rank within query, part and lane, ties by id."""
    w = Window.partitionBy("query_id", "sub", "lane").orderBy(F.desc("score"), "doc_id")
    return hits.withColumn("rank", F.row_number().over(w))


def provenance(ranked: DataFrame, parts: DataFrame, phrases: DataFrame | None = None) -> DataFrame:
    """How each result of a query came about: matched_queries (its parts that hit, in order), ranks (the best one by lane) and matched_phrases.

    ranked: query_id, sub, lane, doc_id, rank; parts: query_id, sub, query; phrases: query_id, phrase,
    doc_id of the exact lane.
    """
    best = ranked.groupBy("query_id", "doc_id", "lane").agg(F.min("rank").alias("rank"), F.collect_set("sub").alias("subs"))
    one = best.groupBy("query_id", "doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("lane", "rank")))).alias("ranks"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("subs")))).alias("subs"))
    named = parts.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("sub", "query"))).alias("named"))
    out = one.join(named, "query_id", "left").select("query_id", "doc_id", "ranks", F.transform("subs", lambda s: F.col("named")[s]).alias("matched_queries"))
    none = F.array().cast("array<string>")
    if phrases is None:
        return out.withColumn("matched_phrases", none)
    held = phrases.groupBy("query_id", "doc_id").agg(F.array_sort(F.collect_set("phrase")).alias("matched_phrases"))
    return out.join(held, ["query_id", "doc_id"], "left").withColumn("matched_phrases", F.coalesce("matched_phrases", none))


def merge_lanes(ranked: DataFrame) -> DataFrame:
    """One row for each query and document: the best score of each kind of lane, the rrf of the best rank in each lane of each part, how many parts hit, and the lanes."""
    best = ranked.groupBy("query_id", "doc_id", "lane", "sub").agg(F.max("score").alias("score"), F.min("rank").alias("rank"))
    of = lambda lane: F.max(F.when(F.col("lane") == lane, F.col("score")))
    return best.groupBy("query_id", "doc_id").agg(
        F.coalesce(of("vector"), F.lit(0.0)).alias("vector_score"),
        F.coalesce(of("keyword"), F.lit(0.0)).alias("keyword_score"),
        F.coalesce(of("exact"), F.lit(0.0)).alias("exact_score"),
        F.array_sort(F.collect_set("lane")).alias("lanes"),
        F.round(F.sum(1.0 / (RRF_K + F.col("rank"))), 12).alias("rrf"),
        F.min("rank").alias("best_rank"),
        F.countDistinct("sub").alias("hits"),
    )


def fuse(merged: DataFrame, limit: int = FUSED, rrf: bool = True) -> DataFrame:
    """The rrf over the query's largest, or else the best score of any lane, and bonuses, at most 1; cut at limit.

    Bonuses: .02 for a second lane, .03 for an exact hit, .02 for each further part of the query that hits, up to .08.
    """
    base = F.col("rrf") / F.max("rrf").over(Window.partitionBy("query_id")) if rrf else F.greatest("vector_score", "keyword_score", "exact_score")
    exact = F.array_contains("lanes", "exact")
    bonus = F.when(F.size("lanes") > 1, 0.02).otherwise(0.0) + F.when(exact, 0.03).otherwise(0.0) + F.least(F.lit(0.08), 0.02 * (F.col("hits") - 1))
    scored = merged.withColumn("score", r6(F.least(F.lit(1.0), base + bonus)))
    return top_k(scored, ["query_id"], [F.desc("score"), F.desc("hits"), F.desc(F.size("lanes")), F.desc(exact), F.col("doc_id")], limit)


def diversify(ranked: DataFrame, key: str, k: int = 10) -> DataFrame:
    """At most one row of each key first, then second ones, then the rest, by score within each pass."""
    seen = F.row_number().over(Window.partitionBy("query_id", key).orderBy(F.desc("score"), "doc_id"))
    passes = ranked.withColumn("pass", F.least(seen, F.lit(3)))
    return top_k(passes, ["query_id"], [F.col("pass"), F.desc("score"), F.col("doc_id")], k, "position")


def strong_support(exact: Column, hits: Column, relevance: Column, semantic: Column, signal: Column) -> Column:
    """An exact hit, two parts of the query, or enough relevance, semantic score or retrieval signal."""
    return exact | (hits >= 2) | (relevance >= 0.28) | F.coalesce(semantic >= 0.55, F.lit(False)) | (signal >= 0.28)


def relevance_floor(df: DataFrame, least: float = 0.45, ratio: float = 0.75, gap: float = 0.18) -> DataFrame:
    """Rows at or above max(least, ratio x top, top - gap) of their query; those with strong support if there are any.

    df: query_id, doc_id, score, strong (boolean, or null where nothing is known about support). If no
    row is strong, all stay where nothing is known about any of them, else the first.
    """
    by = Window.partitionBy("query_id")
    top = F.max("score").over(by)
    kept = df.withColumn("floor", F.greatest(F.lit(least), ratio * top, top - gap)).where("score >= floor")
    kept = kept.withColumn("any_strong", F.coalesce(F.max("strong").over(by), F.lit(False))).withColumn("known", F.count("strong").over(by) > 0)
    kept = kept.withColumn("first", F.row_number().over(by.orderBy(F.desc("score"), "doc_id")))
    stays = F.when(F.col("any_strong"), F.coalesce("strong", F.lit(False))).otherwise(~F.col("known") | (F.col("first") == 1))
    return kept.where(stays).drop("any_strong", "known", "first")


def collapse_to_documents(chunks: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The best chunk of each key for each query, and of those the k best: query_id, key, score, doc_id, rank."""
    one = chunks.groupBy("query_id", key).agg(F.min_by(F.struct("score", "doc_id"), F.struct(-F.col("score"), F.col("doc_id"))).alias("b")).select("query_id", key, "b.score", "b.doc_id")
    return top_k(one, ["query_id"], [F.desc("score"), F.col("doc_id")], k)


def aggregate_documents(hits: DataFrame) -> DataFrame:
    """One row for each query and document: best score and rank, number of hits, and the places of the hits in order; ranked by score, hits, rank and id.

    hits: (query_id, doc_id, place, score, rank). They are shuffled once, by query.
    """
    one = hits.repartition("query_id").groupBy("query_id", "doc_id").agg(F.max("score").alias("score"), F.min("rank").alias("best_rank"), F.count("*").alias("hits"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "place"))), lambda x: x["place"]).alias("places"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("hits"), "best_rank", "doc_id")
    return one.withColumn("position", F.row_number().over(w))


def query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(query_id, query, vec_id): the benchmark's items, and the titles of the documents whose id 100 divides, which may have a vector."""
    items = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("query_id"), F.col("text").alias("query"), F.lit(None).cast("bigint").alias("vec_id"))
    asking = read(spark, sf_dir, "documents").where("doc_id % 100 = 0").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")), section_title("text"), "doc_id")
    return items.union(asking).where("query is not null")


def lanes(spark: SparkSession, sf_dir: str, whole: bool = True) -> DataFrame:
    """(query_id, sub, lane, doc_id, score, rank, n) of the query set, as a scratch table. n: hits of the exact lane.

    The keyword lane of each part of a query, the exact lane of the whole one, and the vector lane
    where the query has a vector; what is not similar enough is dropped without ranking anew.

    Not whole is what fusions of at most FUSED results need. Documents that only the exact lane has are in the
    order of their ranks in every fusion, so that FUSED of them are enough; the others are at most three times
    LANE. So the first of the exact lane stay, as many as both, and those that another lane has too.
    """
    docs, queries = read(spark, sf_dir, "documents"), materialise(query_set(spark, sf_dir), "queries")
    parts, searches = distinct_searches(search_queries(queries))
    found = bm25_ranked(searches, documents_index(spark, sf_dir), LANE, MIN_KEYWORD).withColumnRenamed("query_id", "search")
    keyword = found.join(sized(parts), "search").select("query_id", "sub", F.lit("keyword").alias("lane"), "doc_id", "score", "rank")
    vectors = read(spark, sf_dir, "embeddings")
    asked = vectors.join(sized(queries.where("vec_id is not null").select("query_id", "vec_id")), "vec_id").select("query_id", F.col("embedding").alias("vec"))
    near = knn(asked, vectors, LANE).where(F.col("similarity") >= MIN_SIMILARITY)
    vector = near.select("query_id", F.lit(0).alias("sub"), F.lit("vector").alias("lane"), F.col("vec_id").alias("doc_id"), r6(distance_to_similarity(1 - F.col("similarity"))).alias("score"), "rank")
    best = materialise(keyword.unionByName(vector), "best-lanes")
    pairs = {} if whole else {"most": FUSED + 3 * LANE, "beside": best.select("query_id", "doc_id").distinct()}
    held = ranked_hits(queries.select("query_id", F.col("query").alias("phrase")), grams_of(docs), **pairs)
    exact = held.select("query_id", F.lit(0).alias("sub"), F.lit("exact").alias("lane"), "doc_id", F.lit(EXACT).alias("score"), "rank", "n")
    return materialise(best.withColumn("n", F.lit(None).cast("bigint")).unionByName(exact), "lanes")


def fused_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse(merge_lanes(lanes(spark, sf_dir, whole=False)))


def q_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the fused results of the query set come from."""
    queries = materialise(query_set(spark, sf_dir), "queries")
    parts, ranked = search_queries(queries), lanes(spark, sf_dir, whole=False)
    fused = materialise(fuse(merge_lanes(ranked)).select("query_id", "doc_id", F.col("rank").alias("place")), "fused")
    phrases = ranked.where("lane = 'exact'").select("query_id", "doc_id").join(sized(queries.select("query_id", compact(nfkc("query")).alias("phrase"))), "query_id")
    found = provenance(ranked, parts, phrases)
    rank = lambda lane: F.col("ranks")[lane].alias(f"{lane}_rank")
    return fused.join(found, ["query_id", "doc_id"]).select("query_id", "doc_id", "place", rank("keyword"), rank("exact"), rank("vector"), F.size("matched_queries").alias("parts"), F.md5(F.array_join("matched_queries", "|")).alias("queries_md5"), F.size("matched_phrases").alias("phrases"))


def q_lane_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lanes(spark, sf_dir).drop("n")


def q_search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_queries(query_set(spark, sf_dir))


def q_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = merge_lanes(lanes(spark, sf_dir, whole=False))
    return top_k(m.withColumn("rrf", r6("rrf")), ["query_id"], [F.desc("rrf"), F.desc(F.size("lanes")), F.col("best_rank"), F.col("doc_id")], 10).select("query_id", "doc_id", "rrf", "lanes", "best_rank", "rank")


def q_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused_results(spark, sf_dir).select("query_id", "doc_id", "score", "vector_score", "keyword_score", "exact_score", "lanes", "hits", "rank")


def q_fused_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion by the best score of any lane."""
    return fuse(merge_lanes(lanes(spark, sf_dir, whole=False)), rrf=False).select("query_id", "doc_id", "score", "rank")


def _sourced(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = materialise(fused_results(spark, sf_dir), "fused")
    return read(spark, sf_dir, "documents").select("doc_id", "source").join(sized(fused), "doc_id")


def q_diversify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diversify(_sourced(spark, sf_dir), "source").select("query_id", "doc_id", "source", "score", "pass", "position")


def q_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The floor over fused results, which know of exact hits and of parts of the query."""
    fused = fused_results(spark, sf_dir)
    strong = strong_support(F.array_contains("lanes", "exact"), F.col("hits"), F.lit(0.0), F.lit(None).cast("double"), F.lit(0.0))
    return relevance_floor(fused.select("query_id", "doc_id", "score", strong.alias("strong"))).select("query_id", "doc_id", "score", r6("floor").alias("floor"), "strong")


def q_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hits of all lanes by document; lanes and parts are their places."""
    hits = lanes(spark, sf_dir).drop("n").withColumn("place", F.concat_ws(":", "lane", F.col("sub").cast("string")))
    return aggregate_documents(hits).select("query_id", "doc_id", "score", "best_rank", "hits", F.array_join("places", ",").alias("places"), "position")


def q_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_to_documents(_sourced(spark, sf_dir).drop("rank"), "source")


_WORDS = TOKENS_SQL.format("query")
_QUOTED = " || ".join(rf"regexp_extract_all(query, '[{a}]([^\n\r\x{{85}}\x{{2028}}\x{{2029}}]{{2,}}?)[{b}]', 1)" for a, b in (('"“', '"”'), ("《「", "》」")))
LANES_SQL = f"""
    q0 as (select * from (select 'b' || item_id as query_id, text as query, null::bigint as vec_id from benchmark union all
        select 'd' || doc_id, {TITLE_SQL.format("text")}, doc_id from documents where doc_id % 100 = 0) where query is not null),
    qk as (select query_id, query, {_QUOTED} || {_WORDS} as w from q0),
    sq as (select query_id, 0 as sub, query from q0 where trim(query) <> '' union all select query_id, 1, ws from
        (select *, array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: list_position(w, w[i]) = i), lambda i: w[i])[1:10], ' ') as ws from qk) where trim(ws) <> '' and ws <> query),
    {bm25_sql("select query_id || '#' || sub as query_id, query from sq", LANE)},
    km as (select split_part(query_id, '#', 1) as query_id, split_part(query_id, '#', 2)::int as sub, 'keyword' as lane, doc_id, round(score_raw / max(score_raw) over (partition by query_id), 6) as score, rank::int as rank from bm),
    ex as (select query_id, doc_id, 0.98::double as score from q0 join documents d on {COMPACT_SQL.format("query")} <> '' and contains({COMPACT_SQL.format("d.text")}, {COMPACT_SQL.format("query")})),
    vn as (select 'd' || q.vec_id as query_id, v.vec_id as doc_id, round(list_dot_product(q.embedding::double[], v.embedding::double[]), 6) as s from embeddings q join embeddings v on q.vec_id % 100 = 0 where 'd' || q.vec_id in (select query_id from q0)),
    vr as (select *, row_number() over (partition by query_id order by s desc, doc_id)::int as rank from vn qualify rank <= {LANE}),
    lr as materialized (select * from km where score >= {MIN_KEYWORD} union all select query_id, 0, 'exact', doc_id, score, row_number() over (partition by query_id order by score desc, doc_id)::int from ex
        union all select query_id, 0, 'vector', doc_id, round(greatest(0.0, least(1.0, 1 - (1 - s))), 6), rank from vr where s >= {MIN_SIMILARITY}),
    mg as (select query_id, doc_id, max(case when lane = 'vector' then score else 0 end)::double as vector_score, max(case when lane = 'keyword' then score else 0 end)::double as keyword_score,
        max(case when lane = 'exact' then score else 0 end)::double as exact_score, list_sort(list(distinct lane)) as lanes, round(sum(1.0::double / (60 + rank)), 12) as rrf, min(rank) as best_rank, count(distinct sub) as hits from lr group by query_id, doc_id),
    bo as (select *, case when len(lanes) > 1 then 0.02::double else 0 end + case when list_contains(lanes, 'exact') then 0.03::double else 0 end + least(0.08::double, 0.02::double * (hits - 1)) as bonus from mg),
    fs as (select *, round(least(1.0, rrf / max(rrf) over (partition by query_id) + bonus), 6) as score from bo),
    fu as (select *, row_number() over (partition by query_id order by score desc, hits desc, len(lanes) desc, list_contains(lanes, 'exact') desc, doc_id)::int as rank from fs qualify rank <= 30),
    so as (select fu.*, source from fu join documents using (doc_id)),
    dv as (select *, least(3, row_number() over (partition by query_id, source order by score desc, doc_id))::int as pass from so),
    dp as (select *, row_number() over (partition by query_id order by pass, score desc, doc_id)::int as position from dv qualify position <= 10)"""
_SUPPORTED = "list_contains(lanes, 'exact') or hits >= 2"
_FLOOR = "greatest(0.45, 0.75 * max(score) over (partition by query_id), max(score) over (partition by query_id) - 0.18)"


def floor_sql(table: str, strong: str, columns: str, name: str = "") -> str:
    """CTEs and the final select of the floor over table."""
    return f"""fa{name} as (select *, {strong} as strong, {_FLOOR} as floor from {table}), fb{name} as (select *, bool_or(strong) over (partition by query_id) as any_strong,
        row_number() over (partition by query_id order by score desc, doc_id) as first from fa{name} where score >= floor)
        select {columns} from fb{name} where case when any_strong then strong else first = 1 end"""


QUERIES = {"search_queries": q_search_queries, "lane_ranks": q_lane_ranks, "rrf_fusion": q_rrf, "fused_bonus_rank": q_fused, "fused_best_score": q_fused_scores, "diversify_top10": q_diversify, "relevance_floor": q_floor, "collapse_chunks": q_collapse, "document_hits": q_documents, "result_provenance": q_provenance}
ORACLE = {
    "search_queries": f"with {LANES_SQL} select * from sq",
    "result_provenance": f"""with {LANES_SQL}, pq as (select query_id, doc_id, min(case when lane = 'keyword' then rank end)::int as keyword_rank, min(case when lane = 'exact' then rank end)::int as exact_rank, min(case when lane = 'vector' then rank end)::int as vector_rank, list_sort(list(distinct sub)) as subs from lr group by 1, 2)
        select query_id, doc_id, fu.rank as place, keyword_rank, exact_rank, vector_rank, len(subs)::int as parts,
            md5(array_to_string(list_transform(subs, lambda s: case when s = 0 then q0.query else p1.query end), '|')) as queries_md5, case when exact_rank is null then 0 else 1 end::int as phrases
        from fu join pq using (query_id, doc_id) join q0 using (query_id) left join (select query_id, query from sq where sub = 1) p1 using (query_id)""",
    "lane_ranks": f"with {LANES_SQL} select query_id, sub, lane, doc_id, score, rank from lr",
    "rrf_fusion": f"with {LANES_SQL}, o as (select query_id, doc_id, round(rrf, 6) as rrf, lanes, best_rank from mg) select *, row_number() over (partition by query_id order by rrf desc, len(lanes) desc, best_rank, doc_id)::int as rank from o qualify rank <= 10",
    "fused_bonus_rank": f"with {LANES_SQL} select query_id, doc_id, score, vector_score, keyword_score, exact_score, lanes, hits, rank from fu",
    "fused_best_score": f"with {LANES_SQL}, o as (select *, round(least(1.0, greatest(vector_score, keyword_score, exact_score) + bonus), 6) as score from bo) select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, hits desc, len(lanes) desc, list_contains(lanes, 'exact') desc, doc_id)::int as rank from o qualify rank <= 30",
    "document_hits": f"with {LANES_SQL}, o as (select query_id, doc_id, max(score) as score, min(rank) as best_rank, count(*) as hits, string_agg(lane || ':' || sub, ',' order by rank, lane || ':' || sub) as places from lr group by 1, 2) select *, row_number() over (partition by query_id order by score desc, hits desc, best_rank, doc_id)::int as position from o",
    "diversify_top10": f"with {LANES_SQL} select query_id, doc_id, source, score, pass, position from dp",
    "relevance_floor": f"with {LANES_SQL}, {floor_sql('fu', _SUPPORTED, 'query_id, doc_id, score, round(floor, 6) as floor, strong')}",
    "collapse_chunks": f"with {LANES_SQL}, o as (select query_id, source, max(score) as score, first(doc_id order by score desc, doc_id) as doc_id from so group by all) select *, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from o qualify rank <= 10",
}
