"""Ranking quality: hit rate, precision, recall, reciprocal rank and nDCG, per query and on average, and what to choose by them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.operators.chunking import _boundary_sql, _fixed_sql, boundary_chunks, fixed_chunks
from quern.operators.fusion import LANES_SQL, lanes, merge_lanes, query_set
from quern.operators.rerank import _CAND, _candidates, _reranked, _scored_sql
from quern.operators.inverted import best_scores, create, open_index, query_weights
from quern.operators.sparse import COMPACT_SQL, TOKENS_SQL, benchmark_queries, exact_phrases
from quern.plans.common import materialise, r6, read, scratch, scratch_path, sized, top_k

KS = (1, 3, 5, 10)
#: What counts for one strategy against another, in this order.
KEY = ("rr_10", "recall_10", "recall_5", "precision_3")
# The tags of a query and the words that give them.
QUERY_TAGS: Mapping[str, Sequence[str]] = {
    "exact_numeric_requirement": ("多少", "几个", "几篇", "多长", "多久", "比例", "字", "时间", "%", "率"),
    "format_or_standard": ("格式", "标准", "编号", "字体", "国家标准", "参考文献"),
    "enumeration_or_scope": ("哪些", "哪几", "哪三", "组成", "包括", "分别", "分类", "范围"),
    "policy_rule": ("办法", "规定", "原则", "职责", "评选", "抽检", "申诉", "处理", "奖励"),
}


def normalised_ids(ids: Column) -> Column:
    """Ids as text, without null, empty and zero ones."""
    return F.filter(F.transform(ids, lambda x: x.cast("string")), lambda x: x.isNotNull() & (x != "") & (x != "0"))


def graded_metrics(graded: DataFrame, relevant: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """One row for each query of relevant (query_id, n_relevant). graded: (query_id, rank) of the relevant results.

    Precision divides by k even if fewer documents were found. A query of which nothing relevant was
    found has zeros. Recall's arguments are never swapped, whichever list is shorter.
    """
    rank, aggs = F.col("rank"), []
    for k in ks:
        inside = rank <= k
        aggs += [F.count_if(inside).alias(f"hits_{k}"), F.sum(F.when(inside, 1 / F.log2(rank + 1)).otherwise(0.0)).alias(f"dcg_{k}")]
    per = relevant.join(graded.groupBy("query_id").agg(F.min("rank").alias("first_rank"), *aggs), "query_id", "left")
    out = [F.col("query_id"), F.col("n_relevant"), F.col("first_rank")]
    for k in ks:
        got = F.coalesce(F.col(f"hits_{k}"), F.lit(0))
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant").cast("int"), F.lit(k))), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
        out += [
            F.when(got > 0, 1.0).otherwise(0.0).alias(f"hit_{k}"),
            r6(got / k).alias(f"precision_{k}"),
            r6(got / F.col("n_relevant")).alias(f"recall_{k}"),
            r6(F.when(F.col("first_rank") <= k, 1 / F.col("first_rank")).otherwise(0.0)).alias(f"rr_{k}"),
            r6(F.coalesce(F.col(f"dcg_{k}"), F.lit(0.0)) / ideal).alias(f"ndcg_{k}"),
        ]
    return per.select(*out)


def ir_metrics(rankings: DataFrame, judgments: DataFrame, ks: Sequence[int] = KS) -> DataFrame:
    """One row for each judged query. rankings: (query_id, doc_id, rank); judgments: (query_id, doc_id)."""
    relevant = judgments.select("query_id", "doc_id").distinct()
    n = relevant.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    return graded_metrics(rankings.select("query_id", "doc_id", "rank").join(relevant, ["query_id", "doc_id"]), n, ks)


def summarise(metrics: DataFrame, *by: str) -> DataFrame:
    """Means over the queries, and their number."""
    names = [c for c in metrics.columns if c.rpartition("_")[0] in ("hit", "precision", "recall", "rr", "ndcg")]
    return metrics.groupBy(*by).agg(F.count("*").alias("query_count"), *(F.round(F.avg(c), 4).alias(c) for c in names))


def query_tags(query: Column, tags: Mapping[str, Sequence[str]] = QUERY_TAGS) -> Column:
    """The tags of which the query holds a word."""
    found = [F.when(F.array_contains(F.transform(F.array(*map(F.lit, words)), lambda w: F.contains(query, w)), True), F.lit(tag)) for tag, words in tags.items()]
    return F.array_compact(F.array(*found))


def best_strategy(summaries: DataFrame) -> DataFrame:
    """The strategy with the largest mean reciprocal rank, recall at 10 and 5 and precision at 3, in this order. Ties go to the first name."""
    key = F.struct(*KEY)
    return summaries.agg(F.min_by("strategy", F.struct(*(-F.col(c) for c in KEY), F.col("strategy"))).alias("strategy"), F.max(key).alias("key")).select("strategy", "key.*")


def recommended_chunking(stats: DataFrame) -> DataFrame:
    """Of chunkings (strategy, rr_10, hit_1, recall_5, chunks) the one that ranks best, with fewer chunks at a tie."""
    order = F.struct(-F.col("rr_10"), -F.col("hit_1"), -F.col("recall_5"), F.col("chunks"), F.col("strategy"))
    return stats.agg(F.min_by(F.struct("strategy", "rr_10", "hit_1", "recall_5", "chunks"), order).alias("b")).select("b.*")


def strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(strategy, query_id, doc_id, rank): ten results of the single lanes on whole queries, and of their fusion."""
    ranked = lanes(spark, sf_dir, whole=False)
    single = ranked.where("sub = 0 and rank <= 10").select(F.col("lane").alias("strategy"), "query_id", "doc_id", "rank")
    hybrid = top_k(merge_lanes(ranked), ["query_id"], [F.desc(r6("rrf")), F.col("doc_id")], 10).select(F.lit("hybrid").alias("strategy"), "query_id", "doc_id", "rank")
    return materialise(single.unionByName(hybrid), "strategies")


def _per_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of each strategy for the queries that have a vector: relevant are the documents of the query's label.

    Labels are compared for the results alone, and counted, so that no pairs of documents are made.
    """
    vectors = read(spark, sf_dir, "embeddings").select("vec_id", "label")
    asked = query_set(spark, sf_dir).where("vec_id is not null").join(vectors, "vec_id").select("query_id", F.col("label").alias("wanted"))
    asked = materialise(asked, "asked")
    counts = vectors.groupBy(F.col("label").alias("wanted")).agg(F.count("*").alias("n_relevant"))
    names = spark.createDataFrame([("exact",), ("hybrid",), ("keyword",), ("vector",)], "strategy string")
    results = materialise(strategies(spark, sf_dir).join(sized(asked), "query_id"), "results")
    graded = vectors.join(sized(results), F.col("vec_id") == F.col("doc_id")).where("label = wanted")
    key = F.struct("strategy", "query_id")
    wanted = asked.join(counts, "wanted").crossJoin(F.broadcast(names)).select(key.alias("query_id"), "n_relevant")
    return graded_metrics(graded.select(key.alias("query_id"), "rank"), wanted).withColumnRenamed("query_id", "of").select("of.*", "*").drop("of")


def q_per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keyword lane on whole queries, held against the documents that hold the query's passage."""
    ranked = lanes(spark, sf_dir, whole=False).where("sub = 0")
    exact = ranked.where("lane = 'exact'")
    graded = ranked.where("lane = 'keyword'").select("query_id", "doc_id", "rank").join(exact.select("query_id", "doc_id"), ["query_id", "doc_id"])
    return graded_metrics(graded, exact.where("rank = 1").select("query_id", F.col("n").alias("n_relevant")))


def q_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise(q_per_query(spark, sf_dir))


def q_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarise(_per_strategy(spark, sf_dir), "strategy")


def q_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_strategy(q_strategies(spark, sf_dir))


def q_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For how many queries each strategy does better than the vector lane, or worse, or as well."""
    m = materialise(_per_strategy(spark, sf_dir), "per-strategy")
    of = m.select("strategy", "query_id", F.struct(*KEY).alias("own"))
    base = of.where("strategy = 'vector'").select("query_id", F.col("own").alias("base"))
    won = F.when(F.col("own") > F.col("base"), "better").when(F.col("own") < F.col("base"), "worse").otherwise("tie")
    return of.where("strategy <> 'vector'").join(sized(base), "query_id").groupBy("strategy", won.alias("outcome")).agg(F.count("*").alias("queries"), r6(F.avg(F.col("own.rr_10") - F.col("base.rr_10"))).alias("rr_delta"))


def q_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of all turns of conversations, by words of the given texts, most frequent first."""
    tags = {"numeric": ("%", "0"), "order": ("of the", "and the"), "question": ("?",)}
    t = read(spark, sf_dir, "conversations").select(F.explode(query_tags(F.col("text"), tags)).alias("tag"))
    return t.groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag")


def reranked_at(candidates: DataFrame, tops: Sequence[int]) -> DataFrame:
    """(strategy, query_id, doc_id, rank): the order of fusion, and with its first rows re-ranked, for each number of them.

    candidates: query_id, doc_id, rank, rerank_score.
    """
    grid = F.array(F.struct(F.lit("no_rerank").alias("strategy"), F.lit(0).alias("top")), *(F.struct(F.lit(f"rerank_top{n}").alias("strategy"), F.lit(n).alias("top")) for n in tops))
    rows = candidates.select("query_id", "doc_id", F.col("rank").alias("old"), "rerank_score", F.explode(grid).alias("g")).select("*", "g.*")
    inside = F.col("old") <= F.col("top")
    by = Window.partitionBy("strategy", "query_id").orderBy(F.desc(inside), F.when(inside, -F.col("rerank_score")), "old", "doc_id")
    return rows.withColumn("rank", F.row_number().over(by)).select("strategy", "query_id", "doc_id", "rank")


def chunked_ranking(chunks: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, doc_id, rank): documents by the best BM25 score of their chunks (doc_id, chunk_index, content)."""
    path = scratch_path(chunks.sparkSession, "chunk-index")
    create(chunks.select(F.struct("doc_id", "chunk_index").alias("id"), "content"), path, {"content": F.col("content")}, id_col="id")
    index = open_index(chunks.sparkSession, path)
    best = best_scores(query_weights(queries, index), index, k, F.col("doc_id.doc_id")).select("query_id", "doc_id", r6("bm25").alias("score"))
    return top_k(best, ["query_id"], [F.desc("score"), F.col("doc_id")], k)


def q_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items held against the documents that hold them, with no re-ranking and that of the first 10 and 20."""
    c = _reranked(_candidates(spark, sf_dir), spark, sf_dir).where("query_id like 'b%'").select("query_id", "doc_id", "rank", "rerank_score", "exact_score")
    c = materialise(c, "grid")
    ranked = reranked_at(c, (10, 20))
    judged = c.where("exact_score > 0")
    key = F.struct("strategy", "query_id")
    names = ranked.select("strategy").distinct()
    relevant = judged.groupBy("query_id").agg(F.count("*").alias("n_relevant")).crossJoin(F.broadcast(names)).select(key.alias("query_id"), "n_relevant")
    hits = ranked.join(judged.select("query_id", "doc_id"), ["query_id", "doc_id"]).select(key.alias("query_id"), "rank")
    m = graded_metrics(hits, relevant).select("query_id.strategy", "*")
    return summarise(m, "strategy")


def q_chunking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items looked for in fixed and in boundary chunks, and which of both to choose."""
    docs, queries = read(spark, sf_dir, "documents"), benchmark_queries(spark, sf_dir)
    judged = materialise(exact_phrases(queries.withColumnRenamed("query", "phrase"), docs), "judged")
    path = scratch_path(spark, "chunkings")
    for name, chunks in (("fixed_1000_100", fixed_chunks(docs)), ("paragraph_1000_100", boundary_chunks(docs))):
        with scratch(spark):  # one chunking's index goes before the next is built
            m = summarise(ir_metrics(chunked_ranking(chunks, queries), judged)).crossJoin(chunks.agg(F.count("*").alias("chunks"))).select(F.lit(name).alias("strategy"), "rr_10", "hit_1", "recall_5", "chunks")
            m.write.mode("append").parquet(path)
    found = spark.read.schema(m.schema).parquet(path)
    return found.join(F.broadcast(recommended_chunking(found).select("strategy", F.lit(True).alias("recommended"))), "strategy", "left").withColumn("recommended", F.coalesce("recommended", F.lit(False)))


def _metrics_sql(rankings: str, name: str = "m", judged: str = "ex", ids: str = "query_id") -> str:
    """CTE of the metrics by ids. rankings: (ids, doc_id, rank); judged: (ids, doc_id)."""
    cols = []
    for k in KS:
        cols.append(
            f"""case when count(rank) filter (rank <= {k}) > 0 then 1.0 else 0.0 end::double as hit_{k}, round(count(rank) filter (rank <= {k}) / {k}.0::double, 6) as precision_{k},
            round(count(rank) filter (rank <= {k}) / any_value(n_relevant)::double, 6) as recall_{k}, round(case when min(rank) <= {k} then 1.0::double / min(rank) else 0 end, 6) as rr_{k},
            round(coalesce(sum(1 / log2(rank + 1)) filter (rank <= {k}), 0) / list_sum(list_transform(range(1, least(any_value(n_relevant), {k}) + 1), lambda i: 1 / log2(i + 1))), 6) as ndcg_{k}"""
        )
    return f"""{name} as (select {ids}, any_value(n_relevant) as n_relevant, min(rank) as first_rank, {", ".join(cols)} from
        (select j.*, count(*) over (partition by {", ".join("j." + c.strip() for c in ids.split(","))}) as n_relevant, r.rank from (select distinct * from {judged}) j left join ({rankings}) r using ({ids}, doc_id)) group by {ids})"""


_KEYWORD = "select query_id, doc_id, rank from lr where lane = 'keyword' and sub = 0"
_STRATEGIES = f"""st_ as (select lane as strategy, query_id, doc_id, rank from lr where sub = 0 and rank <= 10 union all
    select 'hybrid', query_id, doc_id, rank from (select query_id, doc_id, row_number() over (partition by query_id order by round(rrf, 6) desc, doc_id)::int as rank from mg) where rank <= 10),
    ju as (select strategy, query_id, v.vec_id as doc_id from q0 join embeddings q using (vec_id) join embeddings v on v.label = q.label cross join (values ('exact'), ('hybrid'), ('keyword'), ('vector')) t(strategy)),
    {_metrics_sql("select * from st_", "ps", "ju", "strategy, query_id")}"""
_NAMES = [f"{m}_{k}" for k in KS for m in ("hit", "precision", "recall", "rr", "ndcg")]
_MEANS = ", ".join(f"round(avg({c}), 4) as {c}" for c in _NAMES)
_KEY_SQL = lambda t: "(" + ", ".join(f"{t}.{c}" for c in KEY) + ")"
QUERIES = {"ir_metrics_per_query": q_per_query, "ir_metrics_summary": q_summary, "strategy_metrics": q_strategies, "best_strategy": q_best, "strategy_compare": q_compare, "query_tags": q_tags, "rerank_grid": q_grid, "chunking_experiment": q_chunking}
_GRID = " union all ".join(f"select '{name}' as strategy, query_id, doc_id, row_number() over (partition by query_id order by rank <= {n} desc, case when rank <= {n} then -rerank_score end, rank, doc_id)::int as rank from bb" for name, n in (("no_rerank", 0), ("rerank_top10", 10), ("rerank_top20", 20)))


def _chunked_sql(name: str, chunks: str) -> str:
    """CTEs up to the summary of a chunking, whose chunks (doc_id, chunk_index, content) a select gives."""
    n = name
    return f"""{n}c as materialized ({chunks}), {n}d as (select doc_id, chunk_index, {TOKENS_SQL.format("content")} as tk from {n}c), {n}l as (select doc_id, chunk_index, len(tk) as dl from {n}d where len(tk) > 0), {n}s as (select count(*) as n, avg(dl) as avgdl from {n}l),
        {n}t as (select doc_id, chunk_index, token, count(*) as tf from (select doc_id, chunk_index, unnest(tk) as token from {n}d) group by all), {n}f as (select token, count(*) as df from {n}t group by all),
        {n}b as (select query_id, doc_id, chunk_index, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) as bm from qt join {n}f using (token) join {n}t using (token) join {n}l using (doc_id, chunk_index) cross join {n}s group by all),
        {n}o as (select query_id, doc_id, round(max(bm), 6) as score from {n}b group by all), {n}r as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, doc_id)::int as rank from {n}o qualify rank <= 10),
        {_metrics_sql(f"select * from {n}r", f"{n}m", "ej")}"""


_OF = lambda n, name: f"select '{name}' as strategy, round(avg(rr_10), 4) as rr_10, round(avg(hit_1), 4) as hit_1, round(avg(recall_5), 4) as recall_5, (select count(*) from {n}c) as chunks from {n}m"
ORACLE = {
    "ir_metrics_per_query": f"with {LANES_SQL}, ej as (select query_id, doc_id from ex), {_metrics_sql(_KEYWORD, judged='ej')} select * from m",
    "ir_metrics_summary": f"with {LANES_SQL}, ej as (select query_id, doc_id from ex), {_metrics_sql(_KEYWORD, judged='ej')} select count(*) as query_count, {_MEANS} from m",
    "strategy_metrics": f"with {LANES_SQL}, {_STRATEGIES} select strategy, count(*) as query_count, {_MEANS} from ps group by strategy",
    "best_strategy": f"with {LANES_SQL}, {_STRATEGIES}, b as (select strategy, {_MEANS} from ps group by strategy) select strategy, {', '.join(KEY)} from b order by {', '.join(f'{c} desc' for c in KEY)}, strategy limit 1",
    "strategy_compare": f"""with {LANES_SQL}, {_STRATEGIES}, c as (select a.strategy, case when {_KEY_SQL("a")} > {_KEY_SQL("b")} then 'better' when {_KEY_SQL("a")} < {_KEY_SQL("b")} then 'worse' else 'tie' end as outcome, a.rr_10 - b.rr_10 as d
        from ps a join ps b on a.query_id = b.query_id and b.strategy = 'vector' and a.strategy <> 'vector') select strategy, outcome, count(*) as queries, round(avg(d), 6) as rr_delta from c group by 1, 2""",
    "rerank_grid": f"""with {_CAND}, {_scored_sql("fc")}, bb as materialized (select * from rr where query_id like 'b%'), gr as ({_GRID}),
        gj as (select strategy, query_id, doc_id from bb cross join (select distinct strategy from gr) where exact_score > 0), {_metrics_sql("select * from gr", "gm", "gj", "strategy, query_id")} select strategy, count(*) as query_count, {_MEANS} from gm group by strategy""",
    "chunking_experiment": f"""with recursive {_fixed_sql("select doc_id, text from documents", 1000, 900)}, {_boundary_sql("select doc_id, text from documents", 1000, 100)},
        qt as (select query_id, token, count(*) as qtf from (select item_id as query_id, unnest({TOKENS_SQL.format("text")}) as token from benchmark) group by all),
        ej as (select item_id as query_id, doc_id from benchmark b join documents d on contains({COMPACT_SQL.format("d.text")}, {COMPACT_SQL.format("b.text")})),
        {_chunked_sql("fx", "select doc_id, chunk_index, content from k")}, {_chunked_sql("bx", "select doc_id, chunk_index, substring(text, start_char + 1, end_char - start_char) as content from bc join documents using (doc_id)")},
        al as ({_OF("fx", "fixed_1000_100")} union all {_OF("bx", "paragraph_1000_100")})
        select *, row_number() over (order by rr_10 desc, hit_1 desc, recall_5 desc, chunks, strategy) = 1 as recommended from al""",
    "query_tags": "with t as (select unnest([case when contains(text, '%') or contains(text, '0') then 'numeric' end, case when contains(text, 'of the') or contains(text, 'and the') then 'order' end, case when contains(text, '?') then 'question' end]) as tag from conversations) select tag, count(*) as n from t where tag is not null group by 1",
}
