"""Re-ranking: duplicates among results, relevance, recency, authority, a model's scores, and the whole hybrid search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.text import compact, normalised, quoted_phrases, rerank_tokens, section_title
from quern.operators.fusion import LANES_SQL, diversify, floor_sql, fused_results, query_set, relevance_floor, strong_support
from quern.operators.sparse import COMPACT_SQL, TITLE_SQL
from quern.plans.common import BROADCAST_IDS, materialise, r6, read, sized, top_k

AS_OF = "2024-02-01"
# How far a kind of source is trusted.
AUTHORITY = {"official_doc": 1.0, "policy": 0.9, "report": 0.8, "document": 0.75, "spreadsheet": 0.78, "presentation": 0.68, "structured_data": 0.82, "code": 0.85, "article": 0.6, "comment": 0.4, "unknown": 0.5}
# The kind of source that a type of file stands for.
SOURCE_OF = {"pdf": "document", "docx": "document", "md": "document", "markdown": "document", "txt": "document", "pptx": "presentation", "xlsx": "spreadsheet", "xls": "spreadsheet", "csv": "spreadsheet", "tsv": "spreadsheet", "json": "structured_data", "xml": "structured_data", "yaml": "structured_data", "yml": "structured_data", "code": "code", "html": "article"}
# Weights, thresholds and bonuses of the re-ranking.
SIMILARITY, RECENCY, TRUST, RELEVANCE, DIVERSITY, SEMANTIC = 0.6, 0.15, 0.1, 0.15, 0.05, 0.75
MIN_RELEVANCE, MIN_SEMANTIC, AGREES, DISAGREES, DUPLICATE = 0.28, 0.55, 0.08, 0.12, 0.9
SECOND_TOP, SECOND_SHARE, SURE, CLEAR = 8, 0.75, 0.72, 0.04


def _lookup(table: dict[str, object], key: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key]


def query_relevance(asked: dict[str, Column], content: Column, structured: Column, reference: Column, exact_lane: Column, content_tokens: Column | None = None) -> Column:
    """How much of the query's tokens the content (.72), structural fields (.14) and titles (.04) have, and exact hits.

    asked: tokens, whole (compact) and phrases (compact) of the query; the others are texts, and
    content_tokens the content's tokens where they are known. A quoted
    phrase in the content or structure adds .08 unless the exact lane has it already; the whole query
    in the titles adds .02, a phrase there .012. Without a query it is .5.
    """
    n = F.size(asked["tokens"])
    of = lambda tokens: F.when(n > 0, F.size(F.array_intersect(asked["tokens"], tokens)) / n).otherwise(0.0)
    share = lambda text: of(rerank_tokens(F.coalesce(text, F.lit(""))))
    has = lambda text: F.exists(asked["phrases"], lambda p: F.contains(compact(F.coalesce(text, F.lit(""))), p))
    named = compact(F.coalesce(reference, F.lit("")))
    in_titles = F.when((asked["whole"] != "") & F.contains(named, asked["whole"]), 1.0).when(has(reference), 0.6).otherwise(0.0)
    phrase = F.when(~exact_lane & (has(content) | has(structured)), 1.0).otherwise(0.0)
    score = 0.72 * (share(content) if content_tokens is None else of(content_tokens)) + 0.14 * share(structured) + 0.04 * share(reference) + 0.08 * phrase + 0.02 * in_titles
    return F.when(asked["whole"] == "", 0.5).otherwise(F.least(F.lit(1.0), score))


def recency(ts: Column, as_of: str = AS_OF) -> Column:
    age = F.datediff(F.lit(as_of).cast("date"), ts.cast("date"))
    return F.when(ts.isNull(), 0.5).when(age <= 7, 1.0).when(age <= 30, 0.9).when(age <= 180, 0.75).when(age <= 365, 0.6).otherwise(0.45)


def authority(kind: Column, region: Column | None = None, file_type: Column | None = None) -> Column:
    """The trust in a kind of source, which the type of its file tells if it isn't given; page furniture has little."""
    of = F.coalesce(F.nullif(kind, F.lit("")), _lookup(SOURCE_OF, F.lower(file_type)) if file_type is not None else F.lit(None).cast("string"))
    found = F.coalesce(_lookup(AUTHORITY, of), F.lit(0.5))
    return found if region is None else F.when(region.isin("header", "footer"), 0.2).otherwise(found)


def retrieval_signal(vector: Column, keyword: Column, exact: Column) -> Column:
    return F.least(F.lit(1.0), 0.45 * vector + 0.2 * keyword + 0.35 * exact)


def feature_score(similarity: Column, signal: Column, recent: Column, trusted: Column, relevance: Column, hits: Column) -> Column:
    """A similarity of 0, or none, counts as .5."""
    near = F.coalesce(F.nullif(similarity, F.lit(0.0)), F.lit(0.5))
    return SIMILARITY * F.greatest(near, signal) + RECENCY * recent + TRUST * trusted + RELEVANCE * F.least(F.lit(1.0), 0.8 * relevance + 0.2 * F.least(F.lit(1.0), hits / 3))


def diversity_score(lanes: Column) -> Column:
    """A third for each lane that found the result."""
    return F.least(F.lit(1.0), F.size(lanes) / 3)


def semantic_blend(feature: Column, diversity: Column, semantic: Column, relevance: Column, exact: Column, exact_score: Column) -> Column:
    """Features and diversity, with three quarters of a model's score where there is one; if both are sure or neither is, it moves.

    semantic: the model's score, or null.
    """
    own = feature + DIVERSITY * diversity
    supported = (exact_score >= 0.9) | exact
    agrees = (semantic >= MIN_SEMANTIC) & ((relevance >= MIN_RELEVANCE) | supported)
    disagrees = (semantic < 0.6 * MIN_SEMANTIC) & (relevance < 0.7 * MIN_RELEVANCE) & ~supported
    moved = (1 - SEMANTIC) * own + SEMANTIC * semantic + F.when(agrees, AGREES).when(disagrees, -DISAGREES).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(moved, own)))


def cascade(df: DataFrame, first: str, second: str) -> DataFrame:
    """Adds cascaded: a second model's score blended in for the best of a query whose first scores are low or close.

    Only the second scores of the SECOND_TOP best rows of such queries are looked at; ties go by doc_id.
    """
    by = Window.partitionBy("query_id").orderBy(F.desc(first), "doc_id")
    whole = by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    top, runner_up = F.first(first).over(whole), F.coalesce(F.nth_value(first, 2).over(whole), F.lit(0.0))
    unsure = (top < SURE) | (top - runner_up < CLEAR)
    ranked = df.withColumn("unsure", unsure).withColumn("place", F.row_number().over(by))
    blended = (1 - SECOND_SHARE) * F.col(first) + SECOND_SHARE * F.col(second)
    return ranked.withColumn("cascaded", F.when(F.col("unsure") & (F.col("place") <= SECOND_TOP), blended).otherwise(F.col(first)))


def word_share(a_tokens: Column, b_tokens: Column) -> Column:
    """Jaccard of two token sets, 0 without tokens."""
    union = F.size(F.array_union(a_tokens, b_tokens))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a_tokens, b_tokens)) / union)


def word_set(tokens: Column) -> Column:
    """A name for a set of tokens, which hold no line breaks."""
    return F.sha2(F.concat_ws("\n", F.sort_array(F.array_distinct(tokens))), 256)


def blended_similarity(share: Column, a_len: Column, b_len: Column) -> Column:
    return 0.75 * share + 0.25 * F.when(F.greatest(a_len, b_len) == 0, 1.0).otherwise(F.least(a_len, b_len) / F.greatest(a_len, b_len))


def text_similarity(a_tokens: Column, b_tokens: Column, a_len: Column, b_len: Column) -> Column:
    """Three quarters Jaccard of the token sets, one quarter the ratio of the lengths."""
    return blended_similarity(word_share(a_tokens, b_tokens), a_len, b_len)


def similar_results(ranked: DataFrame, threshold: float = DUPLICATE) -> DataFrame:
    """Pairs of a query's results that are duplicates: similar texts of the same source, or neighbouring chunks of one file.

    ranked: query_id, doc_id, rank, tokens, len, source, the word_set words if it is known, and file_id and chunk_index where results are
    chunks; at most the ranking's length for each query. The same chunk is a duplicate whatever it
    holds. Results without text have no duplicates, nor has a text of another source.
    """
    extra = [c for c in ("file_id", "chunk_index") if c in ranked.columns]
    ranked = ranked if "words" in ranked.columns else ranked.withColumn("words", word_set(F.col("tokens")))
    narrow = ranked.select("query_id", "doc_id", "rank", "len", "source", *extra, "words", F.size(F.array_distinct("tokens")).alias("n"))
    a, b = narrow.alias("a"), narrow.alias("b")
    pairs = a.join(b, (F.col("a.query_id") == F.col("b.query_id")) & (F.col("a.rank") < F.col("b.rank")) & (F.col("a.len") > 0) & (F.col("b.len") > 0))
    same = F.coalesce("a.source", F.lit("")) == F.coalesce("b.source", F.lit(""))
    again = F.lit(False)
    if "chunk_index" in ranked.columns:
        file = F.col("a.file_id") == F.col("b.file_id")
        again = F.coalesce(file & (F.col("a.chunk_index") == F.col("b.chunk_index")), F.lit(False))
        same = same | F.coalesce(file, F.lit(False))
    # Two sets are no more alike than their sizes; only pairs that may reach the threshold are compared.
    most = 0.75 * F.when(F.greatest("a.n", "b.n") == 0, 0.0).otherwise(F.least("a.n", "b.n") / F.greatest("a.n", "b.n")) + 0.25 * F.least("a.len", "b.len") / F.greatest("a.len", "b.len")
    may = pairs.where(again | (same & (most >= threshold - 1e-5)))
    of = [F.col(f"{t}.{c}").alias(f"{which}_{name}") for c, name in (("doc_id", "id"), ("rank", "rank"), ("len", "len"), ("words", "words")) for t, which in (("a", "first"), ("b", "second"))]
    may = materialise(may.select("a.query_id", *of, F.col("a.n").alias("n"), again.alias("again")), "pairs")
    # Texts of the same words need no tokens, and two sets of words are compared once, however many results have them.
    differ = materialise(may.where("first_words <> second_words").select(F.least("first_words", "second_words").alias("one"), F.greatest("first_words", "second_words").alias("other")).distinct(), "word-sets")
    wanted = materialise(differ.select(F.col("one").alias("words")).union(differ.select("other")).distinct(), "words")
    tokens = materialise(ranked.select("words", "tokens").join(sized(wanted), "words", "left_semi").groupBy("words").agg(F.first("tokens").alias("tokens")), "tokens-of-words")
    one = differ.join(tokens.select(F.col("words").alias("one"), F.col("tokens").alias("a")), "one").join(tokens.select(F.col("words").alias("other"), F.col("tokens").alias("b")), "other")
    shares = materialise(one.select("one", "other", word_share(F.col("a"), F.col("b")).alias("share")), "word-shares")
    ordered = may.withColumns({"one": F.least("first_words", "second_words"), "other": F.greatest("first_words", "second_words")})
    found = ordered.join(sized(shares), ["one", "other"], "left")
    share = F.when(F.col("first_words") != F.col("second_words"), F.col("share")).otherwise(F.when(F.col("n") == 0, 0.0).otherwise(1.0))
    similarity = r6(blended_similarity(share, F.col("first_len"), F.col("second_len")))
    scored = found.select("query_id", "first_id", "second_id", "first_rank", "second_rank", similarity.alias("similarity"), "again")
    return scored.where(F.col("again") | (F.col("similarity") >= threshold)).drop("again")


def greedy_dedup(ranked: DataFrame, pairs: DataFrame) -> DataFrame:
    """The results that stay when each is dropped that is a duplicate of a kept one before it.

    A query has few pairs: they are put in the order of their second results, and one pass over them
    gathers what is dropped.
    """
    ordered = F.array_sort(F.collect_list(F.struct("second_rank", "first_rank", "first_id", "second_id")))
    kind = pairs.schema["second_id"].dataType.simpleString()
    gone = F.aggregate(ordered, F.array().cast(f"array<{kind}>"), lambda out, p: F.when(F.array_contains(out, p["first_id"]), out).otherwise(F.array_append(out, p["second_id"])))
    losers = pairs.groupBy("query_id").agg(gone.alias("gone")).select("query_id", F.explode(F.array_distinct("gone")).alias("doc_id"))
    return ranked.join(sized(materialise(losers, "losers")), ["query_id", "doc_id"], "left_anti")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused results with their documents' texts and what comparing them needs. Not written: texts are read where they lie, once for each use."""
    fused = materialise(fused_results(spark, sf_dir), "fused")
    ids = materialise(fused.select("doc_id").distinct(), "fused-ids")
    docs = read(spark, sf_dir, "documents").join(sized(ids, BROADCAST_IDS), "doc_id", "left_semi")
    once = docs.select("doc_id", "text", "source", rerank_tokens("text").alias("tokens"), F.length(normalised("text")).alias("len"))  # once for each document, not for each result
    once = once.withColumn("words", word_set(F.col("tokens")))
    return once.join(sized(fused), "doc_id").select(*fused.columns, "text", "source", "tokens", "len", "words")


def _comparable(candidates: DataFrame, *keep: str) -> DataFrame:
    """keep and what similar_results needs of candidates, as a scratch table without their texts."""
    return materialise(candidates.select("query_id", "doc_id", "rank", "source", "tokens", "len", "words", *keep), "candidates")


def rerank(candidates: DataFrame, queries: DataFrame, title: Column, recent: Column, trusted: Column, semantic: Column) -> DataFrame:
    """Adds relevance, signal, feature_score, diversity and rerank_score to candidates.

    candidates: query_id, doc_id, score, the lanes' scores, lanes, hits, text, and tokens of the text where
    they are known; queries: (query_id, query).
    """
    asked = queries.select("query_id", rerank_tokens("query").alias("asked"), compact("query").alias("whole"), F.transform(quoted_phrases("query"), compact).alias("phrases"))
    c = candidates.join(sized(asked), "query_id")
    exact = F.array_contains("lanes", "exact")
    relevance = query_relevance({"tokens": F.col("asked"), "whole": F.col("whole"), "phrases": F.col("phrases")}, F.col("text"), title, title, exact, F.col("tokens") if "tokens" in candidates.columns else None)
    c = c.withColumn("relevance", relevance).withColumn("signal", retrieval_signal(F.col("vector_score"), F.col("keyword_score"), F.col("exact_score")))
    c = c.withColumn("feature_score", feature_score(F.col("score"), F.col("signal"), recent, trusted, F.col("relevance"), F.col("hits"))).withColumn("diversity", diversity_score(F.col("lanes")))
    return c.withColumn("rerank_score", r6(semantic_blend(F.col("feature_score"), F.col("diversity"), semantic, F.col("relevance"), exact, F.col("exact_score")))).drop("asked", "whole", "phrases")


def _reranked(candidates: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no dates and are plain texts; the vectors' similarity stands for a model's score."""
    semantic = F.when(F.array_contains("lanes", "vector"), F.col("vector_score"))
    return rerank(candidates, query_set(spark, sf_dir).select("query_id", "query"), section_title("text"), recency(F.lit(None).cast("timestamp")), authority(F.lit(""), file_type=F.lit("txt")), semantic)


def q_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _reranked(_candidates(spark, sf_dir), spark, sf_dir)
    out = out.select("query_id", "doc_id", r6("relevance").alias("relevance"), r6("signal").alias("signal"), r6("feature_score").alias("feature_score"), r6("diversity").alias("diversity"), "rerank_score")
    return top_k(out, ["query_id"], [F.desc("rerank_score"), F.col("doc_id")], 10)


def q_dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-ranked by dates and kinds of their own: a document is as recent as the last event of the user with its number, and of a type by its number; both may be unknown."""
    last = read(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc_id")).agg(F.max("ts").alias("last"))
    c = _candidates(spark, sf_dir)
    dates = materialise(c.select("doc_id").distinct().join(last, "doc_id"), "dates")
    c = c.join(sized(dates), "doc_id", "left")
    kind = F.get(F.array(*map(F.lit, [*SOURCE_OF, "exe"])), (F.col("doc_id") % (len(SOURCE_OF) + 1)).cast("int"))
    semantic = F.when(F.array_contains("lanes", "vector"), F.col("vector_score"))
    region = F.when(F.col("doc_id") % 7 == 0, "header")
    out = rerank(c, query_set(spark, sf_dir).select("query_id", "query"), section_title("text"), recency(F.col("last"), "2024-06-01"), authority(F.lit(""), region, kind), semantic)
    return top_k(out.select("query_id", "doc_id", r6("feature_score").alias("feature_score"), "rerank_score"), ["query_id"], [F.desc("rerank_score"), F.col("doc_id")], 10)


def q_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-ranked as if nothing were known of the results but their texts."""
    zero = F.lit(0.0)
    c = _candidates(spark, sf_dir).withColumns({"score": zero, "vector_score": zero, "keyword_score": zero, "exact_score": zero, "lanes": F.array().cast("array<string>"), "hits": F.lit(0).cast("long")})
    out = _reranked(c, spark, sf_dir).select("query_id", "doc_id", "rerank_score")
    return top_k(out, ["query_id"], [F.desc("rerank_score"), F.col("doc_id")], 10)


def q_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused scores as the first model's, token overlap as the second's."""
    out = _reranked(_candidates(spark, sf_dir), spark, sf_dir).select("query_id", "doc_id", "score", "relevance")
    return cascade(out, "score", "relevance").select("query_id", "doc_id", "unsure", F.round("cascaded", 8).alias("cascaded"))


def q_near_dup_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_results(_comparable(_candidates(spark, sf_dir)))


def q_greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _comparable(_candidates(spark, sf_dir), "score")
    return greedy_dedup(c.select("query_id", "doc_id", "score", "rank"), similar_results(c))


def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lanes, fusion, duplicates dropped, re-ranked, spread over sources, and the relevance floor, for the whole query set."""
    # A result is scored by itself, so that all are while their texts are at hand, and duplicates go afterwards.
    scored = _reranked(_candidates(spark, sf_dir), spark, sf_dir)
    semantic = F.when(F.array_contains("lanes", "vector"), F.col("vector_score"))
    strong = strong_support(F.array_contains("lanes", "exact"), F.col("hits"), F.col("relevance"), semantic, F.col("signal"))
    c = _comparable(scored.withColumn("strong", strong), "rerank_score", "lanes", "strong")
    kept = greedy_dedup(c.drop("tokens"), similar_results(c))
    scored = kept.select("query_id", "doc_id", "source", F.col("rerank_score").alias("score"), "lanes", "strong")
    return relevance_floor(diversify(materialise(scored, "reranked"), "source")).select("query_id", "doc_id", "source", "score", "lanes", "position", "strong")


def recency_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How recent the last event of each user is."""
    last = read(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    return last.select("user_id", recency(F.col("last"), "2024-06-01").alias("recency"), recency(F.when(F.col("user_id") % 2 == 0, F.col("last"))).alias("of_known"))


def authority_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and documents by kind, region and type of file."""
    d = read(spark, sf_dir, "documents").select(F.lit("").alias("kind"), F.when(F.col("doc_id") % 7 == 0, "header").alias("region"), F.get(F.array(*map(F.lit, [*SOURCE_OF, "exe"])), (F.col("doc_id") % (len(SOURCE_OF) + 1)).cast("int")).alias("file_type"))
    p = read(spark, sf_dir, "pages").select(F.get(F.array(*map(F.lit, [*AUTHORITY, "other"])), (F.col("page_id") % (len(AUTHORITY) + 1)).cast("int")), F.lit(None).cast("string"), F.lit("html"))
    rows = d.union(p).withColumn("authority", authority(F.col("kind"), F.col("region"), F.col("file_type")))
    return rows.groupBy("authority").agg(F.count("*").alias("n"))


_TOK = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"
_CAND = f"""{LANES_SQL}, fc as materialized (select fu.*, d.source, d.text, {_TOK.format("d.text")} as tokens, length(trim(regexp_replace(lower(d.text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))) as len from fu join documents d using (doc_id))"""
_PAIRS = f"""pr as (select a.query_id, a.doc_id as first_id, b.doc_id as second_id, a.rank as first_rank, b.rank as second_rank,
    round(0.75 * len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(a.tokens || b.tokens)) + 0.25 * least(a.len, b.len) / greatest(a.len, b.len), 6) as similarity
    from fc a join fc b on a.query_id = b.query_id and a.rank < b.rank and a.len > 0 and b.len > 0 and coalesce(a.source, '') = coalesce(b.source, '')),
    np as materialized (select * from pr where similarity >= {DUPLICATE})"""
#: Rank by rank: a result is dropped if a kept one before it is its duplicate.
_GREEDY = """gd as (select 0 as r, query_id, []::bigint[] as kept from (select distinct query_id from fc) union all
    select gd.r + 1, gd.query_id, case when c.doc_id is null or len(list_filter(gd.kept, lambda x: list_contains(coalesce(c.firsts, []), x))) > 0 then gd.kept else list_append(gd.kept, c.doc_id) end
    from gd left join (select query_id, rank, doc_id, (select list(first_id) from np where np.query_id = fc.query_id and np.second_id = fc.doc_id) as firsts from fc) c on c.query_id = gd.query_id and c.rank = gd.r + 1 where gd.r < 30),
    kd as (select fc.* from fc join gd on gd.r = 30 and gd.query_id = fc.query_id and list_contains(gd.kept, fc.doc_id))"""


def _scored_sql(table: str, name: str = "rr", known: str = "0.075 + 0.075") -> str:
    """CTEs up to name: table re-ranked. known: what recency and trust add."""
    title = TITLE_SQL.format("text")
    share = lambda x: f"case when len(asked) = 0 then 0 else len(list_intersect(asked, {_TOK.format(x)})) / len(asked)::double end"
    return f"""qt as (select query_id, {_TOK.format("query")} as asked, {COMPACT_SQL.format("query")} as whole from q0),
        ra as (select c.*, case when whole = '' then 0.5 else least(1.0, 0.72 * {share("text")} + 0.18 * {share(title)} + 0.02 * case when contains({COMPACT_SQL.format(title)}, whole) then 1 else 0 end) end as relevance,
            least(1.0, 0.45 * vector_score + 0.2 * keyword_score + 0.35 * exact_score) as signal from {table} c join qt using (query_id)),
        rb as (select *, 0.6 * greatest(case when score = 0 then 0.5 else score end, signal) + {known} + 0.15 * least(1.0, 0.8 * relevance + 0.2 * least(1.0, hits / 3)) as feature_score, least(1.0, len(lanes) / 3) as diversity,
            case when list_contains(lanes, 'vector') then vector_score end as semantic, list_contains(lanes, 'exact') as exact from ra),
        rc as (select *, feature_score + 0.05 * diversity as own, case when semantic >= 0.55 and (relevance >= 0.28 or exact) then 0.08 when semantic < 0.33 and relevance < 0.196 and not exact then -0.12 else 0 end as moved from rb),
        {name} as (select *, round(greatest(0.0, least(1.0, case when semantic is null then own else 0.25 * own + 0.75 * semantic + moved end)), 6) as rerank_score from rc)"""


_HYBRID = f"""with recursive {_CAND}, {_PAIRS}, {_GREEDY}, {_scored_sql("kd")},
    hs as (select query_id, doc_id, source, rerank_score as score, lanes, exact or hits >= 2 or relevance >= 0.28 or coalesce(semantic >= 0.55, false) or signal >= 0.28 as supported from rr),
    hv as (select *, least(3, row_number() over (partition by query_id, source order by score desc, doc_id))::int as pass from hs),
    hp as (select *, row_number() over (partition by query_id order by pass, score desc, doc_id)::int as position from hv qualify position <= 10),
    {floor_sql("hp", "supported", "query_id, doc_id, source, score, lanes, position, strong")}"""
QUERIES = {"rerank_features": q_features, "rerank_dated": q_dated, "heuristic_rerank": q_heuristic, "cascade_rerank": q_cascade, "near_dup_pairs": q_near_dup_pairs, "greedy_dedup": q_greedy_dedup, "hybrid_search": hybrid_search, "recency_scores": recency_scores, "authority_scores": authority_scores}
_RECENT = "case when age is null then 0.5 when age <= 7 then 1.0 when age <= 30 then 0.9 when age <= 180 then 0.75 when age <= 365 then 0.6 else 0.45 end"
_TRUST = "case when doc_id % 7 = 0 then 0.2 else coalesce((select v from au join sk on au.k = sk.k where sk.f = ([" + ", ".join(f"'{k}'" for k in SOURCE_OF) + f", 'exe'])[(doc_id % {len(SOURCE_OF) + 1}) + 1]), 0.5) end"
ORACLE = {
    "rerank_dated": f"""with {_CAND}, ag as (select user_id, date '2024-06-01' - max(ts)::date as age from events group by 1), au as (select * from (values {", ".join(f"('{k}', {v})" for k, v in AUTHORITY.items())}) t(k, v)), sk as (select * from (values {", ".join(f"('{k}', '{v}')" for k, v in SOURCE_OF.items())}) t(f, k)),
        dc as (select fc.*, {_RECENT} as recent, {_TRUST} as trust from fc left join ag on ag.user_id = fc.doc_id), {_scored_sql("dc", known="0.15 * recent + 0.1 * trust")}, o as (select query_id, doc_id, round(feature_score, 6) as feature_score, rerank_score from rr)
        select *, row_number() over (partition by query_id order by rerank_score desc, doc_id)::int as rank from o qualify rank <= 10""",
    "rerank_features": f"""with {_CAND}, {_scored_sql("fc")}, o as (select query_id, doc_id, round(relevance, 6) as relevance, round(signal, 6) as signal, round(feature_score, 6) as feature_score, round(diversity, 6) as diversity, rerank_score from rr)
        select *, row_number() over (partition by query_id order by rerank_score desc, doc_id)::int as rank from o qualify rank <= 10""",
    "heuristic_rerank": f"""with {_CAND}, zc as (select * replace (0.0::double as score, 0.0::double as vector_score, 0.0::double as keyword_score, 0.0::double as exact_score, []::varchar[] as lanes, 0 as hits) from fc), {_scored_sql("zc")}, o as (select query_id, doc_id, rerank_score from rr)
        select *, row_number() over (partition by query_id order by rerank_score desc, doc_id)::int as rank from o qualify rank <= 10""",
    "cascade_rerank": f"""with {_CAND}, {_scored_sql("fc")}, p as (select query_id, doc_id, score, relevance, row_number() over (partition by query_id order by score desc, doc_id) as place from rr),
        u as (select *, max(score) over (partition by query_id) as top, coalesce(max(case when place = 2 then score end) over (partition by query_id), 0) as second from p)
        select query_id, doc_id, top < 0.72 or top - second < 0.04 as unsure, round(case when (top < 0.72 or top - second < 0.04) and place <= 8 then 0.25 * score + 0.75 * relevance else score end, 8) as cascaded from u""",
    "near_dup_pairs": f"with {_CAND}, {_PAIRS} select * from np",
    "greedy_dedup": f"with recursive {_CAND}, {_PAIRS}, {_GREEDY} select query_id, doc_id, score, rank from kd",
    "hybrid_search": _HYBRID,
    "recency_scores": """with u as (select user_id, date '2024-06-01' - max(ts)::date as a, case when user_id % 2 = 0 then date '2024-02-01' - max(ts)::date end as b from events group by 1)
        select user_id, case when a <= 7 then 1.0 when a <= 30 then 0.9 when a <= 180 then 0.75 when a <= 365 then 0.6 else 0.45 end::double as recency, case when b is null then 0.5 when b <= 7 then 1.0 when b <= 30 then 0.9 when b <= 180 then 0.75 when b <= 365 then 0.6 else 0.45 end::double as of_known from u""",
    "authority_scores": f"""with a as (select * from (values {", ".join(f"('{k}', {v})" for k, v in AUTHORITY.items())}) t(k, v)), s as (select * from (values {", ".join(f"('{k}', '{v}')" for k, v in SOURCE_OF.items())}) t(f, k)),
        r as (select case when doc_id % 7 = 0 then 0.2 else coalesce((select v from a join s on a.k = s.k where s.f = ([{", ".join(f"'{k}'" for k in SOURCE_OF)}, 'exe'])[(doc_id % {len(SOURCE_OF) + 1}) + 1]), 0.5) end::double as authority from documents
            union all select coalesce((select v from a where k = ([{", ".join(f"'{k}'" for k in AUTHORITY)}, 'other'])[(page_id % {len(AUTHORITY) + 1}) + 1]), 0.5)::double from pages)
        select authority, count(*) as n from r group by 1""",
}
