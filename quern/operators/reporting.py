"""Reports over conversations, executions and calls, and the canned queries behind them.

Tables are mapped as follows: conversations with turns stand for conversations and messages, events
for executions and tool calls (error: failed; value: milliseconds), documents for files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.text import preview
from quern.plans.common import r6, read, top_k

AS_OF = "2024-01-29 00:00:00"


def all_equal(where: dict[str, object]) -> Column:
    """The conjunction of equalities; None matches null."""
    return reduce(Column.__and__, (F.col(c).eqNullSafe(F.lit(v)) for c, v in where.items()), F.lit(True))


def scope(tenant: tuple[str, object], base: str | None, explicit: dict[str, object] | None = None) -> Column:
    """A tenant's rows: the tenant can't be overridden, the knowledge base (column label) can; None is dropped."""
    column, value = tenant
    given = {k: v for k, v in ({"label": base} | (explicit or {})).items() if v is not None and k != column}
    return all_equal(given) & (F.col(column) == F.lit(value))


def select_many(df: DataFrame, columns: list[str], where: dict[str, object] | None = None, order_by: list[tuple[str, bool]] | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Columns of the rows that equal where, ordered by (column, ascending) with nulls first, cut by limit and offset.

    Names that the table doesn't have are refused. A limit of 0 gives no rows, None all.
    """
    for c in [*columns, *(where or {}), *(c for c, _ in order_by or [])]:
        if c not in df.columns:
            raise ValueError(f"no such column: {c}")
    out = df.where(all_equal(where or {}))
    if order_by:
        out = out.orderBy(*(F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in order_by))
    if offset:
        out = out.offset(offset)
    if limit is not None:
        out = out.limit(limit)
    return out.select(*columns)


def is_blank(c: Column | str) -> Column:
    """Null or empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) == ""


def active(df: DataFrame, flag: str = "is_active") -> DataFrame:
    """Rows that aren't deleted softly."""
    return df.where(F.coalesce(F.col(flag).cast("boolean"), F.lit(False)))


def clamped(k: int, least: int = 1, most: int = 30) -> int:
    """A number of results within what may be asked for."""
    return max(least, min(most, int(k)))


def newest_first(df: DataFrame, *columns: str) -> DataFrame:
    """Ordered by the first of the columns that isn't null, latest first; rows without any come last."""
    return df.orderBy(F.coalesce(*(F.col(c).cast("string") for c in columns), F.lit("")).desc())


def zipped(df: DataFrame, key: str, *arrays: str) -> DataFrame:
    """A row for each place of arrays that belong together by position; what a shorter one lacks is null."""
    return df.select(key, F.posexplode(F.arrays_zip(*arrays)).alias("pos", "row")).select(key, "pos", "row.*")


def document_record(row: dict[str, Column], metadata: Column) -> list[Column]:
    """The columns of a document's record: the row's fields, else those of its metadata (JSON), else what stands for nothing.

    row: file_name, file_type, file_size, chunk_count, created_at, summary; all optional.
    """
    of = lambda name, kind, default: F.coalesce(row.get(name, F.lit(None)).cast(kind), F.get_json_object(metadata, f"$.{name}").try_cast(kind), F.lit(default).cast(kind)).alias(name)
    return [of("file_name", "string", "unknown"), of("file_type", "string", "other"), of("file_size", "bigint", 0), of("chunk_count", "int", 0), of("created_at", "string", ""), of("summary", "string", "")]


def latest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The row of each key with the largest order, without a window."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row")).select(key, "row.*")


def success_rate(ok: Column, total: Column) -> Column:
    return F.when(total > 0, r6(ok * 100.0 / total)).otherwise(0.0)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events")


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations")


def conversation_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation with its number of messages and a preview of its last user message."""
    t = _turns(spark, sf_dir)
    return t.groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"), preview(F.max_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn")))).alias("last_user"))


def execution_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("failed", F.col("event_type") == "error")
    return e.groupBy("user_id", "failed").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("avg_ms"), F.max("value").alias("max_ms"), F.min("value").alias("min_ms"))


def tool_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional counts for each tool, the mean of its durations without nulls, and its success rate."""
    e = _events(spark, sf_dir)
    ok = F.count_if(F.col("value") < 100)
    return e.groupBy("event_type").agg(F.count("*").alias("total"), ok.alias("ok"), F.count_if(F.col("value") >= 100).alias("slow"), r6(F.avg("value")).alias("avg_ms"), success_rate(ok, F.count("*")).alias("success_rate"))


def usage_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    ok = F.count_if(F.col("event_type") != "error")
    used = e.groupBy("user_id").agg(F.count("*").alias("calls"), ok.alias("ok"), success_rate(ok, F.count("*")).alias("success_rate"))
    return used.orderBy(F.desc("calls"), "user_id").limit(10)


def file_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left")
    return d.groupBy("source").agg(
        F.count("*").alias("total"), F.count_if(F.col("quality") == 1).alias("completed"), F.count_if(F.col("quality") == 0).alias("failed"),
        F.count_if(F.col("quality").isNull()).alias("pending"), F.sum("n_chars").alias("size"),
    )


def daily_activity(spark: SparkSession, sf_dir: str, days: int = 7, as_of: str = AS_OF) -> DataFrame:
    since = F.expr(f"timestamp_ntz'{as_of}' - interval {int(days)} days")
    e = _events(spark, sf_dir).where((F.col("ts") >= since) & (F.col("ts") < F.expr(f"timestamp_ntz'{as_of}'")))
    return e.groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"))


def usage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily use at two grains: (tool, user, day) and (tool, day)."""
    e = _events(spark, sf_dir).withColumn("day", F.to_date("ts").cast("string"))
    sets = [[F.col("event_type"), F.col("user_id"), F.col("day")], [F.col("event_type"), F.col("day")]]
    return e.groupingSets(sets, "event_type", "user_id", "day").agg(F.count("*").alias("calls"), F.count_if(F.col("value") >= 100).alias("failed"), r6(F.avg("value")).alias("avg_ms"))


def system_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four totals in one row."""
    users = _events(spark, sf_dir).agg(F.countDistinct("user_id").alias("users"))
    for name, df in (("conversations", _turns(spark, sf_dir).select("conv_id").distinct()), ("messages", _turns(spark, sf_dir)), ("files", read(spark, sf_dir, "documents"))):
        users = users.crossJoin(F.broadcast(df.agg(F.count("*").alias(name))))
    return users


def recent_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three last messages of each conversation, newest first."""
    return top_k(_turns(spark, sf_dir), ["conv_id"], [F.desc("turn")], 3).select("conv_id", "turn", "role", "rank")


def last_n_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four last messages of each conversation as one text in their order."""
    kept = top_k(_turns(spark, sf_dir), ["conv_id"], [F.desc("turn")], 4)
    parts = F.array_sort(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))))
    return kept.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("history"))


def next_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _turns(spark, sf_dir).groupBy("conv_id").agg((F.coalesce(F.max("turn"), F.lit(0)) + 1).alias("next_turn"))


def latest_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).select("user_id", "ts", "event_id", "event_type", "value")
    return latest(e, "user_id", ["ts", "event_id"])


def message_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that hold a text; % and _ stand for themselves."""
    return _turns(spark, sf_dir).where(F.contains("text", F.lit("the "))).select("conv_id", "turn", "role")


def paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page 3 of 20 conversations."""
    c = _turns(spark, sf_dir).groupBy("conv_id").agg(F.count("*").alias("messages"))
    return select_many(c, ["conv_id", "messages"], order_by=[("messages", False), ("conv_id", True)], limit=20, offset=40)


def vector_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source, how many have a vector, and the status that follows."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.lit(1).alias("has"))
    c = read(spark, sf_dir, "documents").join(v, "doc_id", "left").groupBy("source").agg(F.count("*").alias("total"), F.count("has").alias("vectorised"))
    return c.withColumn("status", F.when(F.col("total") == 0, "pending").when(F.col("total") == F.col("vectorised"), "succeeded").otherwise("running"))


def missing_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").join(read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti").select("doc_id", "source")


def allowed_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = read(spark, sf_dir, "labels").where("quality = 1 and toxic = 0")
    return read(spark, sf_dir, "documents").join(good, "doc_id", "left_semi").select("doc_id", "lang")


def corpus_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows first, then all documents; the first of each id counts and says where it came from."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("place"), F.lit("database").alias("origin"))
    l = read(spark, sf_dir, "labels").select("doc_id", F.lit(0).alias("place"), F.lit("store").alias("origin"))  # noqa: E741
    return l.unionByName(d).groupBy("doc_id").agg(F.min_by("origin", "place").alias("origin"))


def last_user_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each assistant turn the turn of the user message before it."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    t = _turns(spark, sf_dir).withColumn("asked", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w))
    return t.where("role = 'assistant'").select("conv_id", "turn", "asked")


def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative bucket counts of each tool's durations, with count and sum."""
    e = _events(spark, sf_dir)
    bounds = (5, 10, 25, 50, 100, 250)
    return e.groupBy("event_type").agg(*(F.count_if(F.col("value") <= b).alias(f"le_{b}") for b in bounds), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of each brand: how many types, and their sorted list."""
    return read(spark, sf_dir, "part").groupBy("p_brand").agg(F.countDistinct("p_type").alias("types"), F.array_join(F.array_sort(F.collect_set("p_type")), "|").alias("members"))


def idempotent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user, kind and day: a key that was seen isn't taken again."""
    e = _events(spark, sf_dir).withColumn("day", F.to_date("ts").cast("string"))
    return e.groupBy("user_id", "event_type", "day").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return e.groupBy("k").agg(F.count("*").alias("n"), r6(F.avg("value")).alias("avg_value"))


def document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as records: what the row lacks comes from its metadata."""
    meta = F.to_json(F.struct(F.concat("source", F.lit(".txt")).alias("file_name"), F.col("lang").alias("file_type"), F.lit("many").alias("chunk_count")))
    row = {"file_name": F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("doc"), F.col("doc_id").cast("string"))), "file_size": F.col("n_chars"), "summary": F.when(F.col("doc_id") % 3 == 0, preview("text"))}
    return read(spark, sf_dir, "documents").select("doc_id", *document_record(row, meta))


def newest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty latest orders by the date of shipping, or else of the order."""
    l = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate"))).alias("shipped"))  # noqa: E741
    o = read(spark, sf_dir, "orders").join(l, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "shipped", "o_orderdate")
    by = F.coalesce(F.col("shipped"), F.col("o_orderdate"))
    return newest_first(o.withColumn("key", F.concat(F.date_format(by, "yyyy-MM-dd"), F.format_string("%012d", F.col("o_orderkey")))), "key").limit(clamped(20)).select("o_orderkey", F.date_format(by, "yyyy-MM-dd").alias("day"))


def zip_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, roles and texts of each conversation as parallel arrays, put together again."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    a = _turns(spark, sf_dir).groupBy("conv_id").agg(turns.alias("t")).select("conv_id", F.transform("t", lambda x: x["turn"]).alias("ids"), F.transform("t", lambda x: x["role"]).alias("roles"), F.transform("t", lambda x: F.length(x["text"])).alias("sizes"))
    return zipped(a, "conv_id", "ids", "roles", "sizes").select("conv_id", "pos", "ids", "roles", "sizes")


def rebuild_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by whether they have a vector: those to do, done, without text, and their characters."""
    v = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("label").cast("string").alias("vector_id"))
    d = read(spark, sf_dir, "documents").join(v, "doc_id", "left")
    todo = is_blank("vector_id")
    return d.agg(F.count("*").alias("total"), F.count_if(todo).alias("todo"), F.count_if(~todo).alias("done"), F.count_if(is_blank("text")).alias("empty"), F.sum(F.when(todo, F.col("n_chars")).otherwise(0)).alias("todo_chars"))


def upload_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents uploaded source by source: how many were taken, and whether all were."""
    d = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left").withColumn("is_active", F.col("quality"))
    ok = active(d).groupBy("source").agg(F.count("*").alias("taken"))
    return d.groupBy("source").agg(F.count("*").alias("total")).join(ok, "source", "left").select("source", "total", F.coalesce("taken", F.lit(0)).alias("taken"), (F.coalesce("taken", F.lit(0)) == F.col("total")).alias("complete"))


CANNED = {
    "file_chunks": "select doc_id, label, vec_id from (select vec_id, vec_id % 20 as doc_id, label from embeddings) e where doc_id = 7 order by vec_id",
    "retrieval_results": "select user_id, event_id, value, row_number() over (partition by user_id order by value desc, event_id) as rank from events where user_id = 7 order by rank limit 10",
    "content_generations": "select o_orderkey, o_orderstatus, o_totalprice, o_orderdate from orders where o_custkey = 7 order by o_orderdate desc, o_orderkey limit 10",

    "user_count": "select count(distinct user_id) as n from events",
    "user_info": "select user_id, min(ts) as first_seen, max(ts) as last_seen, count(*) as n from events where user_id = 7 group by user_id",
    "active_users": "select user_id, max(ts) as last_seen from events group by user_id order by last_seen desc, user_id limit 10",
    "conversation_count": "select count(distinct conv_id) as n from conversations",
    "user_conversations": "select conv_id, count(*) as messages from conversations where role = 'user' group by conv_id order by messages desc, conv_id limit 10",
    "conversation_detail": "select conv_id, turn, role, text from conversations where conv_id = 3",
    "message_count": "select role, count(*) as n from conversations group by role",
    "user_message_stats": "select role, count(*) as n, count(distinct c.conv_id) as conversations from conversations c join (select conv_id from conversations group by conv_id having count(*) > 2) k on c.conv_id = k.conv_id group by role",
    "agent_executions": "select event_id, event_type, ts from events where user_id = 7 order by ts desc, event_id desc limit 10",
    "agent_stats": "select event_type, user_id, count(*) as n, round(avg(value), 6) as avg_value from events group by event_type, user_id",
    "failed_executions": "select event_id, user_id, ts from events where event_type = 'error' order by ts desc, event_id desc limit 10",
    "tool_calls": "select event_id, event_type, value from events where event_type in ('click', 'purchase') order by value desc, event_id limit 10",
    "user_files": "select doc_id, source, n_chars from documents where source = 'src3' order by n_chars desc, doc_id limit 10",
    "file_detail": "select doc_id, source, lang, n_chars from documents where doc_id = 42",
    "content_projects": "select o_custkey, count(*) as orders, round(sum(o_totalprice), 2) as total from orders group by o_custkey order by total desc, o_custkey limit 10",
    "project_chapters": "select l_orderkey, l_linenumber, l_quantity from lineitem where l_orderkey in (select max(o_orderkey) from orders) order by l_linenumber",
}
_TABLES = ("events", "conversations", "documents", "orders", "lineitem", "embeddings")


def _canned(sql: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql_with_tables(sql), **{t: read(spark, sf_dir, t) for t in _TABLES if f"{{{t}}}" in sql_with_tables(sql)})

    return run


def sql_with_tables(sql: str) -> str:
    """The statement with its table names as arguments, so that no views are left in the session."""
    words = sql.split(" ")
    return " ".join(f"{{{w}}}" if w in _TABLES and words[i - 1] in ("from", "join") else f"{{{w[:-1]}}})" if w[:-1] in _TABLES and w.endswith(")") and words[i - 1] in ("from", "join") else w for i, w in enumerate(words))


QUERIES = {f.__name__: f for f in (conversation_summaries, execution_stats, tool_stats, usage_ranking, file_statistics, daily_activity, system_stats, last_n_history, next_sequence, latest_row, message_search, paginate, vector_coverage, corpus_merge, last_user_message, latency_histogram, catalogue, idempotent_events, json_props, document_records, newest_documents, zip_positions, rebuild_summary, upload_batches)}
QUERIES |= {"usage_rollup_grouping_sets": usage_rollup, "recent_messages_topk": recent_messages, "missing_vectors_anti": missing_vectors, "allowed_docs_semi": allowed_docs}
QUERIES |= {f"canned_{name}": _canned(sql) for name, sql in CANNED.items()}
ORACLE = {f"canned_{name}": sql for name, sql in CANNED.items()} | {
    "conversation_summaries": """select c.conv_id, n as messages, last_turn, case when length(text) > 50 then text[1:50] || '...' else text end as last_user from
        (select conv_id, count(*) as n, max(turn) as last_turn from conversations group by 1) c left join
        (select conv_id, text from conversations where role = 'user' qualify row_number() over (partition by conv_id order by turn desc) = 1) u on c.conv_id = u.conv_id""",
    "document_records": "select doc_id, case when doc_id % 2 = 0 then 'doc' || doc_id else coalesce(source || '.txt', 'unknown') end as file_name, coalesce(lang, 'other') as file_type, coalesce(n_chars, 0) as file_size, 0::int as chunk_count, '' as created_at, case when doc_id % 3 = 0 then coalesce(case when length(text) > 50 then text[1:50] || '...' else text end, '') else '' end as summary from documents",
    "newest_documents": "with l as (select l_orderkey, max(case when l_returnflag = 'R' then l_shipdate end) as s from lineitem group by 1) select o_orderkey, strftime(coalesce(s, o_orderdate), '%Y-%m-%d') as day from orders left join l on o_orderkey = l_orderkey order by 2 desc, 1 desc limit 20",
    "zip_positions": "select conv_id, (row_number() over (partition by conv_id order by turn) - 1)::int as pos, turn as ids, role as roles, length(text)::int as sizes from conversations",
    "rebuild_summary": "select count(*) as total, count(*) filter (vec_id is null) as todo, count(*) filter (vec_id is not null) as done, count(*) filter (coalesce(text, '') = '') as empty, sum(case when vec_id is null then n_chars else 0 end)::bigint as todo_chars from documents left join embeddings on vec_id = doc_id",
    "upload_batches": "select source, count(*) as total, count(*) filter (quality = 1) as taken, count(*) filter (quality = 1) = count(*) as complete from documents left join labels using (doc_id) group by 1",
    "execution_stats": "select user_id, event_type = 'error' as failed, count(*) as n, round(avg(value), 6) as avg_ms, max(value) as max_ms, min(value) as min_ms from events group by 1, 2",
    "tool_stats": "select event_type, count(*) as total, count(*) filter (value < 100) as ok, count(*) filter (value >= 100) as slow, round(avg(value), 6) as avg_ms, round(count(*) filter (value < 100) * 100.0::double / count(*), 6) as success_rate from events group by 1",
    "usage_ranking": "select user_id, count(*) as calls, count(*) filter (event_type <> 'error') as ok, round(count(*) filter (event_type <> 'error') * 100.0::double / count(*), 6) as success_rate from events group by 1 order by calls desc, user_id limit 10",
    "file_statistics": "select source, count(*) as total, count(*) filter (quality = 1) as completed, count(*) filter (quality = 0) as failed, count(*) filter (quality is null) as pending, sum(n_chars)::bigint as size from documents left join labels using (doc_id) group by 1",
    "daily_activity": f"select ts::date::varchar as day, count(*) as n, count(distinct user_id) as users from events where ts >= timestamp '{AS_OF}' - interval 7 day and ts < timestamp '{AS_OF}' group by 1",
    "system_stats": "select (select count(distinct user_id) from events) as users, (select count(distinct conv_id) from conversations) as conversations, (select count(*) from conversations) as messages, (select count(*) from documents) as files",
    "last_n_history": "select conv_id, string_agg(role || ': ' || text, chr(10) order by turn) as history from (select * from conversations qualify row_number() over (partition by conv_id order by turn desc) <= 4) group by 1",
    "next_sequence": "select conv_id, coalesce(max(turn), 0) + 1 as next_turn from conversations group by 1",
    "latest_row": "select user_id, ts, event_id, event_type, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1",
    "message_search": "select conv_id, turn, role from conversations where contains(text, 'the ')",
    "paginate": "select conv_id, count(*) as messages from conversations group by 1 order by 2 desc, 1 limit 20 offset 40",
    "vector_coverage": "select source, count(*) as total, count(vec_id) as vectorised, case when count(*) = count(vec_id) then 'succeeded' else 'running' end as status from documents left join embeddings on vec_id = doc_id group by 1",
    "corpus_merge": "select doc_id, case when max(l) = 1 then 'store' else 'database' end as origin from (select doc_id, 1 as l from labels union all select doc_id, 0 from documents) group by 1",
    "last_user_message": "select conv_id, turn, asked from (select *, last_value(case when role = 'user' then turn end ignore nulls) over (partition by conv_id order by turn rows between unbounded preceding and 1 preceding) as asked from conversations) where role = 'assistant'",
    "latency_histogram": "select event_type, " + ", ".join(f"count(*) filter (value <= {b}) as le_{b}" for b in (5, 10, 25, 50, 100, 250)) + ", count(*) as n, round(sum(value), 4) as total from events group by 1",
    "catalogue": "select p_brand, count(distinct p_type) as types, array_to_string(list_sort(list(distinct p_type)), '|') as members from part group by 1",
    "idempotent_events": "select user_id, event_type, ts::date::varchar as day, first(event_id order by ts, event_id) as event_id from events group by 1, 2, 3",
    "json_props": "select (props->>'$.k')::int as k, count(*) as n, round(avg(value), 6) as avg_value from events group by 1",
    "usage_rollup_grouping_sets": "select event_type, user_id, ts::date::varchar as day, count(*) as calls, count(*) filter (value >= 100) as failed, round(avg(value), 6) as avg_ms from events group by grouping sets ((event_type, user_id, ts::date::varchar), (event_type, ts::date::varchar))",
    "recent_messages_topk": "select conv_id, turn, role, row_number() over (partition by conv_id order by turn desc)::int as rank from conversations qualify rank <= 3",
    "missing_vectors_anti": "select doc_id, source from documents where doc_id not in (select vec_id from embeddings)",
    "allowed_docs_semi": "select doc_id, lang from documents where doc_id in (select doc_id from labels where quality = 1 and toxic = 0)",
}
