"""Around an answer: query expansion, contexts, verdicts, statuses, page furniture, typed page blocks."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.dom import main_content
from quern.functions.markup import DROPPED, ENTITIES, line_kind, rendered
from quern.functions.text import citation_indices, extractive_summary, is_page_number, json_in, preview, quoted_phrases, source_name, with_source_names
from quern.plans.common import materialise, r6, read, sized

# Words that mean much the same.
SYNONYMS: Mapping[str, tuple[str, ...]] = {
    "公司": ("企业", "组织", "机构"),
    "产品": ("商品", "服务", "项目"),
    "文档": ("文件", "资料", "材料"),
    "政策": ("规定", "制度", "条例"),
    "报告": ("报表", "总结", "汇报"),
}
# Words that are no keywords.
NO_KEYWORDS = ("的", "了", "是", "在", "我", "有", "和", "就", "不", "人", "都", "一个", "也", "很", "到", "说", "要", "去", "你", "会", "着", "没有", "看", "好", "自己", "这")
# Stored states and what they are shown as.
STATUSES = {
    "pending": "pending", "queued": "pending", "running": "processing", "processing": "processing", "retrying": "processing",
    "succeeded": "completed", "completed": "completed", "success": "completed", "failed": "failed", "cancelled": "failed", "timed_out": "failed",
}
# What to do about an answer.
RECOMMENDATIONS = ("内容质量良好，与检索结果高度一致", "内容基本可靠，建议增加更多引用标记", "检测到可能的幻觉内容，建议重新生成并严格基于检索结果", "内容与检索结果一致性较低，强烈建议重新生成")


def keywords(text: Column | str, most: int = 10) -> Column:
    """Quoted phrases first, then Latin words and Han runs in their order, without repeats; a top of the list is the feature.

    A Han run of up to eight characters counts as a whole, and one of three or more also gives its
    parts of four, three and two characters.
    """
    t = F.lower(F.col(text) if isinstance(text, str) else text)
    runs = F.regexp_extract_all(t, F.lit("([a-z0-9]+|[一-鿿]+)"), F.lit(0))
    parts = lambda r, n: F.when(F.length(r) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(r) - n + 1)), lambda i: F.substring(r, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")

    def of(r: Column) -> Column:
        whole = F.when(F.length(r) <= 8, F.array(r)).otherwise(none)
        han = F.when(F.length(r) <= 2, F.array(r)).otherwise(F.concat(whole, *(parts(r, n) for n in (4, 3, 2))))
        return F.when(r.rlike("^[a-z0-9]"), F.when(F.length(r) > 1, F.array(r)).otherwise(none)).otherwise(han)

    words = F.filter(F.flatten(F.transform(runs, of)), lambda w: ~w.isin(*NO_KEYWORDS))
    return F.slice(F.array_distinct(F.concat(quoted_phrases(t), words)), 1, most)


def with_synonyms(tokens: Column, synonyms: Mapping[str, tuple[str, ...]] = SYNONYMS) -> Column:
    """Tokens, then the synonyms of each, without repeats."""
    table = F.create_map(*(x for k, v in synonyms.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    more = F.flatten(F.transform(tokens, lambda t: F.coalesce(table[t], F.array().cast("array<string>"))))
    return F.array_distinct(F.concat(tokens, more))


# What a rewriter says before a query, and what it says instead of one.
QUERY_LABEL = r"^(?:优化|重写)查询\s*\d*\s*[:：\-]\s*"
NO_QUERY = r"^(?:(?:优化|重写)查询\s*\d*|基于核心意图(?:和扩展术语)?|结合同义(?:词|和相关概念)?|扩展术语|相关概念|核心意图)$"


def sanitised_queries(original: Column, rewritten: Column, most: int = 3) -> Column:
    """The original query and the rewritten ones, without labels, placeholders and repeats, at most so many."""
    bare = F.transform(rewritten, lambda q: F.trim(F.regexp_replace(F.regexp_replace(F.trim(q), QUERY_LABEL, ""), r"\s+", " ")))
    kept = F.filter(bare, lambda q: q.isNotNull() & (q != "") & ~q.rlike(NO_QUERY))
    return F.slice(F.array_distinct(F.concat(F.array_compact(F.array(F.nullif(F.trim(original), F.lit("")))), kept)), 1, most)


def mapped_status(*stored: Column) -> Column:
    """The first status that is given, in the four words of the engine; pending if none is, or it isn't known."""
    table = F.create_map(*(F.lit(x) for kv in STATUSES.items() for x in kv))
    return F.coalesce(table[F.lower(F.trim(F.coalesce(*stored, F.lit(""))))], F.lit("pending"))


def recommendation(score: Column, flagged: Column) -> Column:
    good, fair, doubtful, poor = map(F.lit, RECOMMENDATIONS)
    return F.when(~flagged & (score >= 0.9), good).when(~flagged & (score >= 0.7), fair).when(flagged & (score >= 0.5), doubtful).otherwise(poor)


def extracted_citations(answers: DataFrame, results: DataFrame) -> DataFrame:
    """(answer_id, index, source_id, source_name, score, preview) for each cited number that a result has.

    answers: (answer_id, query_id, answer); results: (query_id, rank, source_id, source_name, score, content).
    """
    cited = answers.select("answer_id", "query_id", F.explode(citation_indices("answer")).alias("index"))
    found = cited.join(results, (cited["query_id"] == results["query_id"]) & (F.col("index") == F.col("rank")))
    return found.select("answer_id", "index", "source_id", "source_name", "score", preview("content", 100).alias("preview"))


def formatted_citations(citations: DataFrame, style: str = "markdown") -> DataFrame:
    """(answer_id, text): an answer's citations as Markdown, HTML or plain text, in the order of their numbers."""
    relevance = F.when(F.col("score").isNotNull(), F.format_string("(相关度: %.2f)", F.col("score").cast("double")))
    number, name = F.concat(F.lit("["), F.col("index").cast("string"), F.lit("]")), F.col("source_name")
    if style == "html":
        line = F.concat(F.lit("<li><strong>"), name, F.lit("</strong>"), F.coalesce(F.concat(F.lit(' <span class="score">'), relevance, F.lit("</span>")), F.lit("")), F.lit("</li>"))
        head, tail = ['<div class="citations">', "<h3>参考来源</h3>", "<ol>"], ["</ol>", "</div>"]
    else:
        line = F.concat_ws(" ", number, F.concat(F.lit("**"), name, F.lit("**")) if style == "markdown" else name, relevance)
        head, tail = (["## 参考来源", ""] if style == "markdown" else ["参考来源："]), []
    lines = F.transform(F.array_sort(F.collect_list(F.struct("index", line.alias("line")))), lambda x: x["line"])
    return citations.groupBy("answer_id").agg(F.array_join(F.concat(F.array(*map(F.lit, head)), lines, F.array(*map(F.lit, tail)) if tail else F.array().cast("array<string>")), "\n").alias("text"))


def validated_citations(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """(answer_id, cited, total, unmatched, coverage, is_valid): the numbers in an answer against its extracted citations."""
    held = citations.groupBy("answer_id").agg(F.collect_set("index").alias("known"), F.count("*").alias("total"))
    joined = answers.select("answer_id", citation_indices("answer").alias("cited")).join(held, "answer_id", "left")
    unmatched = F.array_except("cited", F.coalesce("known", F.array().cast("array<int>")))
    total = F.coalesce("total", F.lit(0))
    return joined.select("answer_id", F.size("cited").alias("cited"), total.alias("total"), F.size(unmatched).alias("unmatched"), r6(F.when(total > 0, F.size("cited") / total).otherwise(0.0)).alias("coverage"), (F.size(unmatched) == 0).alias("is_valid"))


_BLANKS = " \t\n\x0b\f\r"


def last_line(text: Column) -> tuple[Column, Column]:
    """The last line that isn't blank, with the blanks behind it, and the text before its line end; of a blank text the first line with blanks.

    The same as `([^\\n]+)\\s*$` and what is left without `\\n?[^\\n]+\\s*$`, which try every place of every line.
    """
    body = F.rtrim(text, F.lit(_BLANKS))
    own = F.substring_index(body, "\n", -1)
    behind = F.substring_index(F.substr(text, F.length(body) + 1), "\n", 1)
    line = F.when(body == "", F.regexp_extract(text, r"([^\n]+)\s*$", 1)).otherwise(F.concat(own, behind))
    before = F.when(body == "", F.regexp_replace(text, r"\n?[^\n]+\s*$", "")).otherwise(F.substr(body, F.lit(1), F.greatest(F.lit(0), F.length(body) - F.length(own) - 1)))
    return line, before


def without_edges(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page_no, text) without the first and last lines that repeat over a document's pages, and without page numbers there."""
    repeated = materialise(repeated_edges(pages).groupBy("doc_id").agg(F.collect_set(F.when(F.col("edge") == "header", F.col("line"))).alias("heads"), F.collect_set(F.when(F.col("edge") == "footer", F.col("line"))).alias("feet")), "edges")
    joined = pages.join(sized(repeated), "doc_id", "left")
    none = F.array().cast("array<string>")
    first, last = F.regexp_extract("text", r"^\s*([^\n]+)", 1), last_line(F.col("text"))[0]
    noise = lambda line, found: F.array_contains(F.coalesce(found, none), line) | is_page_number(F.trim(line))
    t = F.when(noise(first, F.col("heads")), F.regexp_replace("text", r"^\s*[^\n]+\n?", "")).otherwise(F.col("text"))
    t = F.when(noise(last, F.col("feet")), last_line(t)[1]).otherwise(t)
    return joined.select("doc_id", "page_no", t.alias("text"))


def same_name(df: DataFrame, id_col: str, name_col: str, scope: str) -> DataFrame:
    """Rows whose trimmed name, in lower case, another row of the same scope has: id, scope, name, others."""
    n = df.select(id_col, scope, F.lower(F.trim(name_col)).alias("name"))
    counts = n.groupBy(scope, "name").agg((F.count("*") - 1).alias("others")).where("others > 0 and name <> ''")
    return n.join(counts, [scope, "name"]).select(id_col, scope, "name", "others")


# The words that make a request one for a tool, a question, or one about documents.
TOOL_WORDS = ("计算", "算", "天气", "搜索", "查询", "调用工具", "tool", "calculate", "search", "weather")
ASKING = "什么|怎么|如何|为何|为什么|多少|是否|能否|请帮我|介绍|说明|总结|概括|分析|对比|列出|告诉我|解读|梳理|依据|根据"
CUES = ("要求", "字数", "规定", "标准", "条件", "流程", "办法", "规范", "格式", "模板", "示例", "材料", "时间", "节点", "比例", "评分", "评审", "抽检", "存档", "提交")
# What is said without a task, and how an answer is asked for again.
SMALL_TALK = ("hi", "hello", "嗨", "你好", "您好", "在吗", "在嘛", "ok", "okay", "收到", "谢谢", "thanks", "thankyou", "测试", "test")
AGAIN = ("重新回答", "重新作答", "重新回复", "继续回答", "继续回复")
ABOUT_DOCUMENTS, ABOUT_ANSWERS, BY_SEARCH = ("知识库", "资料", "文档"), ("回答", "回复", "作答"), ("检索", "查询", "搜索", "基于", "根据", "使用", "用")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(Column.__or__, (F.contains(text, F.lit(w)) for w in words))


def asks_for_information(text: Column) -> Column:
    return text.rlike(ASKING) | F.contains(text, F.lit("?")) | F.contains(text, F.lit("？")) | _any(text, CUES)


def route(text: Column, preferred: Column, has_base: Column) -> Column:
    """Where a request goes: to what is asked for by name, to a tool, to retrieval where there is a knowledge base, or to generation."""
    named = F.lower(F.trim(preferred))
    found = F.when(_any(F.lower(text), TOOL_WORDS), "tool").when(has_base & asks_for_information(text), "retrieval").otherwise("generation")
    return F.when(named.isin("tool", "retrieval", "generation"), named).otherwise(found)


def _said(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"(?U)[\s\.,，。!！?？~～:：;；、]+", "")


def is_small_talk(text: Column) -> Column:
    said = _said(text)
    return said.isin(*SMALL_TALK) | said.rlike("^(?:哈|呵|嘿|嗨|嗯|哦|啊)+$")


def follows_up(text: Column) -> Column:
    """Whether a message asks for the last question to be answered again, or from the documents."""
    said = _said(text)
    return (_any(said, ABOUT_DOCUMENTS) & _any(said, ABOUT_ANSWERS) & _any(said, BY_SEARCH)) | said.isin(*AGAIN)


def needs_documents(text: Column, has_base: Column) -> Column:
    return ~is_small_talk(text) & (text.rlike("知识库|文档|资料|出处|引用") | (has_base & asks_for_information(text)))


def asked_form(text: Column) -> tuple[Column, Column]:
    """(format, style) that a request asks for."""
    has = lambda *w: _any(text, w)
    return F.when(has("表格"), "table").when(has("列表", "清单"), "list").otherwise("paragraph"), F.when(has("详细"), "detailed").when(has("简洁", "简要"), "brief").otherwise("balanced")


def real_link(link: Column) -> Column:
    """The target of a search engine's redirect, which is in its parameter u after a1, in base 64; other links as they are."""
    code = F.regexp_extract(link, r"^https?://www\.bing\.com/[^#]*[?&]u=a1([A-Za-z0-9+/_-]+)", 1)
    padded = F.rpad(code, (F.ceil(F.length(code) / 4) * 4).cast("int"), "=")
    target = F.when(code != "", F.try_to_binary(padded, F.lit("base64")).cast("string"))
    return F.when(target.rlike("^https?://"), target).otherwise(link)


HIT = r"(?m)^\s*(?:\d+\.|[-*])?\s*\[([^\]]+)\]\((https?://[^)\s]+)\)[ \t]*[-–:]?[ \t]*(.*)$"


def search_hits(text: Column) -> Column:
    """The results in the Markdown of a search: title, link and snippet of each."""
    payload = F.regexp_replace(text, r"(?s)^.*?Markdown Content:", "")
    titles, links, snippets = (F.transform(F.regexp_extract_all(payload, F.lit(HIT), F.lit(i)), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))) for i in (1, 2, 3))
    return F.zip_with(F.zip_with(titles, F.transform(links, real_link), lambda t, k: F.struct(t.alias("title"), k.alias("link"))), snippets, lambda h, s: F.struct(h["title"].alias("title"), h["link"].alias("link"), s.alias("snippet")))


def file_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' beginnings with what they hold."""
    text = F.coalesce("text", F.lit(""))
    paragraphs = F.size(F.filter(F.split(text, r"\n[ \t]*\n+"), lambda x: F.trim(x) != ""))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(extractive_summary(text, F.ceil(F.length(text) / 1000).cast("int"), paragraphs=paragraphs)).alias("summary_md5"))


def parsed_searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as the results of a search: one with its own address, one behind a redirect."""
    p = read(spark, sf_dir, "pages")
    hidden = F.concat(F.lit("https://www.bing.com/ck/a?x=1&u=a1"), F.regexp_replace(F.base64(F.col("url").cast("binary")), r"[=\s]+", ""))
    text = F.concat(F.lit("Title\nMarkdown Content:\n1. [Page  "), F.col("page_id").cast("string"), F.lit("]("), "url", F.lit(") - some  text\n\n- [Other]("), hidden, F.lit(")\n"))
    return p.select("page_id", F.explode(search_hits(text)).alias("h")).select("page_id", "h.*")


def rewritten_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.array(F.concat(F.lit("优化查询 1： "), "text"), F.lit("核心意图"), F.concat(F.lit(" first  of "), F.col("item_id").cast("string")), F.lit("重写查询 2"), F.lit("third"), F.lit("fourth"))
    return read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(sanitised_queries(F.trim("text"), q)).alias("pos", "query"))


def combined_verdict(rule: Column, model: Column, said: Column) -> tuple[Column, Column]:
    """(score, flagged): .4 of the rules and .6 of a model where it has spoken; flagged below .7 or where the model says so."""
    score = F.coalesce(0.4 * rule + 0.6 * model, rule)
    return score, (score < 0.7) | F.coalesce(said, F.lit(False))


def repeated_edges(pages: DataFrame) -> DataFrame:
    """First and last lines that at least max(2, (3n + 4) / 5) of a document's n pages share.

    pages: (doc_id, page_no, text). Counted in Spark, so that a long document isn't one task's.
    """
    edge = F.explode(F.array(F.struct(F.lit("header").alias("edge"), F.regexp_extract("text", r"^\s*([^\n]+)", 1).alias("line")), F.struct(F.lit("footer").alias("edge"), last_line(F.col("text"))[0].alias("line"))))
    n = pages.groupBy("doc_id").agg(F.count("*").alias("pages"))
    counts = pages.select("doc_id", edge.alias("e")).groupBy("doc_id", "e.edge", "e.line").agg(F.count("*").alias("n")).where("line <> ''")
    return counts.join(n, "doc_id").where(F.col("n") >= F.greatest(F.lit(2), F.floor((3 * F.col("pages") + 4) / 5)))


def page_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, pos, kind, section, text): the lines of rendered pages under the last heading before them."""
    lines = pages.select("page_id", F.posexplode(F.split(rendered("html"), "\n")).alias("pos", "line")).where("line <> ''")
    typed = lines.withColumn("kind", line_kind(F.col("line"))).withColumn("text", F.regexp_replace("line", "^(?:#{1,6}|-) ", ""))
    above = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return typed.select("page_id", "pos", "kind", F.last(F.when(F.col("kind") == "heading", F.col("text")), ignorenulls=True).over(above).alias("section"), "text")


#: Synonyms for the benchmark's invented words.
EXAMPLE = {"ention": ("mention",), "hand": ("palm", "fist"), "erth": ("earth",)}


def query_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = keywords("text")
    return read(spark, sf_dir, "benchmark").select("item_id", F.array_join(k, " ").alias("keywords"), F.array_join(with_synonyms(k, EXAMPLE), " ").alias("expanded"))


def answer_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's user turns as numbered entries, an empty line between them."""
    t = read(spark, sf_dir, "conversations").where("role = 'user'")
    numbered = t.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")))
    entry = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] "), "text")
    return numbered.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", entry.alias("e")))), lambda x: x["e"]), "\n\n").alias("context"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule scores from the labels' quality, a model's from toxicity where that is known."""
    rule = F.when(F.col("quality") == 1, 1.0).otherwise(0.5)
    score, flagged = combined_verdict(rule, 1.0 - F.col("toxic"), F.col("toxic") == 1)
    return read(spark, sf_dir, "labels").select("doc_id", r6(score).alias("score"), flagged.alias("flagged"), recommendation(score, flagged).alias("recommendation"))


def status_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["Queued", "running", "success", "timed_out", "failed", "odd", " "]
    s = F.get(F.array(*map(F.lit, names)), (F.col("doc_id") % 7).cast("int"))
    stored = F.when(F.col("doc_id") % 5 == 0, F.lit("completed"))
    return read(spark, sf_dir, "documents").groupBy(mapped_status(stored, s).alias("status")).agg(F.count("*").alias("n"))


def same_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts whose trimmed lower-case name another part of their brand has as well."""
    return same_name(read(spark, sf_dir, "part"), "p_partkey", "p_name", "p_brand")


def _role_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "conversations")
    page = F.concat(F.lit("Same head\n"), "text", F.lit("\nPage "), F.col("turn").cast("string"))
    return t.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), page.alias("text"))


def page_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents, turns as pages: lines that repeat at the edges."""
    return repeated_edges(_role_pages(spark, sf_dir)).select("doc_id", "edge", "line", "n", "pages")


def stripped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages without what repeats at their edges, and without their numbers."""
    return without_edges(_role_pages(spark, sf_dir)).select("doc_id", "page_no", F.md5("text").alias("text_md5"))


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns that cite user turns by number."""
    t = read(spark, sf_dir, "conversations").where("role = 'assistant'")
    mark = F.concat(F.lit(" ["), (F.col("turn") % 3).cast("string"), F.lit("]【来源"), (F.col("turn") % 4 + 1).cast("string"), F.lit("】"))
    return t.select(F.struct("conv_id", "turn").alias("answer_id"), F.col("conv_id").alias("query_id"), F.concat("text", mark).alias("answer"))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "conversations").where("role = 'user'")
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    return t.select(F.col("conv_id").alias("query_id"), rank.alias("rank"), F.col("turn").alias("source_id"), source_name(F.lit(" "), F.concat(F.lit("turn "), F.col("turn").cast("string"))).alias("source_name"), (1.0 / (F.col("turn") + 1)).alias("score"), F.col("text").alias("content"))


def citation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted_citations(_answers(spark, sf_dir), _sources(spark, sf_dir)).select("answer_id.*", "index", "source_id", "source_name", r6("score").alias("score"), F.md5("preview").alias("preview_md5"))


def citation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = _answers(spark, sf_dir)
    return validated_citations(a, extracted_citations(a, _sources(spark, sf_dir))).select("answer_id.*", "cited", "total", "unmatched", "coverage", "is_valid")


def citation_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = extracted_citations(_answers(spark, sf_dir), _sources(spark, sf_dir)).select("answer_id", "index", "source_name", F.lit(0.5).alias("score"))
    out = formatted_citations(c).withColumnRenamed("text", "markdown").join(formatted_citations(c, "plain").withColumnRenamed("text", "plain"), "answer_id")
    return out.select("answer_id.*", "markdown", "plain")


def named_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with the names of two sources in place of their marks."""
    names = F.array(F.lit("A [2]"), F.lit("B"))
    return _answers(spark, sf_dir).select("answer_id.*", F.md5(with_source_names(F.col("answer"), names)).alias("answer_md5"))


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = read(spark, sf_dir, "conversations")
    return t.groupBy(route(F.col("text"), F.when(F.col("turn") % 5 == 4, " Retrieval"), F.col("conv_id") % 2 == 0).alias("route")).agg(F.count("*").alias("n"))


def intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with words of intents put before them: what each asks for."""
    words = ("Hi!", "根据知识库回答：", "用表格简要说明", "详细的清单", "测试。", "哈哈")
    t = read(spark, sf_dir, "conversations")
    word = F.get(F.array(*map(F.lit, words)), (F.col("turn") % 6).cast("int"))
    text = F.when(F.col("conv_id") % 3 == 0, word).otherwise(F.concat(word, "text"))
    form, style = asked_form(text)
    return t.groupBy(is_small_talk(text).alias("small_talk"), follows_up(text).alias("follow_up"), needs_documents(text, F.col("conv_id") % 2 == 0).alias("documents"), form.alias("form"), style.alias("style")).agg(F.count("*").alias("n"))


def answer_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a model's answers that hold JSON, fenced or not, or none."""
    e = read(spark, sf_dir, "events")
    text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit("So: "), "props", F.lit(" it is."))).otherwise(F.lit("none {here"))
    return e.select("event_id", F.get_json_object(json_in(text), "$.k").cast("int").alias("k"))


def html_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main content of each page: its element and score, and how many blocks of each kind it has."""
    p = read(spark, sf_dir, "pages").select("page_id", main_content(F.col("html")).alias("m"))
    of = lambda kind: F.size(F.filter("m.blocks", lambda b: b["kind"] == kind))
    return p.select("page_id", "m.title", "m.root_tag", "m.score", of("heading").alias("headings"), of("paragraph").alias("paragraphs"), F.element_at("m.blocks", -1)["section_path"].alias("last_path"))


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = page_blocks(read(spark, sf_dir, "pages"))
    return b.groupBy("page_id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.max("section").alias("section"))


_KEYS = "list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: length(x) > 1)"
_SYN = "[" + ", ".join(f"{{'k': '{k}', 'v': '{x}'}}" for k, v in EXAMPLE.items() for x in v) + "]"


def _rendered_sql() -> str:
    t = f"regexp_replace(html, '{DROPPED}', '', 'g')"
    t = f"""regexp_replace({t}, '(?is)<a\\s[^>]*href="([^"]*)"[^>]*>(.*?)</a>', '\\2 (\\1)', 'g')"""
    for level in range(1, 7):
        t = f"regexp_replace({t}, '(?i)<h{level}(?:\\s[^>]*)?>', chr(10) || '{'#' * level} ', 'g')"
    t = f"regexp_replace({t}, '(?i)<li(?:\\s[^>]*)?>', chr(10) || '- ', 'g')"
    t = f"regexp_replace({t}, '(?i)</?(?:p|div|section|article|main|ul|ol|table|tr|td|th|br|h[1-6]|li|blockquote)(?:\\s[^>]*)?/?>', chr(10), 'g')"
    t = f"regexp_replace({t}, '<[^>]*>', '', 'g')"
    for entity, character in ENTITIES:
        character = character.replace("'", "''")
        t = f"replace({t}, '{entity}', '{character}')"
    return f"list_filter(list_transform(string_split({t}, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'), ' ')), lambda x: x <> '' and not regexp_matches(x, '^(?:#+|-)$'))"


_PAGES = "p as (select conv_id as doc_id, turn as page_no, 'Same head' || chr(10) || text || chr(10) || 'Page ' || turn as t from conversations)"
_EDGES = r"c as (select doc_id, edge, line, count(*) as n from (select doc_id, 'header' as edge, regexp_extract(t, '^\s*([^\n]+)', 1) as line from p union all select doc_id, 'footer', regexp_extract(t, '([^\n]+)\s*$', 1) from p) where line <> '' group by all), k as (select doc_id, count(*) as pages from p group by 1), ed as (select doc_id, edge, line, n, pages from c join k using (doc_id) where n >= greatest(2, (3 * pages + 4) // 5))"
_CITED = r"""an as (select conv_id, turn, text || ' [' || (turn % 3) || ']【来源' || (turn % 4 + 1) || '】' as a from conversations where role = 'assistant'),
    ix as (select distinct conv_id, turn, unnest(regexp_extract_all(a, '\[(\d+)\]', 1) || regexp_extract_all(a, '【(\d+)】', 1) || regexp_extract_all(a, '\((\d+)\)', 1) || regexp_extract_all(a, '【来源(\d+)】', 1))::int as index from an),
    sr as (select conv_id, row_number() over (partition by conv_id order by turn) as rank, turn as source_id, 'turn ' || turn as source_name, 1.0::double / (turn + 1) as score, text as content from conversations where role = 'user'),
    ci as (select ix.*, source_id, source_name, score, content from ix join sr on sr.conv_id = ix.conv_id and sr.rank = ix.index)"""
_any_sql = lambda text, words: "(" + " or ".join(f"contains({text}, '{w}')" for w in words) + ")"
_ASKS = "(regexp_matches({0}, '" + ASKING + "') or contains({0}, '?') or contains({0}, '？') or " + _any_sql("{0}", CUES) + ")"
QUERIES = {f.__name__: f for f in (query_keywords, answer_context, verdicts, status_mapping, same_names, page_furniture, stripped_pages, citation_rows, citation_checks, citation_lists, named_answers, routes, intents, answer_json, file_summaries, parsed_searches, rewritten_queries, html_roots, html_blocks)}
ORACLE = {
    "query_keywords": f"""with a as (select item_id, {_KEYS} as t from benchmark), b as (select item_id, list_transform(list_filter(range(1, len(t) + 1), lambda i: list_position(t, t[i]) = i), lambda i: t[i])[1:10] as k from a),
        c as (select item_id, k, k || list_transform(list_filter(flatten(list_transform(k, lambda w: list_transform({_SYN}, lambda s: [s.k, s.v, w]))), lambda s: s[1] = s[3]), lambda s: s[2]) as e from b)
        select item_id, array_to_string(k, ' ') as keywords, array_to_string(list_transform(list_filter(range(1, len(e) + 1), lambda i: list_position(e, e[i]) = i), lambda i: e[i]), ' ') as expanded from c""",
    "answer_context": "with t as (select conv_id, row_number() over (partition by conv_id order by turn) as n, text as p from conversations where role = 'user') select conv_id, string_agg('[' || n || '] ' || p, chr(10) || chr(10) order by n) as context from t group by 1",
    "verdicts": f"""with a as (select doc_id, case when quality = 1 then 1.0 else 0.5 end::double as r, 1.0::double - toxic as m, coalesce(toxic = 1, false) as said from labels), b as (select doc_id, coalesce(0.4 * r + 0.6 * m, r) as s, said from a), c as (select doc_id, s, s < 0.7 or said as flagged from b)
        select doc_id, round(s, 6) as score, flagged, case when not flagged and s >= 0.9 then '{RECOMMENDATIONS[0]}' when not flagged and s >= 0.7 then '{RECOMMENDATIONS[1]}' when flagged and s >= 0.5 then '{RECOMMENDATIONS[2]}' else '{RECOMMENDATIONS[3]}' end as recommendation from c""",
    "status_mapping": "select case when doc_id % 5 = 0 then 'completed' else ['pending', 'processing', 'completed', 'failed', 'failed', 'pending', 'pending'][(doc_id % 7) + 1] end as status, count(*) as n from documents group by 1",
    "same_names": "select p_partkey, p_brand, lower(trim(p_name)) as name, count(*) over (partition by p_brand, lower(trim(p_name))) - 1 as others from part qualify others > 0",
    "page_furniture": f"with {_PAGES}, {_EDGES} select doc_id, edge, line, n, pages from ed",
    "stripped_pages": rf"""with {_PAGES}, {_EDGES}, f as (select p.doc_id, p.page_no, regexp_extract(t, '^\s*([^\n]+)', 1) in (select line from ed where ed.doc_id = p.doc_id and edge = 'header') as h, t from p)
        select doc_id, page_no, md5(regexp_replace(case when h then regexp_replace(t, '^\s*[^\n]+\n?', '') else t end, '\n?[^\n]+\s*$', '')) as text_md5 from f""",
    "citation_rows": f"with {_CITED} select conv_id, turn, index, source_id, source_name, round(score, 6) as score, md5(case when length(content) > 100 then content[1:100] || '...' else content end) as preview_md5 from ci",
    "citation_checks": f"""with {_CITED}, n as (select conv_id, turn, count(*) as total from ci group by 1, 2), u as (select conv_id, turn, count(*) as hit from ix semi join ci using (conv_id, turn, index) group by 1, 2), c as (select conv_id, turn, count(*) as cited from ix group by 1, 2)
        select conv_id, turn, cited::int as cited, coalesce(total, 0) as total, (cited - coalesce(hit, 0))::int as unmatched, round(case when total > 0 then cited / total else 0 end, 6)::double as coverage, cited = coalesce(hit, 0) as is_valid from c left join n using (conv_id, turn) left join u using (conv_id, turn)""",
    "citation_lists": f"""with {_CITED} select conv_id, turn, '## 参考来源' || chr(10) || chr(10) || string_agg('[' || index || '] **' || source_name || '** (相关度: 0.50)', chr(10) order by index) as markdown, '参考来源：' || chr(10) || string_agg('[' || index || '] ' || source_name || ' (相关度: 0.50)', chr(10) order by index) as plain from ci group by 1, 2""",
    "named_answers": "with a as (select conv_id, turn, text, turn % 3 as i, turn % 4 + 1 as j from conversations where role = 'assistant') select conv_id, turn, md5(text || ' ' || case i when 1 then '【A [2]】' when 2 then '【B】' else '[0]' end || case j when 1 then '【A [2]】' when 2 then '【B】' else '【来源' || j || '】' end) as answer_md5 from a",
    "routes": f"""select case when turn % 5 = 4 then 'retrieval' when {_any_sql("lower(text)", TOOL_WORDS)} then 'tool' when conv_id % 2 = 0 and {_ASKS.format("text")} then 'retrieval' else 'generation' end as route, count(*) as n from conversations group by 1""",
    "intents": f"""with w as (select conv_id, ['Hi!', '根据知识库回答：', '用表格简要说明', '详细的清单', '测试。', '哈哈'][(turn % 6) + 1] || case when conv_id % 3 = 0 then '' else text end as t from conversations),
        s as (select *, regexp_replace(lower(t), '[\\s\\.,，。!！?？~～:：;；、]+', '', 'g') as said from w),
        k as (select *, said in ({", ".join(f"'{x}'" for x in SMALL_TALK)}) or regexp_matches(said, '^(?:哈|呵|嘿|嗨|嗯|哦|啊)+$') as small_talk from s)
        select small_talk, ({_any_sql("said", ABOUT_DOCUMENTS)} and {_any_sql("said", ABOUT_ANSWERS)} and {_any_sql("said", BY_SEARCH)}) or said in ({", ".join(f"'{x}'" for x in AGAIN)}) as follow_up,
            not small_talk and (regexp_matches(t, '知识库|文档|资料|出处|引用') or (conv_id % 2 = 0 and {_ASKS.format("t")})) as documents,
            case when contains(t, '表格') then 'table' when contains(t, '列表') or contains(t, '清单') then 'list' else 'paragraph' end as form,
            case when contains(t, '详细') then 'detailed' when contains(t, '简洁') or contains(t, '简要') then 'brief' else 'balanced' end as style, count(*) as n from k group by all""",
    "file_summaries": r"with t as (select doc_id, coalesce(text, '') as t from documents) select doc_id, md5('[' || len(list_filter(string_split_regex(t, '\n[ \t]*\n+'), lambda x: trim(x, ' ') <> '')) || ' 段, ' || ceil(length(t) / 1000.0)::int || ' 个文本块] ' || case when length(t) > 200 then t[1:200] || '...' else t end) as summary_md5 from t",
    "parsed_searches": "select page_id, unnest(['Page ' || page_id, 'Other']) as title, unnest([url, url]) as link, unnest(['some text', '']) as snippet from pages",
    "rewritten_queries": r"with a as (select item_id, trim(text) as t, trim(regexp_replace(trim(text), '\s+', ' ', 'g')) as n from benchmark), b as (select item_id, case when t = n then [t, 'first of ' || item_id, 'third'] else [t, n, 'first of ' || item_id] end as q from a) select item_id, (generate_subscripts(q, 1) - 1)::int as pos, unnest(q) as query from b",
    "answer_json": "select event_id, case when event_id % 3 < 2 then (props->>'$.k')::int end as k from events",
    "html_roots": r"""with a as (select page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) as title, regexp_extract(html, '(?s)<article>(.*)</article>', 1) as b from pages),
        e as (select *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '<[^>]*>', ' ', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&nbsp;?', ' ', 'g'), '&middot;?', '·', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') as t, regexp_extract(b, '(?s)<h1>(.*?)</h1>', 1) as h from a)
        select page_id, trim(regexp_replace(regexp_replace(regexp_replace(title, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) as title, 'article' as root_tag, (100 + least(120, length(trim(regexp_replace(t, '\s+', ' ', 'g'))) // 80))::int as score, 1 as headings,
            len(list_filter(string_split(b, '<p>')[2:], lambda x: trim(regexp_replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) <> ''))::int as paragraphs, trim(regexp_replace(regexp_replace(regexp_replace(h, '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) as last_path from e""",
    "html_blocks": f"""with a as (select page_id, {_rendered_sql()} as l from pages), b as (select page_id, unnest(l) as line, generate_subscripts(l, 1) as pos from a),
        c as (select page_id, pos, case when regexp_matches(line, '^#{{1,6}} ') then 'heading' when starts_with(line, '- ') then 'list_item' else 'paragraph' end as kind, regexp_replace(line, '^(?:#{{1,6}}|-) ', '') as text from b),
        d as (select *, last_value(case when kind = 'heading' then text end ignore nulls) over (partition by page_id order by pos rows between unbounded preceding and current row) as section from c)
        select page_id, kind, count(*) as n, sum(length(text))::bigint as chars, max(section) as section from d group by 1, 2""",
}
