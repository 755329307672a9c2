"""Chunkers: one document to many rows, by fixed windows, by boundaries, by headings, by keys."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.text import section_title, token_estimate
from quern.operators.structure import budget_chunks, code_sections, json_blocks, packed_rows, yaml_blocks
from quern.plans.common import r6, read


def fixed_chunks(docs: DataFrame, size: int = 1000, overlap: int = 100) -> DataFrame:
    """Windows of size characters, each overlap characters into the one before; the last ends with the text.

    doc_id, chunk_index, start_char, end_char, content (without white space at its ends). Blank windows
    are left out and take no index.
    """
    n = F.length("text")
    last = F.greatest(F.lit(0), F.ceil((n - size) / (size - overlap)).cast("int"))
    bare = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    windows = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct((k * (size - overlap)).alias("start_char"), F.least(k * (size - overlap) + size, n).alias("end_char"), bare(F.substring(F.col("text"), k * (size - overlap) + 1, F.lit(size))).alias("content")))
    kept = F.filter(windows, lambda w: w["content"] != "")
    return docs.where(n > 0).select("doc_id", F.posexplode(kept).alias("chunk_index", "w")).select("doc_id", "chunk_index", "w.*")


def paragraph_blocks(docs: DataFrame) -> DataFrame:
    """Paragraphs (between empty lines) with their offsets, counted as if joined by two line ends."""
    parts = docs.select("doc_id", F.posexplode(F.split("text", r"\n[ \t]*\n+")).alias("pos", "content")).where("trim(content) <> ''")
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("start_char", F.coalesce(F.sum(F.length("content") + 2).over(before), F.lit(0)))


def page_chunks(pages: DataFrame, size: int = 1000, overlap: int = 100) -> DataFrame:
    """Chunks of pages (doc_id, page_number, text), each with its page and an index that runs through the document."""
    cut = fixed_chunks(pages.select(F.struct("doc_id", "page_number").alias("doc_id"), "text"), size, overlap)
    flat = cut.select("doc_id.doc_id", "doc_id.page_number", F.col("chunk_index").alias("in_page"), "start_char", "end_char", "content")
    by = Window.partitionBy("doc_id").orderBy("page_number", "in_page")
    return flat.withColumn("chunk_index", F.row_number().over(by) - 1).drop("in_page")


def boundary_chunks(docs: DataFrame, size: int = 1000, overlap: int = 100) -> DataFrame:
    """Windows whose end goes back to the last paragraph, sentence or word end nearby, if there is one.

    The next window starts overlap characters before the last end, never past it, so that the chunks
    cover the text. doc_id, chunk_index, start_char, end_char, content (trimmed; blank ones are left
    out). Where a window ends depends on where the one before ended, so each text is walked through
    once, in batches of texts.
    """
    slack = min(120, max(20, size // 4))

    def cut(text: str) -> list[tuple[int, int]]:
        out, start, n = [], 0, len(text)
        while start < n:
            end = min(n, start + size)
            if end < n:
                for mark in ("\n\n", ". ", "\n", " "):
                    at = text.rfind(mark, max(start + 1, end - slack), end)
                    if at >= 0:
                        end = at + len(mark)
                        break
            out.append((start, end))
            if end >= n:
                break
            start = max(start + 1, end - overlap)
        return out

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 500):
                part = b.slice(at, 500)
                found = [(k, i, s, e, c) for k, t in enumerate(part.column("text").to_pylist()) if t for i, (s, e) in enumerate(cut(t)) if (c := t[s:e].strip())]
                cols = list(zip(*found, strict=True)) if found else [[]] * 5
                ids = part.column("doc_id").take(pa.array(cols[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, pa.int32()) for c in cols[1:4]), pa.array(cols[4], pa.string())], ["doc_id", "chunk_index", "start_char", "end_char", "content"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(rows, f"doc_id {kind}, chunk_index int, start_char int, end_char int, content string")


def named_chunks(chunks: DataFrame, strategy: str) -> DataFrame:
    """Chunks under the name of their strategy, with an id that tells all three."""
    return chunks.withColumn("strategy", F.lit(strategy)).withColumn("chunk_id", F.concat_ws("::", F.lit(strategy), F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")))


def paragraph_chunks(docs: DataFrame, size: int = 1000, overlap: int = 100) -> DataFrame:
    """Boundary chunks, named paragraph_SIZE_OVERLAP."""
    return named_chunks(boundary_chunks(docs, size, overlap), f"paragraph_{size}_{overlap}")


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def under_headings(marked: DataFrame, levels: int = 6) -> DataFrame:
    """Adds section (its number) and path (the titles open at a line, from the outermost) to lines.

    marked: doc_id, pos, level (null where the line is no heading), title. A title is open until a
    heading of its level or of one above it comes.
    """
    by = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    at = lambda of: F.max(F.when(of, F.col("pos"))).over(by)
    out = marked.withColumn("section", F.count("level").over(by))
    open_ = []
    for k in range(1, levels + 1):
        mine, above = at(F.col("level") == k), at(F.col("level") < k)
        title = F.last(F.when(F.col("level") == k, F.col("title")), ignorenulls=True).over(by)
        open_.append(F.when(mine.isNotNull() & (mine > F.coalesce(above, F.lit(-1))), title))
    return out.withColumn("path", F.array_compact(F.array(*open_)))


def _sections(marked: DataFrame) -> DataFrame:
    """doc_id, section, title, level, section_path, content of lines under headings (with column line)."""
    lines = under_headings(marked)
    return lines.groupBy("doc_id", "section").agg(
        F.max("title").alias("title"), F.max("level").alias("level"), F.array_join(F.min_by("path", "pos"), " / ").alias("section_path"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("content"),
    )


def heading_sections(docs: DataFrame) -> DataFrame:
    """Lines of a Markdown text gathered under their heading: doc_id, section, title, level, section_path, content."""
    level = F.nullif(F.length(F.regexp_extract("line", r"^(#{1,6}) +[^ ]", 1)), F.lit(0))
    return _sections(_lines(docs).withColumn("level", level).withColumn("title", F.when(level.isNotNull(), section_title("line"))))


def rst_sections(docs: DataFrame) -> DataFrame:
    """Lines of a reStructuredText gathered under their heading, which a line of one mark underlines.

    The levels are the marks in the order in which they first appear in a text.
    """
    by = Window.partitionBy("doc_id").orderBy("pos")
    below = F.lead("line").over(by)
    mark = F.regexp_extract("below", r"""^([=\-~^"'`#*+:._])\1*\s*$""", 1)
    lines = _lines(docs).withColumn("below", below)
    lines = lines.withColumn("mark", F.when((F.trim("line") != "") & (mark != "") & (F.length(F.rtrim("below")) >= F.length(F.rtrim("line"))) & ~F.col("line").rlike(r"^(\W)\1+$"), mark))
    first = F.min(F.when(F.col("mark").isNotNull(), F.col("pos"))).over(Window.partitionBy("doc_id", "mark"))
    ranked = lines.withColumn("first", F.when(F.col("mark").isNotNull(), first))
    level = F.dense_rank().over(Window.partitionBy("doc_id", F.col("mark").isNotNull()).orderBy("first"))
    return _sections(ranked.withColumn("level", F.when(F.col("mark").isNotNull(), F.least(level, F.lit(6)))).withColumn("title", F.when(F.col("mark").isNotNull(), F.trim("line"))).drop("below", "mark", "first"))


def _xml_nodes(texts: pd.Series) -> pd.Series:
    def walk(node: ElementTree.Element, path: str, out: list) -> list:
        path = f"{path}/{node.tag.rpartition('}')[2]}"
        out.append({"path": path, "attributes": ", ".join(f"{k}={v}" for k, v in sorted(node.attrib.items())), "children": ", ".join(dict.fromkeys(c.tag.rpartition("}")[2] for c in node)), "text": " ".join(" ".join([node.text or "", *(c.tail or "" for c in node)]).split())})
        for c in node:
            walk(c, path, out)
        return out

    def one(text: str | None) -> list | None:
        if not text or "<!ENTITY" in text:  # entities of its own may make a text of any size
            return None
        try:
            return walk(ElementTree.fromstring(text), "", [])
        except (ElementTree.ParseError, ValueError, RecursionError):
            return None

    return texts.map(one)


def xml_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, path, attributes, children, text) for each node of XML texts; those that can't be read give none."""
    nodes = F.pandas_udf(_xml_nodes, "array<struct<path:string,attributes:string,children:string,text:string>>")
    return docs.select("doc_id", F.posexplode(nodes(F.col("text"))).alias("pos", "node")).select("doc_id", "pos", "node.*")


def keyed_blocks(docs: DataFrame) -> DataFrame:
    """Blocks of a text that begin at each line with a key or a tag: doc_id, block, content."""
    starts = F.col("line").rlike(r"^\s*(?:[\w.-]+\s*[:=]|<[A-Za-z][^>]*>)")
    by = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    numbered = _lines(docs).withColumn("block", F.sum(starts.cast("int")).over(by))
    return numbered.groupBy("doc_id", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n").alias("content"))


def structured_terms(*fields: Column, headers: Column | None = None) -> Column:
    """The fields of a chunk that aren't blank, and its column headers, once each."""
    terms = F.array(*(F.nullif(F.trim(f), F.lit("")) for f in fields))
    return F.array_distinct(F.array_compact(F.concat(terms, headers) if headers is not None else terms))


# What a chunk's metadata hold if nothing is known.
METADATA = ("section_title", "section_path", "sheet_name", "structured_terms", "symbol_name", "symbol_type", "node_name", "leaf_value", "column_headers", "slide_title", "source_region", "page_number", "source_type")


def with_metadata(chunks: DataFrame) -> DataFrame:
    """Chunks with all metadata columns; those that are missing are null."""
    return chunks.select("*", *(F.lit(None).cast("string").alias(c) for c in METADATA if c not in chunks.columns))


def chunker_of(kind: Column, text: Column) -> Column:
    """Which chunker a text goes to, by its kind of file, else by how it begins."""
    begins = F.ltrim(text)
    sniffed = F.when(begins.rlike(r"^[\[{]") & F.try_parse_json(text).isNotNull(), "json").when(begins.startswith("<?xml"), "xml").when(text.rlike(r"(?m)^#{1,6} +\S"), "markdown").when(text.rlike(r"(?m)^\[[^\]\n]+\]\s*$"), "ini").otherwise("text")
    known = {"md": "markdown", "markdown": "markdown", "rst": "rst", "json": "json", "xml": "xml", "svg": "xml", "yaml": "yaml", "yml": "yaml", "toml": "ini", "ini": "ini", "properties": "ini", "cfg": "ini", "csv": "rows", "tsv": "rows", "xlsx": "rows", "html": "text", "py": "code", "js": "code", "java": "code", "go": "code", "rs": "code", "ts": "code"}
    return F.coalesce(F.create_map(*(F.lit(x) for kv in known.items() for x in kv))[F.lower(kind)], sniffed)


def key_value_blocks(docs: DataFrame) -> DataFrame:
    """`section.key: value` for the lines of an INI or properties text; comments and other lines are left out."""
    lines = _lines(docs).withColumn("line", F.trim("line"))
    section = F.when(F.col("line").rlike(r"^\[.*\]$"), F.regexp_extract("line", r"^\[(.*)\]$", 1))
    by = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    carried = lines.withColumn("section", F.last(section, ignorenulls=True).over(by)).where(F.col("line").rlike(r"^[^#;\[=:]+[=:]"))
    key, value = F.trim(F.regexp_extract("line", r"^([^=:]+)[=:](.*)$", 1)), F.trim(F.regexp_extract("line", r"^([^=:]+)[=:](.*)$", 2))
    return carried.select("doc_id", "pos", F.concat(F.concat_ws(".", "section", key), F.lit(": "), value).alias("block"))


def _joined(df: DataFrame, key: str, order: str, line: Column) -> DataFrame:
    """One text for each key of its lines in order."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("t"))))
    return df.groupBy(F.col(key).alias("doc_id")).agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("text"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations")


def q_page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents, turns as pages, windows of 200 characters."""
    c = page_chunks(_turns(spark, sf_dir).select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_number"), "text"), 200, 20)
    return c.select("doc_id", "page_number", "chunk_index", "start_char", "end_char", F.md5("content").alias("content_md5"))


def q_paragraph_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = paragraph_chunks(read(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text")), 400, 40)
    return c.select("chunk_id", "doc_id", "chunk_index", "start_char", "end_char")


def q_rst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as reStructuredText: each turn under its role, a part of it under the turn's number."""
    rule = lambda x, m: F.concat(x, F.lit("\n"), F.repeat(F.lit(m), F.length(x)), F.lit("\n"))
    t = _joined(_turns(spark, sf_dir), "conv_id", "turn", F.concat(rule(F.col("role"), "="), rule(F.concat(F.lit("turn "), F.col("turn").cast("string")), "-"), F.lit("some text")))
    return rst_sections(t).where("level = 2").select("doc_id", "title", "section_path")


def q_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as programs: a class for each role, a method for each turn."""
    t = _joined(_turns(spark, sf_dir), "conv_id", "turn", F.concat(F.lit("class "), F.col("role"), F.lit(":\n    def turn_"), F.col("turn").cast("string"), F.lit("(self):\n        pass")))
    return code_sections(t).where("level = 2").select("doc_id", "title", "section_path", "content")


def q_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").withColumn("one", F.lit(1))
    t = _joined(n, "n_regionkey", "n_nationkey", F.concat(F.lit("nation:\n  "), F.col("n_name"), F.lit(":\n    key: "), F.col("n_nationkey").cast("string")))
    return yaml_blocks(t).select("doc_id", "block")


def q_ini(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _joined(read(spark, sf_dir, "customer"), "c_nationkey", "c_custkey", F.concat(F.lit("["), F.col("c_name"), F.lit("]\nsegment = "), F.col("c_mktsegment")))
    return key_value_blocks(t).select("doc_id", "block")


def q_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    text = F.concat(F.lit('{"user": {"id": '), F.col("user_id").cast("string"), F.lit(', "kinds": ["'), F.col("event_type"), F.lit('", "x"]}, "list": [{"p": '), F.col("props"), F.lit("}]}"))
    return json_blocks(e.select(F.col("event_id").alias("doc_id"), text.alias("text")))


def q_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    text = F.concat(F.lit('<part key="'), F.col("p_partkey").cast("string"), F.lit('"><brand>'), F.col("p_brand"), F.lit("</brand><size>"), F.col("p_size").cast("string"), F.lit("</size></part>"))
    return xml_blocks(p.select(F.col("p_partkey").alias("doc_id"), text.alias("text")))


def q_keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _joined(_turns(spark, sf_dir), "conv_id", "turn", F.concat("role", F.lit(": turn\n  more of "), F.col("turn").cast("string")))
    return keyed_blocks(t)


def q_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations' customers as sheets."""
    c = read(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name", "c_mktsegment"))).alias("r"))
    sheets = c.select("doc_id", F.array(F.lit("name"), F.lit("segment")).alias("columns"), F.transform("r", lambda x: F.array(x["c_name"], x["c_mktsegment"])).alias("rows"))
    return packed_rows(sheets, 60).select("doc_id", "chunk_index", "rows")


def q_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select(F.get(F.array(*map(F.lit, ["md", "py", "csv", ""])), (F.col("doc_id") % 4).cast("int")).alias("kind"), "text")
    return d.groupBy(chunker_of(F.col("kind"), F.coalesce("text", F.lit(""))).alias("chunker")).agg(F.count("*").alias("n"))


def q_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", F.array_join(structured_terms(F.col("p_brand"), F.lit(" "), F.col("p_type"), headers=F.array("p_brand", "p_name")), "|").alias("terms"))


def q_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fixed_chunks(read(spark, sf_dir, "documents"))
    return c.select("doc_id", "chunk_index", "start_char", "end_char", F.md5("content").alias("content_md5"))


def q_chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = fixed_chunks(read(spark, sf_dir, "documents"))
    n = F.length("content")
    return c.agg(F.count("*").alias("chunks"), r6(F.avg(n)).alias("avg_chars"), F.min(n).alias("min_chars"), F.max(n).alias("max_chars"))


def q_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paragraph_blocks(read(spark, sf_dir, "documents"))
    return p.groupBy("doc_id").agg(F.count("*").alias("paragraphs"), F.max("start_char").alias("last_start"))


def q_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boundary_chunks(read(spark, sf_dir, "documents")).select("doc_id", "chunk_index", "start_char", "end_char")


def q_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of at most 120 words, their starts at boundaries."""
    return budget_chunks(read(spark, sf_dir, "documents"), 1000, 100, 120).select("doc_id", "chunk_index", "start_char", "end_char", "tokens")


def q_yaml_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as YAML of varying shapes: nested keys as deep as the id says, lists of scalars and of maps, and a comment."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("lang", F.lit("x")).alias("lang"), F.coalesce("source", F.lit("x")).alias("source"), (F.col("doc_id") % 9 + 1).cast("int").alias("deep"))
    nest = F.array_join(F.transform(F.sequence(F.lit(1), "deep"), lambda k: F.concat(F.repeat(F.lit("  "), k - 1), F.lit("k"), k.cast("string"), F.lit(":"))), "\n")
    items = F.array_join(F.transform(F.sequence(F.lit(1), "deep"), lambda k: F.when(k % 2 == 0, F.concat(F.lit("  - n: "), k.cast("string"), F.lit('\n    "a b": '), F.col("source"))).otherwise(F.concat(F.lit("  - "), F.col("lang")))), "\n")
    text = F.concat(nest, F.lit(" "), F.col("lang"), F.lit("  # deepest\nlist:\n"), items, F.lit("\nlast: '# no comment'"))
    return yaml_blocks(d.select("doc_id", text.alias("text"))).select("doc_id", "pos", "block")


def q_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as Markdown: a heading for each turn, then its text."""
    t = read(spark, sf_dir, "conversations")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("## "), "role", F.lit("\n"), "text").alias("part")))), lambda x: x["part"]), "\n")
    s = heading_sections(t.groupBy(F.col("conv_id").alias("doc_id")).agg(text.alias("text")))
    return s.groupBy("doc_id", "title").agg(F.count("*").alias("sections"), F.max(F.length("content")).alias("longest"))


def q_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", token_estimate("text").alias("tokens"), section_title("text").alias("title"))


QUERIES = {
    "budget_chunks": q_budget, "yaml_documents": q_yaml_documents, "fixed_chunks": q_fixed, "chunk_stats": q_chunk_stats, "paragraph_blocks": q_paragraphs, "boundary_chunks": q_boundary, "heading_sections": q_sections, "token_estimate": q_token_estimate,
    "page_chunks": q_page_chunks, "paragraph_chunks": q_paragraph_chunks, "rst_sections": q_rst, "code_sections": q_code, "yaml_blocks": q_yaml, "ini_blocks": q_ini, "json_blocks": q_json, "xml_blocks": q_xml, "keyed_blocks": q_keyed, "packed_rows": q_packed, "chunker_dispatch": q_dispatch, "structured_terms": q_terms}
_BARE = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _fixed_sql(source: str, size: int, step: int) -> str:
    """CTEs up to k: the fixed windows of source (ids in doc_id, text)."""
    content = _BARE.format(f"substring(text, i * {step} + 1, {size})")
    return f"""c as (select *, unnest(range(greatest(0, ceil((length(text) - {size}) / {step}.0))::int + 1))::int as i from ({source}) where length(text) > 0),
        w as (select * exclude (text), i * {step} as start_char, least(i * {step} + {size}, length(text))::int as end_char, {content} as content from c),
        k as (select * exclude (i), (row_number() over (partition by doc_id order by i) - 1)::int as chunk_index from w where content <> '')"""


def _boundary_sql(source: str, size: int, overlap: int) -> str:
    """CTEs up to bc: the boundary windows of source (doc_id, text), one window of all texts at a time."""
    slack = min(120, max(20, size // 4))
    low = f"greatest(s + 1, s + {size} - {slack})"
    tail = f"substring(text, {low} + 1, s + {size} - {low})"
    back = lambda mark, n: f"case when contains({tail}, {mark}) then s + {size} - (strpos(reverse({tail}), reverse({mark})) - 1) end"
    end = f"case when s + {size} >= n then n else coalesce({back('chr(10) || chr(10)', 2)}, {back(chr(39) + '. ' + chr(39), 2)}, {back('chr(10)', 1)}, {back(chr(39) + ' ' + chr(39), 1)}, s + {size}) end"
    return f"""t as materialized (select doc_id, text, length(text) as n from ({source}) where length(text) > 0),
        b as (select doc_id, 0::bigint as i, 0::bigint as s, (select {end} from (select t.text, t.n, 0::bigint as s))::bigint as e from t union all
            select doc_id, i, s, {end} as e from (select b.doc_id, b.i + 1 as i, greatest(b.s + 1, b.e - {overlap}) as s, t.text, t.n from b join t using (doc_id) where b.e < t.n)),
        bc as (select b.doc_id, i::int as chunk_index, s::int as start_char, e::int as end_char from b join t using (doc_id) where {_BARE.format("substring(text, s + 1, e - s)")} <> '')"""


def _budget_sql(size: int, overlap: int, budget: int) -> str:
    """CTEs up to gc: budget chunks of documents, one chunk of all texts at a time."""
    low = min(120, max(20, size // 4))
    back = lambda e: f"case when {e} >= n then n else coalesce(list_max(list_filter(bs, lambda x: x >= greatest(s + 1, {e} - {low}) and x <= {e})), {e}) end"
    mid = "case when s > 0 and not regexp_matches(cs[s], '\\s') and not regexp_matches(cs[s + 1], '\\s') then 1 else 0 end"
    part = lambda e: _BARE.format(f"substring(text, s + 1, {e} - s)")
    cost = lambda e: f"case when {part(e)} = '' then 0 when not contains({part(e)}, ' ') then greatest(1, length({part(e)}) // 2) else len(list_filter(ws, lambda x: x >= s and x < {e})) + {mid} end"
    fits = f"case when not contains({part('e0')}, ' ') then s + {2 * budget + 1} else least(e0, list_filter(ws, lambda x: x >= s)[{budget} + 1 - ({mid})]) end"
    ends = lambda rows: f"select *, case when c0 <= {budget} then e0 else {back('l')} end as e from (select *, {cost('e0')} as c0, {fits} as l from (select *, {back(f'least(n, s + {size})')} as e0 from ({rows})))"
    due = f"select g.doc_id, g.i, g.s, g.e, greatest(g.s + 1, g.e - {overlap}) as due, t.bs from g join t using (doc_id) where g.e < t.n"
    around = f"select doc_id, i, s, e, due, list_min(list_filter(bs, lambda x: x >= due)) as ahead, list_max(list_filter(bs, lambda x: x <= due)) as behind from ({due})"
    start = "case when ahead <= least(e, due + 80) then ahead when behind >= greatest(s + 1, due - 80) then behind else due end"
    return rf"""ch as (select doc_id, text, string_split(text, '') as cs, length(text) as n from documents where length(text) > 0),
        t as materialized (select doc_id, text, n, cs, list_filter(range(0, n + 1), lambda i: i = 0 or i = n or regexp_matches(cs[i], '\s') or (contains('。！？!?；;:.', cs[i]) and (regexp_matches(cs[i + 1], '\s') or (cs[i + 1] >= '一' and cs[i + 1] <= '鿿')))) as bs,
            list_filter(range(0, n), lambda i: not regexp_matches(cs[i + 1], '\s') and (i = 0 or regexp_matches(cs[i], '\s'))) as ws from ch),
        g as (select doc_id, i, s, e from ({ends("select *, 0 as i, 0::bigint as s from t")}) union all
            select doc_id, i, s, e from ({ends(f"select t.*, q.i + 1 as i, q.start as s from (select *, {start} as start from ({around})) q join t using (doc_id)")})),
        gc as (select doc_id, (row_number() over (partition by doc_id order by i) - 1)::int as chunk_index, s::int as start_char, e::int as end_char, ({cost("e")})::int as tokens from g join t using (doc_id) where {part("e")} <> '')"""


_FIXED = _fixed_sql("select doc_id, text from documents", 1000, 900)
ORACLE = {
    "budget_chunks": f"with recursive {_budget_sql(1000, 100, 120)} select * from gc",
    "yaml_documents": """with d as (select doc_id, coalesce(lang, 'x') as lang, coalesce(source, 'x') as source, (doc_id % 9 + 1)::int as deep from documents),
        k as (select doc_id, unnest(range(1, deep + 1))::int as k, deep, lang, source from d)
        select doc_id, (k - 1)::int as pos, array_to_string(list_transform(range(1, k + 1), lambda i: 'k' || i), '.') || ':' || case when k = deep then ' ' || lang else '' end as block from k
        union all select doc_id, deep, 'list:' from d
        union all select doc_id, (deep + k + (k - 1) // 2)::int, case when k % 2 = 0 then 'list[' || (k - 1) || '].n: ' || k else 'list[' || (k - 1) || ']: ' || lang end from k
        union all select doc_id, (deep + k + k // 2)::int, 'list[' || (k - 1) || '].a b: ' || source from k where k % 2 = 0
        union all select doc_id, (deep + deep + deep // 2 + 1)::int, 'last: ' || chr(39) || '# no comment' || chr(39) from d""",
    "fixed_chunks": f"with {_FIXED} select doc_id, chunk_index, start_char, end_char, md5(content) as content_md5 from k",
    "chunk_stats": f"with {_FIXED} select count(*) as chunks, round(avg(length(content)), 6) as avg_chars, min(length(content))::int as min_chars, max(length(content))::int as max_chars from k",
    "boundary_chunks": f"with recursive {_boundary_sql('select doc_id, text from documents', 1000, 100)} select * from bc",
    "paragraph_chunks": f"with recursive {_boundary_sql('select page_id as doc_id, html as text from pages', 400, 40)} select *, 'paragraph_400_40::' || doc_id || '::' || chunk_index as chunk_id from bc",
    "page_chunks": f"with {_fixed_sql('select conv_id as cid, turn, (conv_id, turn) as doc_id, text from conversations', 200, 180)} select cid as doc_id, turn as page_number, (row_number() over (partition by cid order by turn, chunk_index) - 1)::int as chunk_index, start_char, end_char, md5(content) as content_md5 from k",
    "rst_sections": "select conv_id as doc_id, 'turn ' || turn as title, role || ' / turn ' || turn as section_path from conversations",
    "code_sections": "select conv_id as doc_id, 'turn_' || turn as title, role || ' / turn_' || turn as section_path, '    def turn_' || turn || '(self):' || chr(10) || '        pass' as content from conversations",
    "yaml_blocks": "select n_regionkey as doc_id, unnest(['nation:', 'nation.' || n_name || ':', 'nation.' || n_name || '.key: ' || n_nationkey]) as block from nation",
    "ini_blocks": "select c_nationkey as doc_id, c_name || '.segment: ' || c_mktsegment as block from customer",
    "json_blocks": "select event_id as doc_id, unnest(['user.id', 'user.kinds', 'list[0].p.k']) as path, unnest([user_id::varchar, '[\"' || event_type || '\",\"x\"]', props->>'$.k']) as value from events",
    "xml_blocks": "select p_partkey as doc_id, unnest([0, 1, 2])::int as pos, unnest(['/part', '/part/brand', '/part/size']) as path, unnest(['key=' || p_partkey, '', '']) as attributes, unnest(['brand, size', '', '']) as children, unnest(['', p_brand, p_size::varchar]) as text from part",
    "keyed_blocks": "select conv_id as doc_id, row_number() over (partition by conv_id order by turn) as block, role || ': turn' || chr(10) || '  more of ' || turn as content from conversations",
    "packed_rows": """with recursive r as (select c_nationkey as doc_id, row_number() over (partition by c_nationkey order by c_custkey) as i, c_name, c_mktsegment from customer),
        c as materialized (select *, len(list_filter(string_split('row ' || i || ': name: ' || c_name || '; segment: ' || c_mktsegment, ' '), lambda x: x <> '')) as n from r),
        p as (select doc_id, i, n, 0 as chunk from c where i = 1 union all
            select c.doc_id, c.i, case when p.n + c.n > 60 then c.n else p.n + c.n end, p.chunk + case when p.n + c.n > 60 then 1 else 0 end from p join c on c.doc_id = p.doc_id and c.i = p.i + 1)
        select doc_id, chunk as chunk_index, count(*) as rows from p group by 1, 2""",
    "chunker_dispatch": r"""with d as (select doc_id % 4 as k, coalesce(text, '') as t from documents)
        select case k when 0 then 'markdown' when 1 then 'code' when 2 then 'rows' else case when regexp_matches(ltrim(t, ' '), '^[\[{]') and json_valid(t) then 'json' when starts_with(ltrim(t, ' '), '<?xml') then 'xml' when regexp_matches(t, '(?m)^#{1,6} +\S') then 'markdown' when regexp_matches(t, '(?m)^\[[^\]\n]+\]\s*$') then 'ini' else 'text' end end as chunker, count(*) as n from d group by 1""",
    "structured_terms": "select p_partkey, p_brand || '|' || p_type || case when p_name in (p_brand, p_type) then '' else '|' || p_name end as terms from part",
    "paragraph_blocks": r"with p as (select doc_id, unnest(string_split_regex(text, '\n[ \t]*\n+')) as c, generate_subscripts(string_split_regex(text, '\n[ \t]*\n+'), 1) as pos from documents), q as (select doc_id, coalesce(sum(length(c) + 2) over (partition by doc_id order by pos rows between unbounded preceding and 1 preceding), 0)::bigint as s from p where trim(c) <> '') select doc_id, count(*) as paragraphs, max(s) as last_start from q group by 1",
    "heading_sections": "select conv_id as doc_id, role as title, count(*) as sections, max(length('## ' || role || chr(10) || text))::int as longest from conversations group by 1, 2",
    "token_estimate": r"select doc_id, greatest(1, case when contains(text, ' ') then len(list_filter(string_split_regex(text, '[\s]+'), lambda w: w <> '')) else length(text) // 2 end)::int as tokens, substring(trim(regexp_replace(regexp_extract(text, '^\s*([^\n]+)', 1), '^[# ]+', '')), 1, 120) as title from documents",
}
