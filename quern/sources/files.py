"""Files as tables: kinds by name, guarded reads, decoding, JSON lines, delimited tables."""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans.common import read

MAX_BYTES = 50 << 20
# Extensions with the kind, the parser and the media types they lead to.
_PLAIN = "text/plain"
_CODE = (_PLAIN, "text/x-python", "application/javascript", "text/javascript", "text/typescript", "application/x-sh", "text/x-shellscript", "text/css", "application/sql")
FORMATS: dict[str, tuple[str, str | None, tuple[str, ...]]] = {
    "pdf": ("pdf", "pdf", ("application/pdf",)),
    "docx": ("docx", "word", ("application/vnd.openxmlformats-officedocument.wordprocessingml.document", "application/zip")),
    "doc": ("other", None, ("application/msword",)),
    "pptx": ("pptx", "pptx", ("application/vnd.openxmlformats-officedocument.presentationml.presentation", "application/zip")),
    "xlsx": ("xlsx", "excel", ("application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "application/zip")),
    "xls": ("xlsx", "excel", ("application/vnd.ms-excel",)),
    "csv": ("tabular", "tabular", ("text/csv", "application/csv", "application/vnd.ms-excel", _PLAIN)),
    "tsv": ("tabular", "tabular", ("text/tab-separated-values", _PLAIN)),
    "html": ("html", "html", ("text/html", "application/xhtml+xml")),
    "htm": ("html", "html", ("text/html", "application/xhtml+xml")),
    "svg": ("xml", "text", ("image/svg+xml", "application/xml", "text/xml", _PLAIN)),
    "txt": ("txt", "text", (_PLAIN,)),
    "rst": ("txt", "text", (_PLAIN,)),
    "log": ("txt", "text", (_PLAIN,)),
    "md": ("md", "text", ("text/markdown", _PLAIN)),
    "markdown": ("md", "text", ("text/markdown", _PLAIN)),
    "json": ("json", "text", ("application/json", _PLAIN)),
    "xml": ("xml", "text", ("application/xml", "text/xml", _PLAIN)),
    "png": ("image", "image", ("image/png",)),
    "jpg": ("image", "image", ("image/jpeg",)),
    "jpeg": ("image", "image", ("image/jpeg",)),
    "gif": ("image", "image", ("image/gif",)),
    "bmp": ("image", "image", ("image/bmp",)),
    "webp": ("image", "image", ("image/webp",)),
} | {x: ("code", "text", _CODE) for x in "py js ts tsx jsx java c cpp cc cxx h hpp go rs rb php cs swift kt kts scala sh bash zsh bat ps1 sql yaml yml toml ini cfg conf env properties css scss less vue gitignore".split()}
KINDS = sorted({k for k, _, _ in FORMATS.values()} | {"other"})
# Cells that name a column.
HEADER_WORDS = ("名称", "说明", "描述", "标题", "内容", "类型", "状态", "备注", "金额", "数量", "日期", "name", "title", "description", "content", "type", "status", "remark", "remarks", "amount", "count", "date", "id")


def extension(name: Column | str) -> Column:
    """The longest end of a name, after a dot, that the registry knows, else what follows the last dot."""
    base = F.lower(F.regexp_extract(name, r"([^/\\\\]*)$", 1))
    parts = F.split(base, r"\.")
    ends = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(parts))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    known = F.get(F.filter(ends, lambda x: x.isin(*FORMATS)), 0)
    return F.when(F.size(parts) > 1, F.coalesce(known, F.element_at(parts, -1))).otherwise("")


def file_kind(name: Column | str) -> Column:
    """struct<file_type, parser, mimes>; unknown extensions are of the type `other` without a parser."""
    entry = lambda t, p, m: F.struct(F.lit(t).alias("file_type"), F.lit(p).cast("string").alias("parser"), F.array(*map(F.lit, m)).alias("mimes"))
    table = F.create_map(*(x for k, v in FORMATS.items() for x in (F.lit(k), entry(*v))))
    return F.coalesce(table[extension(name)], F.struct(F.lit("other").alias("file_type"), F.lit(None).cast("string").alias("parser"), F.array().cast("array<string>").alias("mimes")))


def search_type(asked: Column) -> Column:
    """What a search for a kind or an extension means: the kind that is stored; others as they are, blank ones nothing."""
    t = F.nullif(F.lower(F.trim(asked)), F.lit(""))
    kind = file_kind(F.concat(F.lit("query."), F.regexp_replace(t, r"^\.+", "")))["file_type"]
    return F.when(t.isin(*KINDS), t).when(kind == "other", t).otherwise(kind)


def read_binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files with their bytes; one that is too large keeps its row, with an error in place of its content."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    large = F.col("length") > MAX_BYTES
    return f.select("path", "length", file_kind(F.col("path")).alias("kind"), F.when(~large, F.col("content")).alias("content"), F.when(large, F.lit("too large")).alias("error"))


def declared_charset(content: Column) -> Column:
    """The character set that the first 4,096 bytes of a page declare."""
    head = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    return F.nullif(F.lower(F.regexp_extract(head, r"""(?i)<meta[^>]+charset\s*=\s*["']?\s*([a-z0-9_-]+)""", 1)), F.lit(""))


#: Encodings that are scored where a file is no UTF-8 and declares nothing that fits; equal scores go to the first.
LEGACY = ("gb18030", "big5", "shift_jis", "latin-1")
#: Frequent characters of simplified and of traditional Chinese; what a wrong reading yields is hardly ever among them.
_SIMPLE = frozenset("的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里用道行所然家种事成方多经么去法学如都同现当没动面起看定天分还进好小部其些主样理心她本前开但因只从想实日")
_TRADITIONAL = frozenset("的一是不了在人有我他這個們中來上大為和國地到以說時要就出會可也你對生能而子那得於著下自之年過發後作裡用道行所然家種事成方多經麼去法學如都同現當沒動面起看定天分還進好小部其些主樣理心她本前開但因只從想實日")


def _pair_share(text: str, encoding: str) -> float:
    """How many of the characters beyond ASCII lie where an encoding keeps the frequent ones of its language, the most frequent counted more."""
    n = good = 0.0
    for c, times in Counter(c for c in text if c > "\x7f").items():
        b = c.encode(encoding)
        n += times
        if len(b) != 2:
            continue
        pair = b[0] << 8 | b[1]
        if encoding == "gb18030":
            good += times * (0xB0A1 <= pair <= 0xD7F9 and b[1] >= 0xA1 or b[0] in (0xA1, 0xA3) and b[1] >= 0xA1) + 0.5 * times * (c in _SIMPLE)
        elif encoding == "big5":
            good += times * (0xA140 <= pair <= 0xA3BF or 0xA440 <= pair <= 0xC67E) + 0.5 * times * (c in _TRADITIONAL)
        else:
            good += times * (0x8140 <= pair <= 0x81AC or 0x889F <= pair <= 0x9872) + 1.5 * times * (0x829F <= pair <= 0x82F1 or 0x8340 <= pair <= 0x8396)
    return good / n if n else 0.0


def _latin_share(b: bytes) -> float:
    """How many bytes beyond ASCII are letters of Western Europe, or marks of it, that stand alone or in twos beside ASCII."""
    runs = re.findall(rb"[\x80-\xff]+", b)
    n = sum(map(len, runs))
    return sum(len(x) for x in runs if len(x) <= 2 and all(c >= 0xC0 and c not in (0xD7, 0xF7) or c in b"\xa0\xa1\xab\xb0\xb7\xbb\xbf\x92\x93\x94\x96" for c in x)) / n if n else 1.0


def detected(b: bytes) -> str | None:
    """The legacy encoding whose frequent pairs a file's bytes are most like; each byte sequence is one of them."""
    best, most = None, -1.0
    for e in LEGACY:
        try:
            score = _latin_share(b) if e == "latin-1" else _pair_share(b.decode(e), e)
        except (UnicodeDecodeError, UnicodeEncodeError):
            continue
        if score > most:
            best, most = e, score
    return best


def _decode_other(content: pd.Series, declared: pd.Series) -> pd.Series:
    def one(b: bytes | None, first: str | None) -> str | None:
        if b is None:
            return None
        for e in (first, detected(b)):
            try:
                return b.decode(e)
            except (UnicodeDecodeError, LookupError, TypeError):
                continue
        return None

    return pd.Series([one(b, e) for b, e in zip(content, declared, strict=True)])


def decoded(content: Column) -> Column:
    """Bytes as text: as UTF-8 where that is valid, without leaving the JVM, else by the declared encoding, or by the legacy one that its pairs of bytes are most like."""
    text = content.cast("string")
    utf8 = F.is_valid_utf8(text)
    other = F.when(~utf8, content)
    return F.regexp_replace(F.when(utf8, text).otherwise(F.pandas_udf(_decode_other, "string")(other, declared_charset(other))), "^\ufeff", "")


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The lines that are JSON objects; comments, blank lines and broken ones are left out."""
    lines = spark.read.text(path).where(F.trim("value").startswith("{")).select(F.from_json("value", schema).alias("row"), F.try_parse_json("value").alias("parsed"))
    return lines.where("parsed is not null").select("row.*")


def data_like(cell: str | None) -> bool:
    """A formula, an address, or a number."""
    x = (cell or "").strip()
    return bool(x) and (x.startswith("=") or x.lower().startswith(("http://", "https://", "www.")) or x.replace(".", "", 1).replace(",", "", 1).isdigit())


def is_header(first: list[str | None], others: list[list[str | None]]) -> bool:
    """Whether a first row names columns: it has a word that names one; or it has no data and rows below do."""
    cells = [x.strip() for x in first if x and x.strip()]
    if not cells or any(x.lower() in HEADER_WORDS for x in cells):
        return bool(cells)
    return not any(map(data_like, cells)) and any(data_like(x) for row in others for x in row)


def read_delimited(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Delimited files of one kind whose header is inferred from the first four rows; blank rows are dropped, columns without a name numbered.

    Where there is a header, it is the first row of each file, and of no file more than that.
    """
    reader = lambda header: spark.read.option("multiLine", "true").option("sep", sep).option("escape", '"').option("header", header).option("enforceSchema", "true")
    filled = lambda df: df.where(F.greatest(*(F.length(F.trim(F.coalesce(F.col(f"`{c}`"), F.lit("")))) for c in df.columns), F.lit(0)) > 0)
    raw = reader("false").csv(path)
    head = [list(r) for r in filled(raw).limit(4).collect()]
    if not head or not is_header(head[0], head[1:]):
        return filled(raw).toDF(*(f"column_{i + 1}" for i in range(len(raw.columns))))
    names = [(x or "").strip() or f"column_{i + 1}" for i, x in enumerate(head[0])]
    return filled(reader("true").schema(raw.schema).csv(path)).toDF(*names)


def write_report(df: DataFrame, path: str, title: str = "Report") -> None:
    """A small result as JSON lines, CSV with a header, and a Markdown table, in folders of path."""
    df.write.mode("overwrite").json(f"{path}/json")
    df.write.mode("overwrite").option("header", "true").csv(f"{path}/csv")
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.replace(F.col(f"`{c}`").cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in df.columns)), F.lit(" |"))
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "-|" * len(df.columns)]
    lines = df.sparkSession.createDataFrame([(x,) for x in head], "line string").coalesce(1).union(df.coalesce(1).select(cells))
    lines.coalesce(1).write.mode("overwrite").text(f"{path}/markdown")


def find_in_documents(docs: DataFrame, part: str, text_col: str = "text") -> DataFrame:
    """Rows whose text holds a part, wildcards standing for themselves."""
    return docs.where(F.contains(text_col, F.lit(part)))


def field_equals(row: Column, metadata: Column, key: str, value: str) -> Column:
    """Whether a row's field, or else the same field of its metadata (JSON), equals a value."""
    return F.coalesce(row, F.get_json_object(metadata, f"$.{key}")).eqNullSafe(F.lit(value))


def format_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under file names of all kinds, counted by what the registry makes of them."""
    names = [*FORMATS, "exe", "TXT", "v2.PY", ""]
    ext = F.get(F.array(*map(F.lit, names)), (F.col("doc_id") % len(names)).cast("int"))
    d = read(spark, sf_dir, "documents").withColumn("kind", file_kind(F.concat_ws(".", "source", F.nullif(ext, F.lit("")))))
    return d.groupBy("kind.file_type", "kind.parser", F.array_join("kind.mimes", ",").alias("mimes")).agg(F.count("*").alias("n"))


def search_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.get(F.array(*map(F.lit, ["xls", ".CSV", "tabular", "exe", " ", "htm"])), (F.col("doc_id") % 6).cast("int"))
    return read(spark, sf_dir, "documents").groupBy(search_type(asked).alias("file_type")).agg(F.count("*").alias("n"))


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    return p.groupBy(F.regexp_extract("url", "^https?://([^/:?#]+)", 1).alias("host")).agg(F.count("*").alias("pages"), F.sum(F.length("html")).alias("chars"))


def page_charsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages").withColumn("bytes", F.col("html").cast("binary"))
    return p.groupBy(declared_charset(F.col("bytes")).alias("charset")).agg(F.count("*").alias("pages"), F.count_if(decoded(F.col("bytes")) == F.col("html")).alias("decoded"))


def document_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a text, from one source by field or metadata."""
    d = read(spark, sf_dir, "documents").withColumn("metadata", F.to_json(F.struct(F.col("source").alias("file"))))
    field = F.when(F.col("doc_id") % 2 == 0, F.col("source"))
    return find_in_documents(d, "the").where(field_equals(field, F.col("metadata"), "file", "src3")).select("doc_id")


_CASE = " ".join(f"when '{k}' then '{t}|{p or ''}|{','.join(m)}'" for k, (t, p, m) in FORMATS.items())
_NAMES = ", ".join(f"'{x}'" for x in [*FORMATS, "exe", "TXT", "v2.PY", ""])
QUERIES = {f.__name__: f for f in (format_registry, search_types, page_hosts, page_charsets, document_search)}
ORACLE = {
    "format_registry": f"with a as (select lower([{_NAMES}][(doc_id % {len(FORMATS) + 4}) + 1]) as x from documents), b as (select case string_split(x, '.')[-1] {_CASE} else 'other||' end as k from a) select split_part(k, '|', 1) as file_type, nullif(split_part(k, '|', 2), '') as parser, split_part(k, '|', 3) as mimes, count(*) as n from b group by 1, 2, 3",
    "search_types": "select ['xlsx', 'tabular', 'tabular', 'exe', null, 'html'][(doc_id % 6) + 1] as file_type, count(*) as n from documents group by 1",
    "page_hosts": "select regexp_extract(url, '^https?://([^/:?#]+)', 1) as host, count(*) as pages, sum(length(html))::bigint as chars from pages group by 1",
    "page_charsets": """select nullif(lower(regexp_extract(html[1:4096], '(?i)<meta[^>]+charset\\s*=\\s*["'']?\\s*([a-z0-9_-]+)', 1)), '') as charset, count(*) as pages, count(*) as decoded from pages group by 1""",
    "document_search": "select doc_id from documents where contains(text, 'the') and source = 'src3'",
}
