"""Text as columns: tokens, compact forms, cleaning, phrases, citations, helpers and validators."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The words that the index leaves out.
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "in", "is",
    "of", "on", "or", "that", "the", "this", "to", "was", "were", "with",
)
_HAN = "一-鿿"
#: Characters that compatibility folding surely leaves alone: Latin ones and Han.
_FOLDED = r"[^\x00-\x9f¡-§©«-®°±¶·»¿-ıĴ-ľŁ-ňŊ-žƀ-ǃ一-鿿]"


#: Cheap tests for what folding, or cleaning, may change: any character beyond Latin-1, and those within it.
_BEYOND = r"[\u0100-\x{10ffff}]"
_FOLDS = r"[\xa0\xa8\xaa\xaf\xb2-\xb5\xb8-\xba\xbc-\xbe]"
_DIRTY = r"[\x00-\x08\x0b-\x1f\x7f\xa0\xad]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _fold(x: pa.Array) -> pa.Array:
    if x.null_count == len(x):
        return pa.nulls(len(x), pa.string())
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in x.to_pylist()], pa.string())


def nfkc(text: Column | str) -> Column:
    """The text with compatibility forms folded (full width, ligatures, composed accents).

    Spark has no function for it. Only texts with characters that may change go to Python, in
    batches; Latin and Han texts pass by.
    """
    t = _c(text)
    other = t.rlike(_FOLDS) | (t.rlike(_BEYOND) & t.rlike(_FOLDED))
    return F.coalesce(F.arrow_udf(_fold, "string")(F.when(other, t)), t)


def _pairs_of(run: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(run) - 1), lambda i: F.substring(run, i, F.lit(2)))


def index_tokens(text: Column | str) -> Column:
    """Tokens of the inverted index, with repeats.

    Latin runs in lower case without single characters and stopwords; Han runs of up to two
    characters whole, longer ones as all their pairs, and also whole up to twelve characters. Texts
    without Han take one expression; only others are looked at run by run.
    """
    t = F.lower(_c(text))
    plain = F.filter(F.regexp_extract_all(t, F.lit("[a-z0-9]{2,}+"), F.lit(0)), lambda x: ~x.isin(*STOPWORDS))
    runs = F.regexp_extract_all(t, F.lit(f"([a-z0-9]+|[{_HAN}]+)"), F.lit(0))

    def of(run: Column) -> Column:
        latin = F.when((F.length(run) > 1) & ~run.isin(*STOPWORDS), F.array(run)).otherwise(F.array().cast("array<string>"))
        long_run = F.concat(_pairs_of(run), F.when(F.length(run) <= 12, F.array(run)).otherwise(F.array().cast("array<string>")))
        return F.when(run.rlike("^[a-z0-9]"), latin).when(F.length(run) <= 2, F.array(run)).otherwise(long_run)

    return F.when(t.rlike(f"[{_HAN}]"), F.flatten(F.transform(runs, of))).otherwise(plain)


def rerank_tokens(text: Column | str) -> Column:
    """The set of tokens that re-ranking compares: nothing is left out, Han runs give their pairs."""
    t = F.lower(_c(text))
    runs = F.regexp_extract_all(t, F.lit(f"([a-z0-9]+|[{_HAN}]+)"), F.lit(0))
    return F.when(~t.rlike(f"[{_HAN}]"), F.array_distinct(runs)).otherwise(F.array_distinct(F.flatten(F.transform(runs, lambda r: F.when(r.rlike("^[a-z0-9]") | (F.length(r) == 1), F.array(r)).otherwise(_pairs_of(r))))))


def compact(text: Column | str) -> Column:
    """Lower case without any white space."""
    return F.regexp_replace(F.lower(_c(text)), r"(?U)\s+", "")


def normalised(text: Column | str) -> Column:
    """Lower case, every run of anything but letters and digits as one blank."""
    return F.trim(F.regexp_replace(F.lower(_c(text)), r"(?U)[\s\W_]+", " "))


# The pairs of quotation marks round a phrase.
QUOTES = (('"', '"'), ("'", "'"), ("“", "”"), ("‘", "’"), ("《", "》"), ("「", "」"))


def marked_phrases(text: Column | str) -> Column:
    """Phrases of two or more characters between any quotation marks, without repeats, those of one pair after the other.

    Marks are paired by their places, so that two apostrophes make a phrase of what lies between them.
    """
    found = [F.transform(F.regexp_extract_all(_c(text), F.lit(f"(?s){a}(.*?){b}"), F.lit(1)), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")) for a, b in QUOTES]
    return F.array_distinct(F.filter(F.concat(*found), lambda x: F.length(x) >= 2))


def quoted_phrases(text: Column | str) -> Column:
    """Phrases of two or more characters in double or corner quotes, without repeats."""
    t = _c(text)
    straight = F.regexp_extract_all(t, F.lit("[\"“](.{2,}?)[\"”]"), F.lit(1))
    corner = F.regexp_extract_all(t, F.lit("[《「](.{2,}?)[》」]"), F.lit(1))
    return F.array_distinct(F.concat(straight, corner))


def bind(x: Column, of) -> Column:
    """of(x), with x computed once however often it is used."""
    return F.get(F.transform(F.array(x), of), 0)


def _bare(text: Column) -> Column:
    """Without marks of no width and control characters, with one kind of line end and of blank."""
    t = F.regexp_replace(text, "[\ufeff\u00ad\u200b-\u200f\u2060]", "")
    t = F.regexp_replace(t, "\r\n?", "\n")
    t = F.regexp_replace(t, "[\u00a0\u3000]", " ")
    t = F.regexp_replace(t, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", "")
    return F.when(text.rlike(_DIRTY) | text.rlike(_BEYOND), t).otherwise(text)


def _collapsed(text: Column | str) -> Column:
    """One blank for runs of them, and none at the ends of lines."""
    return F.trim(F.regexp_replace(F.regexp_replace(_bare(nfkc(text)), "[ \t]{2,}|\t", " "), " \n ?|\n ", "\n"))


def _ended(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), r"^\n+|\n+\z", "")


def clean_prose(text: Column | str) -> Column:
    """Compatibility forms folded, marks of no width dropped, line ends and blanks unified, blank runs and repeated lines collapsed."""
    once = F.regexp_replace(_collapsed(text), r"(?md)^(.{3,}+)(?:\n\1)+$", "$1")  # lines that repeat the one before
    return _ended(once)


def clean_markup(text: Column | str) -> Column:
    """As prose, but every line stays."""
    return _ended(_collapsed(text))


def clean_structured(text: Column | str) -> Column:
    """As markup, with the indents of its lines; a tab counts as four blanks."""
    def line(x: Column) -> Column:
        x = F.rtrim(F.replace(x, F.lit("\t"), F.lit("    ")))
        indent = F.regexp_extract(x, "^ *", 0)
        return F.concat(indent, F.regexp_replace(F.substring(x, F.length(indent) + 1, F.length(x)), "[ \t]{2,}", " "))

    return F.regexp_replace(F.regexp_replace(F.array_join(F.transform(F.split(_bare(nfkc(text)), "\n"), line), "\n"), "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


# Extensions whose lines and indents, or whose lines alone, are kept.
STRUCTURED = tuple("json xml svg yaml yml toml ini cfg conf env properties csv tsv py js ts tsx jsx java cc cpp cxx c h hpp cs go rb php rs swift kt kts scala sh bash zsh bat ps1 sql html gitignore css scss less vue".split())
MARKUP = ("md", "markdown", "rst")


def clean_by_kind(text: Column | str, extension: Column) -> Column:
    """Cleaned by the profile of a file's extension."""
    return F.when(extension.isin(*STRUCTURED), clean_structured(text)).when(extension.isin(*MARKUP), clean_markup(text)).otherwise(clean_prose(text))


def distinct_lines(lines: Column) -> Column:
    """Without lines of three or more characters that repeat the line before, and without double empty lines."""

    def of(lines: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("string")), F.slice(lines, F.lit(1), F.size(lines) - 1))
        repeats = lambda x, p: F.coalesce((x == p) & ((F.length(x) >= 3) | (x == "")), F.lit(False))
        kept = F.zip_with(lines, before, lambda x, p: F.when(~repeats(x, p), x))
        return F.array_compact(kept)

    return F.when(F.size(lines) > 0, bind(lines, of)).otherwise(lines)


def looks_like_heading(line: Column) -> Column:
    """A short line without an end mark that is numbered, names a chapter, or is all capitals."""
    numbered = line.rlike(r"^(?i:chapter|section|appendix)\b|^\d+(?:\.\d+){0,5}\s+\S+|^第[一二三四五六七八九十0-9]+(?:章|节|部分|条)|^[A-Z0-9][A-Z0-9 _./:-]{2,}$")
    return (F.length(line) <= 60) & ~line.rlike(r"[.!?。！？；;:：]$") & numbered


def looks_like_table_row(line: Column) -> Column:
    return line.rlike(r"[|\t]|\S+\s{2,}\S+")


# How a list item begins, and what a page number looks like.
BULLET = r"^(?:[-*•●▪■]|(?:\(?\d+\)?[.)、])|(?:[A-Za-z][.)])|(?:[一二三四五六七八九十]+[、.]))\s+"
PAGE_NUMBERS = (r"^\d+$", r"^(?i:page)\s+\d+(?:\s*(?:/|(?i:of))\s*\d+)?$", r"^第\s*\d+\s*页(?:\s*/\s*共\s*\d+\s*页)?$", r"^(?i:[ivxlcdm]+)$")


def looks_like_list_item(line: Column) -> Column:
    return line.rlike(BULLET)


def is_page_number(line: Column) -> Column:
    """A line of up to 80 characters that is nothing but a page's number."""
    found = F.lit(False)
    for p in PAGE_NUMBERS:
        found = found | line.rlike(p)
    return found & (F.length(line) <= 80)


def merged_lines(text: Column | str) -> Column:
    """Lines that a break cut are joined: after a comma or a hyphen, or where the next begins in lower case or with a closing mark.

    Headings, list items and table rows stay lines of their own; so do lines after an end mark. Empty
    lines separate paragraphs.
    """
    structural = lambda x: looks_like_list_item(x) | looks_like_table_row(x) | looks_like_heading(x)
    closing = "[),，。；;:：!?！？」』】）\\]]"

    def joins(p: Column, x: Column) -> Column:
        hyphen, ends = p.rlike("[-‐‑]$"), p.rlike(r"[.!?。！？；;:：]$")
        follows = p.rlike("[,，、/／(（]$") | x.rlike(f"^{closing}") | x.rlike(rf"^[a-z{_HAN}“\"‘（(]") | (F.length(p) < 90)
        return (p != "") & (x != "") & ~structural(p) & ~structural(x) & ~ends & F.when(hyphen, x.rlike("^[A-Za-z0-9]")).otherwise(follows)

    def mark(p: Column, x: Column) -> Column:
        tight = p.rlike("[(（/／]$") | x.rlike(f"^{closing}")
        return F.when(p.isNull(), "").when(~joins(p, x), "\n").when(p.rlike("[-‐‑]$"), "\u0001").when(tight, "").otherwise(" ")

    def of(lines: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("string")), F.slice(lines, F.lit(1), F.size(lines) - 1))
        return F.array_join(F.zip_with(lines, before, lambda x, p: F.concat(mark(p, x), x)), "")

    joined = bind(F.transform(F.split(_c(text), "\n"), lambda x: F.trim(x)), of)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(joined, "[-‐‑]\u0001", ""), "\n{3,}", "\n\n"), "^\n+|\n+$", "")


def token_estimate(text: Column | str) -> Column:
    """Words if there is a blank, else half the characters; 1 at least."""
    t = _c(text)
    words = F.size(F.filter(F.split(t, r"[\s]+"), lambda w: w != ""))
    return F.greatest(F.lit(1), F.when(F.contains(t, F.lit(" ")), words).otherwise(F.floor(F.length(t) / 2).cast("int")))


def section_title(text: Column | str) -> Column:
    """The first line that isn't blank, without marks of a heading, at most 120 characters."""
    first = F.regexp_extract(_c(text), r"^\s*([^\n]+)", 1)
    return F.substring(F.trim(F.regexp_replace(first, "^[# ]+", "")), 1, 120)


# The marks of a citation.
CITATIONS = (r"\[(\d+)\]", r"【(\d+)】", r"\((\d+)\)", r"\[来源(\d+)\]", r"【来源(\d+)】", r"\[参考(\d+)\]", r"【参考(\d+)】")


def citation_indices(text: Column | str) -> Column:
    """Sorted distinct numbers of all citation marks; numbers too large for one are left out."""
    marks = [F.regexp_extract_all(_c(text), F.lit(p), F.lit(1)) for p in CITATIONS]
    return F.array_sort(F.array_distinct(F.array_compact(F.transform(F.concat(*marks), lambda x: x.try_cast("int")))))


def support_score(text: Column, sources: Column, hedges: tuple[str, ...]) -> Column:
    """1, less .3 without any citation, less .2 below half a citation for each source, less .2 with a hedge."""
    n = F.size(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)))
    coverage = F.when(sources > 0, n / sources).otherwise(0.0)
    hedged = F.lit(False)
    for h in hedges:
        hedged = hedged | F.contains(text, F.lit(h))
    return F.greatest(F.lit(0.0), F.lit(1.0) - F.when(n == 0, 0.3).otherwise(0.0) - F.when(coverage < 0.5, 0.2).otherwise(0.0) - F.when(hedged, 0.2).otherwise(0.0))


def preview(text: Column | str, n: int = 50) -> Column:
    t = _c(text)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)


def _two_places(x: Column) -> Column:
    """Two decimals as printf gives them: of the number's exact binary value, halves to the even digit. Java rounds halves up."""

    def of(x: Column) -> Column:
        size = F.abs(x)
        part = (size - F.floor(size)) * 2.0**52
        beyond = (part - F.floor(part)) * 100  # nothing but below 1
        hundredths = F.floor(part) * 100 + F.floor(beyond)
        down, rest = F.shiftright(hundredths, 52), hundredths.bitwiseAND((1 << 52) - 1)
        up = (rest > 1 << 51) | ((rest == 1 << 51) & ((beyond > F.floor(beyond)) | (down % 2 == 1)))
        c = F.floor(size) * 100 + down + up.cast("long")
        short = F.format_string("%s%d.%02d", F.when(x < 0, "-").otherwise(""), F.floor(c / 100), c % 100)
        return F.when(size < 2.0**43, short).otherwise(F.format_string("%.2f", x))

    return bind(x, of)


def human_size(n: Column | str) -> Column:
    b = _c(n).cast("double")
    out = F.concat(_two_places(b / 1024**4), F.lit(" TB"))
    for k, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(b < 1024.0 ** (k + 1), F.concat(_two_places(b / 1024.0**k), F.lit(f" {unit}"))).otherwise(out)
    return F.when(b.isNotNull(), out)


def is_email(x: Column | str) -> Column:
    return _c(x).rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$")


def is_url(x: Column | str) -> Column:
    return _c(x).rlike(r"^https?://[A-Za-z0-9.-]+(?::[0-9]+)?(?:/[^\s]*)?$")


def safe_file_name(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), r'[<>:"/\\|?*\x00-\x1f]', "_")


def is_uuid(x: Column | str) -> Column:
    return _c(x).rlike(r"^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")


def is_strong_password(x: Column | str, least: int = 8) -> Column:
    """Long enough, with a lower and an upper case letter and a digit."""
    t = _c(x)
    return (F.length(t) >= least) & t.rlike("[a-z]") & t.rlike("[A-Z]") & t.rlike("[0-9]")


def is_given(x: Column | str) -> Column:
    """Neither null nor blank."""
    return F.coalesce(F.trim(_c(x)) != "", F.lit(False))


def within(x: Column | str, low: float | None = None, high: float | None = None) -> Column:
    t = _c(x)
    return F.coalesce((t >= low if low is not None else F.lit(True)) & (t <= high if high is not None else F.lit(True)), F.lit(False))


def source_name(*names: Column, default: str = "Unknown") -> Column:
    """The first name that isn't blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(n), F.lit("")) for n in names), F.lit(default))


def with_source_names(text: Column, names: Column) -> Column:
    """Citation marks replaced by 【name】 of the source with their number, from 1; others stay.

    names: an array. A mark is found once: what a name holds isn't replaced again.
    """
    any_mark = "(" + "|".join(p.replace("(\\d+)", "\\d+") for p in CITATIONS) + ")"
    cut = F.split(F.regexp_replace(text, any_mark, "\u0000$1\u0000"), "\u0000")

    def named(x: Column) -> Column:
        n = F.regexp_extract(x, "^[^0-9]*([0-9]+)", 1).try_cast("int")
        known = x.rlike(f"^{any_mark}$") & n.between(1, F.size(names))
        return F.when(known, F.concat(F.lit("【"), F.get(names, n - 1), F.lit("】"))).otherwise(x)

    return F.array_join(F.transform(cut, named), "")


def json_in(text: Column | str) -> Column:
    """The JSON of an answer: what a fence holds, or else from the first brace to the last; null if that isn't JSON."""
    t = F.regexp_replace(_c(text), r"^\s+|\s+$", "")
    fenced = F.nullif(F.regexp_extract(t, r"(?s)^```[^\n]*\n(.*)\n[ \t]*```[^\n]*$", 1), F.lit(""))
    outer = F.nullif(F.regexp_extract(t, r"(?s)(\{.*\})", 1), F.lit(""))
    found = F.trim(F.coalesce(fenced, outer))
    return F.when(F.try_parse_json(found).isNotNull(), found)


def canonical_json(entries: Column) -> Column:
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


def extractive_summary(text: Column, chunks: Column, pages: Column | None = None, paragraphs: Column | None = None, tables: Column | None = None, most: int = 200) -> Column:
    """How much a file holds, in brackets, and its beginning; what isn't known isn't named."""
    counted = ((pages, " 页"), (paragraphs, " 段"), (tables, " 个表格"), (chunks, " 个文本块"))
    stats = F.concat_ws(", ", *(F.concat(n.cast("string"), F.lit(unit)) for n, unit in counted if n is not None))
    return F.concat(F.lit("["), stats, F.lit("] "), preview(text, most))


# The fields of a chunk that make up its source text. Names of files are no part of it.
SOURCE_FIELDS = ("title", "section_title", "section_path", "sheet_name", "structured_terms", "symbol_name", "node_name", "leaf_value", "column_headers", "slide_title", "source_region")


def source_text(fields: dict[str, Column]) -> Column:
    """The structural fields of a chunk that aren't empty, in their fixed order."""
    return F.concat_ws(" ", *(F.nullif(fields[c].cast("string"), F.lit("")) for c in SOURCE_FIELDS if c in fields))
