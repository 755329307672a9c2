r"""Personal data (operator 1): bootstrapped contextual extraction, with DataFrame functions only.

Seeds are the entities that four fixed patterns find in the texts (email, ip, card, phone). The words
in front of an entity are its lexical patterns. Entities and look-alikes (numbers and addresses that
the fixed patterns don't accept) form a graph of patterns and values. Spark scores it in rounds: a
pattern is as sure of a kind as the share of its distinct values that are known to be of that kind;
a look-alike is as sure as its patterns together. Sure look-alikes count as known in the next round,
and all their occurrences become spans. A text's own spans never leave it; base spans always stay.

Identifiers that stand next to each other make one run of digits and separators. Such a run is cut
at base spans and at blanks, and each of its parts with the shape of a kind is a look-alike. A part
that is a base entity elsewhere, or that a base expression accepts by itself, is known from the start.

Places are found without a loop over characters: the texts between the matches and the matches
themselves come from the same expression, and their lengths add up to the places. The expressions
are written so that the engine never tries a run of characters twice (possessive repeats, starts at
the begin of a run), which changes nothing about the matches. Parts of a text are taken from chunks
of it and sums are made in blocks, so that the work grows with the text and its matches and not
with their product.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import materialise, read, sized

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
#: A pattern counts from so many distinct known values of a kind, and from such a share of all its values.
MIN_SUPPORT = 3
MIN_CONFIDENCE = 0.6
#: A look-alike is taken for an entity from this score on.
MIN_SCORE = 0.7
#: The two context words of a value begin within so many characters before it.
REACH = 64
#: Elements in a block of sums, and the binary logarithm of the characters in a chunk of a text.
BLOCK = 256
CHUNK_BITS = 10

#: The base expressions, in a form that is equal to those of the contract and linear in the text.
_LOCAL = "[A-Za-z0-9._%+-]"
_BASE = {
    "email": rf"((?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++)",
    "ip": r"((?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++)",
    "card": r"([0-9]++(?:[\x20-][0-9]++)*+)",
    "phone": r"(\+[0-9][\x20().0-9-]+[0-9])",
}
#: Cheap tests that a text passes if it can hold the kind.
_MAY = {"email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"), "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), "phone": lambda t: t.contains("+")}
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
_DIGITS = lambda v: F.regexp_replace(v, "[^0-9]", "")
_VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: v.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
    "card": lambda v: F.length(_DIGITS(v)).between(14, 19) & F.call_function("luhn_check", _DIGITS(v)),
    "phone": lambda v: F.length(_DIGITS(v)).between(10, 15),
}
#: A look-alike has so many digits at most; parts of a run have no more.
MOST_DIGITS = 19
#: Pieces of a run between its blanks.
_PIECE = r"(\+?\(?[0-9](?:[().-]{0,2}[0-9])*+)"
#: Kinds of look-alikes; a shorter part from the same place isn't a further value of the patterns there.
LIKE, SHORTER = -1, -2
#: Look-alikes: runs of digits with separators, and anything round an @.
_LIKE = {"number": r"((?<![\p{L}0-9])\+?\(?[0-9](?:[\x20().-]{0,2}[0-9])*+)", "address": r"""((?<![^\s@<>"'(),;:])[^\s@<>"'(),;:]++@[^\s@<>"'(),;:]++)"""}
_LIKE_MAY = {"number": lambda t: t.rlike(r"[0-9](?:[\x20().-]{0,2}[0-9]){6}"), "address": lambda t: t.contains("@")}
#: Whether a look-alike has the shape of a kind.
_SHAPE = {
    "email": lambda v: v.contains("@"),
    "ip": lambda v: v.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"),
    "card": lambda v: v.rlike(r"^[0-9][0-9\x20-]+$") & F.length(_DIGITS(v)).between(12, 19),
    "phone": lambda v: v.rlike(r"^[+(]?[0-9][0-9\x20().-]+$") & F.length(_DIGITS(v)).between(7, 15) & ~v.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"),
}
_SPAN = "array<struct<start:int,end:int,kind:int,value:string>>"
_SEEN = "array<struct<start:int,end:int,kind:int,value:string,context:array<string>>>"


def _bind(x: Column, of) -> Column:
    """of(x), with x computed once however often it is used."""
    return F.get(F.transform(F.array(x), of), 0)


def _scan(numbers: Column, op) -> Column:
    """For each number what op makes of 0 and all numbers before it."""

    def running(block: Column, start: Column) -> Column:
        step = lambda acc, x: F.struct(op(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))
        return F.aggregate(block, F.struct(start.alias("at"), F.array().cast("array<int>").alias("out")), step, lambda acc: acc["out"])

    def joined(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), op))
        return F.flatten(F.zip_with(blocks, _bind(totals, lambda t: running(t, F.lit(0))), running))

    def cut(xs: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int")), lambda b: F.slice(xs, b * BLOCK + 1, F.lit(BLOCK)))
        return F.when(F.size(xs) > 0, _bind(blocks, joined)).otherwise(F.array().cast("array<int>"))

    return _bind(numbers, cut)


def _chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << CHUNK_BITS}}}"), F.lit(0))


def _cut(chunks: Column, start: Column, end: Column) -> Column:
    """The characters from start to end of the text that the chunks make up."""
    first = F.shiftright(start, CHUNK_BITS)
    parts = F.slice(chunks, first + 1, F.shiftright(end - 1, CHUNK_BITS) - first + 1)
    return F.when(end > start, F.substring(F.array_join(parts, ""), start - F.shiftleft(first, CHUNK_BITS) + 1, end - start)).otherwise("")


def _find(text: Column, expression: str, valid, kind: int) -> Column:
    """The valid matches with their places in code points."""
    found = F.regexp_extract_all(text, F.lit(expression), F.lit(0))
    between = _bind(F.split(text, expression), lambda g: F.slice(g, F.lit(1), F.size(g) - 1))
    pairs = F.zip_with(found, between, lambda v, g: F.struct(v.alias("value"), F.length(v).alias("size"), F.length(g).alias("gap")))

    def placed(pairs: Column) -> Column:
        before = _scan(F.transform(pairs, lambda p: p["gap"] + p["size"]), lambda a, x: a + x)
        span = lambda p, at: F.struct((at + p["gap"]).alias("start"), (at + p["gap"] + p["size"]).alias("end"), F.lit(kind).alias("kind"), p["value"].alias("value"))
        return F.zip_with(pairs, before, span)

    return F.filter(_bind(pairs, placed), lambda s: valid(s["value"]))


def _none() -> Column:
    return F.array().cast(_SPAN)


def base_spans(text: Column) -> Column:
    """All base spans of a text, by start and then kind."""
    kinds = [F.when(_MAY[k](text), _find(text, _BASE[k], _VALID[k], i)).otherwise(_none()) for i, k in enumerate(KINDS)]
    return F.array_sort(F.concat(*kinds), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"]))


def _replaced(text: Column, spans: Column, by) -> Column:
    """The text with by(span, end of the spans before it) in place of each span; spans come by start and may overlap."""

    def over(spans: Column) -> Column:
        ends = F.transform(spans, lambda s: s["end"])
        piece = lambda chunks: lambda s, at: F.concat(_cut(chunks, at, F.greatest(at, s["start"])), by(s, at))
        whole = lambda chunks: F.concat(F.array_join(F.zip_with(spans, _scan(ends, lambda a, x: F.greatest(a, x)), piece(chunks)), ""), _cut(chunks, F.array_max(ends), F.length(text)))
        return F.when(F.size(spans) == 0, text).otherwise(_bind(_chunks(text), whole))

    return _bind(spans, over)


def _masked(text: Column, spans: Column) -> Column:
    """The text with blanks for its spans; each is longer than the two separators that a run may have in a row."""
    return _replaced(text, spans, lambda s, at: F.repeat(F.lit(" "), F.greatest(F.lit(0), s["end"] - F.greatest(at, s["start"]))))


def _shaped(value: Column) -> Column:
    return reduce(Column.__or__, (f(value) for f in _SHAPE.values()))


def _parts(run: Column, whole: Column, chunks: Column) -> Column:
    """The parts of a run with a kind's shape, from piece to piece; without those to its end if it isn't whole.

    chunks: of the text that the run is from.
    """
    pieces = F.transform(_find(run["value"], _PIECE, lambda v: F.lit(True), LIKE), lambda x: F.struct((run["start"] + x["start"]).alias("start"), (run["start"] + x["end"]).alias("end")))

    def of(pieces: Column) -> Column:
        def from_piece(first: Column, i: Column) -> Column:
            upto = F.slice(pieces, i + 1, F.lit(MOST_DIGITS))  # every piece has a digit
            spans = F.transform(upto, lambda x: F.struct(first["start"].alias("start"), x["end"].alias("end"), F.lit(LIKE).alias("kind"), _cut(chunks, first["start"], x["end"]).alias("value")))
            shaped = F.filter(spans, lambda x: ((x["end"] < run["end"]) | whole) & _shaped(x["value"]))

            def ranked(spans: Column) -> Column:
                longest = F.array_max(F.transform(spans, lambda x: x["end"]))
                return _bind(longest, lambda most: F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.when(x["end"] == most, LIKE).otherwise(SHORTER).alias("kind"), x["value"].alias("value"))))

            return _bind(shaped, ranked)

        return F.flatten(F.transform(pieces, from_piece))

    return _bind(pieces, of)


def _look_alikes(text: Column, masked: Column) -> Column:
    """Spans of look-alikes that touch no base span and no letter behind; kind is LIKE or SHORTER.

    masked: the text with blanks for its base spans.
    """

    def over(masked: Column) -> Column:
        def cut(both: Column) -> Column:
            chunks, hidden = F.get(both, 0), F.get(both, 1)
            whole = lambda s: ~_cut(chunks, s["end"], s["end"] + 1).rlike(r"[\p{L}0-9]")
            runs = _find(masked, _LIKE["number"], lambda v: F.length(_DIGITS(v)) >= 7, LIKE)
            numbers = F.flatten(F.transform(runs, lambda s: F.when(s["value"].contains(" "), _parts(s, whole(s), hidden)).when(whole(s) & _shaped(s["value"]), F.array(s)).otherwise(_none())))
            addresses = F.filter(_find(masked, _LIKE["address"], _shaped, LIKE), whole)
            return F.concat(*(F.when(_LIKE_MAY[k](masked), x).otherwise(_none()) for k, x in (("number", numbers), ("address", addresses))))

        return _bind(F.array(_chunks(text), _chunks(masked)), cut)

    return F.when(reduce(Column.__or__, (may(text) for may in _LIKE_MAY.values())), _bind(masked, over)).otherwise(_none())


def _context(chunks: Column, start: Column) -> Column:
    """The two words in front of a place, in lower case, digits as 0."""
    before = _cut(chunks, F.greatest(F.lit(0), start - REACH - 1), start)
    before = F.when(start > REACH, F.regexp_replace(before, r"^\S+", "")).otherwise(before)  # no part of a word
    tokens = F.filter(F.split(F.regexp_replace(F.lower(before), "[0-9]", "0"), r"[\s]+"), lambda w: w != "")
    return _bind(tokens, lambda t: F.slice(t, F.greatest(F.lit(1), F.size(t) - 1), F.lit(2)))


def _coded(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _given(seen: DataFrame) -> DataFrame:
    """(value, kind, score) of look-alikes that are base entities elsewhere, or cut from a run and valid by themselves."""
    values = seen.groupBy(F.lower("value").alias("value")).agg(F.max("kind").alias("kind"), F.min("kind").alias("least")).where("least < 0")
    v = F.col("value")
    card = v.rlike("^[0-9]+(?:-[0-9]+)*$") & _VALID["card"](v)
    phone = v.rlike(rf"^{_BASE['phone']}$") & _VALID["phone"](v)
    kind = F.when(F.col("kind") >= 0, F.col("kind")).when(card, KINDS.index("card")).when(phone, KINDS.index("phone"))
    return materialise(values.select("value", kind.alias("kind"), F.lit(1.0).alias("score")).where("kind is not null"), "pii-given")


def _discover(seen: DataFrame) -> DataFrame | None:
    """(value, kind) of look-alikes that are known or that patterns are sure of; None if there are none.

    seen: (key, start, end, kind, value, context) of base spans and look-alikes.
    """
    n = F.size("context")
    patterns = F.array_distinct(F.array(F.array_join("context", " "), F.when(n > 0, F.get("context", n - 1))))
    edges = seen.select(F.explode(patterns).alias("pattern"), F.lower("value").alias("value"), "kind").where("pattern <> ''")
    edges = materialise(edges.groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "pii-edges")
    found = given = _given(seen)
    for _ in range(ROUNDS):
        new = found.select("value", F.col("kind").alias("new_kind"), F.col("score").alias("new_score"))
        known = edges.join(sized(new), "value", "left").select("pattern", "value", F.col("kind").alias("own"), F.when(F.col("kind") >= 0, F.col("kind")).otherwise(F.coalesce("new_kind", F.lit(LIKE))).alias("kind"), F.when(F.col("kind") >= 0, 1.0).otherwise(F.col("new_score")).alias("score"))
        sums = [F.sum(F.when(F.col("kind") == i, F.col("score")).otherwise(0.0)).alias(k) for i, k in enumerate(KINDS)]
        shares = known.groupBy("pattern").agg(F.count_if((F.col("own") != SHORTER) | F.col("score").isNotNull()).alias("n"), *sums)
        sure = shares.select("pattern", F.explode(F.array(*(F.struct(F.lit(i).alias("kind"), F.col(k).alias("support"), F.try_divide(F.col(k), F.col("n")).alias("share")) for i, k in enumerate(KINDS)))).alias("s"))
        sure = sure.where((F.col("s.support") >= MIN_SUPPORT) & (F.col("s.share") >= MIN_CONFIDENCE)).select("pattern", F.col("s.kind").alias("of"), F.least(F.col("s.share"), F.lit(0.99)).alias("share"))
        sure = materialise(sure, "pii-patterns")
        if not sure.limit(1).count():
            break
        shape = reduce(Column.__or__, ((F.col("of") == i) & _SHAPE[k](F.col("value")) for i, k in enumerate(KINDS)))
        scored = edges.where("kind < 0").join(sized(sure), "pattern").where(shape).groupBy("value", "of").agg((1 - F.exp(F.sum(F.log(1 - F.col("share"))))).alias("score"))
        scored = scored.where(F.col("score") >= MIN_SCORE).groupBy("value").agg(F.max_by(F.struct(F.col("of").alias("kind"), "score"), F.struct("score", -F.col("of"))).alias("b")).select("value", "b.kind", "b.score")
        found = materialise(scored.join(sized(given.select("value")), "value", "left_anti").unionByName(given), "pii-found")
    return found if found.limit(1).count() else None


def find_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, base, spans) for every row of docs: arrays of (start, end, kind, value).

    kind is the place in KINDS. Spans holds the base spans and the discovered ones, by start and then
    kind. key is a hash of id and text, for joining with the rows again. A null text has no spans. A
    null id is kept, repeated rows each give a row, an empty table gives none, other columns are
    ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text).alias("key"), text.alias("text"))
    rows = rows.select("doc_id", "key", F.when(F.col("text").rlike("[0-9@]"), F.col("text")).otherwise("").alias("text"))
    based = rows.select("doc_id", "key", "text", F.when(F.col("text") != "", base_spans(F.col("text"))).otherwise(_none()).alias("base"))
    both = based.select("*", F.when(F.col("text") != "", _look_alikes(F.col("text"), _masked(F.col("text"), F.col("base")))).otherwise(_none()).alias("likes"))
    with_context = lambda chunks: F.transform(F.concat("base", "likes"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value"), _context(chunks, s["start"]).alias("context")))
    some = (F.size("base") > 0) | (F.size("likes") > 0)
    with_context = F.when(some, _bind(_chunks(F.col("text")), with_context)).otherwise(F.array().cast(_SEEN))
    table = materialise(both.select("doc_id", "key", "base", with_context.alias("seen")), "pii-spans")
    seen = table.where(F.size("seen") > 0).select("doc_id", "key", F.explode("seen").alias("s")).select("doc_id", "key", "s.*")
    found = _discover(seen)
    if found is None:
        return table.select("doc_id", "key", "base", F.col("base").alias("spans"))
    named = found.select(F.col("value").alias("found_value"), F.col("kind").alias("of"))
    added = seen.where("kind < 0").join(sized(named), F.lower("value") == F.col("found_value"))
    added = added.select("doc_id", "key", "start", "end", F.col("of").alias("kind"), "value").distinct()
    before = Window.partitionBy("doc_id", "key").orderBy("start", F.desc("end"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    added = added.withColumn("reached", F.max("end").over(before)).where("reached is null or end > reached")  # without spans within another one
    added = added.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "end", "kind", "value")).alias("more"))
    added = materialise(added.select(F.col("doc_id").alias("id"), F.col("key").alias("of_key"), "more"), "pii-added")
    joined = table.join(sized(added), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("of_key")), "left")
    every = F.array_sort(F.concat("base", F.coalesce("more", _none())), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["kind"] - b["kind"]))
    return joined.select("doc_id", "key", "base", every.alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with each span, or run of spans that overlap, replaced by its first kind: <EMAIL>."""
    names = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))
    return _replaced(text, spans, lambda s, at: F.when(s["start"] >= at, F.get(names, s["kind"])).otherwise(""))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every row of docs, with the spans in its text replaced; n_chars follows.

    Null and empty texts stay as they are, null ids and repeated rows are kept, an empty table stays
    empty, other columns are kept.
    """
    spans = find_spans(docs).where(F.size("spans") > 0).select(F.col("key").alias("of_key"), F.col("doc_id").alias("of_id"), "spans").dropDuplicates(["of_key", "of_id"])
    spans = materialise(spans, "pii-redact")
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("key"))
    joined = packed.join(sized(spans), (F.col("key") == F.col("of_key")) & F.col("row.doc_id").eqNullSafe(F.col("of_id")), "left")
    text = F.when(F.col("spans").isNotNull(), redact(F.col("row.text"), F.col("spans"))).otherwise(F.col("row.text"))
    out = joined.select("row", text.alias("new"), F.col("spans").isNotNull().alias("changed"))
    kept = {c: F.col(f"row.`{c}`") for c in docs.columns} | {"text": F.col("new")}
    if "n_chars" in kept:
        kept["n_chars"] = F.when(F.col("changed"), F.length("new")).otherwise(kept["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return out.select(*(kept[c].alias(c) for c in docs.columns))


def op1_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = find_spans(read(spark, sf_dir, "documents"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return d.select("doc_id", *counts, F.sha2(_coded(F.col("base")), 256).alias("base_sha256"), _coded(F.col("spans")).alias("spans"))


QUERIES = {"op1_personal_data": op1_personal_data}
#: SQL can't express the bootstrapping; the tests hold all spans against plain loops, and the base columns against SQL.
ORACLE: dict[str, str] = {}
#: The base columns.
BASE_SQL = r"""
        with t as (select doc_id, coalesce(text, '') as t from documents),
        m as (select doc_id, 0 as kind, regexp_extract_all(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') as m, string_split_regex(t, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') as g from t
            union all select doc_id, 1, regexp_extract_all(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), string_split_regex(t, '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') from t
            union all select doc_id, 2, regexp_extract_all(t, '[0-9]([\x20-]?[0-9])+'), string_split_regex(t, '[0-9]([\x20-]?[0-9])+') from t
            union all select doc_id, 3, regexp_extract_all(t, '\+[0-9][\x20().0-9-]+[0-9]'), string_split_regex(t, '\+[0-9][\x20().0-9-]+[0-9]') from t),
        u as (select doc_id, kind, m, g, unnest(range(1, len(m) + 1)) as i from m),
        s as (select doc_id, kind, m[i] as v, regexp_replace(m[i], '[^0-9]', '', 'g') as d,
                     list_sum(list_transform(g[1:i], lambda x: length(x)))::bigint + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x)))::bigint, 0) as s0 from u),
        ok as (select doc_id, kind, s0, s0 + length(v) as s1 from s where kind = 0
               or kind = 1 and list_max(list_transform(string_split(v, '.'), lambda x: case when length(ltrim(x, '0')) > 3 then 999 else x::bigint end)) <= 255
               or kind = 3 and length(d) between 10 and 15
               or kind = 2 and length(d) between 14 and 19 and list_sum(list_transform(range(1, length(d) + 1), lambda k:
                    case when k % 2 = 1 then d[length(d) + 1 - k]::int else (d[length(d) + 1 - k]::int * 2) % 10 + (d[length(d) + 1 - k]::int * 2) // 10 end)) % 10 = 0),
        a as (select doc_id, count(*) filter (kind = 0) as n_email, count(*) filter (kind = 1) as n_ip, count(*) filter (kind = 2) as n_card, count(*) filter (kind = 3) as n_phone,
                     string_agg(['email', 'ip', 'card', 'phone'][kind + 1] || ':' || s0 || ':' || s1, ',' order by s0, kind) as spans from ok group by doc_id)
        select doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone,
               sha256(coalesce(spans, '')) as base_sha256
        from documents left join a using (doc_id)"""
