"""Filter interaction audit (operator 13): what each filter removes under every order of the filters.

A document is known by the set of filters that it fails, a mask of five bits, so a part of the corpus
is 32 cells at most, whatever its size. Each cell is folded across the array of all 120 orders with
transform and aggregate: 600 structs (order x step), weighed with the cell's counts; cells merge by
adding their structs element by element. All of it is DataFrame functions.
"""

from __future__ import annotations

import itertools
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import materialise, read

#: Filters by their letters; bit k of a mask tells that the k-th one fails.
LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(LETTERS)]
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
BLANKS = r"[\x20\x09-\x0D]+"


def failing(text: Column) -> Column:
    """The bits of A to D, which depend on the text alone."""
    words = F.array_remove(F.split(text, BLANKS), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    tests = (n < 100, distinct * 100 < n * 80, capitals * 100 > F.length(text) * 10, text.rlike("[#$%&*|]"))
    return reduce(lambda a, b: a + b, (F.when(t, 1 << k).otherwise(0) for k, t in enumerate(tests)))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: at most 32 rows for each part.

    Texts leave the scan as a digest and a mask. Rows are added up by document first and then by
    text, so a text of any number of copies reaches the last step as a few rows for each task.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), failing(text).alias("mask"))
    marks = labels.groupBy("doc_id").agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    rows = rows.join(marks, "doc_id", "left").na.fill(False, ["good", "toxic"])
    by_id = rows.groupBy("doc_id", "digest", "part", "mask", "good", "toxic").agg(F.count("*").alias("n"))
    kind = ("digest", "part", "mask", "good", "toxic")
    # Of the rows of a kind those with its least id; rows without an id come after all and have no smaller one.
    by_text = by_id.groupBy(*kind).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("lo"), F.coalesce(F.min_by("n", "doc_id"), F.lit(0)).alias("n_lo"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("n_null")
    )
    by_text = materialise(by_text, "audit-texts")
    firsts = by_text.groupBy("digest").agg(F.min("lo").alias("first"))
    first = F.col("n_null") + F.when(F.col("lo") == F.col("first"), F.col("n_lo")).otherwise(0)
    split = by_text.join(firsts, "digest").select("part", "mask", "good", "toxic", first.alias("first"), (F.col("n") - first).alias("later"))
    both = split.select("part", "good", "toxic", F.explode(F.array(F.struct("mask", F.col("first").alias("n")), F.struct((F.col("mask") + 16).alias("mask"), F.col("later").alias("n")))).alias("c"))
    n = F.col("c.n")
    return both.groupBy("part", F.col("c.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"))


def _fold(order: Column) -> Column:
    """The five structs of a cell under one order: a fold over its filters that knows whether the cell is still there."""
    zero = F.lit(0).cast("long")

    def step(acc: Column, bit: Column) -> Column:
        fails = F.col("mask").bitwiseAND(bit) != 0
        here, gone = acc["there"] & fails, ~acc["there"] & fails
        there = acc["there"] & ~fails
        alone = F.col("mask") == bit
        one = F.struct(
            F.when(there, F.col("n")).otherwise(zero).alias("kept"), F.when(here, F.col("n")).otherwise(zero).alias("removed"), F.when(gone, F.col("n")).otherwise(zero).alias("redundant"),
            F.when(alone, F.col("n")).otherwise(zero).alias("unique_fails"), F.when(here, F.col("good")).otherwise(zero).alias("good_lost"), F.when(here, F.col("toxic")).otherwise(zero).alias("toxic_lost"),
        )
        return F.struct(there.alias("there"), F.concat(acc["steps"], F.array(one)).alias("steps"))

    empty = f"array<struct<{','.join(f'{c}:bigint' for c in COUNTS)}>>"
    return F.aggregate(order, F.struct(F.lit(True).alias("there"), F.array().cast(empty).alias("steps")), step, lambda acc: acc["steps"])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, the six counts and shapley for every part of docs (doc_id, text, lang).

    Filters: A fewer than 100 words, B fewer than 80 distinct words in 100, C more than 10 capitals
    A-Z in 100 code points, D any of #$%&*|, E a text that a smaller doc_id has too. A null text is an
    empty one, a null lang the part ''. Rows that repeat an id and its text count once each, and none
    of them is the smaller; rows without an id neither have nor are smaller ones. A document is good or
    toxic if any of its labels says so; labels without an id or of unknown documents don't count. An
    empty table gives no rows; other columns are ignored.
    """
    # A literal of the plan: Spark broadcasts it to the executors with the code of the tasks.
    orders = F.from_json(F.lit(json.dumps([[1 << LETTERS.index(x) for x in o] for o in ORDERS])), "array<array<int>>")
    folded = cells(docs, labels).select("part", F.flatten(F.transform(orders, _fold)).alias("steps"))
    merged = F.reduce(F.slice("all", 2, F.size("all")), F.col("all")[0], lambda acc, x: F.zip_with(acc, x, lambda a, b: F.struct(*((a[c] + b[c]).alias(c) for c in COUNTS))))
    parts = folded.groupBy("part").agg(F.collect_list("steps").alias("all")).select("part", merged.alias("steps"))  # at most 32 cells
    rows = parts.select("part", F.posexplode("steps").alias("at", "s"))
    rows = rows.select("part", F.split(F.lit(",".join(ORDERS)), ",")[F.floor(F.col("at") / 5).cast("int")].alias("filter_order"), (F.col("at") % 5 + 1).alias("step"), "s.*")
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    shares = rows.groupBy("part", letter.alias("letter")).agg(F.sum("removed").alias("shapley"))
    return rows.withColumn("letter", letter).join(shares, ["part", "letter"]).select("part", "filter_order", "step", *COUNTS, "shapley")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {"op13_filter_audit": op13_filter_audit}
ORACLE = {
    "op13_filter_audit": r"""
        with d as (
            select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text,
                   list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
            from documents),
        l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
        f as (
            select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
                   len(w) < 100 as a, 100 * len(list_distinct(w)) < 80 * len(w) as b,
                   100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) as c,
                   regexp_matches(text, '[#$%&*|]') as d,
                   coalesce(doc_id > min(doc_id) over (partition by text), false) as e
            from d left join l using (doc_id)),
        c as (select part, a::int + 2 * b::int + 4 * c::int + 8 * d::int + 16 * e::int as mask, count(*) as n,
                     count(*) filter (good) as good, count(*) filter (toxic) as toxic from f group by all),
        x as (select unnest([0, 1, 2, 3, 4]) as i),
        o as (
            select p.i as p1, q.i as p2, r.i as p3, s.i as p4, t.i as p5
            from x p, x q, x r, x s, x t where len(list_distinct([p.i, q.i, r.i, s.i, t.i])) = 5),
        g as (
            select list_transform([p1, p2, p3, p4, p5], lambda i: substr('ABCDE', i + 1, 1)).array_to_string('') as filter_order,
                   unnest([1, 2, 3, 4, 5]) as step, unnest([p1, p2, p3, p4, p5]) as i,
                   unnest([0, 1 << p1, (1 << p1) + (1 << p2), (1 << p1) + (1 << p2) + (1 << p3), (1 << p1) + (1 << p2) + (1 << p3) + (1 << p4)]) as before
            from o),
        s as (
            select part, filter_order, step, i,
                   coalesce(sum(n) filter (mask & before = 0 and mask & (1 << i) = 0), 0)::bigint as kept,
                   coalesce(sum(n) filter (mask & before = 0 and mask & (1 << i) <> 0), 0)::bigint as removed,
                   coalesce(sum(n) filter (mask & before <> 0 and mask & (1 << i) <> 0), 0)::bigint as redundant,
                   coalesce(sum(n) filter (mask = 1 << i), 0)::bigint as unique_fails,
                   coalesce(sum(good) filter (mask & before = 0 and mask & (1 << i) <> 0), 0)::bigint as good_lost,
                   coalesce(sum(toxic) filter (mask & before = 0 and mask & (1 << i) <> 0), 0)::bigint as toxic_lost
            from c, g group by all)
        select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               (sum(removed) over (partition by part, i))::bigint as shapley
        from s"""
}
