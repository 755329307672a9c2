"""Benchmark decontamination (operator 3): spaced-seed hashing, with DataFrame functions only.

A mask names the words of a short run that are hashed; the others may be anything. The hashes of all
runs of the benchmark items are joined with those of all runs of the documents. Each hit fixes an
alignment, and around it the words of the item are held against the document's: a document is
contaminated by an item if some window of WINDOW words of the item (all of it, if it is shorter) has
at least PERCENT of its words in place. The two masks together hit every such window of MIN_WORDS
words or more, wherever its substituted words stand (tried exhaustively in the tests). Shorter items
leave no room for a substitution: they are looked for word for word, by one mask for each of their
lengths that covers the whole item. Words are the runs of letters and digits, in lower case.

All documents are passed over once for the candidates, whatever the size of the benchmark. Seeds
that are few go to the documents. Of more seeds a bitmap of fixed size goes there instead, and only
runs that pass it are shuffled to the seeds. Texts with a hit are read again to verify it, each
split into words once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import materialise, read, sized

#: Offsets of the hashed words: 1 1 1 0 1 and 1 1 0 0 1 1.
MASKS = ((0, 1, 2, 4), (0, 1, 4, 5))
WINDOW = 13
PERCENT = 80
#: Items of fewer words are looked for word for word.
MIN_WORDS = 8
#: Seeds that go to the documents as they are, and 64-bit words of the bitmap beyond that.
FEW_SEEDS = 1_000_000
SLOTS = 1 << 20
#: Items that are verified beside one copy of a document.
GROUP = 64


def words(text: Column) -> Column:
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda w: w != "")


def _runs(df: DataFrame, keep: str, masks: Sequence[Sequence[int]]) -> DataFrame:
    """For each run of df's words that a mask covers: keep, its place at, and its hash seed.

    The words are hashed once; shifted copies of the array, side by side, give a row for each place
    with the words that the masks need, so that no row carries the text on.
    """
    offsets = sorted({o for mask in masks for o in mask})
    hashed = df.select(keep, F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("h"))
    shifted = F.arrays_zip(*(F.when(F.size("h") > o, F.slice("h", o + 1, F.size("h"))).otherwise(F.array().cast("array<bigint>")).alias(f"w{o}") for o in offsets))
    placed = hashed.where(F.size("h") > min(m[-1] for m in masks)).select(keep, F.posexplode(shifted).alias("at", "run"))
    run = {o: F.col("run").getField(f"w{o}") for o in offsets}
    keys = [F.when(run[mask[-1]].isNotNull(), F.xxhash64(F.lit(",".join(map(str, mask))), *(run[o] for o in mask))) for mask in masks]
    return placed.select(keep, "at", F.explode(F.array(*keys)).alias("seed")).where("seed is not null")


def _meeting(runs: DataFrame, seeds: DataFrame) -> DataFrame:
    """The runs whose seed the benchmark has, with its items."""
    near = sized(seeds, FEW_SEEDS)
    if near is seeds:
        slot = lambda seed: F.pmod(F.shiftrightunsigned(seed, 6), F.lit(SLOTS))
        bit = lambda seed: F.expr("shiftleft(1L, cast(seed & 63 as int))")
        bitmap = materialise(seeds.select(slot(F.col("seed")).alias("slot"), bit("seed").alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits")), "seed-bits")
        runs = runs.withColumn("slot", slot(F.col("seed"))).join(F.broadcast(bitmap), "slot").where(F.col("bits").bitwiseAND(bit("seed")) != 0).drop("slot", "bits")
    return runs.join(near, "seed")


def _best_window(item: Column, doc: Column, shift: Column) -> Column:
    """The most words in place in any window of the item, when item word i is held against doc word i + shift."""
    n = F.size(item)
    size = F.least(n, F.lit(WINDOW))
    same = F.transform(item, lambda x, i: F.when((i + shift >= 0) & (x == F.get(doc, i + shift)), 1).otherwise(0))
    most = lambda same: F.array_max(F.transform(F.sequence(F.lit(1), n - size + 1), lambda s: F.aggregate(F.slice(same, s, size), F.lit(0), lambda a, x: a + x)))
    return F.get(F.transform(F.array(same), most), 0)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, matched_words, window_words) for each document that holds an item.

    matched_words: the most words in place in a window. Null or empty texts hold nothing, on either
    side. Rows that repeat an id are reported as one; a null id is reported as null. No benchmark or
    no documents give no rows. Other columns are ignored.
    """
    items = materialise(benchmark.select("item_id", "text", words(F.col("text")).alias("item")).where(F.size("item") > 0), "items")
    short = sorted(r.n for r in items.where(F.size("item") < MIN_WORDS).select(F.size("item").alias("n")).distinct().collect())  # MIN_WORDS - 1 numbers at most
    whole = [tuple(range(n)) for n in short]
    masks = [*MASKS, *whole]
    seeds = _runs(items.where(F.size("item") >= MIN_WORDS), "item_id", MASKS)
    for n, mask in zip(short, whole, strict=True):
        seeds = seeds.union(_runs(items.where(F.size("item") == n), "item_id", [mask]))
    seeds = materialise(seeds.withColumnRenamed("at", "item_at").distinct(), "seeds")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    hits = _meeting(_runs(texts, "doc_id", masks), seeds).select("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    hits = materialise(hits.groupBy("doc_id", "item_id").agg(F.collect_list("shift").alias("shifts")), "hits")
    # A document that many items meet is dealt out in groups of them, each verified beside its text by itself.
    many = hits.groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > GROUP).select(F.col("doc_id").alias("many_id"), F.ceil(F.col("n") / GROUP).alias("groups"))
    hits = hits.join(sized(materialise(many, "many")), F.col("doc_id").eqNullSafe(F.col("many_id")), "left").withColumn("group", F.coalesce(F.pmod(F.xxhash64("item_id"), "groups"), F.lit(0)))
    hits = hits.join(sized(items.select("item_id", "item")), "item_id").groupBy("doc_id", "group").agg(F.collect_list(F.struct("item_id", "item", "shifts")).alias("hits"))
    hits = materialise(hits.withColumnRenamed("doc_id", "hit_id").drop("group"), "hits")
    found = texts.join(sized(hits), F.col("doc_id").eqNullSafe(F.col("hit_id")))
    verified = lambda doc: F.transform("hits", lambda h: F.struct(h["item_id"].alias("item_id"), F.least(F.size(h["item"]), F.lit(WINDOW)).alias("window_words"), F.array_max(F.transform(h["shifts"], lambda s: _best_window(h["item"], doc, s))).alias("matched_words")))
    found = found.select("doc_id", F.explode(F.get(F.transform(F.array(words(F.col("text"))), verified), 0)).alias("v")).select("doc_id", "v.*")
    enough = F.when(F.col("window_words") < MIN_WORDS, F.col("matched_words") == F.col("window_words")).otherwise(F.col("matched_words") * 100 >= F.col("window_words") * PERCENT)
    return found.where(enough).groupBy("doc_id", "item_id").agg(F.max("matched_words").alias("matched_words"), F.max("window_words").alias("window_words"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows of docs that hold no item of the benchmark, with all their columns.

    Rows are told apart by id and text. A null or empty text holds nothing and stays; a null id is an
    id like others; repeated rows go or stay together; an empty table, or no benchmark, drops nothing.
    """
    row = F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    found = contaminated(docs.select(row.alias("doc_id"), "text"), read(spark, sf_dir, "benchmark"))
    found = materialise(found.select("doc_id.*").distinct().toDF("contaminated_id", "contaminated_hash"), "contaminated")
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    same = F.col("id").eqNullSafe(F.col("contaminated_id")) & (F.col("hash") == F.col("contaminated_hash"))
    return whole.join(sized(found), same, "left_anti").select("row.*")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {"op3_decontamination": op3_decontamination}
ORACLE = {
    "op3_decontamination": r"""
        with d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as w from documents),
        i as (select item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as w from benchmark),
        k as (select item_id, w from i where len(w) >= 8),
        dw as (select doc_id, w, unnest(range(1, len(w) + 1)) as p from d),
        e as (select distinct doc_id, item_id, len(i.w)::int as n from i join dw on i.w[1] = dw.w[p] and dw.w[p : p + len(i.w) - 1] = i.w where len(i.w) between 1 and 7),
        dp as (select doc_id, w, unnest(range(1, len(w) - 3)) as p from d where len(w) > 4),
        ip as (select item_id, w, unnest(range(1, len(w) - 3)) as p from k),
        ds as (select doc_id, p, 'a' || ' ' || w[p] || ' ' || w[p+1] || ' ' || w[p+2] || ' ' || w[p+4] as s from dp
               union all select doc_id, p, 'b' || ' ' || w[p] || ' ' || w[p+1] || ' ' || w[p+4] || ' ' || w[p+5] from dp where p + 5 <= len(w)),
        s as (select item_id, p, 'a' || ' ' || w[p] || ' ' || w[p+1] || ' ' || w[p+2] || ' ' || w[p+4] as s from ip
               union all select item_id, p, 'b' || ' ' || w[p] || ' ' || w[p+1] || ' ' || w[p+4] || ' ' || w[p+5] from ip where p + 5 <= len(w)),
        h as (select distinct doc_id, item_id, ds.p - s.p as shift from ds join s using (s)),
        v as (select h.doc_id, h.item_id, least(len(k.w), 13) as n,
                     list_transform(range(1, len(k.w) + 1), lambda x: case when x + shift >= 1 and k.w[x] = d.w[x + shift] then 1 else 0 end) as m
              from h join k using (item_id) join d using (doc_id)),
        b as (select doc_id, item_id, n, list_max(list_transform(range(1, len(m) - n + 2), lambda x: list_sum(m[x : x + n - 1]))) as best from v)
        select doc_id, item_id, max(best)::int as matched_words, max(n)::int as window_words from b where best * 100 >= n * 80 group by doc_id, item_id
        union all select doc_id, item_id, n, n from e"""
}
