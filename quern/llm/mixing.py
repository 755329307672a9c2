"""Mixing sources to target weights (operator 4): hierarchical budgeting over domain, language, source.

A token budget is shared out down the tree in proportion to weights. A child can take no more than
its tokens times the allowed epochs; what one child can't take goes to its siblings first, and only
what all of them together can't take is missing on the level above, where it goes to the siblings of
the parent. Each leaf then takes whole epochs of its documents, and of one more epoch the prefix
that fits, in an order that is seeded for each epoch.

The prefix of a leaf isn't found by sorting the leaf: documents fall into ranges of their order key,
the ranges' token sums are added up, whole ranges are taken or left, and only the range in which the
budget ends is looked at document by document. A leaf of n documents has about sqrt(n) ranges, so
neither the ranges of a leaf nor the documents of a range are ever many.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import materialise, read, sized

LEVELS = ("domain", "language", "origin")
NONE = "(none)"


@dataclass(frozen=True)
class Mix:
    """domains: (name, pattern of the source), the first that matches counts; weights by level and name.

    A name without a weight weighs as the least named one of its level that isn't 0, and no more; on a
    level without weights all names weigh the same.
    """

    domains: Sequence[tuple[str, str]] = (("forum", "^src[0-4]$"), ("news", "^src[5-9]$"), ("books", "^src1[0-4]$"))
    other: str = "misc"
    weights: Mapping[str, Mapping[str, float]] = field(default_factory=lambda: {"domain": {"forum": 0.15, "news": 0.35, "books": 0.3, "misc": 0.2}, "language": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}})
    share: float = 0.6
    epochs: int = 4
    seed: int = 17


def _weight(level: str, mix: Mix) -> Column:
    given = mix.weights.get(level) or {}
    rest = F.lit(float(min((w for w in given.values() if w > 0), default=1.0)))
    if not given:
        return rest
    return F.coalesce(F.create_map(*(F.lit(x) for kv in given.items() for x in kv))[F.col(level)], rest)


def _tree(mix: Mix) -> list[Column]:
    source = F.coalesce(F.col("source"), F.lit(NONE))
    domain = F.lit(mix.other)
    for name, pattern in reversed(mix.domains):
        domain = F.when(source.rlike(pattern), name).otherwise(domain)
    return [domain.alias("domain"), F.coalesce(F.col("lang"), F.lit(NONE)).alias("language"), source.alias("origin")]


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _share_out(children: DataFrame, parent: list[str], level: str, mix: Mix) -> DataFrame:
    """Adds budget to children (with cap and total, their parent's budget): min(cap, weight x water level)."""
    w = _weight(level, mix)
    ratio = F.when(w > 0, F.col("cap") / w).otherwise(F.lit(0.0))
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy("ratio", level)
    ranked = children.withColumn("w", w).withColumn("ratio", ratio).withColumn("cap_", F.when(F.col("w") > 0, F.col("cap")).otherwise(F.lit(0.0)))
    ranked = ranked.withColumn("before", F.sum("cap_").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap_"))
    ranked = ranked.withColumn("rest", F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)))
    ranked = ranked.withColumn("water", F.when(F.col("rest") > 0, (F.col("total") - F.col("before")) / F.col("rest")))
    ranked = ranked.withColumn("level", F.max(F.when(F.col("ratio") > F.col("water"), F.col("water"))).over(by))
    return ranked.withColumn("budget", F.coalesce(F.least(F.col("cap_"), F.col("w") * F.col("level")), F.col("cap_"))).drop("w", "ratio", "cap_", "before", "rest", "water", "level")


def budgets(leaves: DataFrame, mix: Mix, total: int | None = None) -> DataFrame:
    """(domain, language, origin, tokens, budget) from (domain, language, origin, tokens).

    total: the budget in tokens; the mix's share of all tokens if not given. Only tokens that may be
    taken count as a node's room: those under a weight of zero, on any level, leave the budget to others.
    """
    if total is None:
        total = int((leaves.agg(F.sum("tokens")).first()[0] or 0) * mix.share)
    open_ = reduce(Column.__and__, (_weight(level, mix) > 0 for level in LEVELS))  # what a weight of zero closes has no room on any level
    leaves = leaves.withColumn("cap", F.when(open_, F.col("tokens") * F.lit(float(mix.epochs))).otherwise(F.lit(0.0)))
    got = None
    for depth, level in enumerate(LEVELS):
        keys = list(LEVELS[: depth + 1])
        children = leaves.groupBy(*keys).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
        if got is None:
            children = children.withColumn("total", F.lit(float(total)))
        else:
            children = children.join(got.select(*keys[:-1], F.col("budget").alias("total")), keys[:-1])
        got = _share_out(children, keys[:-1], level, mix)
    return got.select(*LEVELS, "tokens", F.floor(F.col("budget") + 1e-6).cast("long").alias("budget"))


def _order_key(epoch: Column, mix: Mix) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(mix.seed)), epoch.cast("string"), F.col("doc_id").cast("string")))


def _plan(docs: DataFrame, mix: Mix, total: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents without their texts, the leaves with their budgets, and the documents taken in the ranges in which budgets end."""
    rows = materialise(docs.select("doc_id", *_tree(mix), n_tokens(F.col("text")).alias("n_tokens")), "mix-rows")
    sizes = materialise(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.ceil(F.sqrt(F.count("*"))).alias("ranges")), "mix-leaves")
    leaves = budgets(sizes, mix, total).where("tokens > 0").join(sizes.select(*LEVELS, "ranges"), list(LEVELS))
    leaves = leaves.withColumn("full", F.floor(F.col("budget") / F.col("tokens"))).withColumn("part", F.col("budget") - F.col("full") * F.col("tokens"))
    leaves = materialise(leaves, "mix-budgets")
    placed = rows.join(sized(leaves.where("part > 0")), list(LEVELS)).withColumn("key", _order_key(F.col("full"), mix)).withColumn("range", _range(F.col("key"), F.col("ranges")))
    sums = placed.groupBy(*LEVELS, "range").agg(F.sum("n_tokens").alias("in_range"), F.first("part").alias("part"))
    upto = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("upto", F.sum("in_range").over(upto)).where("upto > part")
    ends = sums.groupBy(*LEVELS).agg(F.min_by(F.struct("range", (F.col("upto") - F.col("in_range")).alias("before")), "range").alias("end")).select(*LEVELS, F.col("end.range").alias("end_range"), F.col("end.before").alias("before"))
    ends = materialise(ends, "mix-ends")
    last = placed.join(sized(ends), list(LEVELS)).where("range = end_range").groupBy(*LEVELS, "doc_id", "key", "part", "before").agg(F.sum("n_tokens").alias("n"))
    running = Window.partitionBy(*LEVELS).orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    taken = last.withColumn("upto", F.col("before") + F.sum("n").over(running)).where("upto <= part").select(*LEVELS, F.col("doc_id").alias("taken_id"))
    leaves = leaves.join(sized(ends.select(*LEVELS, "end_range")), list(LEVELS), "left").select(*LEVELS, "full", "part", "end_range", "ranges")
    return rows, materialise(leaves, "mix-leaves"), materialise(taken, "mix-taken")


def _range(key: Column, ranges: Column) -> Column:
    """The place of a key among equal ranges of its first 32 bits."""
    number = F.conv(F.substring(key, 1, 8), 16, 10).cast("long")
    return F.shiftright(number * ranges, 32)


def _take(rows: DataFrame, leaves: DataFrame, taken: DataFrame, mix: Mix) -> DataFrame:
    """rows (with the levels) with a copy for each epoch in which it is taken: adds epoch."""
    found = rows.join(sized(leaves), list(LEVELS))
    place = _range(_order_key(F.col("full"), mix), F.col("ranges"))
    found = found.withColumn("place", F.when(F.col("part") > 0, place))
    same = [F.col(f"r.{c}") == F.col(f"t.{c}") for c in LEVELS]
    found = found.alias("r").join(sized(taken).alias("t"), same[0] & same[1] & same[2] & F.col("r.doc_id").eqNullSafe(F.col("t.taken_id")) & (F.col("r.place") == F.col("r.end_range")), "left").select("r.*", F.col("t.domain").isNotNull().alias("in_last"))
    more = (F.col("part") > 0) & (F.col("in_last") | F.coalesce(F.col("place") < F.col("end_range"), F.lit(False)))
    count = F.col("full") + F.when(more, 1).otherwise(0)
    return found.where(count > 0).withColumn("epoch", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))))


def mix_sources(docs: DataFrame, mix: Mix | None = None, total: int | None = None) -> DataFrame:
    """(doc_id, domain, language, origin, n_tokens, epoch), a row for each time a document is taken.

    Tokens are words between white space. A null or blank text has none; it is taken with the whole
    epochs of its leaf, and a leaf without any tokens isn't taken at all. A null language or source
    counts as "(none)". Rows that repeat an id within a leaf are taken or left together; ties of the
    order go by id. Null ids form one such group. An empty table gives no rows; other columns are
    ignored.
    """
    mix = mix or Mix()
    rows, leaves, taken = _plan(docs, mix, total)
    return _take(rows, leaves, taken, mix).select("doc_id", *LEVELS, "n_tokens", F.col("epoch").cast("long").alias("epoch"))


def mix_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents, each as often as it is taken, with its columns and its epoch.

    The texts aren't shuffled: what is taken is decided row by row from the leaves' budgets. Nulls,
    repeated rows, ties and an empty table are as in mix_sources; other columns are kept.
    """
    mix = Mix()
    _, leaves, taken = _plan(docs, mix, None)
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id"), *_tree(mix))
    return _take(whole, leaves, taken, mix).select("row.*", F.col("domain").alias("mix_domain"), F.col("epoch").cast("long").alias("mix_epoch"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents"))


def _level_sql(name: str, below: str, keys: list[str], weight: str) -> str:
    parent = ", ".join(keys[:-1])
    part = f"partition by {parent}" if parent else ""
    total = f"join {below} using ({parent})" if parent else f"cross join {below}"
    k = keys[-1]
    return f"""
        {name}_c as (select {", ".join(keys)}, sum(tokens) * 4.0::double as cap, {weight} as w from leaf group by all),
        {name}_o as (select c.*, {below}.budget as total, sum(cap) over (wo rows between unbounded preceding and current row) - cap as before,
            sum(w) over (wo rows between current row and unbounded following) as rest from {name}_c c {total} window wo as ({part} order by cap / w, {k})),
        {name}_w as (select *, (total - before) / rest as water from {name}_o),
        {name} as (select {", ".join(keys)}, least(cap, w * coalesce(max(case when cap / w > water then water end) over ({part}), 1e300)) as budget from {name}_w)"""


QUERIES = {"op4_mixing": op4_mixing}
ORACLE = {
    "op4_mixing": rf"""
        with rw as (select doc_id, case when regexp_matches(coalesce(source, '(none)'), '^src[0-4]$') then 'forum' when regexp_matches(coalesce(source, '(none)'), '^src[5-9]$') then 'news'
                when regexp_matches(coalesce(source, '(none)'), '^src1[0-4]$') then 'books' else 'misc' end as domain, coalesce(lang, '(none)') as language, coalesce(source, '(none)') as origin,
                len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as n_tokens from documents),
        leaf as (select domain, language, origin, sum(n_tokens)::double as tokens from rw group by all),
        top as (select floor(sum(tokens) * 0.6) as budget from leaf),
        {_level_sql("l1", "top", ["domain"], "case domain when 'forum' then 0.15::double when 'news' then 0.35::double when 'books' then 0.3::double when 'misc' then 0.2::double else 0.15::double end")},
        {_level_sql("l2", "l1", ["domain", "language"], "case language when 'en' then 0.4::double when 'de' then 0.2::double when 'fr' then 0.2::double when 'es' then 0.2::double else 0.2::double end")},
        {_level_sql("l3", "l2", ["domain", "language", "origin"], "1::double")},
        b as (select *, floor(floor(budget + 1e-6) / tokens)::bigint as full_, floor(budget + 1e-6) - floor(floor(budget + 1e-6) / tokens) * tokens as part from l3 join leaf using (domain, language, origin) where tokens > 0),
        o as (select rw.*, full_, part, sum(n_tokens) over (partition by domain, language, origin order by md5('17:' || full_ || ':' || doc_id), doc_id rows between unbounded preceding and current row) as upto
              from rw join b using (domain, language, origin)),
        t as (select *, full_ + case when part > 0 and upto <= part then 1 else 0 end as times from o)
        select doc_id, domain, language, origin, n_tokens, unnest(range(times)) as epoch from t"""
}
