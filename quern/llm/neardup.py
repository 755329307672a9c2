"""MinHash near-duplicates (operator 10): banded candidates checked by odd sketches, then on full sets.

1. Every text becomes a set of word shingles, MinHash samples of it, band keys, and an odd sketch:
   each sample flips one bit of a bitmap, so the population count of the XOR of two bitmaps tells how
   many samples differ, most precisely where few do.
2. Texts with the same set are one class; only the class's smallest id goes on.
3. Band keys that several classes share are buckets. In each bucket the others are compared with the
   smallest, which makes as many pairs as the bucket has rows. Components of the links found so far
   settle almost all buckets.
4. Documents of buckets that still hold more than one component are compared across components.
   Two similar sets share a shingle among the rarest of each (prefix filtering, which misses
   nothing), so a text that differs from its bucket by words of its own is in no pair, however
   large the bucket. Pairs within a component are never made, and of a shingle's documents those
   outside its largest component are held against the others.
5. All pairs first pass the odd sketches, then the intersection and union of the full sets.

The bands miss a pair that is exactly as similar as the threshold with a chance below 1e-5.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import arrow_map, materialise, read, sized
from quern.llm.graph import components
from quern.llm.shingles import mix, shingles, similar

SAMPLES = 256
MISS = 1e-5
ODD_BITS = 1024
_WORDS = ODD_BITS // 64
_STEP = 1024


def banding(percent: int) -> tuple[int, int]:
    """(rows, bands) with the most rows for which a pair at the threshold is missed with a chance of at most MISS."""
    t = percent / 100
    return max((r, SAMPLES // r) for r in range(1, 33) if (1 - t**r) ** (SAMPLES // r) <= MISS)


_RNG = np.random.default_rng(20240229)
_MUL = (_RNG.integers(0, 1 << 32, SAMPLES, np.uint32) | np.uint32(1))[:, None]
_XOR = _RNG.integers(0, 1 << 32, SAMPLES, np.uint32)[:, None]


def minhash(s: np.ndarray, k: int) -> np.ndarray:
    """k samples: the least value of the set under each of k permutations of 32-bit numbers."""
    x = (s >> np.uint64(32)).astype(np.uint32)
    out = np.full(k, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), _STEP):
        np.minimum(out, ((x[None, at : at + _STEP] ^ _XOR[:k]) * _MUL[:k]).min(axis=1), out=out)
    return out


def band_keys(samples: np.ndarray, rows: int) -> np.ndarray:
    """One number for each band, which depends on the band's place."""
    m = samples.reshape(-1, rows).astype(np.uint64)
    key = np.arange(len(m), dtype=np.uint64)
    for k in range(rows):
        key = mix(key) ^ m[:, k]
    return mix(key).view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """The bitmap as signed 64-bit words."""
    at = mix(samples.astype(np.uint64) | (np.arange(len(samples), dtype=np.uint64) << np.uint64(32))) % np.uint64(ODD_BITS)
    parity = (np.bincount(at.astype(np.int64), minlength=ODD_BITS) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.int64)


def most_odd_bits(percent: int, samples: int) -> int:
    """Differing bits up to which a pair may be similar enough: the threshold less five standard deviations."""
    t = percent / 100
    low = max(0.0, t - 5 * math.sqrt(t * (1 - t) / samples))
    return math.ceil(ODD_BITS / 2 * (1 - math.exp(-4 * samples * (1 - low) / ODD_BITS)))


def sketches(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, digest (of the set; null if empty), bands and odd for every row of docs."""
    rows_, bands = banding(percent)
    small = docs.select("doc_id", "text")

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, digest, keys, odd = [], [], [], []
            for text in b.column("text").to_pylist():
                s = shingles(text, width)
                n.append(len(s))
                if not len(s):
                    digest.append(None)
                    keys.append(None)
                    odd.append(None)
                    continue
                m = minhash(s, rows_ * bands)
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                keys.append(band_keys(m, rows_))
                odd.append(odd_sketch(m))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "digest", "bands", "odd"],
            )

    return arrow_map(small, rows, f"doc_id {small.schema['doc_id'].dataType.simpleString()}, n_shingles bigint, digest binary, bands array<bigint>, odd array<bigint>")


def _odd_ok(a: str, b: str, most: int) -> Column:
    bits = F.lit(0)
    for k in range(_WORDS):
        bits = bits + F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k]))
    return bits <= most


def _links(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of pairs (u, v) whose full sets are similar, as a scratch table (u, v)."""
    kind = pairs.schema["u"].dataType.simpleString()
    a, b = (texts.select(F.col("doc_id").alias(x), F.col("text").alias(f"text_{x}")) for x in "uv")

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = (None, None)
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("text_u").to_pylist(), batch.column("text_v").to_pylist(), strict=True):
                if last[0] != x:
                    last = (x, shingles(x, width))
                ok.append(similar(last[1], shingles(y, width), percent))
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return materialise(arrow_map(pairs.join(b, "v").join(a, "u").select("u", "v", "text_u", "text_v"), rows, f"u {kind}, v {kind}"), "links")


def _prefixes(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(doc_id, token, bound): the shingles of which two similar sets must share one.

    Of a set of n shingles all but ceil(percent * n) - 1 of any fixed order are enough; the order
    goes from rare to frequent. Shingles that only one document has come first and match nothing, so
    a text with enough words of its own has no tokens left at all. bound: how many of the set's
    shared shingles come from this one on. Where two sets meet first, that is the most that they can
    have in common; a similar pair passes this bound there at the latest, and fails it at later ones
    that only repeat the pair.
    """
    kind = texts.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                s = shingles(b.column("text")[at].as_py(), width)
                ids = pa.array([b.column("doc_id")[at].as_py()], b.schema.field("doc_id").type).take(pa.array(np.zeros(len(s), np.int64)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(s), len(s))), pa.array(s.view(np.int64))], ["doc_id", "n", "token"])

    every = materialise(arrow_map(texts.select("doc_id", "text"), rows, f"doc_id {kind}, n bigint, token bigint"), "shingles")
    shared = sized(materialise(every.groupBy("token").agg(F.count("*").alias("df")).where("df > 1"), "shared"))
    sets = every.join(shared, "token").groupBy("doc_id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("held"))
    length = F.col("n") - F.floor((percent * F.col("n") + 99) / 100) + 1 - (F.col("n") - F.size("held"))
    placed = sets.where(length > 0).select("doc_id", F.size("held").alias("held"), F.posexplode(F.slice("held", F.lit(1), length.cast("int"))).alias("at", "t"))
    return placed.select("doc_id", "t.token", (F.col("held") - F.col("at")).alias("bound"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text).

    Documents are linked if 100 * intersection >= percent * union of their sets of width-word
    shingles; component_id is the smallest id reachable, and kept tells whether it is the row's own.
    A null or blank text has no shingles and no links, and is kept. Rows with the same id count as
    one document, which has the links of all of them. A row with a null id has no links: its
    component_id is null, and it is kept. An empty table gives no rows; other columns are ignored.
    """
    sketch = materialise(sketches(docs, width, percent), "sketches")
    some = sketch.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    classes = materialise(some.groupBy("digest").agg(F.min("doc_id").alias("rep")), "classes")
    reps = some.join(classes.select(F.col("rep").alias("doc_id"), F.col("digest").alias("of")), "doc_id").where("digest = of")
    reps = materialise(reps.select("doc_id", "n_shingles", "bands", "odd"), "reps")

    keys = reps.select("doc_id", F.explode("bands").alias("band"))
    buckets = keys.groupBy("band").agg(F.min("doc_id").alias("pivot"), F.max("doc_id").alias("top")).where("pivot <> top").select("band", "pivot")
    members = materialise(keys.join(buckets, "band"), "members")
    ids = materialise(members.select("doc_id").distinct(), "ids")
    texts = materialise(docs.select("doc_id", "text").join(sized(ids), "doc_id", "left_semi"), "texts")
    odd = materialise(reps.select("doc_id", "n_shingles", "odd").join(sized(ids), "doc_id", "left_semi"), "odd")
    most = most_odd_bits(percent, math.prod(banding(percent)))

    def alike(a: str, b: str) -> Column:
        x, y = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
        return (F.least(x, y) * 100 >= F.greatest(x, y) * percent) & _odd_ok(f"{a}.odd", f"{b}.odd", most)

    stars = members.where("doc_id <> pivot").select(F.col("doc_id").alias("u"), F.col("pivot").alias("v")).distinct()
    stars = stars.join(odd.alias("a"), F.col("u") == F.col("a.doc_id")).join(odd.alias("b"), F.col("v") == F.col("b.doc_id")).where(alike("a", "b")).select("u", "v")
    found = components(_links(materialise(stars, "pairs"), texts, width, percent))

    # Buckets of more than one component: across the components, by prefixes.
    own = F.coalesce("component", "doc_id").alias("component")
    placed = materialise(members.join(found, F.col("doc_id") == F.col("node"), "left").select("band", "doc_id", own), "placed")
    mixed = placed.groupBy("band").agg(F.min("component").alias("least"), F.max("component").alias("most")).where("least <> most").select("band")
    unsettled = materialise(placed.join(mixed, "band").select("doc_id", "component").distinct(), "unsettled")
    tokens = _prefixes(texts.join(sized(unsettled.select("doc_id")), "doc_id", "left_semi"), width, percent)
    tokens = materialise(tokens.join(unsettled, "doc_id"), "prefixes")
    parts = tokens.groupBy("token", "component").agg(F.count("*").alias("n"))
    open_ = parts.groupBy("token").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    open_ = sized(materialise(open_.select("token", "main"), "open-tokens"))  # written first, so that the join has nothing but its sides and a hot token can be split
    rest = materialise(tokens.join(open_, "token").join(odd, "doc_id"), "open")
    a, b = rest.where("component <> main").alias("a"), rest.alias("b")
    across = (F.col("a.token") == F.col("b.token")) & (F.col("a.component") != F.col("b.component")) & ((F.col("b.component") == F.col("b.main")) | (F.col("a.doc_id") < F.col("b.doc_id")))
    common = F.least("a.bound", "b.bound")
    possible = common * 100 >= (F.col("a.n_shingles") + F.col("b.n_shingles") - common) * percent
    pairs = a.join(b, across & possible & alike("a", "b")).select(F.greatest("a.doc_id", "b.doc_id").alias("u"), F.least("a.doc_id", "b.doc_id").alias("v")).distinct()
    more = _links(materialise(pairs, "pairs"), texts, width, percent)
    found = components(more.union(found.select(F.col("node").alias("u"), F.col("component").alias("v")))) if more.limit(1).count() else found

    of_class = classes.join(found, F.col("rep") == F.col("node"), "left").select("digest", F.coalesce("component", "rep").alias("component"))
    of_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    out = sketch.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left").select("doc_id", "n_shingles", of_id.alias("component_id"))
    return out.withColumn("kept", F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group stays (5 words, 80 %), with all its columns.

    Of rows that repeat an id the first in the order of all columns stays, of equal ones any. Null or
    blank texts, and rows without an id, stay; an empty table stays empty.
    """
    decided = near_duplicates(docs)
    out = docs.join(sized(materialise(decided.where(~F.col("kept")).select("doc_id").distinct(), "dropped")), "doc_id", "left_anti").select(*docs.columns)
    repeated = materialise(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    if repeated.limit(1).count():
        row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
        once = out.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.to_json(row)).alias("row")).select("row.*")
        out = out.join(repeated, "doc_id", "left_anti").select(*docs.columns).union(once)
    return out


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), width=3, percent=85)


QUERIES = {"op10_near_duplicates": op10_near_duplicates}
ORACLE = {
    "op10_near_duplicates": r"""
        with recursive w as (
            select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
            from documents),
        s as (
            select doc_id, unnest(list_distinct(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')]
                else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end)) as sh
            from w),
        n as (select doc_id, count(*) as n from s group by doc_id),
        p as (select a.doc_id as u, b.doc_id as v, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id <> b.doc_id group by all),
        l as (select u, v from p join n x on x.doc_id = u join n y on y.doc_id = v where 100 * c >= 85 * (x.n + y.n - c)),
        r as (select u as node, u as other from l union select r.node, l.v from r join l on l.u = r.other),
        m as (select node, min(other) as m from r group by node)
        select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) as component_id,
               least(d.doc_id, coalesce(m.m, d.doc_id)) = d.doc_id as kept
        from documents d left join n using (doc_id) left join m on m.node = d.doc_id"""
}
