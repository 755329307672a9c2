"""Language identification (operator 9): rank-order profiles and the out-of-place distance.

A profile is the list of a language's most frequent character n-grams (one to three characters,
words padded by a blank), most frequent first. A document has a profile of its own; for each
language the distances between the ranks of the document's n-grams in both lists are added, an
n-gram that the language's list lacks costs the full list length, and the nearest language wins.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.common import arrow_map, held_out, read

PROFILE = 300
ORDERS = (1, 2, 3)
#: Languages whose profiles go to the tasks at once; with more of them the texts are passed over once for each block.
BLOCK_LANGS = 1_000
_BITS = 21
_FLUSH = 1 << 20


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of the whole text as numbers, and their counts; both empty without a letter."""
    none = np.empty(0, np.uint64), np.empty(0, np.int64)
    if not text:
        return none
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[c]
    if not letter.any():
        return none
    c = np.concatenate([[32], np.where(letter, c, 32), [32]]).astype(np.uint64)
    c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
    found, counts = [], []
    for n in ORDERS:
        g = c[: len(c) - n + 1].copy()
        for k in range(1, n):
            g = (g << np.uint64(_BITS)) | c[k : len(c) - n + 1 + k]
        inner = np.ones(len(g), bool)  # a blank may stand at either end only
        inner[(c[: len(g)] == 32) & (n == 1)] = False
        if n == 3:
            inner &= c[1 : 1 + len(g)] != 32
        u, k = np.unique(g[inner], return_counts=True)
        found.append(u)
        counts.append(k)
    return np.concatenate(found), np.concatenate(counts)


def ranked(g: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, first the most frequent, ties by number."""
    return g[np.lexsort((g, -counts))[:size]]


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> dict[str, np.ndarray]:
    """The profile of every language of docs, from all its rows; null languages and texts are left out.

    The counts are added up by Spark; the driver gets PROFILE numbers for each language.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def merged(parts: list) -> tuple[np.ndarray, np.ndarray]:
            g, inverse = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
            return g, np.bincount(inverse, np.concatenate([n for _, n in parts])).astype(np.int64)

        def out() -> Iterator[pa.RecordBatch]:
            for lang, parts in held.items():
                g, n = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g), pa.string()), pa.array(g.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])
            held.clear()

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
                held.setdefault(lang, []).append(grams(text))
            for lang in held:
                held[lang] = [merged(held[lang])]
            if sum(len(p[0][0]) for p in held.values()) > _FLUSH:
                yield from out()
        yield from out()

    totals = arrow_map(labelled, rows, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    by_count = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = totals.withColumn("rank", F.row_number().over(by_count)).where(F.col("rank") <= PROFILE)
    profiles: dict[str, list[int]] = {}
    for r in top.orderBy("lang", "rank").toLocalIterator():
        profiles.setdefault(r.lang, []).append(r.gram)
    return {lang: np.array(g, np.int64).view(np.uint64) for lang, g in profiles.items()}


def distances(doc: np.ndarray, profile: np.ndarray) -> int:
    """Out-of-place distance of two ranked lists."""
    order = np.argsort(profile)
    at = np.searchsorted(profile, doc, sorter=order).clip(max=len(profile) - 1)
    place = order[at]
    there = profile[place] == doc
    return int(np.where(there, np.abs(place - np.arange(len(doc))), PROFILE).sum())


def nearest(text: str | None, profiles: dict[str, np.ndarray], best: str | None = None, first: int | None = None, second: int | None = None) -> tuple[str | None, int | None, int | None]:
    """The nearest language and the two smallest distances, also counting those found before; all None without a letter."""
    doc = ranked(*grams(text))
    if len(doc):
        for lang, profile in profiles.items():
            d = distances(doc, profile)
            if first is None or d < first:
                best, first, second = lang, d, first
            elif second is None or d < second:
                second = d
    return best, first, second


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out (the column out), lang_pred and score for every row of docs.

    score is second / (nearest + second) of the two smallest distances: 0.5 for a tie, 1 for a
    perfect fit or where only one language is known. A null text, a text without a letter, and every
    text when nothing was learnt get `und` with score 0. Ties go to the language first in order.
    A null id is kept, repeated rows each give a row, other columns are ignored.
    """
    small = docs.select(F.col(id_col).alias("doc_id"), out.alias("held_out"), F.col(text_col).alias("text"), F.lit(None).cast("string").alias("best"), F.lit(None).cast("bigint").alias("first"), F.lit(None).cast("bigint").alias("second"))
    names = sorted(profiles)
    kind = small.schema["doc_id"].dataType.simpleString()
    for at in range(0, len(names), BLOCK_LANGS):
        block = {x: profiles[x] for x in names[at : at + BLOCK_LANGS]}
        last = at + BLOCK_LANGS >= len(names)

        def rows(batches: Iterable[pa.RecordBatch], block=block, last=last) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [nearest(t, block, *held) for t, *held in zip(*(b.column(c).to_pylist() for c in ("text", "best", "first", "second")), strict=True)]
                cols = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)] if found else [pa.array([], k) for k in (pa.string(), pa.int64(), pa.int64())]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.nulls(b.num_rows, pa.string()) if last else b.column("text"), *cols], ["doc_id", "held_out", "text", "best", "first", "second"])

        small = arrow_map(small, rows, f"doc_id {kind}, held_out boolean, text string, best string, first bigint, second bigint")
    both = F.col("first") + F.col("second")
    score = F.when(F.col("best").isNull(), 0.0).when(F.col("second").isNull(), 1.0).when(both == 0, 0.5).otherwise(F.col("second") / both)
    return small.select("doc_id", "held_out", F.coalesce("best", F.lit("und")).alias("lang_pred"), score.alias("score"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return identify(docs, learn(docs.where(~held_out())), held_out())


QUERIES = {"op9_language_id": op9_language_id}
ORACLE: dict[str, str] = {}
