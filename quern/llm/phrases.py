"""Repeated-phrase automata (operator 11): windows of words that recur anywhere in the corpus.

1. Of every window of 20 words the least hash of its 8-word grams is its anchor. Equal windows have
   equal anchors, and a text has about one for every seven words, so anchors are what is counted.
2. Anchors that recur are dealt to shards by one document that holds them, so that a group of copies
   needs few of the shards. The parts of a document with such anchors are its pieces; no window that
   recurs lies outside of them.
3. Windows of pieces are confirmed as recurring by counting them, and belong to the smallest document
   that holds them. Runs of such windows in their own document are passages; those of a shard become
   one Aho-Corasick automaton of 8-word blocks, one of which lies in every window of a passage.
4. All pieces of a shard are streamed through its automaton; around each block that it finds the
   windows are compared word by word with the shard's passages. A shard that many documents need is
   handed out several times, each time to a part of them.
5. Words under windows that aren't the first of their kind are removed.

Words are compared as numbers of 64 bits, windows are counted by 95.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import arrow_map, materialise, read, sized
from quern.llm.shingles import mix, words_of

WINDOW = 20
GRAM = 8
#: Places of a gram within a window; blocks of GRAM words at this distance leave no window without one.
SPAN = WINDOW - GRAM + 1
#: Bytes (as a power of two) of a very long document whose anchors are dealt out together, windows of a shard, bytes of the pieces that meet one copy of it.
SLOT_BITS = 19
SHARD_WINDOWS = 50_000
PART_BYTES = 4 << 20

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def grams(w: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """A number for each run of n words: a polynomial in base, put together from runs of 1, 2, 4, ... words."""
    out, done, power, part, size = None, 0, base, w, 1
    with np.errstate(over="ignore"):
        while True:
            if n & size:
                if out is None:
                    out, done = part, size
                else:
                    out = out[: max(0, len(part) - done)] * power + part[done:]
                    done += size
            size *= 2
            if size > n:
                break
            part = part[: -(size // 2)] * power + part[size // 2 :]
            power = power * power
    return mix(out[: max(0, len(w) - n + 1)])


def anchors(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The grams of w, and for each window the place of its least gram, the leftmost of equal ones."""
    g = grams(w, GRAM, _A)
    at, least, span = np.arange(len(g)), g, 1
    for step in (1, 2, 4, SPAN - 8):
        right = least[step:] < least[:-step]
        at, least = np.where(right, at[step:], at[:-step]), np.where(right, least[step:], least[:-step])
        span += step
    assert span == SPAN
    return g, at


def with_uid(texts: DataFrame) -> DataFrame:
    """texts (doc_id, sig, text) with a number for each; its six lowest bits say in how many shards, as a power of two, the anchors first seen in it may go."""
    bits = F.length(F.bin(F.shiftright(F.octet_length("text"), SLOT_BITS)))
    return texts.withColumn("uid", F.xxhash64("doc_id", "sig").bitwiseAND(~63).bitwiseOR((bits - 1).cast("long")))


def windows_in(of: np.ndarray) -> np.ndarray:
    """Starts of the windows that lie within one text; of: the text of each word."""
    return np.flatnonzero(of[: 1 - WINDOW] == of[WINDOW - 1 :])


def anchor_rows(texts: DataFrame) -> DataFrame:
    """uid, gram for each anchor of texts (uid, text)."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, of = words_of(b.column("text").to_pylist())
            g, at = anchors(w)
            at = np.unique(at[windows_in(of)])
            yield pa.RecordBatch.from_arrays([b.column("uid").take(pa.array(of[at])), pa.array(g[at].view(np.int64))], ["uid", "gram"])

    return arrow_map(texts.select("uid", "text"), rows, "uid bigint, gram bigint")


def _first(c: str = "doc_id") -> Column:
    """The least of a group's ids; rows without an id come before all others."""
    return F.when(~F.bool_or(F.col(c).isNull()), F.min(c))


def _null_sig() -> Column:
    """Of a group with rows that have no id the least signature of these: its windows are read from one of them and not from all."""
    return F.min(F.when(F.col("doc_id").isNull(), F.col("sig")))


def _words(texts: list[str]) -> list[bytes]:
    return " ".join(texts).encode("utf-8", "surrogatepass").split()


def _texts(words: list[bytes], first: np.ndarray, last: np.ndarray) -> list[str]:
    """The words from the start of one window to the end of another, as texts."""
    return [b" ".join(words[i : j + WINDOW]).decode("utf-8", "surrogatepass") for i, j in zip(first.tolist(), last.tolist(), strict=True)]


def _cuts(new: np.ndarray) -> np.ndarray:
    """Starts of runs; new: whether each but the first begins one."""
    return np.concatenate([[0], np.flatnonzero(new) + 1])


def _nested(group: np.ndarray, values: list | np.ndarray, kind: pa.DataType) -> pa.Array:
    """values as lists, one for each run of equal groups."""
    starts = _cuts(group[1:] != group[:-1]) if len(group) else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(group)), pa.int32()), pa.array(values, kind))


def piece_rows(held: DataFrame) -> DataFrame:
    """doc_id, sig, shard, starts, texts: the parts of held (doc_id, sig, text, marks) that hold the windows whose anchors recur, for each shard of these anchors.

    A part also holds windows of other shards; where both copies of such a window lie in parts of this
    shard they are found here too, which changes nothing. What recurs in one document of a batch
    recurs in all of it, so that their marks are looked up together.
    """
    kind = held.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            w, of = words_of(texts)
            items = b.column("marks").flatten()
            gram, first = np.unique(items.field("gram").to_numpy(zero_copy_only=False).view(np.uint64), return_index=True)
            to = items.field("shard").to_numpy(zero_copy_only=False)[first]
            g, at = anchors(w)
            starts = windows_in(of)
            where = np.searchsorted(gram, g)
            where[where == len(gram)] = 0
            hit = gram[where] == g if len(gram) else np.zeros(len(g), bool)
            starts = starts[hit[at[starts]]]
            shard, doc = to[where[at[starts]]], of[starts]
            order = np.lexsort((starts, shard, doc))
            starts, shard, doc = starts[order], shard[order], doc[order]
            if len(starts):
                same = (shard[1:] == shard[:-1]) & (doc[1:] == doc[:-1])
                cut = _cuts(~same | (starts[1:] - starts[:-1] > WINDOW))
                first, last = starts[cut], starts[np.append(cut[1:], len(starts)) - 1]
                doc, shard = doc[cut], shard[cut]
            else:
                first = last = starts
            found = _texts(_words(texts), first, last)
            group = np.cumsum(np.concatenate([[0], (shard[1:] != shard[:-1]) | (doc[1:] != doc[:-1])]))[: len(doc)]
            one = _cuts(group[1:] != group[:-1]) if len(group) else np.empty(0, np.int64)
            begin = np.searchsorted(of, doc)  # the place of each document's first word
            ids = pa.array(doc[one])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(ids), b.column("sig").take(ids), pa.array(shard[one]), _nested(group, first - begin, pa.int64()), _nested(group, found, pa.string())], ["doc_id", "sig", "shard", "starts", "texts"]
            )

    return arrow_map(held.select("doc_id", "sig", "text", "marks"), rows, f"doc_id {kind}, sig bigint, shard bigint, starts array<bigint>, texts array<string>")


def _pieces(lists: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """The texts of a column of lists, the words of all of them, and the text and the row of each word."""
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    texts = lists.flatten().to_pylist()
    w, of = words_of(texts)
    return texts, w, of, row[of] if len(of) else of


def _numbers(w: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two numbers for each window."""
    return grams(w, WINDOW, _A)[starts].view(np.int64), (grams(w, WINDOW, _B)[starts] >> np.uint64(33)).astype(np.int32)


def window_rows(pieces: DataFrame) -> DataFrame:
    """doc_id, sig, shard, h1, h2, n for each distinct window of pieces; n: 2 if the document has it more than once, else 1."""
    kind = pieces.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, w, of, row = _pieces(b.column("texts"))
            starts = windows_in(of)
            h1, h2 = _numbers(w, starts)
            row = row[starts]
            order = np.lexsort((h2, h1, row))
            h1, h2, row = h1[order], h2[order], row[order]
            at = _cuts((h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (row[1:] != row[:-1])) if len(row) else np.empty(0, np.int64)
            n = np.minimum(np.diff(np.append(at, len(row))), 2).astype(np.int32)
            ids = pa.array(row[at])
            yield pa.RecordBatch.from_arrays([*(b.column(x).take(ids) for x in ("doc_id", "sig", "shard")), pa.array(h1[at]), pa.array(h2[at]), pa.array(n)], ["doc_id", "sig", "shard", "h1", "h2", "n"])

    return arrow_map(pieces.select("doc_id", "sig", "shard", "texts"), rows, f"doc_id {kind}, sig bigint, shard bigint, h1 bigint, h2 int, n int")


def passage_rows(firsts: DataFrame) -> DataFrame:
    """owner, shard, n, text: the runs of windows that begin in their document.

    firsts: doc_id, shard, texts, windows (struct h1, h2) of the recurring windows that are the document's own.
    """
    kind = firsts.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, w, of, row = _pieces(b.column("texts"))
            starts = windows_in(of)
            key = lambda h1, h2, row: mix(mix(h1.view(np.uint64) + row.astype(np.uint64)) ^ h2.astype(np.uint64))
            own = b.column("windows").flatten()
            number = lambda c: own.field(c).to_numpy(zero_copy_only=False)
            mine = key(number("h1"), number("h2"), np.repeat(np.arange(b.num_rows), b.column("windows").value_lengths().to_numpy(zero_copy_only=False)))
            starts = starts[np.isin(key(*_numbers(w, starts), row[starts]), mine)]
            if len(starts):
                cut = _cuts((starts[1:] - starts[:-1] > 1) | (of[starts[1:]] != of[starts[:-1]]))
                first, last = starts[cut], starts[np.append(cut[1:], len(starts)) - 1]
            else:
                first = last = starts
            ids = pa.array(row[first])
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(ids), b.column("shard").take(ids), pa.array(last - first + 1), pa.array(_texts(_words(texts), first, last), pa.string())], ["owner", "shard", "n", "text"])

    return arrow_map(firsts.select("doc_id", "shard", "texts", "windows"), rows, f"owner {kind}, shard bigint, n bigint, text string")


class Shard:
    """The automaton of a shard's passages: blocks of GRAM words, SPAN apart, so that every window holds a whole one."""

    def __init__(self, passages: list[str], owners: list[object]) -> None:
        self.words, of = words_of(passages)
        self.codes = {x: k for k, x in enumerate(dict.fromkeys(owners))}
        owner = np.array([self.codes[x] for x in owners], np.int64)
        at = windows_in(of)
        h = grams(self.words, WINDOW, _A)[at]
        order = np.argsort(h, kind="stable")
        self.hashes, self.at = h[order], at[order]
        self.owner = owner[of[self.at]]
        begin = np.searchsorted(of, np.arange(len(passages)))
        blocks = np.flatnonzero(of[: 1 - GRAM] == of[GRAM - 1 :])
        blocks = blocks[(blocks - begin[of[blocks]]) % SPAN == 0]
        self.vocabulary = np.unique(self.words[blocks[:, None] + np.arange(GRAM)])
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
        text = self.coded(self.words)
        for word in {text[3 * k : 3 * (k + GRAM)] for k in blocks.tolist()}:
            self.automaton.add_word(word)
        self.automaton.make_automaton()

    def coded(self, w: np.ndarray) -> str:
        """Words as three characters each, of three alphabets so that only whole words can match; unknown ones match nothing."""
        at = np.searchsorted(self.vocabulary, w)
        at[at == len(self.vocabulary)] = 0
        known = self.vocabulary[at] == w if len(self.vocabulary) else np.zeros(len(w), bool)
        parts = np.stack([0x4000 + (at >> 14), 0x400 + ((at >> 7) & 127), 0x500 + (at & 127)], axis=1)
        parts[~known] = 0x300
        return parts.astype("<u4").tobytes().decode("utf-32-le")

    def found(self, w: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the windows of several texts (w: their words, of: the text of each) that are in the shard, and their places in it."""
        nothing = np.empty(0, np.int64)
        if len(w) < WINDOW or not len(self.hashes):
            return nothing, nothing
        ends = np.fromiter((end for end, _ in self.automaton.iter(self.coded(w))), np.int64)
        if not len(ends):
            return nothing, nothing
        edge = np.zeros(len(w) + 2, np.int64)  # windows that hold a block found at words b to b + GRAM - 1 start at b - SPAN + 1 to b
        block = ends // 3 - GRAM + 1
        np.add.at(edge, np.maximum(block - SPAN + 1, 0), 1)
        np.add.at(edge, block + 1, -1)
        near = np.cumsum(edge) > 0
        starts = windows_in(of)
        starts = starts[near[starts]]
        h = grams(w, WINDOW, _A)[starts]
        at = np.searchsorted(self.hashes, h)
        found = np.full(len(h), -1)
        offset = np.arange(WINDOW)
        open_ = np.flatnonzero(at < len(self.hashes))
        while len(open_):  # once for each window of the shard with the same number: as a rule once
            open_ = open_[self.hashes[at[open_]] == h[open_]]
            same = (self.words[self.at[at[open_]][:, None] + offset] == w[starts[open_][:, None] + offset]).all(axis=1)
            found[open_[same]] = at[open_[same]]
            open_ = open_[~same]
            at[open_] += 1
            open_ = open_[at[open_] < len(self.hashes)]
        return starts[found >= 0], found[found >= 0]


def located(passages: DataFrame, pieces: DataFrame) -> DataFrame:
    """doc_id, sig, starts, ends: word ranges to remove, of each document in each shard that it has pieces for."""
    kind = pieces.schema["doc_id"].dataType.simpleString()

    def scan(_: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        shard = Shard(left.column("text").to_pylist(), left.column("owner").to_pylist())
        right = right.combine_chunks()
        ids, lists, places = (right.column(c).combine_chunks() for c in ("doc_id", "texts", "starts"))
        _, w, of, row = _pieces(lists)
        starts, found = shard.found(w, of)
        doc = row[starts]
        mine = np.array([shard.codes.get(x, -1) for x in ids.to_pylist()], np.int64)
        first = np.zeros(len(found), bool)  # of a document's windows of one kind
        first[np.unique(doc * (len(shard.hashes) + 1) + found, return_index=True)[1]] = True
        again = ~((shard.owner[found] == mine[doc]) & first)
        starts, doc = starts[again], doc[again]
        place = starts - np.searchsorted(of, of[starts]) + places.flatten().to_numpy(zero_copy_only=False)[of[starts]]
        if len(place):
            cut = _cuts((place[1:] - place[:-1] > WINDOW) | (place[1:] < place[:-1]) | (doc[1:] != doc[:-1]))
            begin, end, doc = place[cut], place[np.append(cut[1:], len(place)) - 1] + WINDOW, doc[cut]
        else:
            begin = end = place
        one = pa.array(np.unique(doc))
        whole = pa.int64()
        return pa.table([ids.take(one), right.column("sig").take(one), _nested(doc, begin, whole), _nested(doc, end, whole)], ["doc_id", "sig", "starts", "ends"])

    by = ("shard", "part")
    return passages.groupBy(*by).cogroup(pieces.groupBy(*by)).applyInArrow(scan, f"doc_id {kind}, sig bigint, starts array<bigint>, ends array<bigint>")


def removals(texts: DataFrame) -> DataFrame:
    """doc_id, sig, text, starts, ends: those of texts (doc_id, sig, text) that repeat earlier ones, with the ranges of their repeated words.

    All tables here grow with the corpus, so none is broadcast by us.
    """
    texts = with_uid(texts)
    every = materialise(anchor_rows(texts), "anchors")
    seen = every.groupBy("gram").agg(F.count("*").alias("n"), F.min("uid").alias("home")).where("n > 1")
    seen = materialise(seen.select("gram", "home"), "grams")
    shards = seen.count() * SPAN // 2 // SHARD_WINDOWS + 1  # an anchor has about as many windows as half its span
    slot = F.pmod(F.col("gram"), F.pow(F.lit(2), F.col("home").bitwiseAND(63)).cast("long"))
    shard = F.pmod(F.xxhash64("home", slot), F.lit(shards))
    marks = every.join(seen.select("gram", shard.alias("shard")), "gram").groupBy("uid").agg(F.collect_set(F.struct("gram", "shard")).alias("marks"))
    held = materialise(texts.join(materialise(marks, "marks"), "uid").select("doc_id", "sig", "text", "marks"), "held")
    pieces = materialise(piece_rows(held), "pieces")

    again = window_rows(pieces).groupBy("h1", "h2", "shard").agg(F.sum("n").alias("n"), _first().alias("home"), _null_sig().alias("home_sig")).where("n > 1")
    again = again.groupBy("home", "home_sig", F.col("shard").alias("of_shard")).agg(F.collect_list(F.struct("h1", "h2")).alias("windows"))
    owner = F.col("doc_id").eqNullSafe(F.col("home")) & (F.col("shard") == F.col("of_shard")) & F.when(F.col("doc_id").isNull(), F.col("sig")).eqNullSafe(F.col("home_sig"))
    passages = materialise(passage_rows(pieces.join(materialise(again, "windows"), owner)), "passages")

    size = F.aggregate("texts", F.lit(0), lambda n, t: n + F.octet_length(t))
    loads = pieces.groupBy("shard").agg(F.ceil(F.sum(size) / PART_BYTES).cast("int").alias("parts"))
    loads = sized(materialise(loads.join(passages.select("shard").distinct(), "shard"), "loads"))
    dealt = pieces.join(loads, "shard").select("doc_id", "sig", "starts", "texts", "shard", F.pmod(F.xxhash64("doc_id", "sig"), "parts").cast("int").alias("part"))
    placed = passages.join(loads, "shard").select("owner", "text", "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    found = materialise(located(placed, dealt), "located").groupBy("doc_id", "sig").agg(F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"))
    found = found.withColumnsRenamed({"doc_id": "of", "sig": "of_sig"})
    return held.select("doc_id", "sig", "text").join(found, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("sig") == F.col("of_sig"))).select("doc_id", "sig", "text", "starts", "ends")


def kept_words(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of keep, n_words, n_removed and kept_sha256 of docs (text, starts, ends, gone); all words go where gone is true and there is a window."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, kept = [], [], []
            for text, none, starts, ends in zip(*(b.column(c).to_pylist() for c in ("text", "gone", "starts", "ends")), strict=True):
                words = text.encode("utf-8", "surrogatepass").split()
                left = [] if none and len(words) >= WINDOW else words
                if starts:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, ends, -1)
                    left = [words[k] for k in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]
                n.append(len(words))
                gone.append(len(words) - len(left))
                kept.append(hashlib.sha256(b" ".join(left)).hexdigest())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], [*keep, "n_words", "n_removed", "kept_sha256"])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return arrow_map(docs.select(*keep, "text", "starts", "ends", "gone"), rows, f"{kinds}n_words bigint, n_removed bigint, kept_sha256 string")


def repeated_phrases(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs (doc_id, text).

    A word is removed if a window of 20 words that covers it also starts in a document with a smaller
    id, or earlier in the same one. A null text has no words; a text of fewer than 20 words loses
    none. Every row is a document: rows that repeat an id aren't earlier than each other, and rows
    without an id are earlier than all others. An empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("sig"))
    digest = F.unhex(F.sha2("text", 256))
    groups = rows.groupBy(digest.alias("digest")).agg(F.count("*").alias("n"), _first().alias("home")).where("n > 1")
    groups = materialise(groups.select("digest", "home"), "texts")
    small = sized(groups)
    if small is not groups:
        known = rows.withColumn("digest", digest).join(small, "digest", "left")
        rows = known.select("doc_id", "text", "sig", (F.col("home").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("home"))).alias("gone"))
    else:  # by document and not by text, so that a text of many documents isn't one task's
        ids = rows.select("doc_id", "sig", digest.alias("digest")).distinct().join(groups, "digest").where(~F.col("doc_id").eqNullSafe(F.col("home")))
        ids = ids.select(F.col("doc_id").alias("of"), F.col("sig").alias("of_sig"), F.lit(True).alias("copy"))
        rows = rows.join(ids, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("sig") == F.col("of_sig")), "left").select("doc_id", "text", "sig", F.coalesce("copy", F.lit(False)).alias("gone"))
    none = F.array().cast("array<bigint>")
    cut = kept_words(removals(rows.where(~F.col("gone")).select("doc_id", "sig", "text")).withColumn("gone", F.lit(False)), ["doc_id", "sig"]).distinct()
    cut = materialise(cut.select(F.col("doc_id").alias("of"), F.col("sig").alias("of_sig"), F.col("n_removed").alias("less"), F.col("kept_sha256").alias("rest")), "removals")
    whole = kept_words(rows.withColumns({"starts": none, "ends": none}), ["doc_id", "sig"])  # nothing but counts and hashes is shuffled
    both = whole.join(cut, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("sig") == F.col("of_sig")), "left")
    return both.select("doc_id", "n_words", F.coalesce("less", "n_removed").alias("n_removed"), F.coalesce("rest", "kept_sha256").alias("kept_sha256"))


def op11_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_phrases(read(spark, sf_dir, "documents"))


QUERIES = {"op11_repeated_phrases": op11_repeated_phrases}
ORACLE = {
    "op11_repeated_phrases": r"""
        with w as (
            select row_number() over () as r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
        s as (select r, doc_id, unnest(range(1, len(w) - 18)) as i, w from w where len(w) >= 20),
        k as (select r, doc_id, i, hash(array_to_string(w[i:i + 19], ' ')) as h, md5(array_to_string(w[i:i + 19], ' ')) as m from s),
        a as (select r, i, doc_id > min(doc_id) over (partition by h, m) or row_number() over (partition by h, m, r order by i) > 1 as again from k),
        g as (select distinct r, i + j as i from a, (select unnest(range(20)) as j) where again),
        p as (select r, unnest(w) as x, unnest(range(1, len(w) + 1)) as i from w where len(w) > 0),
        z as (select p.r, count(g.i) as gone, coalesce(string_agg(x, ' ' order by p.i) filter (g.i is null), '') as kept from p left join g on g.r = p.r and g.i = p.i group by p.r)
        select doc_id, len(w)::bigint as n_words, coalesce(gone, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
        from w left join z using (r)"""
}
