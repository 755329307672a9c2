"""Token counts (operator 8): batches encoded in Arrow functions that return lengths only.

A text is cut where the tokenizer itself would cut: in front of a single blank before a letter, and
between a Latin letter and a mark of punctuation. The byte-level pre-tokenizer starts a new piece
there (" ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+"), and no special string holds a blank or one of
these marks, so the counts of the pieces add up to the count of the text. A worker gathers
the distinct pieces of its texts until their bytes reach a bound and has the library encode them in
one call; nothing but the pieces' lengths is kept, and a text's count is the sum over its pieces.
Texts repeat their words, so that most pieces are encoded once for many texts. The lengths that are
held are bounded by the bytes of their pieces; beyond the bound they are forgotten and encoded again.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import arrow_map, read

#: UTF-8 bytes of the pieces in one call of the library, and of the pieces whose lengths are held.
CALL_BYTES = 1 << 18
HELD_BYTES = 4 << 20
#: Characters whose pieces are looked at together.
GROUP_CHARS = 1 << 19
#: Here the byte-level pre-tokenizer always starts a new piece; texts for any other one aren't cut.
SAFE = re.compile(r"(?<=\S)(?= [^\W\d_])|(?<=[A-Za-zÀ-ÖØ-öø-ÿ])(?=[.,;:!?])")

_loaded: dict[object, object] = {}


def segments(text: str, limit: int = GROUP_CHARS) -> Iterator[str]:
    """Parts of about limit characters, cut at safe places only; a text without any stays whole."""
    start = 0
    while len(text) - start > limit and (cut := SAFE.search(text, start + limit)):
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


def _tokenizer(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        _loaded[path] = t
    return _loaded[path]


def cuttable(tokenizer: object) -> bool:
    """Whether SAFE holds: a byte-level pre-tokenizer that splits by its own expression, and nothing that changes texts before it."""
    made = json.loads(tokenizer.to_str())
    before = made.get("pre_tokenizer") or {}
    return before.get("type") == "ByteLevel" and before.get("use_regex", True) and not made.get("normalizer") and not any(x.get("lstrip") or x.get("rstrip") or x.get("single_word") for x in made.get("added_tokens") or [])


class Lengths(dict):
    """Token counts of pieces, encoded by the library in calls of CALL_BYTES."""

    def __init__(self, path: str):
        self.tokenizer, self.size = _tokenizer(path), 0
        self.cut = cuttable(self.tokenizer)

    def learn(self, pieces: Iterable[str]) -> None:
        batch: list[str] = []
        size = 0
        for piece in dict.fromkeys(pieces):
            if piece not in self:
                batch.append(piece)
                size += len(piece.encode())
                if size >= CALL_BYTES:
                    self._encode(batch, size)
                    batch, size = [], 0
        self._encode(batch, size)

    def _encode(self, batch: list[str], size: int) -> None:
        if batch:
            self.update(zip(batch, map(len, self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)), strict=True))
            self.size += size

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        group: list[tuple[int, list[str]]] = []
        size = 0

        def add() -> None:
            if self.size > HELD_BYTES:
                self.clear()
                self.size = 0
            self.learn(piece for _, pieces in group for piece in pieces)
            for i, pieces in group:
                out[i] += sum(map(self.__getitem__, pieces))
            group.clear()

        for i, text in enumerate(texts):
            for part in segments(text) if self.cut else (text,):
                group.append((i, SAFE.split(part) if self.cut else [part]))
                size += len(part)
                if size >= GROUP_CHARS:
                    add()
                    size = 0
        add()
        return out


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row per row of docs: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    A null text counts as empty: 0 bytes, 0 tokens. A null id is kept. Repeated rows are counted
    each. An empty table gives an empty result. Other columns are ignored, whatever their names.
    """
    small = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    schema = f"doc_id {small.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean"

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = _loaded.setdefault(("lengths", tokenizer_path), Lengths(tokenizer_path))  # kept for the worker's next tasks
        for b in batches:
            texts = b.column("text").to_pylist()
            n = lengths.counts(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return arrow_map(small, rows, schema)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES = {"op8_token_counts": op8_token_counts}
ORACLE: dict[str, str] = {}
