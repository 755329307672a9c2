"""Helpers that the operators share: scratch tables, sized broadcasts, bounded Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.plans.common import clear_scratch, materialise, read, scratch, scratch_path, shared_dir, sized

__all__ = ["arrow_map", "clear_scratch", "held_out", "materialise", "read", "scratch", "scratch_path", "shared_dir", "sized"]

#: Bytes and rows of input that a function gets at once; a longer single row makes a batch of its own.
BATCH_BYTES = 4 << 20
BATCH_ROWS = 2_000


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        step = max(1, min(BATCH_ROWS, b.num_rows * BATCH_BYTES // max(1, b.nbytes)))
        for at in range(0, max(1, b.num_rows), step):
            yield b.slice(at, step)


def arrow_map(df: DataFrame, rows: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with batches cut to BATCH_BYTES, so that long texts don't pile up as Python objects."""
    return df.mapInArrow(lambda batches: rows(_slices(batches)), schema)


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Documents of which no label may be learnt: crc32 of the id as text leaves 2 when divided by 4."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))
