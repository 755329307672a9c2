"""The engine's functions under names for SQL: what an expression can't call by Python."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quern.functions.dom import SCHEMA, _parse
from quern.functions.text import _fold
from quern.operators.chunking import _xml_nodes

XML = "array<struct<path:string,attributes:string,children:string,text:string>>"


def _folded(x: pd.Series) -> pd.Series:
    return pd.Series(_fold(pa.array(x, pa.string())).to_pylist())


class FixedChunks:
    """A table function: the fixed windows of a text."""

    def eval(self, text: str, size: int, overlap: int):
        text = text or ""
        k = 0
        for start in range(0, max(1, len(text)), max(1, size - overlap)):
            content = text[start : start + size].strip()
            if content:
                yield k, start, min(start + size, len(text)), content
                k += 1
            if start + size >= len(text):
                break


FUNCTIONS = {"nfkc": (_folded, "string"), "html_content": (_parse, SCHEMA), "xml_nodes": (_xml_nodes, XML)}
TABLE_FUNCTIONS = {"fixed_chunks": (FixedChunks, "chunk_index int, start_char int, end_char int, content string")}


def register(spark: SparkSession, prefix: str = "quern_") -> list[str]:
    """Makes all functions callable from SQL, and gives their names, by which they are told apart from others."""
    for name, (f, kind) in FUNCTIONS.items():
        spark.udf.register(prefix + name, F.pandas_udf(f, kind))
    for name, (f, kind) in TABLE_FUNCTIONS.items():
        spark.udtf.register(prefix + name, F.udtf(f, returnType=kind))
    return sorted(prefix + name for name in [*FUNCTIONS, *TABLE_FUNCTIONS])
