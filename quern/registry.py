"""Queries of the engine's own operators and their SQL."""

from __future__ import annotations

from quern.operators import assist, cells, chunking, dense, evaluation, fusion, reporting, rerank, sparse, sweep
from quern.sources import files
from quern.streaming import events

MODULES = (sparse, dense, cells, fusion, rerank, evaluation, reporting, chunking, assist, sweep, events, files)

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
