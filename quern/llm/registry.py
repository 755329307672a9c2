"""Queries of the package and their SQL."""

from __future__ import annotations

from quern.llm import audit, decontam, html, langid, media, mixing, neardup, phrases, pii, quality, repair, tokens, warc

MODULES = (pii, quality, decontam, mixing, warc, media, html, tokens, langid, neardup, phrases, repair, audit)

QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}
