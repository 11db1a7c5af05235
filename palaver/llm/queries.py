"""Queries of problems 1 to 4 and 7 to 9."""

from __future__ import annotations

import importlib

_PARTS = ("truncation_queries", "transcript_queries", "conversation_queries", "pair_queries", "reading_queries", "corpus_queries")

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _p in _PARTS:
    _m = importlib.import_module(f"palaver.llm.{_p}")
    QUERIES |= _m.QUERIES
    SQL |= _m.SQL
