"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("conversations", "byte_language", "broken_pairs", "cut_texts", "grouped_splits", "consensus", "split_overlap", "leaked_passages", "mixture", "spam_pages")

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"varnika.llm.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= _module.SQL
