"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

MODULES = ["encodings", "error_pages", "leakage", "near_duplicates", "packing", "page_template", "repeated_lines", "scanned_pages", "sentences"]

QUERIES: dict = {}
SQL: dict[str, str] = {}
for _name in MODULES:
    _module = importlib.import_module(f"lodestrata.llm.{_name}")
    QUERIES |= _module.QUERIES
    SQL |= getattr(_module, "SQL", {})
