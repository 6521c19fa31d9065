"""Operators for large text corpora; nothing else in the library imports them."""

from __future__ import annotations

import importlib

MODULES = [
    "token_counts", "huffman", "language", "disclosure", "decontaminate", "exact_dedup", "licenses", "substring", "packing", "near_dedup",
    "vector_codes", "whitening", "html_text",
]


def load() -> tuple[dict, dict[str, str]]:
    """All registered queries and SQL checks, the pipeline included."""
    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    importlib.import_module("corpus_pipeline")  # registers the query "pipeline"
    from panelwright.llm.registry import CHECKS, QUERIES

    return dict(QUERIES), dict(CHECKS)
