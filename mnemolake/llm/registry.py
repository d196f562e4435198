"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import ann_search, conversation_trie, decontamination, embedding_dedup, html_extract, license_scan, ngram_join, packing, periodic_runs, quality, token_files, toxicity, url_filter

MODULES = (license_scan, ngram_join, token_files, quality, decontamination, embedding_dedup, toxicity, url_filter, html_extract, packing, periodic_runs, ann_search, conversation_trie)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: text() if callable(text) else text for m in MODULES for name, text in m.SQL.items()}
