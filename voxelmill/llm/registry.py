"""Queries of this subpackage and their SQL."""

from voxelmill.llm import decontaminate, exact_dedup, fill_middle, html_text, language, mixing, quality, ranked_search, secret_scan, simhash_dedup, substring_dedup, token_counts, token_output

_MODULES = (quality, token_output, simhash_dedup, token_counts, substring_dedup, html_text, decontaminate, language, mixing, exact_dedup, ranked_search, secret_scan, fill_middle)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: text for m in _MODULES for name, text in m.SQL.items()}
