"""All queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from filigree.llm import chat_format, decontamination, filter_audit, line_dedup, near_dedup, packing, quality, quality_rules, secrets, spelling, substrings, toxicity, url_filter

MODULES = (chat_format, decontamination, filter_audit, line_dedup, near_dedup, packing, quality, quality_rules, secrets, spelling, substrings, toxicity, url_filter)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
