"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, fingerprint, html_extract, language_id, line_dedup, mixing, ngram_join, pii, token_pack, toxicity

MODULES = [language_id, line_dedup, token_pack, pii, mixing, fingerprint, ngram_join, toxicity, html_extract, decontaminate]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
