"""The operators' queries, and their DuckDB equivalents where SQL can say them."""

from __future__ import annotations

from nearfield.llm import chat, decontaminate, html, jaccard, licenses, mixing, quality, secrets, substrings, urls

_MODULES = {"op1_mix_sources": mixing, "op2_suffix_dedup": substrings, "op3_decontaminate": decontaminate, "op4_quality_rules": quality, "op5_secrets": secrets, "op6_chat_format": chat, "op7_licenses": licenses, "op8_url_filter": urls, "op9_jaccard_join": jaccard, "op10_html_text": html}
QUERIES = {name: m.query for name, m in _MODULES.items()}
ORACLE = {name: m.ORACLE_SQL for name, m in _MODULES.items() if hasattr(m, "ORACLE_SQL")}
