"""The corpus operators' queries, by name."""

from __future__ import annotations

from foliospark.llm import chat_format, exact_dedup, fill_middle, filter_audit, lattice_score, license_scan, mixing, packing, quality_rules, simhash, suffix_dedup, toxicity, warc

MODULES = (quality_rules, toxicity, exact_dedup, license_scan, packing, suffix_dedup, warc, simhash, chat_format, mixing, filter_audit, lattice_score, fill_middle)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
