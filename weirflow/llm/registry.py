"""Queries and SQL of this subpackage."""

from __future__ import annotations

from weirflow.llm import language_model, licences, lines, mixing, neighbours, packing, quality, simhash, toxicity, warc

MODULES = (warc, mixing, licences, quality, simhash, neighbours, toxicity, language_model, packing, lines)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
