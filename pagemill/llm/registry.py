"""Queries of this package and their SQL twins."""

from __future__ import annotations

from pagemill.llm import alignment, chat, decontamination, jaccard, licenses, lines, merkle, packing, quality, sharding, substrings, tokenfiles, urlfilter

MODULES = (decontamination, sharding, quality, urlfilter, substrings, lines, chat, jaccard, licenses, packing, merkle, tokenfiles, alignment)


def all_queries() -> dict:
    return {m.QUERY: m.query for m in MODULES}


def oracle_sql() -> dict[str, str]:
    return {m.QUERY: m.ORACLE for m in MODULES if m.ORACLE}
