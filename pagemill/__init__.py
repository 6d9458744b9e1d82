"""Captured web pages in, ordered Markdown corpora out: a library of Spark DataFrame operators."""

from pagemill.operators.corpus import (
    combine_corpus,
    crawl_documents,
    crawl_outcomes,
    crawl_stats,
    stats_report,
    stats_summary,
    write_corpus,
    write_report,
)
from pagemill.operators.crawl import bounded_crawl, crawl_progress, fetch_plan
from pagemill.operators.documents import page_documents, page_markdown
from pagemill.operators.robots import robots_table, robots_verdicts
from pagemill.session import build_session
from pagemill.sources.captures import as_fetches, fetch_outcomes, read_pages

__all__ = [
    "as_fetches",
    "bounded_crawl",
    "build_session",
    "combine_corpus",
    "crawl_documents",
    "crawl_outcomes",
    "crawl_progress",
    "crawl_stats",
    "fetch_outcomes",
    "fetch_plan",
    "page_documents",
    "page_markdown",
    "read_pages",
    "robots_table",
    "robots_verdicts",
    "stats_report",
    "stats_summary",
    "write_corpus",
    "write_report",
]
