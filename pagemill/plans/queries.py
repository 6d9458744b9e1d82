"""Named queries, one or more for each operator, over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.functions.text import byte_size
from pagemill.functions.urls import normalize_url, resolve_url, url_host
from pagemill.operators import corpus, crawl, html, lines, markdown, robots
from pagemill.operators.documents import page_documents, page_markdown
from pagemill.sources import derived
from pagemill.sources.captures import as_fetches, fetch_outcomes, read_pages

RUN_AT = datetime(2026, 1, 2, 3, 4, 5)
RUN_DATE = date(2026, 1, 2)

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def _query(make: Query) -> Query:
    """Register under the function's name; ``_query`` at its end only avoids a clash."""
    _QUERIES[make.__name__.removesuffix("_query")] = make
    return make


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return read_pages(spark, f"{folder}/pages.parquet")


def site(spark: SparkSession, folder: str) -> DataFrame:
    return derived.site(pages(spark, folder))


def rich(spark: SparkSession, folder: str) -> DataFrame:
    return derived.rich_pages(pages(spark, folder))


def _numbered_lines(spark: SparkSession, folder: str) -> DataFrame:
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    return lines.number_lines(derived.dirty_lines(documents), "doc_id", "md")


@_query
def normalized_urls(spark, folder):
    return pages(spark, folder).select("page_id", "url", normalize_url(F.col("url")).alias("normalized"))


@_query
def pages_per_host(spark, folder):
    return (
        pages(spark, folder).groupBy(url_host(F.col("url")).alias("host"))
        .agg(F.count(F.lit(1)).alias("n_pages"))
    )


@_query
def fetches(spark, folder):
    return as_fetches(pages(spark, folder)).select(
        "page_id", "requested_url", "final_url", "status_code",
        F.length("content").cast("bigint").alias("n_chars"),
    )


@_query
def fetch_outcomes_query(spark, folder):
    return fetch_outcomes(site(spark, folder)).select(
        "requested_url", "url", "status_code", "title", "error", "is_redirect",
        F.octet_length("content").cast("bigint").alias("n_bytes"),
    )


@_query
def redirects(spark, folder):
    return fetch_outcomes(site(spark, folder)).where("is_redirect").select("requested_url", "url")


@_query
def page_titles(spark, folder):
    return pages(spark, folder).select("page_id", html.extract_title(F.col("html")).alias("title"))


@_query
def html_tokens(spark, folder):
    return html.html_tokens(pages(spark, folder)).withColumn("pos", F.col("pos").cast("bigint"))


@_query
def element_spans(spark, folder):
    spans = html.elements(pages(spark, folder))
    return spans.select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "tag",
        F.col("close_pos").cast("bigint").alias("close_pos"),
    )


@_query
def comments_dropped(spark, folder):
    kept = html.drop_comments(html.html_tokens(pages(spark, folder)))
    return kept.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_tokens"))


@_query
def page_links(spark, folder):
    found = html.page_links(pages(spark, folder), scoped=False)
    return found.withColumn("pos", F.col("pos").cast("bigint"))


@_query
def links_resolved(spark, folder):
    """Links of the linked site, resolved only."""
    fetched = site(spark, folder)
    found = html.page_links(
        fetched, "requested_url", "content", "final_url", scoped=False
    ).join(fetched.select("requested_url", "final_url"), "requested_url")
    return found.select(
        "requested_url", F.col("pos").cast("bigint").alias("pos"), "href",
        resolve_url(normalize_url(F.col("final_url")), F.col("href")).alias("absolute"),
    )


@_query
def links_scoped(spark, folder):
    found = html.page_links(site(spark, folder), "requested_url", "content", "final_url")
    return found.select("requested_url", F.col("pos").cast("bigint").alias("pos"), "target")


def _matched(source: DataFrame) -> DataFrame:
    tokens = html.html_tokens(source.select("page_id", "html").repartition(html.parts_of(source), "page_id"))
    return html.match_elements(tokens)


def _both(spark, folder, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    captured = step(_matched(pages(spark, folder))).withColumn("source", F.lit("pages"))
    return captured.unionByName(
        step(_matched(rich(spark, folder))).withColumn("source", F.lit("rich"))
    ).select("source", "page_id", F.col("pos").cast("bigint").alias("pos"), "tok")


@_query
def junk_removed(spark, folder):
    return _both(spark, folder, lambda t: html.drop_comments(html.drop_junk(t)))


@_query
def main_content(spark, folder):
    return _both(spark, folder, lambda t: html.drop_comments(html.main_content(t)))


def _content_text(source: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("pos")).cast("bigint")
    return html.main_content(_matched(source)).where("kind = 'text'").select("page_id", place.alias("place"), "tok")


@_query
def optional_end_tags(spark, folder):
    """Text of the main content of pages that leave end tags out."""
    return _content_text(derived.optional_pages(pages(spark, folder)))


@_query
def misnested_tags(spark, folder):
    """Text of the main content of pages with stray and crossing close tags."""
    return _content_text(derived.misnested_pages(pages(spark, folder)))


@_query
def misnested_spans(spark, folder):
    """Where the elements of such pages end."""
    return _matched(derived.misnested_pages(pages(spark, folder))).where("kind in ('open', 'raw')").select(
        "page_id", F.col("pos").cast("bigint").alias("pos"), "tag", F.col("end_pos").cast("bigint").alias("end_pos")
    )


@_query
def junk_by_rule(spark, folder):
    both = pages(spark, folder).select("page_id", "html").unionByName(rich(spark, folder))
    return html.junk_by_rule(both)


def _rendered(source: DataFrame) -> DataFrame:
    tokens = html.match_elements(html.page_tokens(source, parts=html.parts_of(source)))
    blocks = markdown.content_blocks(html.main_content(tokens))
    return markdown.render_blocks(blocks).where("line <> ''")


@_query
def md_blocks(spark, folder):
    place = F.row_number().over(Window.partitionBy("page_id").orderBy("block")).cast("bigint")
    return _rendered(pages(spark, folder)).select(
        "page_id", place.alias("place"), "kind", "sep", "line"
    )


@_query
def md_headings(spark, folder):
    return _rendered(pages(spark, folder)).where("kind = 'heading'").select("page_id", "line")


@_query
def md_lists(spark, folder):
    return _rendered(rich(spark, folder)).where("kind = 'item'").select("page_id", "sep", "line")


@_query
def md_links(spark, folder):
    return _rendered(rich(spark, folder)).where("contains(line, '](x?p=')").select("page_id", "line")


@_query
def md_images(spark, folder):
    return _rendered(rich(spark, folder)).where("contains(line, '![')").select("page_id", "line")


@_query
def md_code(spark, folder):
    return _rendered(rich(spark, folder)).where("contains(line, '`')").select("page_id", "kind", "line")


@_query
def rich_markdown(spark, folder):
    source = rich(spark, folder)
    return page_markdown(source, parts=html.parts_of(source))


@_query
def fence_state(spark, folder):
    return lines.fence_state(_numbered_lines(spark, folder), "doc_id").select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"), "is_fence", "in_code"
    )


def _lines_where(spark, folder, test: str) -> DataFrame:
    judged = lines.line_verdicts(_numbered_lines(spark, folder), "doc_id").where(test)
    return judged.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line")


@_query
def gibberish_lines(spark, folder):
    return _lines_where(spark, folder, "gibberish")


@_query
def short_lines(spark, folder):
    return _lines_where(spark, folder, "short")


@_query
def low_variety_lines(spark, folder):
    return _lines_where(spark, folder, "monotone")


@_query
def clean_lines(spark, folder):
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    return lines.clean_lines(derived.dirty_lines(documents), "doc_id")


def _documents(spark, folder) -> DataFrame:
    captured = pages(spark, folder)
    return page_documents(captured, "page_id", "url", "html", error=None, parts=html.parts_of(captured))


@_query
def page_documents_query(spark, folder):
    return _documents(spark, folder).select("page_id", "url", "title", "markdown")


@_query
def token_counts(spark, folder):
    return _documents(spark, folder).select("page_id", "token_count")


@_query
def byte_sizes(spark, folder):
    return pages(spark, folder).select("page_id", byte_size(F.col("html")).alias("byte_size"))


@_query
def robots_rules(spark, folder):
    rules = robots.parse_robots(derived.robots_bodies(pages(spark, folder)))
    return rules.select(
        "origin", F.col("entry_no").cast("bigint").alias("entry_no"),
        F.array_join(F.array_sort("agents"), ",").alias("agents"),
        F.col("rule_no").cast("bigint").alias("rule_no"), "path", "allow",
    )


@_query
def robots_policy(spark, folder):
    return robots.robots_policy(derived.robots_bodies(pages(spark, folder)))


@_query
def robots_verdicts(spark, folder):
    captured = pages(spark, folder).select("page_id", normalize_url(F.col("url")).alias("url"))
    table = robots.robots_table(derived.robots_bodies(pages(spark, folder)))
    return robots.robots_verdicts(captured, table)


@_query
def robots_verdicts_by_prefix(spark, folder):
    captured = pages(spark, folder).select("page_id", normalize_url(F.col("url")).alias("url"))
    bodies = derived.robots_bodies(pages(spark, folder))
    paths = robots.agent_paths(robots.parse_robots(bodies))
    return robots.robots_verdicts_by_prefix(captured, robots.robots_policy(bodies), paths)


def _crawl_inputs(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame]:
    fetched = site(spark, folder)
    return (
        derived.seeds(pages(spark, folder)),
        fetched,
        derived.robots_bodies(fetched, "requested_url"),
    )


def _crawled(spark, folder) -> DataFrame:
    return crawl.bounded_crawl(*_crawl_inputs(spark, folder))


def _crawl_documents(spark, folder, texts: bool = True) -> DataFrame:
    inputs = _crawl_inputs(spark, folder)
    # The title of a result is not asked for here, and it would cost one more pass over the tokens of each page.
    return corpus.crawl_documents(crawl.bounded_crawl(*inputs).drop("title"), inputs[1], texts=texts)


@_query
def crawl_site(spark, folder):
    return _crawled(spark, folder).select(
        "crawl_id", F.col("depth").cast("bigint").alias("depth"), "requested_url", "url",
        F.col("status_code").cast("bigint").alias("status_code"), "title", "error", "is_redirect",
    )


@_query
def crawl_depths(spark, folder):
    visits = crawl.crawl_visits(*_crawl_inputs(spark, folder))
    return visits.groupBy("crawl_id", "depth").agg(F.count(F.lit(1)).alias("n_urls")).withColumn(
        "depth", F.col("depth").cast("bigint")
    )


@_query
def crawl_order(spark, folder):
    visits = crawl.crawl_visits(*_crawl_inputs(spark, folder)).withColumn("one", F.lit(1))
    placed = crawl.running_totals(visits, {"visit_no": "one"})
    return crawl.in_visit_order(placed).select("crawl_id", "visit_no", "requested_url")


@_query
def result_links(spark, folder):
    inputs = _crawl_inputs(spark, folder)
    found = crawl.result_links(crawl.bounded_crawl(*inputs), inputs[1]).withColumn("one", F.lit(1).cast("bigint"))
    return crawl.running_totals(found, {"place": "one"}, order=("depth", "ord", "pos")).select(
        "crawl_id", "place", "requested_url", "target"
    )


@_query
def crawl_progress(spark, folder):
    return crawl.crawl_progress(_crawl_measures(spark, folder)).select(
        "crawl_id", "url", "pages_so_far", "tokens_so_far", "bytes_so_far"
    )


@_query
def fetch_plan(spark, folder):
    return crawl.fetch_plan(_crawled(spark, folder)).select(
        "crawl_id", "requested_url", "pause_ms", "offset_ms"
    )


@_query
def crawl_documents(spark, folder):
    return _crawl_documents(spark, folder).select(
        "crawl_id", "requested_url", "markdown", "token_count", "byte_size"
    )


def _crawl_measures(spark, folder) -> DataFrame:
    return _crawl_documents(spark, folder, texts=False)


@_query
def crawl_stats(spark, folder):
    """The whole job of a crawl: results with their titles, the document of each, and the statistics of these."""
    inputs = _crawl_inputs(spark, folder)
    documents = corpus.crawl_documents(crawl.bounded_crawl(*inputs), inputs[1])
    return corpus.crawl_stats(documents).drop("duration_seconds").withColumn(
        "max_depth", F.col("max_depth").cast("bigint")
    )


def _placed(rows: DataFrame, name: str, order: tuple[str, ...] = ("depth", "ord")) -> DataFrame:
    """Number the rows of each crawl in order."""
    return crawl.running_totals(rows.withColumn("one", F.lit(1).cast("bigint")), {name: "one"}, order=order).drop("one")


@_query
def crawl_outcomes(spark, folder):
    return _placed(corpus.crawl_outcomes(_crawled(spark, folder)), "visit_no").select(
        "crawl_id", "visit_no", "succeeded", "label"
    )


@_query
def stats_summary(spark, folder):
    stats = corpus.stats_summary(corpus.crawl_stats(_crawl_measures(spark, folder)))
    return stats.select("crawl_id", "n_total", "n_success", "n_failed", "total_kb", "estimated_tokens")


@_query
def combined_corpus(spark, folder):
    return _placed(corpus.combine_corpus(_crawl_documents(spark, folder)), "place").select("crawl_id", "place", "chunk")


@_query
def stats_report(spark, folder):
    measured = _crawl_measures(spark, folder)
    report = corpus.stats_report(corpus.crawl_stats(measured), corpus.crawl_outcomes(measured), RUN_AT)
    return _placed(report, "line_no", ("part", "depth", "ord")).select(
        "crawl_id", F.col("part").cast("bigint").alias("part"), "line_no", "line"
    )


@_query
def output_names(spark, folder):
    name = corpus.output_name(F.col("url"), RUN_DATE)
    return pages(spark, folder).select(
        "page_id", name.alias("file_name"), corpus.report_name(name).alias("report_name")
    )
