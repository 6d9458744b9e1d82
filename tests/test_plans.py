"""What the plans must look like at any scale, and parity with the SQL twins."""

import re

import pytest

from pagemill.operators import html
from pagemill.operators.documents import page_documents, page_markdown
from pagemill.plans.queries import all_queries
from pagemill.sources.captures import read_pages, save_bucketed_pages

import __spark_entry__ as contract
import compare

SMALL = "/root/testdata/sf0.001"


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def pages(spark):
    return read_pages(spark, f"{SMALL}/pages.parquet")


def test_one_shuffle_from_pages_to_documents(spark):
    plan = plan_of(page_documents(pages(spark), "page_id", "url", "html", error=None))
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == len(re.findall("Exchange", plan)) == 1
    assert "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_no_shuffle_for_links_titles_and_tokens(spark):
    frame = pages(spark)
    for step in (html.page_links(frame), html.html_tokens(frame), frame.select(html.extract_title(frame.html))):
        assert "Exchange" not in plan_of(step)


def test_no_shuffle_from_a_bucketed_table(spark):
    spark.sql("drop table if exists bucketed_pages")
    save_bucketed_pages(pages(spark), "bucketed_pages", 4)
    try:
        stored = spark.table("bucketed_pages")
        plan = plan_of(page_markdown(stored, colocated=True))
        assert "Exchange" not in plan
        assert page_markdown(stored, colocated=True).exceptAll(page_markdown(pages(spark))).isEmpty()
    finally:
        spark.sql("drop table bucketed_pages")


def test_columns_are_pruned(spark):
    plan = plan_of(all_queries()["normalized_urls"](spark, SMALL))
    assert "html" not in re.search(r"ReadSchema: struct<[^>]*>", plan).group(0)


def test_no_python_and_no_cross_join_anywhere(spark):
    for name in ("page_documents", "links_scoped", "junk_removed", "robots_verdicts", "clean_lines", "fetches"):
        plan = plan_of(all_queries()[name](spark, SMALL))
        assert not re.search("Python|Cartesian|NestedLoop|ArrowEval", plan), name


def test_entry(spark):
    assert contract.entry(spark).count() == 50


@pytest.fixture(scope="module")
def twins():
    return contract.oracle_sql(), compare.connect(SMALL)


@pytest.mark.parametrize("name", list(all_queries()))
def test_twin(spark, twins, name):
    sql, db = twins
    assert compare.difference(spark, db, all_queries()[name], sql[name], SMALL) == ""


def test_crawl_queries_take_no_titles(spark, monkeypatch):
    """A title costs a pass over the tokens of its page, and no query on crawl documents has one."""
    from pagemill.plans import queries

    results = spark.createDataFrame([(1, "http://a.example/", "t")], "crawl_id long, requested_url string, title string")
    monkeypatch.setattr(queries, "_crawl_inputs", lambda spark, folder: (None, None, None))
    monkeypatch.setattr(queries.crawl, "bounded_crawl", lambda *inputs: results)
    monkeypatch.setattr(queries.corpus, "crawl_documents", lambda got, fetches, texts: got)
    for texts in (True, False):
        assert queries._crawl_documents(spark, "", texts).columns == ["crawl_id", "requested_url"]


def test_crawl_stats_makes_every_document(spark, monkeypatch, tmp_path):
    """The statistics are those of documents that were made and written with their titles and texts."""
    from pagemill.plans import queries

    body = "<html><head><title>{0}</title></head><body><article><p>words of page {0}</p></article></body></html>"
    rows = [(n, f"http://a.example/en/{n}", body.format(t)) for n, t in enumerate(["zero", "one", "two", "three"])]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    made = []
    whole = queries.corpus.crawl_stats
    monkeypatch.setattr(queries.corpus, "crawl_stats", lambda documents: made.append(documents) or whole(documents))
    stats = {r.crawl_id: r for r in all_queries()["crawl_stats"](spark, str(tmp_path)).collect()}
    documents = made[0].collect()
    assert {"title", "markdown"} <= set(made[0].columns) and set(stats) == {0, 1, 2, 3}
    answered = [d for d in documents if not d.error]
    assert answered and all(d.title in ("zero", "one", "two", "three") and f"words of page {d.title}" in d.markdown for d in answered)
    for crawl_id, found in stats.items():
        own = [d for d in documents if d.crawl_id == crawl_id]
        assert found.n_success + found.n_failed == len(own)
        assert found.estimated_tokens == sum(len(d.markdown.split()) for d in own)
