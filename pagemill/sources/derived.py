"""Tables derived from the captured ones, in SQL that Spark and other engines both run.

They add what the captured pages lack: pages that link to each other, richer HTML, and Markdown
with the defects the line rules look for.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.urls import url_host
from pagemill.operators.crawl import running_totals
from pagemill.operators.stage import Stage
from pagemill.sources.captures import as_fetches

# The captured pages with links between them put into their text: on its host, page j leads to pages 2j+1, 2j+2
# and one of the first 50; another link leads to the page with the next id, on any host.  Some answers are
# errors, some pages moved on their host or to another one, some hold boilerplate only.
SITE_SQL = """
with named as (select host as grp, j as num, url from {numbered} union all select '' as grp, page_id as num, url from {numbered}),
wanted as (
  select page_id, 1 as k, host as grp, 2 * j + 1 as num from {numbered} union all
  select page_id, 2 as k, host as grp, 2 * j + 2 as num from {numbered} union all
  select page_id, 3 as k, host as grp, (j * 7) % 50 as num from {numbered} union all
  select page_id, 4 as k, '' as grp, page_id + 1 as num from {numbered} union all
  select page_id, 5 as k, host as grp, j - 1 as num from {numbered} where j % 13 = 12 union all
  select page_id, 6 as k, '' as grp, page_id - 1 as num from {numbered} where j % 7 = 3),
met as (
  select w.page_id, max(case when w.k = 1 then n.url end) as to_left, max(case when w.k = 2 then n.url end) as to_right,
    max(case when w.k = 3 then n.url end) as to_back, max(case when w.k = 4 then n.url end) as to_other,
    max(case when w.k = 5 then n.url end) as moved, max(case when w.k = 6 then n.url end) as left_host
  from wanted w join named n on n.grp = w.grp and n.num = w.num group by w.page_id),
linked as (
  select n.page_id, n.requested_url, coalesce(m.left_host, m.moved, n.url) as final_url, case when n.j % 11 = 10 then 500 else 200 end as status_code,
    replace(p.html, '<article>', '<article><p>' || coalesce('<a href="' || m.to_left || '">left page</a> ', '')
      || coalesce('<a href="' || regexp_extract(m.to_right, '^[a-z]+://[^/?#]*([^?#]*)', 1) || '?q=1">right page</a> ', '')
      || coalesce('<a href="' || m.to_back || '/#x">back page</a> ', '') || coalesce('<a href="' || m.to_other || '">other page</a> ', '')
      || '<a href="mailto:a@b.c">mail us</a></p>') as html
  from {numbered} n join {pages} p on p.page_id = n.page_id left join met m on m.page_id = n.page_id)
select page_id, requested_url, final_url, status_code,
       case when status_code = 200 then case when page_id % 10 = 5
         then replace(replace(replace(html, '<article>', '<aside>'), '</article>', '</aside>'), '<div class="ad">', '<div class="advert">')
         else html end end as content,
       case when status_code = 200 then null else 'HTTP 500' end as error
from linked
"""

SEEDS_SQL = """
select page_id as crawl_id, concat(upper(substr(url, 1, 4)), substr(url, 5)) as start_url,
       cast(case page_id when 0 then 0 when 1 then 1 when 2 then 4 when 3 then 8
            else page_id % 3 end as int) as max_depth,
       cast(250 as double) as delay_ms,
       page_id % 5 <> 4 as respect_robots
from {pages}
"""

# Every page with a richer article: lists, links, code and images made of its title and address.
RICH_SQL = """
with titled as (select page_id, url, html, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) as title from {pages})
select page_id, replace(replace(html, '<article>', concat('<header><h1>', title, '</h1></header>',
  case when page_id % 2 = 0 then '<div role="navigation"><p>role junk</p></div>'
       else '<div id="my-cookie-bar"><p>id junk</p></div>' end,
  case when page_id % 3 = 0 then '<main>' when page_id % 3 = 1 then '<div class="a content b">'
       else '<div id="content">' end,
  '<h2>Part of ', title, '</h2><p>See <a href="x?p=', cast(page_id as {text}),
  '" title="', title, '">the_link to ', title, '</a> and <b>', title, '</b>.</p>',
  '<div class="x-advert-y"><p>class junk <span>', title, '</span></p></div>',
  '<ul><li>first ', title, '<ul><li>nested ', title, '</li></ul></li><li>second ', title, '</li></ul>',
  '<ol start="', cast(page_id % 7 + 1 as {text}), '"><li>third ', title, '</li><li>fourth ', title, '</li></ol>',
  '<pre>for  x:', chr(10), '  ', title, '(*x)</pre><p>Call <code>f_', cast(page_id as {text}), '()</code> now <img src="', url, '.png" alt="', title, '"></p>')),
  '</article>', case when page_id % 3 = 0 then '</main>' else '</div>' end) as html
from titled
"""

# Every page with a list, a table, terms and a menu before its article, with or without their end tags.
OPTIONAL_SQL = """
select page_id, replace(html, '<article>', concat('<article><ul><li class="social">', url,
  '<ul><li>', url, {ends:li}, '</ul>', {ends:li}, '<li>', url, {ends:li}, '</ul><table><tr><td class="sidebar">', url, {ends:td}, '<td><p>', url, '</p>',
  {ends:td}, {ends:tr}, '<tr class="sidebar"><td>', url, {ends:td}, {ends:tr}, '<tr><th>', url, {ends:th}, {ends:tr},
  '</table><dl><dt class="related">', url, {ends:dt}, '<dd>', url, {ends:dd}, '</dl><div><nav>', url, {ends:nav}, '</div>')) as html
from {pages}
"""

# Every page with close tags that end what is around them, cross each other, or end nothing.
MISNESTED_SQL = """
select page_id, replace(html, '<article>', concat('<article><section><div class="cookie">', url, '</section><p>', url,
  '</p></div></nav><table><tr><td><div class="sidebar">', url, '</td><td>', url, '</div></td></tr></table><p>', url,
  '<b><i>', url, '</b>', url, '</i></p><ul><li class="social">', url, '<li><b>', url, '<li>', url, '</ul></b><div><p class="advert">', url, '<div>', url,
  '</div><nav><span>', url, '</div>')) as html
from {pages}
"""

DIRTY_SQL = """
select doc_id, concat(text,
  case when doc_id % 5 = 0 then concat(chr(10), '```', chr(10), 'x=1', chr(10), '```', chr(10), 'ab') else '' end,
  case when doc_id % 7 = 0 then concat(chr(10), repeat('Ab1+', 30)) else '' end,
  case when doc_id % 11 = 0 then concat(chr(10), repeat('-', 20)) else '' end,
  case when doc_id % 3 = 0 then concat(chr(10), chr(10), chr(10), chr(10), '- a', chr(10), '4. a', chr(10), '3. a', chr(10), '# A') else '' end) as md
from {documents}
"""

ROBOTS_SQL = """
with o as (select distinct regexp_extract(lower({column}), '^[a-z]+://[^/?#]+', 0) as origin from {urls}),
v as (select origin, (length(origin) + 5 + ascii(substr(origin, 10, 1))) % 10 as v from o)
select origin,
  case v when 5 then 401 when 6 then 404 when 7 then 500 when 8 then cast(null as int) else 200 end as http_status,
  case v
    when 0 then concat('User-agent: *', chr(10), 'Disallow: /en/1', chr(10), 'Allow: /en', chr(10))
    when 1 then concat('User-agent: other', chr(10), 'User-agent: PageMill', chr(10),
                       'Disallow: /p/4 # four', chr(10), 'Disallow: /en/2', chr(10), chr(10),
                       'User-agent: *', chr(10), 'Disallow: /', chr(10))
    when 2 then concat('Disallow: /', chr(10), chr(10), 'User-agent: *', chr(10), 'Disallow:', chr(10))
    when 3 then concat('User-agent: *', chr(10), chr(10), 'Disallow: /', chr(10))
    when 4 then concat('User-agent: *', chr(10), '# note', chr(10), 'Disallow: /%65n/', chr(10),
                       'Disallow: *', chr(10), 'disallow : /p/5', chr(10))
    when 9 then concat('User-agent: pagemill', chr(10), 'Crawl-delay: 3', chr(10), chr(10),
                       'User-agent: *', chr(10), 'Disallow: /', chr(10))
  end as body
from v
"""


def optional_sql(ends: bool) -> str:
    """``OPTIONAL_SQL`` with the end tags that may be left out, or without them."""
    return re.sub(r"\{ends:(\w+)\}", r"'</\1>'" if ends else "''", OPTIONAL_SQL)


def _run(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    return spark.sql(sql.replace("{text}", "string"), **tables)


def site(pages: DataFrame) -> DataFrame:
    """Fetch records of the captured pages, linked to each other; one per normalised URL.

    Pages are numbered within their hosts slice by slice, so a host with a third of all pages is no single task.
    """
    once = as_fetches(pages).select(
        "page_id", "requested_url", F.col("final_url").alias("url"), url_host(F.col("final_url")).alias("host"),
        F.lit(1).cast("bigint").alias("one"),
    )
    numbered = running_totals(once, {"j": "one"}, "host", ("page_id",), include_self=False).drop("one")
    made = _run(pages.sparkSession, SITE_SQL, numbered=numbered, pages=pages.select("page_id", "html"))
    return Stage(pages.sparkSession, "site").save(made, "pages")


def seeds(pages: DataFrame) -> DataFrame:
    """One crawl per page; the first four go 0, 1, 4 and 8 levels deep."""
    return _run(pages.sparkSession, SEEDS_SQL, pages=pages.select("page_id", "url"))


def rich_pages(pages: DataFrame) -> DataFrame:
    return _run(pages.sparkSession, RICH_SQL, pages=pages.select("page_id", "url", "html"))


def optional_pages(pages: DataFrame) -> DataFrame:
    """Pages some of whose elements have no end tag."""
    return _run(pages.sparkSession, optional_sql(False), pages=pages.select("page_id", "url", "html"))


def misnested_pages(pages: DataFrame) -> DataFrame:
    """Pages whose close tags do not stand where their elements end."""
    return _run(pages.sparkSession, MISNESTED_SQL, pages=pages.select("page_id", "url", "html"))


def dirty_lines(documents: DataFrame) -> DataFrame:
    return _run(documents.sparkSession, DIRTY_SQL, documents=documents.select("doc_id", "text"))


def robots_bodies(urls: DataFrame, column: str = "url") -> DataFrame:
    """One robots answer for each origin that occurs."""
    sql = ROBOTS_SQL.replace("{column}", column)
    return _run(urls.sparkSession, sql, urls=urls.select(column))
