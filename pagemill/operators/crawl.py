"""Bounded breadth-first walks over captured pages, many at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.urls import normalize_url
from pagemill.operators.html import page_links
from pagemill.operators.robots import AGENT, BLOCKED, robots_table, robots_verdicts
from pagemill.operators.stage import Stage
from pagemill.sources.captures import fetch_outcomes

VISIT_ORDER = ["crawl_id", "depth", "ord"]


def crawl_visits(
    seeds: DataFrame,
    fetches: DataFrame,
    robots: DataFrame | None = None,
    agent: str = AGENT,
    keep_query: bool = False,
    resolve_against: str = "normalized",
    link_buckets: int | None = None,
) -> DataFrame:
    """Every URL each crawl reaches, with its depth and place in the visit order.

    ``crawl_id, depth, ord, requested_url`` and the seed's settings.  ``ord`` lists the positions
    of the links that led to the URL; among URLs of one depth it sorts in the order a first-in
    first-out walk would visit them, so no level needs to be numbered as a whole.

    Links are extracted once, while the pages are read.  Each level is a robots verdict on the
    frontier (never on all links), one join of the frontier with the links, one aggregate (combined before its shuffle, so a much-linked URL is no hot key) and one anti-join
    with the levels before it.  Levels are written to the shared folder; the driver only asks
    whether the last one is empty.

    ``link_buckets`` stores the links clustered by their page, so that levels too big to be
    broadcast move the frontier only.  Leave it out when very many crawls visit one URL at the same
    depth: adaptive execution can split such a key only in a join that shuffles both sides.
    """
    spark = seeds.sparkSession
    stage = Stage(spark, "crawl")
    outcomes = fetch_outcomes(fetches, keep_query)
    pages = outcomes.where(F.col("error").isNull())
    links = page_links(
        pages,
        key="requested_url",
        html="content",
        base="url" if resolve_against == "normalized" else "raw_url",
        resolve_against=resolve_against,
        keep_query=keep_query,
    ).select(F.col("requested_url").alias("source"), "pos", "target")
    if link_buckets:
        links = stage.save_clustered(links, "links", "source", link_buckets)
    else:
        links = stage.save(links, "links")
    verdicts = None if robots is None else stage.save(robots_table(robots, agent), "robots")

    first = seeds.select(
        "crawl_id",
        F.lit(0).alias("depth"),
        F.array().cast("array<int>").alias("ord"),
        normalize_url(F.col("start_url"), keep_query).alias("requested_url"),
        "start_url",
        "max_depth",
        "delay_ms",
        "respect_robots",
    )
    level = stage.save(first, "level-0")
    names = ["level-0"]
    deepest = level.agg(F.max("max_depth")).first()[0] or 0
    settings = ["start_url", "max_depth", "delay_ms", "respect_robots"]
    for depth in range(1, deepest + 1):
        reached = (
            _not_blocked(level.where(F.col("max_depth") >= depth), verdicts)
            .join(links, F.col("requested_url") == F.col("source"))
            .groupBy("crawl_id", "target")
            .agg(
                F.min(F.concat("ord", F.array("pos"))).alias("ord"),
                *(F.any_value(c).alias(c) for c in settings),
            )
            .withColumnRenamed("target", "requested_url")
        )
        seen = stage.load(names, first).select("crawl_id", "requested_url")
        fresh = reached.join(seen, ["crawl_id", "requested_url"], "left_anti")
        level = stage.save(
            fresh.withColumn("depth", F.lit(depth)).select(first.columns), f"level-{depth}"
        )
        if level.isEmpty():
            break
        names.append(f"level-{depth}")
    return stage.load(names, first)


def _not_blocked(visits: DataFrame, verdicts: DataFrame | None) -> DataFrame:
    if verdicts is None:
        return visits
    judged = robots_verdicts(visits, verdicts, "requested_url")
    return judged.where(F.col("allowed") | ~F.col("respect_robots")).drop("allowed")


def bounded_crawl(
    seeds: DataFrame,
    fetches: DataFrame,
    robots: DataFrame | None = None,
    agent: str = AGENT,
    keep_query: bool = False,
    resolve_against: str = "normalized",
    dedupe_final_url: bool = False,
    link_buckets: int | None = None,
) -> DataFrame:
    """Result of every page attempt of every crawl, the walk of :func:`crawl_visits` included.

    ``seeds`` has ``crawl_id, start_url, max_depth, delay_ms, respect_robots``.  ``fetches`` has one
    record per normalised requested URL, as :func:`as_fetches` makes them.

    A URL that was not captured is a transport error, one that robots rules forbid a 403 without
    content.  ``dedupe_final_url`` keeps only the first result of each final URL in a crawl.
    """
    visits = crawl_visits(seeds, fetches, robots, agent, keep_query, resolve_against, link_buckets)
    return crawl_results(visits, fetches, robots, agent, keep_query, dedupe_final_url)


def crawl_results(
    visits: DataFrame,
    fetches: DataFrame,
    robots: DataFrame | None = None,
    agent: str = AGENT,
    keep_query: bool = False,
    dedupe_final_url: bool = False,
) -> DataFrame:
    outcomes = fetch_outcomes(fetches, keep_query).drop("raw_url")
    judged = visits
    if robots is not None:
        judged = robots_verdicts(visits, robots_table(robots, agent), "requested_url")
    else:
        judged = judged.withColumn("allowed", F.lit(True))
    judged = judged.withColumn("blocked", F.col("respect_robots") & ~F.col("allowed")).drop("allowed")
    joined = judged.join(outcomes, "requested_url", "left")
    blocked, missing = F.col("blocked"), F.col("status_code").isNull()
    results = joined.select(
        *VISIT_ORDER,
        "requested_url",
        F.when(blocked | missing, F.col("requested_url")).otherwise(F.col("url")).alias("url"),
        F.when(~blocked, F.col("content")).alias("content"),
        F.when(~blocked, F.col("title")).alias("title"),
        F.when(blocked, 403).when(missing, 0).otherwise(F.col("status_code")).alias("status_code"),
        F.when(blocked, F.lit(BLOCKED))
        .when(missing, F.lit("Page was not captured"))
        .otherwise(F.col("error"))
        .alias("error"),
        F.coalesce(F.col("is_redirect") & ~blocked, F.lit(False)).alias("is_redirect"),
        "start_url", "max_depth", "delay_ms", "respect_robots",
    )
    if dedupe_final_url:
        by_url = Window.partitionBy("crawl_id", "url").orderBy("depth", "ord")
        results = results.withColumn("_n", F.row_number().over(by_url)).where("_n = 1").drop("_n")
    return results


def result_links(
    results: DataFrame, fetches: DataFrame, keep_query: bool = False, resolve_against: str = "normalized"
) -> DataFrame:
    """Links of every page that a crawl got, in document order, copies kept.

    ``crawl_id, depth, ord, requested_url, pos, target``.  The links of a page are found once, however many
    crawls got it, and joined by the URL asked for.
    """
    pages = fetch_outcomes(fetches, keep_query).where(F.col("error").isNull())
    links = page_links(
        pages, "requested_url", "content", "url" if resolve_against == "normalized" else "raw_url",
        resolve_against, keep_query,
    ).select("requested_url", "pos", "target")
    got = results.where(F.coalesce(F.col("error"), F.lit("")) == "")
    return got.select(*VISIT_ORDER, "requested_url").join(links, "requested_url").select(
        *VISIT_ORDER, "requested_url", "pos", "target"
    )


def running_totals(
    rows: DataFrame,
    amounts: dict[str, str],
    group: str = "crawl_id",
    order: tuple[str, ...] = ("depth", "ord"),
    include_self: bool = True,
) -> DataFrame:
    """Running sums within each group, for groups of any size.

    ``amounts`` maps new columns to the columns they sum.  A window over a whole group would put
    it into one task.  Here the rows are range-partitioned, each slice of a group is summed by
    itself, and the few slice totals before it are added.  The slices are written down first:
    their bounds come from a sample and must not change between the two readings.
    """
    stage = Stage(rows.sparkSession, "running")
    sliced = stage.save(
        rows.repartitionByRange(group, *order).withColumn("_slice", F.spark_partition_id()), "slices"
    )
    totals = sliced.groupBy(group, "_slice").agg(
        *(F.sum(c).alias(f"_sum_{n}") for n, c in amounts.items())
    )
    earlier = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        group,
        "_slice",
        *(F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_before_{n}") for n in amounts),
    )
    within = (
        Window.partitionBy(group, "_slice").orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0 if include_self else -1)
    )
    return (
        sliced.join(offsets, [group, "_slice"])
        .withColumns(
            {
                n: F.coalesce(F.sum(c).over(within), F.lit(0)) + F.col(f"_before_{n}")
                for n, c in amounts.items()
            }
        )
        .drop("_slice", *(f"_before_{n}" for n in amounts))
    )


def fetch_plan(results: DataFrame) -> DataFrame:
    """When each page would be asked for: one pause after every page without error."""
    paused = results.select(
        *VISIT_ORDER,
        "requested_url",
        F.when(F.coalesce(F.col("error"), F.lit("")) == "", F.col("delay_ms"))
        .otherwise(F.lit(0.0))
        .alias("pause_ms"),
    )
    return running_totals(paused, {"offset_ms": "pause_ms"}, include_self=False)


def crawl_progress(documents: DataFrame) -> DataFrame:
    """Running page, token and byte counts of each crawl in visit order."""
    counted = documents.select(
        *VISIT_ORDER, "url", "token_count", "byte_size", F.lit(1).cast("bigint").alias("one")
    )
    return running_totals(
        counted,
        {"pages_so_far": "one", "tokens_so_far": "token_count", "bytes_so_far": "byte_size"},
    ).drop("one")


def in_visit_order(results: DataFrame) -> DataFrame:
    """The one order of the walk: a range-partitioned sort by crawl, depth and ``ord``."""
    return results.orderBy(*VISIT_ORDER)
