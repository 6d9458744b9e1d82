"""Documents of a crawl, its statistics and report, the combined corpus and the file names."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import fixed2, token_count
from pagemill.functions.urls import malformed, url_netloc
from pagemill.operators.crawl import VISIT_ORDER
from pagemill.operators.documents import error_page, has_error, page_documents
from pagemill.operators.html import parts_of
from pagemill.operators.stage import Stage
from pagemill.sources.captures import fetch_outcomes

# Fixed value: what stands between two documents.
SEPARATOR = "\n\n---\n\n"


def crawl_documents(
    results: DataFrame, fetches: DataFrame, keep_query: bool = False, texts: bool = True, **options
) -> DataFrame:
    """Document of every result, in the columns of both.

    A page seen by many crawls is converted once: Markdown is made per captured page that was
    visited, then joined by requested URL.  Error pages are written from the result alone.  The
    documents are written to the shared folder, because statistics, report and corpus all read
    them and conversion is the costly part of a job.  Without ``texts`` only their sizes are
    joined and written: statistics need no more.
    """
    visited = results.where(~has_error(F.col("error"))).select("requested_url").distinct()
    wanted = fetch_outcomes(fetches, keep_query).join(visited, "requested_url", "left_semi")
    options = {"parts": parts_of(fetches, "content")} | options
    made = page_documents(wanted, key="requested_url", **options).select(
        "requested_url",
        *([F.col("markdown").alias("_markdown")] if texts else []),
        F.col("token_count").alias("_tokens"),
        F.col("byte_size").alias("_bytes"),
    )
    joined = results.drop("content").join(made, "requested_url", "left")
    failed = has_error(F.col("error"))
    page = error_page(F.col("url"), F.col("error"))
    documents = joined.select(
        *results.drop("content").columns,
        *([F.when(failed, page).otherwise(F.coalesce("_markdown", F.lit(""))).alias("markdown")] if texts else []),
        F.when(failed, token_count(page)).otherwise(F.coalesce("_tokens", F.lit(0))).alias("token_count"),
        F.when(failed, F.lit(0)).otherwise(F.coalesce("_bytes", F.lit(0))).cast("bigint").alias("byte_size"),
    )
    return Stage(results.sparkSession, "documents").save(documents, "all")


def failure_label(url: Column, status: Column, error: Column) -> Column:
    return F.concat(
        url, F.lit(" (Status: "), status.cast("string"), F.lit(", Error: "), error, F.lit(")")
    )


def crawl_outcomes(results: DataFrame) -> DataFrame:
    """The success and failure lists, one row per URL, in visit order within a crawl.

    They are rows, not arrays: a crawl can have more pages than one row should hold.
    """
    failed = has_error(F.col("error"))
    return results.select(
        *VISIT_ORDER,
        (~failed).alias("succeeded"),
        F.when(failed, failure_label(F.col("url"), F.col("status_code"), F.col("error")))
        .otherwise(F.col("url"))
        .alias("label"),
    )


def crawl_stats(documents: DataFrame, duration_seconds: float | None = None) -> DataFrame:
    """Counts and totals of each crawl and its settings.

    Sums and counts only, combined before the shuffle.  The duration is the caller's measure.
    """
    failed = has_error(F.col("error"))
    return documents.groupBy("crawl_id").agg(
        F.any_value("start_url").alias("start_url"),
        F.any_value("max_depth").alias("max_depth"),
        F.any_value("delay_ms").alias("delay_ms"),
        F.any_value("respect_robots").alias("respect_robots"),
        F.count_if(~failed).alias("n_success"),
        F.count_if(failed).alias("n_failed"),
        F.sum("byte_size").alias("total_size_bytes"),
        F.sum("token_count").alias("estimated_tokens"),
        F.lit(duration_seconds).cast("double").alias("duration_seconds"),
    )


def stats_summary(stats: DataFrame) -> DataFrame:
    return stats.withColumns(
        {
            "n_total": F.col("n_success") + F.col("n_failed"),
            "total_kb": F.col("total_size_bytes") / F.lit(1024.0),
        }
    )


def stats_report(stats: DataFrame, outcomes: DataFrame, run_at: datetime) -> DataFrame:
    """Markdown report of each crawl, line by line.

    ``crawl_id, part, depth, ord, line``; the report is the lines in the order of these columns.
    """
    s = stats_summary(stats)
    tick = F.lit("`")

    def say(label: str, value: Column, unit: str = "") -> Column:
        return F.concat(F.lit(f"- **{label}:** `"), value, F.lit(f"{unit}`"))

    kilobytes = fixed2(F.col("total_size_bytes").cast("decimal(20,0)") * F.lit("0.0009765625").cast("decimal(11,10)"))
    seconds = F.coalesce("duration_seconds", F.lit(0.0)).cast("decimal(30,12)")
    start = F.coalesce("start_url", F.lit(""))
    rule = [F.lit(""), F.lit("---"), F.lit("")]
    head = [
        F.concat(F.lit("# Crawl Statistics for `"), start, tick),
        F.lit(f"**Crawl Date:** `{run_at:%Y-%m-%d %H:%M:%S}`"),
        *rule,
        F.lit("## Summary"),
        say("Total URLs Processed", F.col("n_total").cast("string")),
        say("Successful Pages", F.col("n_success").cast("string")),
        say("Failed Pages", F.col("n_failed").cast("string")),
        say("Total Duration", fixed2(seconds), " seconds"),
        say("Total Content Size", kilobytes, " KB"),
        say("Estimated Tokens", F.format_number("estimated_tokens", 0)),
        *rule,
        F.lit("## Configuration"),
        say("Start URL", start),
        say("Max Depth", F.col("max_depth").cast("string")),
        say("Delay Between Requests", F.bround("delay_ms", 0).cast("bigint").cast("string"), " ms"),
        say("Respect robots.txt", F.when(F.col("respect_robots"), "True").otherwise("False")),
        *rule,
        F.concat(F.lit("## Successful URLs ("), F.col("n_success").cast("string"), F.lit(")")),
    ]
    middle = [*rule, F.concat(F.lit("## Failed URLs ("), F.col("n_failed").cast("string"), F.lit(")"))]
    none = F.when(F.col("n_failed") == 0, F.array(F.lit("None."))).otherwise(
        F.array().cast("array<string>")
    )
    fixed = s.select(
        "crawl_id",
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("part"), F.array(*head).alias("lines")),
                F.struct(F.lit(2).alias("part"), F.concat(F.array(*middle), none).alias("lines")),
            )
        ).alias("p"),
    ).select("crawl_id", "p.part", F.posexplode("p.lines").alias("depth", "line"))
    listed = outcomes.select(
        "crawl_id",
        F.when(F.col("succeeded"), 1).otherwise(3).alias("part"),
        "depth",
        "ord",
        F.concat(F.lit("- `"), F.col("label"), tick).alias("line"),
    )
    return fixed.select(
        "crawl_id", "part", "depth", F.array().cast("array<int>").alias("ord"), "line"
    ).unionByName(listed)


def combine_corpus(
    documents: DataFrame, separator: str = SEPARATOR, keep_empty: bool = False
) -> DataFrame:
    """Chunks whose concatenation in visit order is the combined document of a crawl.

    ``crawl_id, depth, ord, chunk``.  Empty documents are left out unless ``keep_empty``.  The
    separator stands before every chunk but the first; the first is found by an aggregate and
    marked by a join on the full, unique key, so a big crawl is never gathered in one place.
    """
    kept = documents.select(*VISIT_ORDER, "markdown")
    if not keep_empty:
        kept = kept.where(F.col("markdown") != "")
    firsts = (
        kept.groupBy("crawl_id")
        .agg(F.min(F.struct("depth", "ord")).alias("f"))
        .select("crawl_id", "f.depth", "f.ord", F.lit(True).alias("_first"))
    )
    return kept.join(firsts, VISIT_ORDER, "left").select(
        *VISIT_ORDER,
        F.when(F.col("_first"), F.col("markdown"))
        .otherwise(F.concat(F.lit(separator), F.col("markdown")))
        .alias("chunk"),
    )


def output_name(start_url: Column, run_date: date) -> Column:
    """File name of a crawl: its host with dots and dashes as underscores, and the date."""
    stamp = F.lit(f"{run_date:%d%m%y}.md")
    return (
        F.when(F.coalesce(start_url, F.lit("")) == "", F.lit("crawled_content.md"))
        .when(malformed(start_url), F.concat(F.lit("crawl_output-"), stamp))
        .otherwise(F.concat(F.translate(url_netloc(start_url), ".-", "__"), F.lit("-"), stamp))
    )


def report_name(name: Column) -> Column:
    return F.replace(name, F.lit(".md"), F.lit("_stats.md"))


def write_corpus(documents: DataFrame, path: str, separator: str = SEPARATOR,
                 keep_empty: bool = False) -> None:
    """Write the combined documents as text, one folder per crawl.

    Part files of a folder, read by name, are the combined document and one final line break.
    Rows are range-partitioned in visit order, so a big crawl becomes several files.
    """
    if not separator.startswith("\n"):
        raise ValueError("the separator must start with a line break")
    chunks = combine_corpus(documents, separator[1:], keep_empty)
    (
        chunks.repartitionByRange(*VISIT_ORDER)
        .sortWithinPartitions(*VISIT_ORDER)
        .select("crawl_id", "chunk")
        .write.mode("overwrite").partitionBy("crawl_id").option("lineSep", "\n").text(path)
    )


def write_report(report: DataFrame, path: str) -> None:
    """Write the reports as text, one folder per crawl, lines in order."""
    order = ["crawl_id", "part", "depth", "ord"]
    (
        report.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("crawl_id", "line")
        .write.mode("overwrite").partitionBy("crawl_id").text(path)
    )


def publish(folder: str, out: str, names: DataFrame) -> int:
    """Give the text files of a written folder their names in ``out``: the last step of a sink.

    ``folder`` comes from :func:`write_corpus` or :func:`write_report`, ``names`` has ``crawl_id, file_name``, one row per
    crawl.  A crawl of one file gets the name as it is; the files of a bigger one get a number before the
    ending, in their order, and so do crawls that share a name.  Each file appears whole, by one rename in the
    store's own file system.  The driver handles names only, one crawl at a time.  Returns the number of files.
    """
    spark = names.sparkSession
    Path = spark._jvm.org.apache.hadoop.fs.Path
    root = Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    target = Path(out)
    files.mkdirs(target)
    sharing = names.groupBy("file_name").agg(F.count(F.lit(1)).alias("n_sharing"))
    n_files = 0
    for row in names.join(sharing, "file_name").orderBy("crawl_id").toLocalIterator():
        place = Path(root, f"crawl_id={row['crawl_id']}")
        if not files.exists(place):
            continue
        parts = sorted(f.getPath().getName() for f in files.listStatus(place) if f.getPath().getName().startswith("part-"))
        stem, dot, ending = row["file_name"].rpartition(".")
        for k, part in enumerate(parts):
            marks = [str(row["crawl_id"])] * (row["n_sharing"] > 1) + [f"{k + 1:05d}"] * (len(parts) > 1)
            name = "-".join([stem, *marks]) + dot + ending
            # Named by its parts, since a name may hold a colon.
            named = Path(target.toUri().getScheme(), target.toUri().getAuthority(), f"{target.toUri().getPath()}/{name}")
            if files.exists(named) or not files.rename(Path(place, part), named):
                raise FileExistsError(f"{out}/{name}")
            n_files += 1
    return n_files


def publish_crawls(
    documents: DataFrame, out: str, run_at: datetime, duration_seconds: float | None = None, separator: str = SEPARATOR,
) -> None:
    """Write the content and the report of every crawl side by side, ``X.md`` and ``X_stats.md``."""
    stage = Stage(documents.sparkSession, "published")
    stats = crawl_stats(documents, duration_seconds)
    name = output_name(F.col("start_url"), run_at.date())
    names = stage.save(stats.select("crawl_id", name.alias("file_name")), "names")
    write_corpus(documents, f"{stage.root}/content", separator)
    write_report(stats_report(stats, crawl_outcomes(documents), run_at), f"{stage.root}/report")
    publish(f"{stage.root}/content", out, names)
    publish(f"{stage.root}/report", out, names.withColumn("file_name", report_name(F.col("file_name"))))
