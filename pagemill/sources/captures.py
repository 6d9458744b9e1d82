"""Captured pages and fetch records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.urls import normalize_url
from pagemill.operators.documents import has_error
from pagemill.operators.html import extract_title


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Captured pages: ``page_id, url, html``."""
    return spark.read.parquet(path).select("page_id", "url", "html")


def save_bucketed_pages(pages: DataFrame, table: str, buckets: int, key: str = "page_id") -> None:
    """Store pages clustered by key.

    Operators that read the table with ``colocated=True`` then need no shuffle at all, which pays
    when the same pages are processed more than once.
    """
    pages.write.bucketBy(buckets, key).sortBy(key).mode("overwrite").saveAsTable(table)


def as_fetches(pages: DataFrame, keep_query: bool = False) -> DataFrame:
    """One successful fetch record per normalised URL; the lowest ``page_id`` wins.

    The winners are found on URLs alone, so page bodies are shuffled at most once, and copies of
    one URL are reduced before the shuffle however many there are.
    """
    keyed = pages.select(
        "page_id", "url", "html", normalize_url(F.col("url"), keep_query).alias("requested_url")
    )
    winners = keyed.groupBy("requested_url").agg(F.min("page_id").alias("page_id")).select("page_id")
    return keyed.join(winners, "page_id", "left_semi").select(
        "page_id",
        "requested_url",
        F.col("url").alias("final_url"),
        F.lit(200).alias("status_code"),
        F.col("html").alias("content"),
        F.lit(None).cast("string").alias("error"),
    )


def fetch_outcomes(fetches: DataFrame, keep_query: bool = False) -> DataFrame:
    """Typed result of each fetch record; no join, no shuffle.

    A status outside 2xx is an HTTP error and status 0 or NULL a transport error; both lose body
    and title and keep the requested URL.  A success has the normalised final URL.
    """
    status = F.coalesce(F.col("status_code"), F.lit(0))
    told = F.when(has_error(F.col("error")), F.col("error"))
    error = F.when(
        ~status.between(200, 299),
        F.coalesce(told, F.when(status == 0, F.lit("No response")).otherwise(
            F.concat(F.lit("HTTP "), status.cast("string")))),
    ).otherwise(told)
    final = normalize_url(F.col("final_url"), keep_query)
    typed = fetches.withColumns({"_error": error, "_status": status, "_final": final})
    good = F.col("_error").isNull()
    content = F.when(good, F.col("content"))
    return typed.select(
        "requested_url",
        F.when(good, F.col("_final")).otherwise(F.col("requested_url")).alias("url"),
        F.when(good, F.col("final_url")).alias("raw_url"),
        F.col("_status").cast("int").alias("status_code"),
        content.alias("content"),
        extract_title(content).alias("title"),
        F.col("_error").alias("error"),
        (good & (normalize_url(F.col("requested_url"), keep_query) != F.col("_final"))).alias(
            "is_redirect"
        ),
    )
