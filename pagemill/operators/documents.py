"""Documents: one Markdown text per page attempt, with a heading, or an error page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import byte_size, is_blank, token_count
from pagemill.operators.html import (
    main_content,
    match_elements,
    page_tokens,
    text_token_array,
    title_of,
)
from pagemill.operators.lines import clean_lines
from pagemill.operators.markdown import content_blocks, join_blocks, render_blocks


def page_markdown(
    pages: DataFrame,
    key: str = "page_id",
    html: str = "html",
    carry: list[str] | None = None,
    junk_rules=None,
    content_rules=None,
    colocated: bool = False,
    clean: bool = True,
    toks: str | None = None,
    parts: int | None = None,
    **line_rules,
) -> DataFrame:
    """HTML to clean Markdown: ``key, markdown`` and the ``carry`` columns, one row per page.

    One shuffle, of pages without scripts and comments; none at all when ``colocated``.
    """
    carry = carry or []
    tokens = match_elements(page_tokens(pages, key, html, carry, colocated, toks, parts), key)
    kept = main_content(tokens, key, content_rules, junk_rules)
    texts = join_blocks(render_blocks(content_blocks(kept, key), key), key)
    if clean:
        texts = clean_lines(texts, key, "md", "markdown", ["note"], colocated=True, **line_rules)
    else:
        texts = texts.withColumnRenamed("md", "markdown")
    return texts.select(key, "markdown", *(F.col(f"note.{c}").alias(c) for c in carry))


def with_metadata(title: Column, url: Column, markdown: Column) -> Column:
    return F.concat(
        F.lit("# "), title, F.lit("\n**Source:** `"), url, F.lit("`\n\n---\n\n"), markdown
    )


def error_page(url: Column, error: Column) -> Column:
    return F.concat(
        F.lit("# Error Processing Page\n\n**URL:** `"), url,
        F.lit("`\n**Error:** "), error, F.lit("\n"),
    )


def has_error(error: Column) -> Column:
    """An empty message counts as no error."""
    return F.coalesce(error, F.lit("")) != ""


def document_text(
    markdown: Column, url: Column, title: Column, error: Column, include_metadata: bool = True
) -> Column:
    """Error page, nothing for a blank page, or the Markdown under its heading, in that order."""
    body = (
        F.when(F.coalesce(title, F.lit("")) != "", with_metadata(title, url, markdown))
        .otherwise(markdown)
        if include_metadata
        else markdown
    )
    return (
        F.when(has_error(error), error_page(url, error))
        .when(is_blank(F.coalesce(markdown, F.lit(""))), F.lit(""))
        .otherwise(body)
    )


def convert_failure(message: Column) -> Column:
    """The text that stands for a page whose conversion failed; such a page is still a success."""
    return F.concat(F.lit("Error processing HTML content: "), message)


# Encodings that bodies are read in; UTF-8 where none is named.
_CHARSETS = {
    "utf-8": "UTF-8", "utf8": "UTF-8", "us-ascii": "US-ASCII", "ascii": "US-ASCII", "iso-8859-1": "ISO-8859-1",
    "latin-1": "ISO-8859-1", "latin1": "ISO-8859-1", "utf-16": "UTF-16", "utf-16le": "UTF-16LE", "utf-16be": "UTF-16BE",
}


def decode_bodies(
    pages: DataFrame, body: str = "body", charset: str | None = None, html: str = "html", convert_error: str = "convert_error",
    deepest: int = 100_000,
) -> DataFrame:
    """Add the text of captured bytes and, where they cannot be converted, what is wrong with them.

    ``html`` is NULL exactly where ``convert_error`` says something: an encoding that is not known, bytes that are
    none of it, or more open tags without a close tag than ``deepest``.  No row fails the job.  Such a page is a
    success whose document is the message, see :func:`page_documents`.  A NULL body stays NULL and is no failure.
    """
    raw = F.col(body)
    named = F.lower(F.trim(F.col(charset))) if charset else F.lit(None).cast("string")
    known = F.coalesce(F.nullif(named, F.lit("")), F.lit("utf-8"))
    # A character outside ASCII shows in two's complement bytes; UTF-16 comes in pairs of bytes.
    fits = (
        F.when(known.isin([c for c, n in _CHARSETS.items() if n == "UTF-8"]), F.is_valid_utf8(raw.cast("string")))
        .when(known.isin([c for c, n in _CHARSETS.items() if n == "US-ASCII"]), F.is_valid_utf8(raw.cast("string")) & (F.octet_length(raw) == F.length(raw.cast("string"))))
        .when(known.isin([c for c, n in _CHARSETS.items() if n.startswith("UTF-16")]), F.octet_length(raw) % 2 == 0)
        .otherwise(F.lit(True))
    )
    text = F.lit(None).cast("string")
    for name in sorted(set(_CHARSETS.values())):
        text = F.when(known.isin([c for c, n in _CHARSETS.items() if n == name]), F.decode(raw, name)).otherwise(text)
    wrong = F.when(raw.isNull(), F.lit(None).cast("string")).when(
        ~known.isin(list(_CHARSETS)), F.concat(F.lit("unknown encoding "), known)
    ).when(~fits, F.concat(F.lit("bytes are not "), known))
    decoded = pages.withColumn(convert_error, wrong).withColumn(html, F.when(F.col(convert_error).isNull(), text))
    opened = F.regexp_count(F.col(html), F.lit("<[A-Za-z]")) - F.regexp_count(F.col(html), F.lit("</"))
    deep = F.coalesce(opened > deepest, F.lit(False))
    return decoded.withColumn(
        convert_error, F.when(deep, F.lit(f"more than {deepest} tags are left open")).otherwise(F.col(convert_error))
    ).withColumn(html, F.when(F.col(convert_error).isNull(), F.col(html)))


def page_documents(
    results: DataFrame,
    key: str | list[str] = "page_id",
    url: str = "url",
    html: str = "content",
    error: str | None = "error",
    convert_error: str | None = None,
    keep: list[str] | None = None,
    include_metadata: bool = True,
    **options,
) -> DataFrame:
    """Document of every page attempt.

    ``key, url, title, error, markdown, token_count, byte_size`` and the ``keep`` columns.  All
    of it travels with the page through its one shuffle; nothing is joined back.  ``key`` may be several
    columns; two pages with one key are an error.
    """
    if not isinstance(key, str):
        keyed = results.withColumn("_page", F.struct(*key))
        made = page_documents(
            keyed, "_page", url, html, error, convert_error, keep, include_metadata, **options
        )
        return made.select(*(F.col(f"_page.{c}").alias(c) for c in key), *made.drop("_page").columns)
    keep = keep or []
    failed = F.col(error) if error else F.lit(None).cast("string")
    broken = F.col(convert_error) if convert_error else F.lit(None).cast("string")
    good = ~has_error(failed)
    # The title and the Markdown come from the same tokens: a page is matched once.
    tokenised = results.select(
        key,
        *keep,
        F.col(url).alias("_url"),
        failed.alias("_error"),
        broken.alias("_broken"),
        F.when(good, F.coalesce(byte_size(F.col(html)), F.lit(0)))
        .otherwise(F.lit(0)).cast("bigint").alias("_bytes"),
        F.when(good, text_token_array(F.col(html))).alias("_all"),
    )
    slim = tokenised.select(
        key, *keep, "_url", "_error", "_broken", "_bytes",
        title_of(F.col("_all")).alias("_title"),
        F.when(~has_error(F.col("_broken")), F.col("_all")).alias("_toks"),
    )
    carry = [*keep, "_url", "_title", "_error", "_broken", "_bytes"]
    made = page_markdown(slim, key, carry=carry, toks="_toks", **options)
    text = F.when(has_error(F.col("_broken")), convert_failure(F.col("_broken"))).otherwise(
        F.col("markdown")
    )
    return (
        made.withColumn(
            "markdown",
            document_text(text, F.col("_url"), F.col("_title"), F.col("_error"), include_metadata),
        )
        .select(
            key,
            *keep,
            F.col("_url").alias("url"),
            F.col("_title").alias("title"),
            F.col("_error").alias("error"),
            "markdown",
            token_count(F.col("markdown")).alias("token_count"),
            F.col("_bytes").alias("byte_size"),
        )
    )
