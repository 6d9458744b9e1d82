"""Line rules for Markdown: unreadable runs, stray short lines, rules of one character."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import strip

FENCE = "```"
# The run that counts as unreadable, the shortest line kept outside code, and the
# beginnings that excuse a short line.
GIBBERISH_RUN = "[A-Za-z0-9+/=]{100,}"
MIN_LINE = 5
SHORT_OK = r"^(?:\*|-|1\.|2\.|3\.)"

_WORD = r"[\p{L}\p{N}_]"
_EDGE = f"(?:(?<!{_WORD})(?={_WORD})|(?<={_WORD})(?!{_WORD}))"


def is_gibberish(line: Column, run: str = GIBBERISH_RUN) -> Column:
    """Does a long run of encoded-looking characters stand between two word edges?

    The cheap test looks only where a run can begin; few lines need the exact one.
    """
    start = f"(?<!{run[: run.index(']') + 1]})" if run == GIBBERISH_RUN else ""
    return line.rlike(start + run) & line.rlike(_EDGE + run + _EDGE)


def is_short(stripped: Column, min_line: int = MIN_LINE) -> Column:
    return (stripped != "") & (F.length(stripped) < min_line) & ~stripped.rlike(SHORT_OK)


def is_monotone(stripped: Column) -> Column:
    """More than ten characters, fewer than three of them different.

    Stripping the first character, then it and its successor, from the front leaves nothing
    only in that case, and stops at the third character otherwise.
    """
    one = F.substr(stripped, F.lit(1), F.lit(1))
    other = F.substr(F.ltrim(stripped, one), F.lit(1), F.lit(1))
    return (F.length(stripped) > 10) & (F.ltrim(stripped, F.concat(one, other)) == "")


def number_lines(texts: DataFrame, key: str, text: str, carry: list[str] | None = None,
                 colocated: bool = False) -> DataFrame:
    """Lines of every text: ``key, line_no, line`` and, on line 0, the ``carry`` columns."""
    carry = carry or []
    narrow = texts.select(key, text, *carry)
    if not colocated:
        narrow = narrow.repartition(key)
    lines = narrow.select(key, *carry, F.posexplode(F.split(F.col(text), "\n")).alias("line_no", "line"))
    return lines.select(
        key, "line_no", "line",
        *(F.when(F.col("line_no") == 0, F.col(c)).alias(c) for c in carry),
    )


def fence_state(lines: DataFrame, key: str) -> DataFrame:
    """Add ``stripped``, ``is_fence`` and ``in_code``; a fence line counts with its new state."""
    upto = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    return (
        lines.withColumn("stripped", strip(F.col("line")))
        .withColumn("is_fence", F.col("stripped").startswith(FENCE))
        .withColumn("in_code", F.sum(F.col("is_fence").cast("int")).over(upto) % 2 == 1)
    )


def line_verdicts(
    lines: DataFrame,
    key: str,
    gibberish_run: str = GIBBERISH_RUN,
    min_line: int = MIN_LINE,
    keep_closing_fences: bool = False,
) -> DataFrame:
    """Add ``gibberish``, ``short``, ``monotone`` and ``kept`` to numbered lines."""
    stated = fence_state(lines, key)
    short = ~F.col("in_code") & is_short(F.col("stripped"), min_line)
    if keep_closing_fences:
        short = short & ~F.col("is_fence")
    return stated.withColumns(
        {
            "gibberish": ~F.col("in_code") & is_gibberish(F.col("line"), gibberish_run),
            "short": short,
            "monotone": is_monotone(F.col("stripped")),
        }
    ).withColumn("kept", ~(F.col("gibberish") | F.col("short") | F.col("monotone")))


def clean_lines(
    texts: DataFrame,
    key: str,
    text: str = "md",
    out: str = "markdown",
    carry: list[str] | None = None,
    colocated: bool = False,
    **rules,
) -> DataFrame:
    """Apply the line rules and rejoin: ``key, out`` and the ``carry`` columns.

    Every text keeps its row, also when no line is left.
    """
    carry = carry or []
    judged = line_verdicts(number_lines(texts, key, text, carry, colocated), key, **rules)
    joined = judged.groupBy(key).agg(
        F.coalesce(
            F.expr("listagg(CASE WHEN kept THEN line END, '\n') WITHIN GROUP (ORDER BY line_no)"),
            F.lit(""),
        ).alias("_joined"),
        *(F.max(c).alias(c) for c in carry),
    )
    return joined.select(
        key, strip(F.regexp_replace("_joined", "\n{3,}", "\n\n")).alias(out), *carry
    )
