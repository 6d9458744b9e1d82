"""Markdown from content tokens.

Inline constructs are written as control characters first and become Markdown once the text of a
block is complete, because whether a link is empty, or shows its own address, is only known then.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import decode_attribute, decode_entities, squeeze, strip
from pagemill.operators.html import PAGE_END, raw_attr

# The elements that start and end a block.
BLOCK_TAGS = "h1 h2 h3 h4 h5 h6 p ul ol li pre".split()
LIST_TAGS = ["ul", "ol"]

# Link: LINK address TITLE title SAME escaped-address TEXT text END.  Image: IMAGE alt MORE target DONE.
LINK, TEXT, END, TITLE, SAME = "\x01", "\x02", "\x03", "\x05", "\x06"
IMAGE, MORE, DONE = "\x04", "\x07", "\x08"
CODE_ON, CODE_OFF = "\x0e", "\x0f"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([*_])", r"\\$1")


def _payload(kind: Column, tag: Column, tok: Column) -> Column:
    """What a token contributes, as written: its text, or the attributes its Markdown needs."""

    def value(name: str) -> Column:
        return F.coalesce(raw_attr(tok, name), F.lit(""))

    return (
        F.when(kind == "text", tok)
        .when(kind == "raw", F.regexp_replace(tok, r"(?is)^<(\w+)[^>]*>|</\w+\s*>\z", ""))
        .when((kind == "open") & (tag == "a"), F.concat(value("href"), F.lit(TITLE), value("title")))
        .when(
            (kind == "open") & (tag == "img"),
            F.concat(value("alt"), F.lit(MORE), value("src"), F.lit(TITLE), value("title")),
        )
        .otherwise(F.lit(""))
    )


def _titled(title: Column) -> Column:
    quoted = F.concat(F.lit(' "'), F.replace(title, F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.when(title != "", quoted).otherwise(F.lit(""))


def _link_start(payload: Column) -> Column:
    href = F.substring_index(payload, TITLE, 1)
    title = F.substring_index(payload, TITLE, -1)
    return F.when(
        href != "",
        F.concat(
            F.lit(LINK), href, F.lit(TITLE), _titled(title), F.lit(SAME), escape(href), F.lit(TEXT)
        ),
    ).otherwise(F.lit(""))


def _image(payload: Column) -> Column:
    target = F.substring_index(payload, MORE, -1)
    return F.concat(
        F.lit(IMAGE), F.substring_index(payload, MORE, 1), F.lit(MORE + "]("),
        F.substring_index(target, TITLE, 1), _titled(F.substring_index(target, TITLE, -1)),
        F.lit(")" + DONE),
    )


def inline_markdown(text: Column, heading: Column) -> Column:
    """Turn the control characters of one block into Markdown."""
    no_empty_link = F.regexp_replace(
        text, f"{LINK}[^{TEXT}]*{TEXT}\\s*(?:{END}|\\z)", ""
    )
    no_empty_code = F.regexp_replace(no_empty_link, f"{CODE_ON}\\s*{CODE_OFF}", "")
    flat = strip(squeeze(no_empty_code))
    auto = F.regexp_replace(
        flat,
        f"{LINK}([^{TITLE}{TEXT}]*){TITLE}{SAME}([^{TEXT}]*){TEXT}( ?)\\2( ?)(?:{END}|\\z)",
        "$3<$1>$4",
    )
    linked = F.regexp_replace(
        auto,
        f"{LINK}([^{TITLE}{TEXT}]*){TITLE}([^{SAME}]*){SAME}[^{TEXT}]*{TEXT}"
        f"( ?)([^{LINK}{END}]*?)( ?)(?:{END}|\\z)",
        "$3[$4]($1$2)$5",
    )
    rest = F.regexp_replace(linked, f"{LINK}[^{TEXT}]*{TEXT}|{END}", "")
    imaged = F.when(
        F.contains(rest, F.lit(IMAGE)),
        F.when(heading, F.regexp_replace(rest, f"{IMAGE}([^{MORE}]*){MORE}[^{DONE}]*{DONE}", "$1"))
        .otherwise(F.regexp_replace(rest, f"{IMAGE}([^{MORE}]*){MORE}([^{DONE}]*){DONE}", "![$1$2")),
    ).otherwise(rest)
    marked = text.rlike(f"[{LINK}-{DONE}{CODE_ON}{CODE_OFF}]")
    return F.when(marked, strip(F.translate(imaged, CODE_ON + CODE_OFF, "``"))).otherwise(
        strip(squeeze(text))
    )


def content_blocks(tokens: DataFrame, key: str = "page_id") -> DataFrame:
    """Cut content tokens into blocks: ``key, block, tag, opens, depth, root, start, raw, note``.

    ``tag``/``opens`` tell which tag began the block and whether it was its start or its end,
    ``depth``/``root`` its place in lists, ``raw`` its text with control characters.
    """
    kind, tag, pos, tok = F.col("kind"), F.col("tag"), F.col("pos"), F.col("tok")
    order = Window.partitionBy(key).orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    is_open, is_close = kind == "open", kind == "close"
    is_list = tag.isin(LIST_TAGS)
    closed = F.col("close_pos") < PAGE_END

    states = tokens.withColumn("_raw", _payload(kind, tag, tok)).withColumn(
        "payload", F.when(kind == "open", decode_attribute(F.col("_raw"))).otherwise(decode_entities(F.col("_raw")))
    ).drop("_raw").withColumns(
        {
            "pre_end": F.max(F.when(is_open & (tag == "pre"), F.col("end_pos"))).over(before),
            "code_end": F.max(
                F.when(is_open & (tag == "code") & closed, F.col("close_pos"))
            ).over(before),
            "depth": F.sum(
                F.when(is_open & is_list, 1).when(is_close, -F.col("lists")).otherwise(0)
            ).over(upto),
            "a_open": F.last(
                F.when(
                    (tag == "a") & (is_open | is_close),
                    F.when(is_open & closed, F.col("payload")).otherwise(F.lit("")),
                ),
                True,
            ).over(upto),
        }
    ).withColumn("in_pre", F.coalesce(F.col("pre_end") > pos, F.lit(False)))
    states = states.withColumn(
        "in_code", F.col("in_pre") | F.coalesce(F.col("code_end") > pos, F.lit(False))
    ).withColumn("edge", (is_open | is_close) & tag.isin(BLOCK_TAGS) & ~F.col("in_pre"))

    edge, in_pre, in_code = F.col("edge"), F.col("in_pre"), F.col("in_code")
    plain = F.col("payload")
    piece = (
        F.when(kind.isin("text", "raw"), F.when(in_code, plain).otherwise(escape(plain)))
        .when(edge & is_open & (tag == "pre"), F.lit(""))
        .when(edge & (F.col("a_open") != ""), _link_start(F.col("a_open")))
        .when(in_pre, F.lit(""))
        .when((tag == "a") & ~in_code, F.when(is_open, _link_start(plain)).when(is_close, F.lit(END)))
        .when((tag == "img") & is_open, _image(plain))
        .when((tag == "code") & is_open & closed, F.lit(CODE_ON))
        .when((tag == "code") & is_close & F.col("open_pos").isNotNull(), F.lit(CODE_OFF))
        .otherwise(F.lit(""))
    )
    numbered = states.withColumns(
        {
            "block": F.sum(edge.cast("int")).over(upto),
            "root": F.last(
                F.when(is_open & is_list & (F.col("depth") == 1), pos), True
            ).over(upto),
        }
    ).select(
        key,
        "block",
        "pos",
        piece.alias("piece"),
        "note",
        F.when(edge, tag).alias("tag"),
        F.when(edge, is_open).alias("opens"),
        F.when(edge, F.col("depth")).alias("depth"),
        F.when(edge & (F.col("depth") > 0), F.col("root")).alias("root"),
        F.when(edge & is_open & (tag == "ol"), raw_attr(tok, "start").try_cast("int")).alias("start"),
    )
    # Only the token that begins a block has values here, so ``max`` simply picks them up.
    return numbered.groupBy(key, "block").agg(
        F.expr("listagg(piece, '') WITHIN GROUP (ORDER BY pos)").alias("raw"),
        F.max("note").alias("note"),
        F.max("tag").alias("tag"),
        F.coalesce(F.max("opens"), F.lit(False)).alias("opens"),
        F.coalesce(F.max("depth"), F.lit(0)).alias("depth"),
        F.max("root").alias("root"),
        F.max("start").alias("start"),
    )


def render_blocks(blocks: DataFrame, key: str = "page_id") -> DataFrame:
    """Markdown of every block: ``key, block, kind, sep, line, note``.

    ``sep`` is what stands before the block: nothing, one line break between items of a list, or
    a blank line.  Blocks without text are gone, save the first of a page.
    """
    tag, opens, depth, block = F.col("tag"), F.col("opens"), F.col("depth"), F.col("block")
    list_open = opens & tag.isin(LIST_TAGS)
    item_open = opens & (tag == "li")
    item_close = ~opens & (tag == "li")
    heading = opens & F.coalesce(tag.rlike("^h[1-6]$"), F.lit(False))
    fenced = opens & F.coalesce(tag == "pre", F.lit(False))
    upto = (
        Window.partitionBy(key, "depth").orderBy("block")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    placed = (
        blocks.withColumns(
            {
                "text": F.when(fenced, F.col("raw")).otherwise(
                    inline_markdown(F.col("raw"), heading)
                ),
                "items": F.sum(F.coalesce(item_open, F.lit(False)).cast("int")).over(upto),
                "item": F.last(
                    F.when(item_open, block).when(list_open | item_close, F.lit(-1)), True
                ).over(upto),
                "in_list": F.last(
                    F.when(list_open, F.struct(tag, F.coalesce("start", F.lit(1)).alias("start"))),
                    True,
                ).over(upto),
            }
        )
        .withColumn("base", F.coalesce(F.last(F.when(list_open, F.col("items")), True).over(upto), F.lit(0)))
        .where((F.col("text") != "") | (block == 0))
    )
    order = Window.partitionBy(key).orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    item = F.coalesce(F.col("item"), F.lit(-1))
    placed = placed.withColumns(
        {
            "starts": (item >= 0) & (item > F.coalesce(F.max(item).over(before), F.lit(-1))),
            "prev": F.lag(F.struct("depth", "root", "text")).over(order),
        }
    )
    number = F.col("items") - F.col("base") + F.col("in_list.start") - 1
    marker = F.when(
        F.col("starts"),
        F.when(F.col("in_list.tag") == "ol", F.concat(number.cast("string"), F.lit(". ")))
        .otherwise(F.lit("- ")),
    ).otherwise(F.lit(""))
    indent = F.repeat(
        F.lit("  "),
        F.when(F.col("starts"), F.greatest(depth - 1, F.lit(0))).otherwise(
            F.when(item >= 0, depth).otherwise(F.greatest(depth - 1, F.lit(0)))
        ),
    )
    body = (
        F.when(fenced, F.concat(F.lit("```\n"), F.col("text"), F.lit("\n```")))
        .when(heading, F.concat(F.repeat(F.lit("#"), F.substr(tag, F.lit(2)).try_cast("int")), F.lit(" "), F.col("text")))
        .otherwise(F.col("text"))
    )
    first = F.col("prev").isNull() | (F.col("prev.text") == "")
    tight = (
        F.col("starts") & (depth > 0) & (F.col("prev.depth") > 0)
        & (F.col("prev.root") == F.col("root"))
    )
    return placed.select(
        key,
        "block",
        F.when(fenced, F.lit("code"))
        .when(heading, F.lit("heading"))
        .when(F.col("starts"), F.lit("item"))
        .otherwise(F.lit("text"))
        .alias("kind"),
        F.when(first, F.lit("")).when(tight, F.lit("\n")).otherwise(F.lit("\n\n")).alias("sep"),
        F.when(F.col("text") == "", F.lit(""))
        .when((depth > 0) & fenced,
              F.concat(indent, marker, F.replace(body, F.lit("\n"), F.concat(F.lit("\n"), F.repeat(F.lit("  "), depth)))))
        .otherwise(F.concat(indent, marker, body))
        .alias("line"),
        "note",
    )


def join_blocks(rendered: DataFrame, key: str = "page_id") -> DataFrame:
    """One Markdown text per page: ``key, md, note``."""
    return (
        rendered.withColumn("chunk", F.concat("sep", "line"))
        .groupBy(key)
        .agg(
            F.expr("listagg(chunk, '') WITHIN GROUP (ORDER BY block)").alias("md"),
            F.max("note").alias("note"),
        )
    )
