"""HTML as a token table: tokens, element spans, titles, links, boilerplate, main content.

A page is cut into tokens by one pattern while its file is read.  Which close tag belongs to which
open tag is found by one fold over the tags of a page, an expression on its array of tokens; what lies
inside what is then a running window over the tokens of one page.  All windows are partitioned by
the page key first, so the only shuffle is the one that brings pages, not tokens, to their partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.functions.text import decode_attribute, decode_entities, strip
from pagemill.functions.urls import link_target, normalize_url, url_netloc
from pagemill.operators.rules import (
    CONTENT_RULES,
    JUNK_RULES,
    Rule,
    any_rule,
    attributes_in,
    rule_label,
    rule_rank,
    rule_test,
)

# One alternative per token kind, tried in this order.  A comment or a raw-text element that is
# never closed runs to the end of the page; a tag cut off by the end of the page is no text.
TOKEN = "(?is)" + "|".join(
    (
        r"<!--.*?(?:-->|\z)",
        r"<(script|style|textarea|title)(?=[\s/>]).*?(?:</\1\s*>|\z)",
        r"""</?[a-z][^\s/>]*+(?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+>""",
        r"<[!?][^>]*(?:>|\z)",
        r"</?[a-z][^>]*\z",
        r"</[^>]*>",
        r"[^<]+",
        r"<",
    )
)
_RAW_START = r"(?i)^<(?:script|style|textarea|title)[\s/>]"

# Elements that have no content and no close tag.
VOID_TAGS = (
    "area base br col embed frame hr img input link meta param source track wbr"
).split()
# Elements whose start or end also ends an open paragraph.
PARAGRAPH_ENDS = (
    "address article aside blockquote body center details dir div dl fieldset figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html main menu nav ol p pre section table td th tr ul li dd dt"
).split()

# Elements whose end tag may be left out.  Such an element ends where one of its own or
# a lower rank begins beside it, or where its parent ends.
OPTIONAL_ENDS = {
    "tbody": 1, "thead": 1, "tfoot": 1, "tr": 2, "optgroup": 2,
    "li": 3, "dt": 3, "dd": 3, "td": 3, "th": 3, "option": 3, "p": 4,
}
# Elements within a line of text; what begins inside them may end what is around them.
INLINE_TAGS = (
    "a abbr b bdi bdo big cite code del dfn em font i ins kbd label mark q s samp small span strike "
    "strong sub sup time tt u var"
).split()
# A close tag does not reach over the edge of such an element, unless it is that of a
# part of a table (over cells) or of a table, body or page (over tables too).
EDGES = {"caption": 1, "td": 1, "th": 1, "object": 1, "template": 1, "table": 2}
REACH = {
    "caption": 1, "td": 1, "th": 1, "tr": 1, "tbody": 1, "thead": 1, "tfoot": 1,
    "table": 2, "body": 2, "html": 2,
}
_INLINE, _NO_RANK = 8, 9
# Tags that are folded at a time: what a step appends to stays short on a long page.
_FOLDED = 32
# Bytes of HTML that a task regroups; their tokens take about 30 times as much memory.
PART_BYTES = 4 << 20

PAGE_END = 2**31 - 1


def raw_attr(token: Column, name: str) -> Column:
    """Value of one attribute of a tag token as written.

    '' when it has no value, NULL when it is absent.
    """
    pattern = (
        r"(?is)^<[a-z][^\s/>]*+(?:[\s/]++(?!" + name + r"(?:[\s=/>]|\z))[^\s=/>]++"
        r"""(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)*+"""
        r"[\s/]++(" + name + r"""(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)"""
    )
    found = F.regexp_extract(token, pattern, 1)
    value = F.regexp_replace(found, r"(?s)^[^=]*+=?+\s*+", "")
    bare = F.when(
        value.startswith('"') | value.startswith("'"),
        F.substr(value, F.lit(2), F.greatest(F.length(value) - 2, F.lit(0))),
    ).otherwise(value)
    return F.when(token.rlike(rf"(?i)[\s/]{name}") & (found != ""), bare)


def attr(token: Column, name: str) -> Column:
    """Value of one attribute with its character references decoded."""
    return decode_attribute(raw_attr(token, name))


def token_array(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))


def text_token_array(html: Column) -> Column:
    """Tokens without the control characters that HTML has no use for; see the renderer."""
    dirty = html.rlike(r"[\x01-\x08\x0e\x0f]")
    return token_array(
        F.when(dirty, F.translate(html, "\x01\x02\x03\x04\x05\x06\x07\x08\x0e\x0f", "")).otherwise(html)
    )


def _kind(tok: Column) -> Column:
    return (
        F.when(~tok.startswith("<") | (tok == "<"), F.lit("text"))
        .when(tok.startswith("<!--"), F.lit("comment"))
        .when(tok.startswith("<!") | tok.startswith("<?"), F.lit("decl"))
        .when(tok.rlike(_RAW_START), F.lit("raw"))
        .when(~tok.endswith(">"), F.lit("cut"))
        .when(~tok.rlike("^</?[A-Za-z]"), F.lit("decl"))
        .when(tok.startswith("</"), F.lit("close"))
        .otherwise(F.lit("open"))
    )


def _tag(tok: Column, kind: Column) -> Column:
    name = F.lower(F.regexp_extract(tok, r"^</?([A-Za-z][^\s/>]*)", 1))
    return F.when(kind.isin("open", "close", "raw"), name).otherwise(F.lit(""))


def _typed(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("kind", _kind(F.col("tok"))).withColumn(
        "tag", _tag(F.col("tok"), F.col("kind"))
    )


def parts_of(pages: DataFrame, html: str = "html") -> int:
    """How many partitions pages are dealt to, so that a task's memory does not grow with the table.

    One pass over the sizes of the pages.
    """
    total = pages.agg(F.sum(F.octet_length(html))).first()[0] or 0
    return max(pages.sparkSession.sparkContext.defaultParallelism, -(-total // PART_BYTES))


def html_tokens(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Ordered tokens of every page: ``key, pos, kind, tag, tok``.  No shuffle."""
    return _typed(pages.select(key, F.posexplode(token_array(F.col(html))).alias("pos", "tok"))).select(
        key, "pos", "kind", "tag", "tok"
    )


def page_tokens(
    pages: DataFrame,
    key: str = "page_id",
    html: str = "html",
    carry: list[str] | None = None,
    colocated: bool = False,
    toks: str | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Tokens that can carry text or structure, with all tokens of a page in one partition.

    Comments, scripts and styles are left out before the shuffle, where they would often be most
    of the bytes.  Position 0 is an empty text token that every page has, NULL pages too; it
    holds the ``carry`` columns, so that they need not be joined back later.  ``colocated``
    leaves the shuffle out for input that is already clustered by ``key`` (a bucketed table).
    ``toks`` names a column of tokens to be used in place of the HTML.  ``parts`` is the number of
    partitions, see :func:`parts_of`.
    """
    carry = carry or []
    useful = F.filter(
        F.col(toks) if toks else text_token_array(F.col(html)),
        lambda t: ~(
            t.startswith("<!")
            | t.startswith("<?")
            | ((t.startswith("<s") | t.startswith("<S")) & t.rlike(r"(?i)^<(?:script|style)[\s/>]"))
        ),
    )
    narrow = pages.select(
        key,
        *carry,
        F.coalesce(useful, F.array().cast("array<string>")).alias("toks"),
    )
    if not colocated:
        narrow = narrow.repartition(parts, key) if parts else narrow.repartition(key)
    exploded = narrow.select(
        key,
        *carry,
        F.posexplode(F.concat(F.array(F.lit("")), F.col("toks"))).alias("pos", "tok"),
    )
    note = F.when(F.col("pos") == 0, F.struct(*carry)) if carry else F.lit(None).cast("string")
    return _typed(exploded.select(key, "pos", "tok", note.alias("note")))


def _by_tag(tag: Column, values: dict[str, int], other: int) -> Column:
    chosen = None
    for value in sorted(set(values.values())):
        test = tag.isin([t for t, v in values.items() if v == value])
        chosen = F.when(test, value) if chosen is None else chosen.when(test, value)
    return chosen.otherwise(other)


_STACK = "array<struct<pos:int,tag:string,rank:int,edge:int,list:boolean>>"
_ENDED = "array<struct<open:int,close:int,end:int>>"
_CLOSED = "array<struct<open:int,lists:int>>"


def _let(value: Column, use) -> Column:
    """``use(value)``, with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _tag_event(token: Column) -> Column:
    """What the fold has to know of a tag."""
    tag, opens = token["tag"], token["step"] == 1
    ranks = OPTIONAL_ENDS | {t: _INLINE for t in INLINE_TAGS}
    starts = {t: 4 for t in PARAGRAPH_ENDS} | OPTIONAL_ENDS
    return F.struct(
        token["pos"].alias("pos"), tag.alias("tag"), opens.alias("opens"),
        _by_tag(tag, ranks, 0).alias("rank"),
        F.when(opens, _by_tag(tag, EDGES, 0)).otherwise(_by_tag(tag, REACH, 0)).alias("edge"),
        # An element of a rank up to this ends where the tag begins, unless something else is between.
        F.when(opens, _by_tag(tag, starts, _NO_RANK)).otherwise(_NO_RANK).alias("ends"),
        tag.isin("ul", "ol").alias("list"),
    )


def _n_ended(stack: Column, tag: Column) -> Column:
    """How many elements, innermost first, a tag ends."""

    def first(test) -> Column:
        return F.array_position(F.transform(stack, test), F.lit(True)).cast("int")

    def ended_by_start(n: Column) -> Column:
        beside = F.reverse(F.slice(stack, F.lit(1), n))
        last = F.array_position(F.transform(beside, lambda e: e["rank"] < _INLINE), F.lit(True)).cast("int")
        return F.when(last == 0, 0).otherwise(n - last + 1)

    def ended_by_close(n: Column) -> Column:
        over = F.exists(F.slice(stack, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda e: e["edge"] > tag["edge"])
        return F.when(over, 0).otherwise(n)

    def beside(stop: Column) -> Column:
        return _let(F.when(stop == 0, F.size(stack)).otherwise(stop - 1), ended_by_start)

    return F.when(
        tag["opens"] & (tag["ends"] < _NO_RANK), _let(first(lambda e: e["rank"] < tag["ends"]), beside)
    ).when(~tag["opens"], _let(first(lambda e: e["tag"] == tag["tag"]), ended_by_close)).otherwise(0)


def _fold_tag(state: Column, tag: Column) -> Column:
    """One step: what the tag ends is taken from the stack, what it begins is put on it."""
    stack = state["stack"]

    def step(n: Column) -> Column:
        closes = ~tag["opens"]

        def end(element: Column, k: Column) -> Column:
            own = closes & (k == n - 1)
            return F.struct(
                element["pos"].alias("open"),
                F.when(own, tag["pos"]).alias("close"),
                F.when(own, tag["pos"]).when(element["tag"].isin("html", "body"), F.lit(PAGE_END))
                .otherwise(tag["pos"] - 1).alias("end"),
            )

        ended = F.slice(stack, F.lit(1), n)
        begun = F.array(F.struct(*(tag[c].alias(c) for c in ("pos", "tag", "rank", "edge", "list"))))
        pair = F.struct(
            F.when(n > 0, F.get(stack, n - 1)["pos"]).alias("open"),
            F.size(F.filter(ended, lambda e: e["list"])).alias("lists"),
        )
        return F.struct(
            F.concat(
                F.when(tag["opens"], begun).otherwise(F.array().cast(_STACK)),
                F.slice(stack, n + 1, F.size(stack)),
            ).alias("stack"),
            F.concat(state["ended"], F.transform(ended, end)).alias("ended"),
            F.concat(state["closed"], F.when(closes, F.array(pair)).otherwise(F.array().cast(_CLOSED))).alias("closed"),
        )

    return _let(_n_ended(stack, tag), step)


def _nested(tags: Column) -> Column:
    """Fold of a page's tags: ``ended`` has every element's end, ``closed`` every close tag's element."""
    return _let(tags, _nested_once)


def _nested_once(tags: Column) -> Column:
    starts = F.sequence(F.lit(1), F.greatest(F.size(tags), F.lit(1)), F.lit(_FOLDED))

    def fold_run(state: Column, start: Column) -> Column:
        none = F.struct(
            state["stack"].alias("stack"), F.array().cast(_ENDED).alias("ended"), F.array().cast(_CLOSED).alias("closed")
        )
        done = F.aggregate(F.slice(tags, start, _FOLDED), none, _fold_tag)
        return _let(done, lambda d: F.struct(
            d["stack"].alias("stack"),
            F.concat(state["ended"], F.array(d["ended"])).alias("ended"),
            F.concat(state["closed"], F.array(d["closed"])).alias("closed"),
        ))

    zero = F.struct(
        F.array().cast(_STACK).alias("stack"), F.array().cast(f"array<{_ENDED}>").alias("ended"),
        F.array().cast(f"array<{_CLOSED}>").alias("closed"),
    )

    def result(state: Column) -> Column:
        left = F.transform(state["stack"], lambda e: F.struct(
            e["pos"].alias("open"), F.lit(None).cast("int").alias("close"), F.lit(PAGE_END).alias("end")
        ))
        return F.struct(
            F.array_sort(F.concat(F.flatten(state["ended"]), left)).alias("ended"),
            F.flatten(state["closed"]).alias("closed"),
        )

    return F.aggregate(starts, zero, fold_run, result)


def match_elements(tokens: DataFrame, key: str = "page_id") -> DataFrame:
    """Add ``close_pos`` and ``end_pos`` to open and raw tokens, ``open_pos`` and ``lists`` to close tokens.

    A close tag ends the innermost open element of its name and all that is open inside it; over the edge of
    a table or a cell (``EDGES``) it does not reach, and a close tag that ends nothing is ignored.  An element of
    ``OPTIONAL_ENDS`` also ends where one like it begins beside it, a paragraph where any block begins.
    ``close_pos`` is an element's own close tag, or :data:`PAGE_END` if it has none; ``end_pos`` is the last
    token of the element, that of the body of a page being the last of all unless it is closed.  ``lists`` says
    how many lists a close tag ends.

    The tokens of a page are put together again from their own partition: no shuffle where they come
    clustered by ``key``.
    """
    tag, tok, kind = F.col("tag"), F.col("tok"), F.col("kind")
    empty = tag.isin(VOID_TAGS) | (tok.endswith("/>") & ~tok.rlike(r"""=\s*[^\s"'>]+/>\z"""))
    step = F.when((kind == "open") & ~empty, 1).when(kind == "close", -1).otherwise(0)
    others = [c for c in tokens.columns if c not in (key, "pos", "kind", "tag", "tok")]
    fields = ("pos", "kind", "tag", "tok", "step", *others)
    pages = tokens.withColumn("step", step).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("tokens")
    )
    place = [F.get("tokens", F.lit(k))["pos"] for k in (0, 1)]
    pages = pages.withColumn("tokens", F.when(
        place[0] == place[1], F.raise_error(F.lit(f"two pages have one {key}; name more columns as the key"))
    ).otherwise(F.col("tokens")))
    tags = F.transform(F.filter("tokens", lambda t: t["step"] != 0), _tag_event)
    folded = pages.withColumn("nested", _nested(tags))

    def joined(token: Column, close: Column, end: Column, opened: Column, lists: Column) -> Column:
        return F.struct(
            *(token[c].alias(c) for c in fields if c != "step"),
            close.cast("int").alias("close_pos"), end.cast("int").alias("end_pos"), opened.cast("int").alias("open_pos"), lists.cast("int").alias("lists"),
        )

    none = F.lit(None)
    # Elements and close tags stand in the fold's results in the order of their tokens.
    rows = F.concat(
        F.zip_with(
            F.filter("tokens", lambda t: t["step"] == 1), F.col("nested.ended"),
            lambda t, e: joined(t, F.coalesce(e["close"], F.lit(PAGE_END)), e["end"], none, none),
        ),
        F.zip_with(
            F.filter("tokens", lambda t: t["step"] == -1), F.col("nested.closed"),
            lambda t, c: joined(t, none, none, c["open"], c["lists"]),
        ),
        F.transform(
            F.filter("tokens", lambda t: t["step"] == 0),
            lambda t: _let(F.when(t["kind"].isin("open", "raw"), t["pos"]), lambda own: joined(t, own, own, none, none)),
        ),
    )
    return folded.select(key, F.inline(rows)).select(
        key, *(c for c in tokens.columns if c != key), "close_pos", "end_pos", "open_pos", "lists"
    )


def elements(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """One row per element: ``key, pos, tag, tok, close_pos``; NULL ``close_pos`` = page end."""
    tokens = html_tokens(pages.select(key, html).repartition(parts_of(pages, html), key), key, html)
    spans = match_elements(tokens, key).where(F.col("kind").isin("open", "raw"))
    return spans.select(
        key,
        "pos",
        "tag",
        "tok",
        F.when(F.col("close_pos") < PAGE_END, F.col("close_pos")).alias("close_pos"),
    )


def extract_title(html: Column) -> Column:
    """Text of the first title, ``No Title`` when the page has none."""
    return F.when(html.isNotNull(), title_of(token_array(html)))


def title_of(toks: Column) -> Column:
    """The same, from the tokens of a page."""
    first = F.try_element_at(
        F.filter(
            toks,
            lambda t: (t.startswith("<t") | t.startswith("<T")) & t.rlike(r"(?i)^<title[\s/>]"),
        ),
        F.lit(1),
    )
    inner = F.regexp_replace(first, r"(?is)^<title[^>]*>|</title\s*>\z", "")
    return F.when(toks.isNotNull(), F.coalesce(strip(decode_entities(inner)), F.lit("No Title")))


def page_links(
    pages: DataFrame,
    key: str = "page_id",
    html: str = "html",
    base: str = "url",
    resolve_against: str = "normalized",
    keep_query: bool = False,
    scoped: bool = True,
) -> DataFrame:
    """Every ``<a href>`` of every page in document order, duplicates kept.

    ``key, pos, href, target`` where ``target`` is the normalised absolute URL.  ``scoped``
    keeps only web links to the page's own host.  ``resolve_against='raw'`` resolves from the
    page URL as given, with its trailing slash.  No shuffle: links are found while reading.
    """
    if resolve_against not in ("normalized", "raw"):
        raise ValueError("resolve_against must be 'normalized' or 'raw'")
    from_url = normalize_url(F.col(base), keep_query) if resolve_against == "normalized" else F.col(base)
    anchors = (
        pages.where(F.col(html).isNotNull())
        .select(
            key,
            from_url.alias("_base"),
            url_netloc(F.col(base)).alias("_host"),
            token_array(F.col(html)).alias("_toks"),
        )
        .select(key, "_base", "_host", F.posexplode("_toks").alias("pos", "tok"))
        .where(F.col("tok").rlike(r"(?i)^<a[\s/]") & F.col("tok").endswith(">"))
    )
    # Generators, unlike projections, are not copied into the filters above them: each link is
    # taken apart once.
    hrefs = anchors.select(
        key, "_base", "_host", "pos",
        F.explode(F.array_compact(F.array(attr(F.col("tok"), "href")))).alias("href"),
    )
    target = link_target(F.col("_base"), F.col("_host"), F.col("href"), keep_query, scoped)
    return hrefs.select(key, "pos", "href", F.explode(F.array_compact(F.array(target))).alias("target"))


def _with_attributes(tokens: DataFrame, names: list[str]) -> DataFrame:
    """Add ``a_<name>`` for open tags; the values are decoded together, in one pass."""
    together = F.concat_ws(
        "\x05", *(F.coalesce(raw_attr(F.col("tok"), n), F.lit("")) for n in names)
    )
    wanted = (F.col("kind") == "open") & F.contains(F.col("tok"), F.lit("="))
    return tokens.withColumn(
        "_attributes", F.when(wanted, F.split(decode_attribute(together), "\x05"))
    ).select(
        "*", *(F.col("_attributes")[i].alias(f"a_{n}") for i, n in enumerate(names))
    ).drop("_attributes")


def mark_junk(
    tokens: DataFrame, key: str = "page_id", rules: list[Rule] | None = None
) -> DataFrame:
    """Add ``junk``: does the token lie inside an element matched by one of the rules?

    A token is inside such an element exactly when the furthest end of all junk elements opened
    before it is not behind it.
    """
    rules = JUNK_RULES if rules is None else rules
    names = attributes_in(rules)
    marked = _mark_junk(_with_attributes(tokens, names), key, rules)
    return marked.drop(*(f"a_{n}" for n in names))


def _mark_junk(tokens: DataFrame, key: str, rules: list[Rule]) -> DataFrame:
    names = attributes_in(rules)
    page = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    hit = F.col("kind").isin("open", "raw") & any_rule(
        rules, F.col("tag"), {n: F.col(f"a_{n}") for n in names}
    )
    return (
        tokens.withColumn("reach", F.max(F.when(hit, F.col("end_pos"))).over(page))
        .withColumn("junk", F.coalesce(F.col("reach") >= F.col("pos"), F.lit(False)))
        .drop("reach")
    )


def drop_junk(
    tokens: DataFrame, key: str = "page_id", rules: list[Rule] | None = None
) -> DataFrame:
    """Delete every token inside a junk element."""
    return mark_junk(tokens, key, rules).where(~F.col("junk")).drop("junk")


def drop_comments(tokens: DataFrame) -> DataFrame:
    return tokens.where(F.col("kind") != "comment")


def junk_by_rule(pages: DataFrame, key: str = "page_id", html: str = "html",
                 rules: list[Rule] | None = None) -> DataFrame:
    """How many elements each rule matches.  No page needs to be regrouped for this."""
    rules = JUNK_RULES if rules is None else rules
    names = attributes_in(rules)
    tags = html_tokens(pages, key, html).where(F.col("kind").isin("open", "raw"))
    columns = {n: F.col(f"a_{n}") for n in names}
    labels = F.array_compact(
        F.array(*(F.when(rule_test(r, F.col("tag"), columns), F.lit(rule_label(r))) for r in rules))
    )
    return (
        _with_attributes(tags, names)
        .select(F.explode(labels).alias("rule"))
        .groupBy("rule")
        .agg(F.count(F.lit(1)).alias("n_elements"))
    )


def main_content(
    tokens: DataFrame, key: str = "page_id", rules: list[Rule] | None = None,
    junk_rules: list[Rule] | None = None,
) -> DataFrame:
    """Keep the tokens of the main content of every page, without boilerplate.

    ``tokens`` come from :func:`match_elements`.  The first element of the best content rule
    wins, then the body, then everything.  A page without a body tag has an implied body, which
    leaves out the head; a body that is itself boilerplate leaves the head's text.
    """
    rules = CONTENT_RULES if rules is None else rules
    junk_rules = JUNK_RULES if junk_rules is None else junk_rules
    names = attributes_in(rules, junk_rules)
    is_open, tag = F.col("kind") == "open", F.col("tag")
    order = Window.partitionBy(key).orderBy("pos")
    page = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    clean = (
        _mark_junk(_with_attributes(tokens, names), key, junk_rules)
        .withColumn("has_body", F.max(is_open & (tag == "body")).over(page))
        .withColumn(
            "head_end",
            F.max(
                F.when(is_open & (tag == "head") & (F.col("close_pos") < PAGE_END), F.col("close_pos"))
            ).over(upto),
        )
        .where(~F.col("junk"))
        .where(
            F.col("has_body")
            | ~(
                F.coalesce(F.col("head_end") >= F.col("pos"), F.lit(False))
                | ((F.col("kind") == "raw") & (tag == "title"))
            )
        )
        .drop("junk", "has_body", "head_end")
    )
    rank = F.when(
        is_open,
        F.coalesce(
            rule_rank(rules, tag, {n: F.col(f"a_{n}") for n in names}),
            F.when(tag == "body", F.lit(len(rules))),
        ),
    )
    ranked = clean.withColumn("rank", rank)
    chosen = F.min(
        F.when(F.col("rank").isNotNull(), F.struct("rank", "pos", "end_pos"))
    ).over(page)
    return (
        ranked.withColumn("chosen", chosen)
        .where(
            (F.col("tok") == "")  # the row every page has, see page_tokens
            | F.col("chosen").isNull()
            | F.col("pos").between(F.col("chosen.pos"), F.col("chosen.end_pos"))
        )
        .drop("rank", "chosen", *(f"a_{n}" for n in names))
    )
