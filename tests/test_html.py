"""Tokens, spans, boilerplate, main content, links and titles on small pages."""

import html as stdlib_html
import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from pagemill.operators import html
from pagemill.operators.documents import page_markdown


def frame(spark, pages):
    rows = [(i, "http://h.x/d/", p) for i, p in enumerate(pages)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def markdown(spark, pages, **options):
    made = page_markdown(frame(spark, pages), **options).collect()
    return [r.markdown for r in sorted(made, key=lambda r: r.page_id)]


def kinds(spark, page):
    tokens = html.html_tokens(frame(spark, [page])).orderBy("pos").collect()
    return [(t.kind, t.tok) for t in tokens]


def test_tokens(spark):
    page = '<!doctype html><a title="x > y">1 < 2</a><!-- <p> --><script>var t="</p>"</script><br/'
    assert kinds(spark, page) == [
        ("decl", "<!doctype html>"), ("open", '<a title="x > y">'), ("text", "1 "), ("text", "<"),
        ("text", " 2"), ("close", "</a>"), ("comment", "<!-- <p> -->"),
        ("raw", '<script>var t="</p>"</script>'), ("cut", "<br/"),
    ]


def test_tokens_keep_every_character(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    glued = F.array_join(html.token_array(F.col("html")), "")
    assert pages.where(glued != F.col("html")).isEmpty()


def test_unclosed_comment_and_script_run_to_the_end(spark):
    assert kinds(spark, "a<!-- b<p>") == [("text", "a"), ("comment", "<!-- b<p>")]
    assert kinds(spark, "a<script>b<p>") == [("text", "a"), ("raw", "<script>b<p>")]


class Attributes(HTMLParser):
    def handle_starttag(self, tag, attrs):
        self.found = attrs


def test_attributes_like_the_standard_library(spark):
    rnd = random.Random(5)
    names = ["href", "data-href", "HREF", "title", "x"]
    forms = ['{n}="a href=b"', "{n}='c&amp;d'", "{n}=e/f", "{n}", '{n} = "g>h"', '{n}=""']
    tags = [
        "<a " + " ".join(rnd.choice(forms).format(n=rnd.choice(names)) for _ in range(rnd.randint(0, 4))) + ">"
        for _ in range(400)
    ]
    got = spark.createDataFrame([(t,) for t in tags], "t string").select(
        "t", html.attr(F.col("t"), "href").alias("v")
    )
    for row in got.collect():
        parser = Attributes()
        parser.feed(row.t)
        want = [v for n, v in parser.found if n == "href"]
        assert row.v == ((want[0] or "") if want else None), row


def test_titles(spark):
    pages = [
        "<p>x", "<title></title>", "<title> A &amp; B\n</title><title>C</title>", "<TITLE lang=a>T</TITLE>",
        "<!-- <title>no</title> --><title>yes</title>", None, "<title>cut",
    ]
    got = frame(spark, pages).select("page_id", html.extract_title(F.col("html")).alias("t")).collect()
    titles = [r.t for r in sorted(got, key=lambda r: r.page_id)]
    assert titles == ["No Title", "", "A & B", "T", "yes", None, "cut"]


def test_links_keep_order_and_copies(spark):
    page = (
        '<nav><a href="b/">1</a></nav><a href="/c?x#y">2</a><a>no</a><a href="//H.X/c">3</a>'
        '<a href="http://o.x/">off</a><a href="mailto:a@b">m</a><a href="http://[x">bad</a>'
        '<a href="">self</a><a href="?q&amp;r">q</a><abbr href="z">no</abbr>'
    )
    links = html.page_links(frame(spark, [page])).orderBy("pos").collect()
    assert [l.target for l in links] == [
        "http://h.x/b", "http://h.x/c", "http://h.x/c", "http://h.x/d", "http://h.x/d",
    ]
    raw = html.page_links(frame(spark, [page]), resolve_against="raw").orderBy("pos").collect()
    assert raw[0].target == "http://h.x/d/b"
    every = html.page_links(frame(spark, [page]), scoped=False)
    assert every.count() == 8
    kept = html.page_links(frame(spark, [page]), keep_query=True).orderBy("pos").collect()
    assert [l.target for l in kept][1] == "http://h.x/c?x"


CASES = [
    ("junk inside main", "<body><main><p>keep this</p><nav><p>drop it</p></nav></main></body>", "keep this"),
    ("main inside header", "<body><header><main><p>lost text</p></main></header><p>other text</p></body>", "other text"),
    ("junk body", "<html><head><title>Head text</title></head><body class='has-sidebar'><p>gone away</p></body></html>", "Head text"),
    ("no body", "<html><head><title>Title here</title></head><p>first para</p>", "first para"),
    ("unclosed nav", "<body><p>before it</p><nav><p>all the rest</p></body>", "before it"),
    ("nav closed by its parent", "<body><div><nav>menu</div><p>After the menu</p></body>", "After the menu"),
    ("junk item without end tag", '<body><ul><li class="social">share me<li>plain item</ul><p>Important text</p></body>', "- plain item\n\nImportant text"),
    ("nested junk item", '<body><ul><li class="social">share<ul><li>deep one</ul><li>plain item</ul><p>Tail of page</p></body>', "- plain item\n\nTail of page"),
    ("junk cell", '<body><table><tr><td class="sidebar">side<td><p>real words</p></table><p>Tail of page</p></body>', "real words\n\nTail of page"),
    ("junk row", '<body><table><tr class="sidebar"><td>side<td>bar<tr><td><p>real words</p></table></body>', "real words"),
    ("junk term", '<body><dl><dt class="related">gone<dd><p>kept words</p></dl><p>Tail of page</p></body>', "kept words\n\nTail of page"),
    ("junk option", '<body><select><option class="social">a<option>plain choice</select><p>Tail of page</p></body>', "plain choice\n\nTail of page"),
    ("content without end tag", "<body><div><article><p>the content</p></div><p>not this</p></body>", "the content"),
    ("text after the body", "<html><body><p>first of all</p></html><p>and after</p>", "first of all\n\nand after"),
    ("stray close", "<body></nav><p>kept text</p></article><nav>dropped</nav><p>more text</p></body>", "kept text\n\nmore text"),
    ("comment with tags", "<body><p>one <!-- </p><nav> -->two</p></body>", "one two"),
    ("quoted bracket", '<body><p title="a > b">quoted</p></body>', "quoted"),
    ("stray close in a cell", '<table><tr><td><div class="sidebar">x</td><td>main text of the page</td></tr></table><p>tail of it</p></div>', "main text of the page\n\ntail of it"),
    ("close over a cell", '<body><div class="popup">p<table><tr><td>a</div>b</td></tr></table>c</div><p>left of it</p></body>', "left of it"),
    ("list ended by its parent", "<body><div><ul><li>an item</div><ul><li>another one</li></ul><p>plain text</p></body>", "- an item\n\n- another one\n\nplain text"),
    ("empty", "", ""),
    ("blank", "  \n ", ""),
    ("missing", None, ""),
    ("unclosed junk paragraph", "<body><p class=social>share us<p>kept words</p><div>and these</div></body>", "kept words\n\nand these"),
    ("nested junk", "<body><aside>x<aside>y</aside>z</aside><p>after all</p></body>", "after all"),
    ("role", '<body><div role="banner">x</div><div role="main"><p>the main part</p></div><p>not this</p></body>', "the main part"),
    ("word match", '<body><div class="contents">wrong one</div><div class="a content">right one</div></body>', "right one"),
    ("best rule wins", '<body><div id="content">second</div><article>first of all</article></body>', "first of all"),
    ("plain ad stays", '<body><div class="ad">the ad stays</div></body>', "the ad stays"),
    ("self-closed junk", "<body><nav/><p>still here</p></body>", "still here"),
]


@pytest.fixture(scope="module")
def case_results(spark):
    return dict(zip((c[0] for c in CASES), markdown(spark, [c[1] for c in CASES])))


@pytest.mark.parametrize("name,want", [(c[0], c[2]) for c in CASES])
def test_cases(case_results, name, want):
    assert case_results[name] == want


def test_big_pages(spark):
    """No pattern may run out of stack or time on a long page."""
    words = "word &amp; more " * 60000
    attributes = " ".join(f'data-a{i}="x > y"' for i in range(20000))
    page = (
        f"<body><!--{'- ' * 300000}--><script>{'var a = 1 < 2; ' * 40000}</script><div {attributes} id=content>"
        f"<p>{words}</p>{'<p>short one' * 5000}<p>{' ' * 200000}last words</p></div></body>"
    )
    [got] = markdown(spark, [page])
    assert got == "\n\n".join([("word & more " * 60000).strip(), *["short one"] * 5000, "last words"])


def test_own_rules(spark):
    page = '<body><div class="promo">x</div><div id="story"><p>the story text</p></div></body>'
    got = markdown(
        spark, [page],
        junk_rules=[("contains", "class", "promo")], content_rules=[("equals", "id", "story")],
    )
    assert got == ["the story text"]


class Walk(HTMLParser):
    """A stack walk that keeps the text of the first article outside junk tags."""

    junk = {"script", "style", "nav", "footer"}

    def __init__(self):
        super().__init__()
        self.depth = self.inside = 0
        self.seen = False
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in self.junk:
            self.depth += 1
        if tag == "article" and not self.depth:
            self.inside += 1

    def handle_endtag(self, tag):
        if tag in self.junk:
            self.depth = max(0, self.depth - 1)
        if tag == "article":
            self.inside = max(0, self.inside - 1)

    def handle_data(self, data):
        if self.inside and not self.depth:
            self.text.append(data)


def test_content_text_like_a_stack_walk(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    tokens = html.match_elements(html.page_tokens(pages))
    kept = html.main_content(tokens).where("kind = 'text'").groupBy("page_id").agg(
        F.expr("listagg(tok, '') within group (order by pos)").alias("t")
    )
    got = {r.page_id: stdlib_html.unescape(r.t or "") for r in kept.collect()}
    for row in pages.collect():
        walk = Walk()
        walk.feed(row.html)
        walk.close()
        want = "".join(walk.text)
        ours = got[row.page_id]
        # a tag cut off by the end of the page is text for the walk and nothing for us
        assert ours == want or want.startswith(ours) and len(want) - len(ours) < 20, row.page_id


def test_junk_removal_only_removes(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    tokens = html.match_elements(html.page_tokens(pages))
    before, after = tokens.select("page_id", "pos"), html.drop_junk(tokens).select("page_id", "pos")
    assert after.exceptAll(before).isEmpty() and after.count() < before.count()


@pytest.mark.parametrize("parts", [1, 32])
def test_same_result_under_any_partitioning(spark, parts):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    base = page_markdown(pages)
    assert base.exceptAll(page_markdown(pages.repartition(parts))).isEmpty()


@pytest.mark.parametrize(("written", "read"), [
    ("/q?a=1&copy=2&region=us&notify=1&current=3", "/q?a=1&copy=2&region=us&notify=1&current=3"),
    ("/q?x=1&amp;y=2", "/q?x=1&y=2"),
    ("/q?&copy", "/q?\u00a9"),
    ("/q?&copy;=1", "/q?\u00a9=1"),
    ("/q?&notit;", "/q?&notit;"),
    ("/q?&lt &gt=", "/q?< &gt="),
    ("/q?&#65;&#x42=", "/q?AB="),
])
def test_query_strings_are_no_references(spark, written, read):
    token = spark.createDataFrame([(f'<a href="{written}">',)], "t string")
    assert token.select(html.attr(F.col("t"), "href").alias("h")).first().h == read


def test_empty_rule_lists(spark):
    from pagemill.operators.rules import rule_rank

    assert spark.range(1).select(rule_rank([], F.lit("p"), {}).alias("r")).first().r is None


def plain_stack(tokens):
    """End of every element by a list used as a stack: another statement of the same rules."""
    stack, ends = [], {}

    def pop(to, at, own=False):
        while len(stack) > to:
            tag, pos = stack.pop()
            last = len(stack) == to
            ends[pos] = at if own and last else html.PAGE_END if tag in ("html", "body") else at - 1

    for t in tokens:
        if t.kind == "open" and t.tag not in html.VOID_TAGS and not t.tok.endswith("/>"):
            limit = html.OPTIONAL_ENDS.get(t.tag, 4 if t.tag in html.PARAGRAPH_ENDS else None)
            if limit:
                to = len(stack)
                for place in range(len(stack) - 1, -1, -1):
                    rank = html.OPTIONAL_ENDS.get(stack[place][0])
                    if rank and rank >= limit:
                        to = place
                    elif stack[place][0] not in html.INLINE_TAGS:
                        break
                pop(to, t.pos)
            stack.append((t.tag, t.pos))
        elif t.kind == "close":
            for place in range(len(stack) - 1, -1, -1):
                if stack[place][0] == t.tag:
                    pop(place, t.pos, own=True)
                    break
                if html.EDGES.get(stack[place][0], 0) > html.REACH.get(t.tag, 0):
                    break
        elif t.kind in ("open", "raw"):
            ends[t.pos] = t.pos
    for _, pos in stack:
        ends[pos] = html.PAGE_END
    return ends


def test_ends_like_a_plain_stack(spark):
    rnd = random.Random(8)
    names = "html body div div div p p b a li ul ol table tr td th tbody dl dt dd article nav span br section option select".split()
    pages = []
    for size in [rnd.randint(0, 60) for _ in range(300)] + [900, 2000]:
        parts = [rnd.choice(["<{}>", "<{}>", "</{}>", "</{}>", "<{}/>", "text"]).format(rnd.choice(names)) for _ in range(size)]
        pages.append("".join(parts))
    tokens = html.match_elements(html.html_tokens(frame(spark, pages))).collect()
    by_page = {}
    for t in sorted(tokens, key=lambda t: (t.page_id, t.pos)):
        by_page.setdefault(t.page_id, []).append(t)
    assert len(by_page) > 290
    for page, found in by_page.items():
        want = plain_stack(found)
        assert {t.pos: t.end_pos for t in found if t.kind in ("open", "raw")} == want, pages[page]


def test_crossing_closes_keep_what_is_outside(spark):
    # The article holds the boilerplate only, so as main content it is empty; its text is lost to no other rule.
    page = '<div id="w"><article><div class="cookie">c</article><p>body text of the page</p></div></div>'
    tokens = html.match_elements(html.page_tokens(frame(spark, [page])))
    assert "".join(r.tok for r in html.drop_junk(tokens).where("kind = 'text'").collect()) == "body text of the page"
    assert markdown(spark, [page], content_rules=[]) == ["body text of the page"]


def test_matching_needs_one_exchange(spark):
    made = html.match_elements(html.page_tokens(frame(spark, ["<p>x"])))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan


def test_pages_are_dealt_by_their_bytes(spark, monkeypatch):
    """More HTML makes more tasks, not larger ones."""
    pages = spark.createDataFrame([(k, "<p>x</p>" * 100) for k in range(40)], "page_id long, html string")
    few = html.elements(pages).rdd.getNumPartitions()
    monkeypatch.setattr(html, "PART_BYTES", 400)
    assert html.parts_of(pages) == 80 and html.elements(pages).rdd.getNumPartitions() == 80 > few
    assert html.page_tokens(pages, parts=html.parts_of(pages)).rdd.getNumPartitions() == 80
    assert html.parts_of(pages.where("false")) == spark.sparkContext.defaultParallelism


def test_long_pages_fold_like_short_ones(spark):
    """Runs of folded tags end anywhere: elements around them, and tags left open, keep their places."""
    n = 3 * html._FOLDED + 5
    page = "<ul>" + "".join(f"<li>{k}<b>" for k in range(n)) + "</ul>" + "<p>" * n
    spans = {r.pos: (r.tag, r.end_pos) for r in html.match_elements(html.html_tokens(spark.createDataFrame([(1, page)], "page_id long, html string"))).where("kind = 'open'").collect()}
    assert spans[0] == ("ul", 3 * n + 1)
    assert all(spans[1 + 3 * k] == ("li", 3 * k + 3) and spans[3 + 3 * k] == ("b", 3 * k + 3) for k in range(n))
    assert [spans[3 * n + 2 + k][1] for k in range(n)] == [3 * n + 2 + k for k in range(n - 1)] + [html.PAGE_END]
