"""Rendering and the line rules."""

import random
import re

import pytest

from pagemill.operators import lines
from pagemill.operators.documents import page_markdown
from pagemill.sources import derived

RICH_ONE = """## Part 1

See [the\\_link](x?p=1 "T") and bold.

- first item
  - nested item
- second item

3. third entry
4. fourth entry

```
for  x:
  run(*x)
```

Call `f_x()` now ![pic](i.png)"""


def test_rich_page(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    raw = page_markdown(derived.rich_pages(pages), clean=False).where("page_id = 1").first().markdown
    assert raw == RICH_ONE
    clean = page_markdown(derived.rich_pages(pages)).where("page_id = 1").first().markdown
    assert clean == RICH_ONE.replace("run(*x)\n```", "run(*x)")
    fixed = page_markdown(derived.rich_pages(pages), keep_closing_fences=True)
    assert fixed.where("page_id = 1").first().markdown == RICH_ONE


CASES = {
    "headings": ("<h1>A</h1><h6>B <b>c</b></h6>", "# A\n\n###### B c"),
    "white space": ("<p> a\n\n b&nbsp;c <i> d</i></p>", "a b c d"),
    "escape": ("<p>a*b_c</p><pre>a*b_c</pre><p><code>a*b_c</code></p>", "a\\*b\\_c\n\n```\na*b_c\n```\n\n`a*b_c`"),
    "transparent": ("<div>a<br>b<hr></div><table><tr><td>c</td></tr></table>", "abc"),
    "auto link": ('<a href="http://x/a_b">http://x/a_b</a>', "<http://x/a_b>"),
    "titled same text": ('<a href="x" title="t">x</a>', '[x](x "t")'),
    "no href": ("<a>text</a>", "text"),
    "empty href": ('<a href="">text</a>', "text"),
    "empty link": ('<p>a<a href="x"> </a>b</p>', "ab"),
    "spaces in link": ('<p>a<a href="x"> b </a>c</p>', "a [b](x) c"),
    "quoted title": ('<a href="x" title=\'say "a"\'>t</a>', '[t](x "say \\"a\\"")'),
    "block link": ('<a href="x"><h3>Head</h3><p>Text</p></a>', "### [Head](x)\n\n[Text](x)"),
    "unclosed link": ('<p>see <a href="x">this</p><p>next</p>', "see [this](x)\n\nnext"),
    "link in code": ('<p><code><a href="x">y</a></code></p>', "`y`"),
    "image": ('<p><img src="a_b.png" alt="x &amp; y" title="t"></p>', '![x & y](a_b.png "t")'),
    "image in heading": ('<h2>See <img src="a.png" alt="pic"></h2>', "## See pic"),
    "image in link": ('<a href="u"><img src="s" alt="a"></a>', "[![a](s)](u)"),
    "empty code": ("<p>a<code></code>b</p>", "ab"),
    "pre keeps space": ("<pre>  a\n   <b>b</b>  &lt;\n</pre>", "```\n  a\n   b  <\n\n```"),
    "pre with blocks": ("<pre>a<p>b</p></pre>", "```\nab\n```"),
    "list of paragraphs": ("<ul><li><p>a</p><p>b</p></li><li><p>c</p></li></ul>", "- a\n\n  b\n- c"),
    "deep list": (
        "<ol><li>a<ul><li>b<ol><li>c</li></ol></li></ul>d</li><li>e</li></ol>",
        "1. a\n  - b\n    1. c\n\n  d\n2. e",
    ),
    "two lists": ("<ul><li>a</li></ul><ul><li>b</li></ul>", "- a\n\n- b"),
    "list in between": ("<p>x</p><ul><li>a</li></ul>y", "x\n\n- a\n\ny"),
    "numbers go on after a nested list": (
        "<ol><li>a<ol><li>b</li><li>c</li></ol></li><li>d</li></ol>", "1. a\n  1. b\n  2. c\n2. d",
    ),
    "open list ends": ("<ol start=7><li>a<li>b</ol>", "7. a\n8. b"),
    "code in list": ("<ul><li><pre>a\nb</pre></li></ul>", "- ```\n  a\n  b\n  ```"),
    "stray item": ("<li>a</li><p>b</p>", "- a\n\nb"),
    "raw text": ("<textarea>a &lt; b</textarea>", "a < b"),
    "control characters": ("<p>a\x01b\x0fc</p>", "abc"),
}


@pytest.fixture(scope="module")
def rendered(spark):
    rows = [(name, f"<body>{body}</body>") for name, (body, _) in CASES.items()]
    made = page_markdown(spark.createDataFrame(rows, "page_id string, html string"), clean=False)
    return {r.page_id: r.markdown for r in made.collect()}


@pytest.mark.parametrize("name", list(CASES))
def test_rendering(rendered, name):
    assert rendered[name] == CASES[name][1]


def cleaned(text: str) -> str:
    """The line rules, said once more."""
    kept, code = [], False
    for line in text.split("\n"):
        bare = line.strip()
        code ^= bare.startswith("```")
        excused = re.match(r"\*|-|[123]\.", bare)
        drop = not code and re.search(r"\b[A-Za-z0-9+/=]{100,}\b", line)
        drop = drop or (not code and 0 < len(bare) < 5 and not excused)
        drop = drop or (len(bare) > 10 and len({*bare}) <= 2)
        if not drop:
            kept.append(line)
    return re.sub("\n\n\n+", "\n\n", "\n".join(kept)).strip()


def test_line_rules_on_derived_texts(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    dirty = derived.dirty_lines(documents)
    got = {r.doc_id: r.markdown for r in lines.clean_lines(dirty, "doc_id").collect()}
    for row in dirty.collect():
        assert got[row.doc_id] == cleaned(row.md)


def test_line_rules_on_random_texts(spark):
    rnd = random.Random(6)
    bits = ["```", "x=1", "ab", "- a", "1. a", "4. a", "", " ", "\x1f", "é" + "A" * 100, "A" * 100, "+" + "A" * 100 + "=", "A" * 99,
            "-" * 11, "-" * 10, "=-" * 6, "ab" * 8 + "c", "😀" * 11, "normal line", "  ```py", "\xa0\xa0ab\xa0", "a" * 50 + " " + "=" * 120]
    rows = [(i, "\n".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12)))) for i in range(600)]
    frame = spark.createDataFrame(rows, "id int, md string")
    got = {r.id: r.markdown for r in lines.clean_lines(frame, "id").collect()}
    for i, text in rows:
        assert got[i] == cleaned(text), repr(text)
    again = lines.clean_lines(lines.clean_lines(frame, "id"), "id", "markdown", "twice")
    assert again.count() == len(rows)


def test_line_rule_parameters(spark):
    frame = spark.createDataFrame([(1, "abc\nlonger\n" + "A" * 20)], "id int, md string")
    got = lines.clean_lines(frame, "id", min_line=3, gibberish_run="[A]{20,}").first().markdown
    assert got == "abc\nlonger"
