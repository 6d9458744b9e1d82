"""The operators of the data-preparation package on small tables, against plain brute force."""

from __future__ import annotations

import json
import random
import re
from hashlib import sha256
from itertools import pairwise
from pathlib import Path
from zlib import crc32

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pagemill.llm import chat, decontamination, jaccard, licenses, lines, packing, quality, sharding, substrings, urlfilter
from pagemill.operators.stage import Stage
from pagemill.llm.words import SPACED, Words, blocks, text_bytes

DOCS = "doc_id long, text string, n_words string, k_0 string, doc string"


@pytest.fixture(scope="module")
def awkward():
    """Documents with NULLs, empty, long, repeated and near-equal texts, ties and clashing columns."""
    random.seed(11)
    words = [f"w{k}" for k in range(40)] + ["é", "ß", "<x>", "a-b", "AbC"]

    def prose(n):
        return " ".join(random.choice(words) for _ in range(n))

    base = [prose(60) for _ in range(8)]
    texts = [None, "", " \t\n ", "one two", "One  TWO\n", "x" * 50_000, prose(6_000), "a b c d e f g h " * 40]
    for text in base:
        texts += [text, text]
        for _ in range(4):
            w = text.split(" ")
            for _ in range(random.randint(0, 2)):
                w[random.randrange(len(w))] = random.choice(words)
            texts.append(" ".join(w))
        texts.append(prose(30) + "\n" + text[20:200] + "\n" + prose(20))
    rows = [(k, t, "n", "k", "d") for k, t in enumerate(texts)]
    rows += [(None, base[0], "n", None, "d"), (3, base[1], "n", "k", None), (9, texts[9], "n", "k", "d"), (9, texts[9], "n", "k", "d")]
    random.shuffle(rows)
    return rows


def twin(rows, sql: str, names=("doc_id", "text"), **more):
    """Rows of a SQL twin over a small ``documents`` table."""
    import pandas as pd

    db = duckdb.connect()
    frame = pd.DataFrame([r[: len(names)] for r in rows], columns=list(names))
    if "doc_id" in names:
        frame["doc_id"] = frame["doc_id"].astype("Int64")
    db.register("documents", frame)
    for name, table in more.items():
        db.register(name, table)
    answer = db.execute(sql)
    columns = [d[0] for d in answer.description]
    return sorted((tuple(r[i] for i in np.argsort(columns)) for r in answer.fetchall()), key=repr)


def ours(frame):
    order = sorted(frame.columns)
    return sorted((tuple(r[c] for c in order) for r in frame.collect()), key=repr)


def test_words_are_those_of_the_pattern(awkward):
    import pyarrow as pa

    texts = [r[1] or "" for r in awkward]
    data, offsets = text_bytes(pa.array(texts))
    for low, high in blocks(offsets, 5_000):
        w = Words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], SPACED)
        prints = w.prints()
        for d in range(high - low):
            own = range(w.first[d], w.first[d + 1])
            found = [w.data[w.start[k] : w.end[k]].tobytes().decode() for k in own]
            assert found == re.findall(r"[^\x20\x09-\x0D]+", texts[low + d])
            assert len({prints[k] for k in own}) == len(set(found))


def test_leaks(spark, awkward):
    import pandas as pd

    docs = spark.createDataFrame(awkward, DOCS)
    items = [(0, awkward[0][1]), (1, None), (2, ""), (3, "one TWO"), (4, "w1 w2 nowhere"), (7, " ".join("w5 w6 w7 w8".split() * 5))]
    items += [(5, r[1][10:120]) for r in awkward if r[1] and 300 < len(r[1]) < 400][:3] + [(3, "one TWO")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = ours(decontamination.leak_report(docs, bench))
    assert got == twin(awkward, decontamination.ORACLE, benchmark=pd.DataFrame(items, columns=["item_id", "text"]))
    assert any(r[1] > 0 for r in got if r)
    # In several blocks the answer is the same, and clean documents keep all their columns.
    whole = decontamination.BENCHMARK_BYTES
    try:
        decontamination.benchmark_blocks.__defaults__ = ("item_id", "text", 100)
        assert ours(decontamination.leak_report(docs, bench)) == got
    finally:
        decontamination.benchmark_blocks.__defaults__ = ("item_id", "text", whole)
    left = decontamination.drop_leaks(docs, bench)
    assert left.columns == docs.columns
    assert left.count() == sum(1 for r in got if r[0] is False)
    assert decontamination.leak_report(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontamination.leak_report(docs.limit(0), bench).count() == 0


def test_longest_match_and_its_place(spark):
    docs = spark.createDataFrame([(1, "x a b c d e f y a b c d z")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "a b c d e f")], "item_id long, text string")
    row = decontamination.find_leaks(docs, bench, ["doc_id"], window=3).first()
    assert [(m.item_id, m.doc_start, m.n_words) for m in row.matches] == [("9", 1, 6)]
    assert row.hits == [1, 7, 8, 12]


def test_quality(spark, awkward):
    docs = spark.createDataFrame(awkward, DOCS)
    got = quality.quality(docs.select("doc_id", "text"), ["doc_id"])
    assert ours(got) == twin(awkward, quality.ORACLE)
    good = quality.keep_good(docs)
    assert good.columns == docs.columns
    assert good.count() == got.where("kept").count()
    # The order of the rules does not change the verdict.
    assert ours(quality.quality(docs, ["doc_id"], rules=quality.RULES[::-1])) == ours(got)
    assert quality.quality(docs.limit(0), ["doc_id"]).count() == 0


def near(a, b):
    return 100 * len(a & b) >= 75 * len(a | b)


def brute_components(rows):
    sets = []
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        sets.append((doc, {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()))
    parent = {d: d for d, _ in sets if d is not None}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, (d, a) in enumerate(sets):
        for e, b in sets[:i]:
            if d is not None and e is not None and a and b and near(a, b):
                x, y = sorted((root(d), root(e)))
                parent[y] = x
    return sorted(((d, len(s), None if d is None else root(d)) for d, s in sets), key=repr)


@pytest.mark.parametrize("cell", [1024, 4])
def test_jaccard(spark, awkward, cell, monkeypatch):
    monkeypatch.setattr(jaccard, "CELL", cell)
    docs = spark.createDataFrame(awkward, DOCS).repartition(5)
    got = sorted((tuple(r) for r in jaccard.similar_components(docs).collect()), key=repr)
    assert got == brute_components([(r[0], r[1]) for r in awkward])
    if cell == 4:
        left = jaccard.drop_near_duplicates(docs)
        assert left.columns == docs.columns
        assert left.count() == sum(1 for d, _, c in got if d is None or d == c)
        assert jaccard.similar_components(docs.limit(0)).count() == 0


def test_chains_of_near_copies(spark):
    """Links that go through documents other than the centre: only the trees can find them."""
    random.seed(3)
    words = [f"t{k}" for k in range(3000)]
    rows, text = [], words[:100]
    for k in range(60):
        rows.append((k, " ".join(text)))
        text = [*text[3:], *words[100 + 3 * k : 103 + 3 * k]]
    rows += [(100 + k, " ".join(random.choice(words) for _ in range(50)) + " " + " ".join(words[:30])) for k in range(20)]
    random.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in jaccard.similar_components(docs).collect()), key=repr)
    assert got == brute_components(rows)
    assert sum(1 for r in got if r[2] == 0) == 60


def test_tree_bounds_lose_nothing():
    random.seed(5)
    sets = []
    for _ in range(30):
        base = np.array(random.sample(range(10_000), 60), np.int64)
        for _ in range(random.randint(1, 4)):
            sets.append(np.unique(np.where(np.random.default_rng(len(sets)).random(60) < 0.08, np.random.default_rng(len(sets)).integers(0, 10_000, 60), base)))
    sizes = np.array([len(s) for s in sets])
    tree = jaccard.Tree(sets, sizes, np.arange(len(sets)))
    found = set(jaccard.dual_traversal(tree, tree, step=7))
    want = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and near(set(a.tolist()), set(b.tolist()))}
    assert want and want <= found and len(found) < len(sets) ** 2 / 4


@pytest.mark.parametrize("shard_bytes", [6 << 20, 3000])
def test_substrings(spark, awkward, shard_bytes, monkeypatch):
    monkeypatch.setattr(substrings, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 20_000)
    docs = spark.createDataFrame(awkward, DOCS)
    found = substrings.remove_repeats(docs, digest=True).select(F.col("doc").alias("doc_id"), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))
    got = ours(found)
    # A document without an id loses nothing; SQL leaves it out of every comparison, too.
    assert got == twin(awkward, substrings.ORACLE)
    assert sum(r[2] for r in got) > 1000
    if shard_bytes == 3000:
        texts = {r.doc: r.kept for r in substrings.remove_repeats(docs.where("doc_id > 9")).collect()}
        assert all(t == " ".join(t.split(" ")) for t in texts.values())
        assert substrings.remove_repeats(docs.limit(0)).count() == 0


def mutated(text, alphabet="abc"):
    s = list(text)
    for _ in range(random.randint(0, 3)):
        k, c, how = random.randrange(len(s) + 1), random.choice(alphabet), random.random()
        if how < 0.33:
            s.insert(k, c)
        elif k < len(s):
            s[k : k + 1] = [c] if how < 0.66 else []
    return "".join(s)


@pytest.mark.parametrize("pairs", [2000, 3])
def test_lines(spark, awkward, pairs, monkeypatch):
    monkeypatch.setattr(lines, "PAIRS", pairs)
    monkeypatch.setattr(lines, "MARKED_PAIRS", pairs)
    random.seed(5)
    base = ["".join(random.choice("ab ") for _ in range(random.randint(20, 30))) for _ in range(6)]
    rows = [(d, "\n".join(mutated(random.choice(base)) for _ in range(4))) for d in range(60)]
    rows += [(100 + d, f"Page number {d:03d} of the whole book") for d in range(120)]
    rows += [(500 + d, f"Sheet of the atlas, no. {7 * d}") for d in range(200)]
    rows += [(300 + k, r[1]) for k, r in enumerate(awkward)] + [(None, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = lines.line_classes(docs, short=True).select(
        F.col("doc").alias("doc_id"), "line_no", F.col("first_doc").alias("first_doc_id"), F.col("first_line").alias("first_line_no"), "kept"
    )
    assert ours(found) == twin(rows, lines.ORACLE)
    if pairs == 3:
        wide = docs.withColumn("_doc", F.lit(1)).withColumn("line_no", F.lit(2))
        left = lines.drop_near_lines(wide)
        assert left.columns == wide.columns and left.count() == len(rows)
        assert lines.line_classes(docs.limit(0)).count() == 0


def distance(x, y):
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def linked(pairs):
    """Sets of what hangs together."""
    sets = {}
    for a, b in pairs:
        both = sets.get(a, {a}) | sets.get(b, {b})
        for x in both:
            sets[x] = both
    return {frozenset(x) for x in sets.values()}


@pytest.mark.parametrize("edits", [1, 2])
def test_links_of_crowded_lines(spark, edits):
    """Every link to the least line of a set is within the distance, and what is near hangs together."""
    random.seed(edits)
    texts = {"".join(random.choice("abé") for _ in range(random.randint(0, 7))) for _ in range(150)}
    texts |= {mutated("a longer text that repeats aaaa", "ax") for _ in range(60)} | {"aa", "aaa", "aaaa", ""}
    texts = sorted(texts)
    frame = spark.createDataFrame([(k, t, len(t)) for k, t in enumerate(texts)], "line long, text string, n int")
    found = [(r.a, r.b) for r in lines._star_pairs(frame, Stage(spark, "stars"), edits).collect()]
    assert all(distance(texts[a], texts[b]) <= edits for a, b in found)
    near = [(a, b) for b in range(len(texts)) for a in range(b) if abs(len(texts[a]) - len(texts[b])) <= edits and distance(texts[a], texts[b]) <= edits]
    assert linked(found) == linked(near) and len(near) > 100


def test_keys_of_a_template_grow_with_its_lines(spark):
    """Twelve times as many lines that crowd under the same keys make about as many times the keys."""
    rows = {}
    for n in (400, 4800):
        kept = {}

        class Counting(Stage):
            def save(self, frame, name):
                kept[name] = super().save(frame, name)
                return kept[name]

        made = spark.createDataFrame([(f"Sheet of the atlas, no. {7 * k} of the set",) for k in range(n)], "text string")
        texts = made.select(F.xxhash64("text").alias("line"), "text", F.length("text").alias("n"))
        lines.candidate_pairs(texts, Counting(spark, "template")).count()
        rows[n] = {name: frame.count() for name, frame in kept.items() if name.startswith(("entries", "decompositions"))}
    assert len(rows[400]) == 3
    assert all(rows[4800][name] <= 2.5 * 12 * many for name, many in rows[400].items())


def test_short_lines_go_by_their_text(spark):
    """Repeats of lines under the bound go too, blank lines stay, rows of one id lose only their own lines."""
    page = "Les.\n\n}\n \t\nA line that is long enough, number one"
    rows = [(1, page), (2, page), (2, "only here\nLes.\nLes\n}\n}"), (3, "Les.\nles.\n\u00a0\n\u00a0"), (None, page), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = lines.drop_near_lines(docs)
    wanted = [(1, page), (2, "\n \t"), (2, "only here\nLes"), (3, "les.\n\u00a0\n\u00a0"), (None, page), (4, None), (5, "")]
    assert ours(left) == sorted(wanted, key=repr)
    first = {}
    for d, k, line in sorted((d, k, line) for d, t in rows if d and t for k, line in enumerate(t.split("\n")) if line.strip()):
        first.setdefault(line, (d, k))
    expected = {(d, k, *first[line], (d, k) == first[line]) for d, t in rows if d and t for k, line in enumerate(t.split("\n")) if line.strip()}
    found = lines.line_classes(docs, short=True).select("doc", "line_no", "first_doc", "first_line", "kept")
    assert {tuple(r) for r in found.collect()} == expected


def test_banded_distance(spark):
    random.seed(8)
    pairs = []
    for _ in range(300):
        a = "".join(random.choice("abé") for _ in range(random.randint(0, 12)))
        pairs.append((a, mutated(a, "abé") if random.random() < 0.8 else "ab"))
    frame = spark.createDataFrame(pairs, "x string, y string").select("x", "y", *(lines.within(F.col("x"), F.col("y"), e).alias(f"w{e}") for e in (1, 2, 3)))

    def table(x, y):
        row = list(range(len(y) + 1))
        for i, c in enumerate(x, 1):
            last, row[0] = row[0], i
            for j, d in enumerate(y, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
        return row[-1]

    for r in frame.collect():
        distance = table(r.x, r.y)
        assert (r.w1, r.w2, r.w3) == (distance <= 1, distance <= 2, distance <= 3), (r.x, r.y)


def test_sharding(spark, awkward):
    rows = awkward + [(1000 + k % 7, "hot text that a third of all rows have", "n", "k", "d") for k in range(len(awkward) // 2)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    for most in (4096, 3):
        found = sharding.assign_shards(
            docs, F.coalesce(F.xxhash64("text"), F.lit(0)), F.coalesce(F.octet_length("text"), F.lit(0)) + 1, F.col("doc_id"),
            ["doc_id", "text", "text_crc32"], n_shards=4, range_rows=most,
        ).collect()
        assert sorted((repr(r.doc_id), repr(r.text)) for r in found) == sorted((repr(r[0]), repr(r[1])) for r in rows)
        longest = max(r["size"] for r in found)
        total = sum(r["size"] for r in found)
        for s in range(4):
            own = [r for r in found if r.shard == s]
            assert sorted(r.slot for r in own) == list(range(len(own)))
            assert abs(sum(r["size"] for r in own) - total / 4) <= longest + total / 32
        for r in found:
            assert r["size"] == len((r.text or "").encode()) + 1 and r.text_crc32 == crc32((r.text or "").encode())
    assert sharding.assign_shards(docs.limit(0), F.xxhash64("text"), F.lit(1), F.col("doc_id"), ["doc_id"]).count() == 0


def plain_cut(records, n_shards):
    """``records``: (key, sub, size, name) -> rows of name, size, shard and slot, by one sort and one pass."""
    records = sorted(records, key=lambda r: r[:2])
    total, end = sum(r[2] for r in records), 0
    group, begin, middle = {}, {}, []
    for key, _, size, _ in records:
        begin.setdefault(key, end)
        group[key] = group.get(key, 0) + size
        end += size
        middle.append(end - -(-size // 2))
    slots, rows = [0] * n_shards, []
    for (key, _, size, name), at in zip(records, middle, strict=True):
        if group[key] * 16 * n_shards < total and sum(1 for r in records if r[0] == key) > 1:
            at = begin[key]
        shard = min(at * n_shards // total, n_shards - 1)
        rows.append((*name, size, shard, slots[shard]))
        slots[shard] += 1
    return sorted(rows, key=repr)


def test_shards_are_those_of_a_plain_cut(spark, awkward):
    """Whatever the ranges and however the rows lie, the shards are those of one sorted list; equal texts stay together."""
    rows = [r[:2] for r in awkward if not r[1] or len(r[1]) < 5_000] + [(2000 + k % 40, f"a text that has some copies, {k % 9}") for k in range(90)]
    rows += [(None, "hot text that a third of all rows have")] * 40 + [(7, "hot text that a third of all rows have")] * 60
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    key, size = F.coalesce(F.xxhash64("text"), F.lit(0)), F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    known = docs.select(key.alias("key"), F.xxhash64("doc_id").alias("sub"), size.alias("bytes"), "doc_id", "text").collect()
    want = plain_cut([(r["key"], r["sub"], r["bytes"], (r["doc_id"], r["text"])) for r in known], 4)
    for parts, most in ((5, 4096), (3, 3)):
        found = sharding.assign_shards(docs.repartition(parts), key, size, F.col("doc_id"), ["doc_id", "text"], n_shards=4, range_rows=most)
        assert sorted(((r.doc_id, r.text, r["size"], r.shard, r.slot) for r in found.collect()), key=repr) == want
    shards = {}
    for _, text, _, shard, _ in want:
        shards.setdefault(text, set()).add(shard)
    assert all(len(s) == 1 for t, s in shards.items() if t and t.startswith("a text that has"))


def test_urls(spark, monkeypatch):
    import pandas as pd

    hosts = ["a.com", "example.com", "www.example.com", "x.www.example.com", "net", "b.net", "COM", "notexample.com", "a.org", "org", ""]
    paths = ["", "/", "/en", "/en/", "/en/a", "/es/b?x", "/fr/#y", "/de/q"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "nothing", "a://b://c.com/en/", "http://h?x=1://y/", "http://u\nv.com/\nx"]
    urls += [f"https://m{k}.org/p{k % 50}" for k in range(200)] + ["http://a.org/de/q"] * 2 + ["http://long.org/" + "x" * 100_000]
    rows = list(enumerate(urls))
    pages = spark.createDataFrame([(k, u, "h") for k, u in rows], "page_id long, url string, host string")
    want = twin(rows, urlfilter.ORACLE.replace("from pages", "from documents"), ("page_id", "url"))
    for most in (1 << 17, 1):
        monkeypatch.setattr(urlfilter, "LIST_KEYS", most)
        assert ours(urlfilter.judge_urls(pages, urlfilter.listed_pages(pages))) == want
    # With filters so small that many keys pass by mistake, the levels still tell them apart.
    monkeypatch.setattr(urlfilter, "BITS_PER_KEY", 2)
    monkeypatch.setattr(urlfilter, "HASHES", 1)
    monkeypatch.setattr(urlfilter, "LIST_KEYS", 1 << 17)
    assert ours(urlfilter.judge_urls(pages, urlfilter.listed_pages(pages))) == want
    empty = pages.limit(0)
    assert urlfilter.judge_urls(empty, urlfilter.listed_pages(empty)).count() == 0


def test_levels_of_a_page_list(spark):
    """A list of a thousand pages takes three levels or more, and each of them is needed for an exact answer."""
    pages = spark.range(4000).select("id", F.concat(F.lit("http://h"), F.col("id") % 7, F.lit(".org/p"), "id").alias("url"))
    listed = urlfilter.listed_pages(pages).persist()
    cascade = urlfilter.build_cascade(listed, Stage(spark, "levels"), "pages")
    assert 800 < listed.where("listed").count() < 1200
    assert len(cascade.parts) == 1 and len(cascade.parts[0]) >= 3
    assert listed.where(cascade.has(F.col("key")) != F.col("listed")).count() == 0
    for depth in range(1, len(cascade.parts[0])):
        shorter = urlfilter.Cascade([cascade.parts[0][:depth]])
        assert listed.where(shorter.has(F.col("key")) != F.col("listed")).count() > 0


def test_chat(spark):
    rows = [
        (1, 0, "user", "hi <turn role=\"x\">"), (1, 1, "assistant", "\\l \\\\ \\b</turn>\n"),
        (2, 0, "system", "s"), (2, 1, "user", None), (2, 2, "assistant", ""),
        (3, 0, "system", "s"), (3, 1, "user", "é\u0000😀"), (3, 2, "assistant", "a"), (3, 3, "assistant", "b"),
        (4, 0, "human", "q"), (4, 0, "gpt", "ä"), (4, 0, "gpt", "ä"), (5, 0, None, None), (6, 1, 'to"ol', "{}"),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    records = chat.conversation_records(frame)
    done = chat.format_turns(chat.canonical_turns(records))
    assert done.select("fingerprint").distinct().count() == 4
    for r in done.select("conv_id", chat.read_back(F.col("formatted")).alias("read"), chat.loss_text("formatted", "loss_spans").alias("loss")).collect():
        own = sorted((t, role or "", text or "") for c, t, role, text in rows if c == r.conv_id)
        assert [(t.role, t.text) for t in r.read] == [(role, text) for _, role, text in own]
        assert r.loss == "".join(text for _, role, text in own if role == "assistant")
    odd = spark.createDataFrame([("{",), ("3",), ('{"unknown": 1}',), (None,)], "record string")
    assert [(r.turns, r.formatted) for r in chat.format_turns(chat.canonical_turns(odd)).collect()] == [(None, None)] * 4


def test_turns_come_from_the_mappings(spark):
    """Each conversation is read by the parts of its layout: other parts, other turns; no layout, no turns."""
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "system", "s"), (2, 1, "user", "u"), (2, 2, "assistant", "a")]
    rows += [(3, 0, "system", "s"), (3, 1, "user", "u"), (3, 2, "tool", "t"), (4, 0, "gpt", "x"), (5, 0, "system", "alone")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")

    def turns(layouts):
        return {r.conv_id: r.turns and [tuple(t) for t in r.turns] for r in chat.conversation_turns(frame, layouts).collect()}

    own = turns(chat.LAYOUTS)
    assert own == {c: [(r, t) for d, _, r, t in rows if d == c] for c in range(1, 6)}
    nobody = tuple(x._replace(parts=(chat.Field("nobody", "$.nothing"),)) for x in chat.LAYOUTS)
    assert turns(nobody) == {c: [("nobody", "")] for c in range(1, 6)}
    by_name = {x.name: x for x in chat.LAYOUTS}
    swapped = by_name["prompt"]._replace(parts=(chat.Field("assistant", "$.prompt"), chat.Field("user", "$.completion")))
    assert turns((swapped, by_name["messages"])) == {1: [("assistant", "q"), ("user", "a")], 2: None, 3: None, 4: own[4], 5: own[5]}
    forms = chat.structured(frame)
    assert {chat.type_paths(forms.schema[f].dataType) for f in chat.FORMS} == {x.paths for x in chat.LAYOUTS}


def test_chat_of_any_size(spark, tmp_path):
    """Turns beyond the limits of the JSON parser are kept; a JSON record beyond them is an error."""
    long = "a<" * 10_000_001
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", long), (2, 0, "system", "s"), (2, 1, "user", None), (2, 2, "tool", "t"), (2, 3, "assistant", "x\n")]
    rows += [(3, 0, "system", "s"), (3, 1, "user", "u"), (3, 2, "assistant", "a"), (None, 0, "human", long), (None, 1, None, "b")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r.conv_id: r for r in chat.query(spark, str(tmp_path)).collect()}
    for conv in (1, 2, 3, None):
        own = [(r or "", t or "") for c, _, r, t in rows if c == conv]
        assert found[conv].n_turns == len(own)
        assert found[conv].turns_sha256 == sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert found[conv].loss_sha256 == sha256("".join(t for r, t in own if r == "assistant").encode()).hexdigest()
    small = frame.where(F.length(F.coalesce("text", F.lit(""))) < 100)
    parsed = chat.canonical_turns(chat.conversation_records(small)).select("conv_id", "fingerprint", "turns")
    assert ours(chat.conversation_turns(small)) == ours(parsed)
    big = spark.range(1).select(F.to_json(F.struct(F.lit("q").alias("prompt"), F.repeat(F.lit("a"), 20_000_001).alias("completion"))).alias("record"))
    with pytest.raises(Exception, match="beyond the limits"):
        chat.canonical_turns(big).select("turns").collect()


def test_conversations_are_parsed_records(spark, monkeypatch):
    """Fingerprint and turns come from the record of each conversation; what JSON cannot hold is read from its struct, unchanged."""
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "system", "s"), (2, 1, "user", "u"), (2, 2, "assistant", "")]
    rows += [(3, 0, "system", "s"), (3, 1, "tool", "t"), (4, 0, None, None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    broken = spark.range(1).selectExpr("5L as conv_id", "0L as turn", "'user' as role", "cast(unhex('41ff42') as string) as text")
    wide = spark.range(1).selectExpr("6L as conv_id", "0L as turn", "'user' as role", "repeat('\U0001F600', 10000001 + cast(id as int)) as text")
    frame = frame.union(broken).union(wide)
    digests = F.transform("turns", lambda t: F.concat(t["role"], F.lit(" "), F.sha2(t["text"].cast("binary"), 256))).alias("turns")
    found = {r.conv_id: r for r in chat.conversation_turns(frame).select("conv_id", "fingerprint", digests).collect()}
    texts = {(c, t): (text or "").encode() for c, t, _, text in rows} | {(5, 0): b"A\xffB", (6, 0): ("\U0001F600" * 10_000_001).encode()}
    roles = {(c, t): role or "" for c, t, role, _ in rows} | {(5, 0): "user", (6, 0): "user"}
    assert {c: r.turns for c, r in found.items()} == {
        c: [f"{roles[k]} {sha256(texts[k]).hexdigest()}" for k in sorted(texts) if k[0] == c] for c in range(1, 7)
    }
    assert len({r.fingerprint for r in found.values()}) == 4 and len({found[c].fingerprint for c in (4, 5, 6)}) == 1

    seen = []
    parse = chat.canonical_turns
    other = F.when(F.col("conv_id") == 1, F.lit('{"messages": [{"content": "y", "role": "x"}]}')).otherwise(F.col("record"))
    monkeypatch.setattr(chat, "canonical_turns", lambda records, **more: seen.append(records) or parse(records.withColumn("record", other), **more))
    turns = chat.conversation_turns(frame).where("conv_id = 1").first()
    assert [tuple(t) for t in turns.turns] == [("x", "y")] and turns.fingerprint == found[4].fingerprint
    records = {r.conv_id: r.record for r in seen[0].select("conv_id", "record").collect()}
    assert {c for c, record in records.items() if record is None} == {5, 6}
    assert json.loads(records[1]) == {"prompt": "q", "completion": "a"} and json.loads(records[4]) == {"messages": [{"role": "", "content": ""}]}


def test_licenses(spark, awkward):
    mit = licenses.NOTICES[4][1]
    rows = awkward + [
        (500, "Copyright (c) 2020 Somebody\n\n" + mit.upper().replace(", ", " ,  ")), (501, "text\n© me\n released under the MIT Licence!\nmore"),
        (502, "We do not say: Released under the MIT License."), (503, "Copyright 1\nCopyright 2"),
    ]
    docs = spark.createDataFrame([(r[0], r[1], "x") for r in rows], "doc_id long, text string, license string")
    known = spark.createDataFrame(list(licenses.NOTICES), "license string, text string")
    found = licenses.scan_licenses(docs, known)
    assert ours(found) == twin(rows, licenses.ORACLE)
    seen = {r.doc_id: (r.text_license, r.n_license_lines, r.licenses) for r in found.collect()}
    assert seen[500] == ("MIT", 0, "MIT") and seen[501] == (None, 1, "MIT") and seen[502] == (None, 0, "") and seen[503] == (None, 0, "")
    assert licenses.scan_licenses(docs.limit(0), known).count() == 0


def test_license_files(spark):
    """Whole LICENSE files as they are found, each with its own lines and title; a changed text is none of them."""
    folder = Path(__file__).with_name("license_files")
    files = sorted(folder.glob("*.txt"))
    assert len(files) >= 10
    rows = [(k, f.read_text(encoding="utf-8")) for k, f in enumerate(files)]
    rows += [(100 + k, "\n".join(text.split("\n")[1:])) for k, text in rows if files[k].name.startswith(("MIT", "ISC"))]
    rows += [(200, rows[0][1].replace("Work", "Word")), (201, "Code\nSPDX-License-Identifier: GPL-2.0-only\nLicensed under the MPL 2.0")]
    rows += [(202, "# Widget\nThis project is licensed under the BSD 3-Clause License.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    known = spark.createDataFrame(licenses.known_licenses(), "license string, text string")
    found = {r.doc_id: (r.text_license, r.licenses) for r in licenses.scan_licenses(docs, known).collect()}
    assert [found[k][0] for k in range(len(files))] == [f.stem.split("_")[0] for f in files]
    assert {found[k][0] for k in found if 100 <= k < 200} == {"MIT", "ISC"}
    assert found[200] == (None, "") and found[201] == (None, "GPL-2.0") and found[202] == (None, "BSD-3-Clause")


def plain_pack(sizes, lengths, least):
    """Contents of the bins of best fit, by looking at every open bin."""
    per_token = sorted((n for n in lengths if n >= least), key=lambda n: packing.cost(n) / n)
    room, filled, used = [], [], {}
    for step, size in enumerate(sizes):
        # Of bins with equal room the one used last is taken.
        fits = [(r, -used[k], k) for k, r in enumerate(room) if r >= size]
        if fits:
            k = min(fits)[2]
        else:
            room.append(next((n for n in per_token if n >= size), max(lengths)))
            filled.append(0)
            k = len(room) - 1
        room[k] -= size
        filled[k] += size
        used[k] = step
    return sorted(filled)


def test_best_fit_is_that_of_a_plain_search():
    random.seed(2)
    lengths = (8, 16, 40)
    for _ in range(30):
        sizes = sorted((random.randint(1, 40) for _ in range(80)), reverse=True)
        for least in lengths:
            bins, contents = packing.best_fit(sizes, lengths, least)
            assert sorted(contents) == plain_pack(sizes, lengths, least)
            of_bins = [0] * len(contents)
            for number, size in zip(bins, sizes, strict=True):
                of_bins[number] += size
            assert of_bins == contents
        prices = []
        for least in lengths:
            plain = plain_pack(sizes, lengths, least)
            prices.append(sum(packing.cost(min(n for n in lengths if n >= size)) for size in plain))
        _, final = packing.pack(sizes, lengths)
        assert sum(map(packing.cost, final)) == pytest.approx(min(prices))


def test_packing_keeps_every_token(spark, awkward):
    docs = spark.createDataFrame(awkward, DOCS)
    found = packing.pack_documents(docs, lengths=(64, 256, 1024), group_pieces=40).collect()
    total = sum(len((r[1] or "").encode()) + 1 for r in awkward)
    assert sum(r.n_tokens for r in found) == total
    by_bin = {}
    for r in found:
        by_bin.setdefault(r.bin, []).append(r)
    for rows in by_bin.values():
        rows.sort(key=lambda r: r.bin_start)
        assert rows[0].bin_start == 0 and all(a.bin_start + a.n_tokens == b.bin_start for a, b in pairwise(rows))
        filled = sum(r.n_tokens for r in rows)
        assert rows[0].bin_length == min(n for n in (64, 256, 1024) if n >= filled)
    assert packing.pack_documents(docs.limit(0)).count() == 0


def test_digest_of_nothing(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert substrings.remove_repeats(docs, digest=True).first().kept == sha256(b"").hexdigest()


def test_packing_of_given_counts(spark):
    """Counts of 0, below 0 and NULL are one piece without tokens; no row is lost, no token is made."""
    rows = [(1, 0), (2, None), (3, -5), (4, 7), (5, 40), (6, 16)]
    docs = spark.createDataFrame(rows, "doc_id long, counted long")
    found = packing.pack_documents(docs, text="counted", tokens=F.col("counted"), lengths=(8, 16)).collect()
    by_doc = {}
    for r in found:
        by_doc.setdefault(r.doc, []).append(r.n_tokens)
        assert r.piece >= 0 and r.bin_length in (8, 16)
    assert {d: sorted(n) for d, n in by_doc.items()} == {1: [0], 2: [0], 3: [0], 4: [7], 5: [8, 16, 16], 6: [16]}


@pytest.mark.parametrize("bits", [0, 7, 8, 13, 16])
def test_packed_fingerprints_round_trip(bits):
    draw = np.random.Generator(np.random.PCG64(bits))
    value = draw.integers(0, 2**64, 500, dtype=np.uint64, endpoint=False)
    bucket = (value >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(500, np.int64)
    for b in set(bucket.tolist()):
        own = value[bucket == b]
        assert (jaccard._uncut(jaccard._cut(own, bits), bits, b) == own).all()
    for doc in ([], [0], [3, 3, 9], [0] * 300 + [1], [70_000, 70_000, 900_000], list(range(400))):
        assert jaccard._unpacked(jaccard._packed(np.array(doc, np.int32))).tolist() == doc
