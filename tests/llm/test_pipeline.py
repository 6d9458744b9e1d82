"""The pipeline, stage by stage, against plain Python and the operators' SQL on planted documents."""

from __future__ import annotations

import random
import re

import corpus_pipeline
import pytest
from pagemill.llm import lines, packing, quality
from pagemill.operators.stage import Stage
from test_operators import brute_components, twin

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def plain_quality(rows, bench):
    """In a twin's rows the columns are in the order of their names."""
    names = sorted(("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"))
    verdict = {r[names.index("doc_id")]: r[names.index("kept")] for r in twin(rows, quality.ORACLE)}
    return [r for r in rows if verdict[r[0]]]


def plain_lines(rows, bench):
    names = sorted(("doc_id", "line_no", "first_doc_id", "first_line_no", "kept"))
    gone = {(r[names.index("doc_id")], r[names.index("line_no")]) for r in twin(rows, lines.ORACLE) if not r[names.index("kept")]}
    return [(d, "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone)) for d, t in rows]


def plain_join(rows, bench):
    return [r for r in rows if next(c for d, _, c in brute_components(rows) if d == r[0]) == r[0]]


def plain_leaks(rows, bench):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())

    def runs(text, size):
        w = words(text)
        return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}

    windows = set()
    for text in bench:
        windows |= runs(text, min(10, len(words(text)))) if words(text) else set()
    return [r for r in rows if not any(runs(r[1], n) & windows for n in {len(x) for x in windows})]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    random.seed(17)
    vocabulary = [a + b + c for a in ("ba", "ke", "lo", "mi", "tu") for b in ("r", "n", "st", "l") for c in ("a", "en", "ok", "im")]

    def sentence(n=12):
        return " ".join(random.choice(vocabulary) for _ in range(n)) + "."

    def page(n=8):
        return [sentence() for _ in range(n)]

    notice = "This page may be copied by all who keep this line with it"
    bench = [sentence(14), "nowhere else to be found at all in any of these texts", None, ""]
    pages = [page() for _ in range(14)]
    pages += [[*page(), notice + end] for end in ("", ".", "!")]
    pages += [[*page(3), "So it was said: " + bench[0], *page(3)], page(60)]
    pages += [[random.choice(vocabulary) for _ in range(6)], ["the same five words again"] * 30]
    texts = ["\n".join(p) for p in pages]
    # Near copies whose lines differ by more than the line dedup forgives, cut in other places.
    for p in pages[:3]:
        w = " ".join(p).split(" ")
        w[30] = "changed"
        texts.append("\n".join(" ".join(w[k : k + 17]) for k in range(0, len(w), 17)))
    rows = [(k, t) for k, t in enumerate([*texts, "", None])]
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame([(d, "web", "en", len(t or ""), t) for d, t in rows], COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, bench


def test_each_stage_like_plain_python(spark, folder):
    path, rows, bench = folder
    docs, stage = spark.read.parquet(f"{path}/documents.parquet"), Stage(spark, "stages")
    columns = docs.columns
    for k, ((_, step), plain) in enumerate(zip(corpus_pipeline.STAGES, (plain_quality, plain_lines, plain_join, plain_leaks))):
        docs = stage.save(step(spark, docs, path), str(k))
        assert docs.columns == columns
        before, rows = rows, plain(rows, bench)
        assert rows != before, corpus_pipeline.STAGES[k][0]
        assert sorted((tuple(r) for r in docs.select("doc_id", "text").collect()), key=repr) == sorted(rows, key=repr), corpus_pipeline.STAGES[k][0]
    packed = corpus_pipeline.run(spark, path).collect()
    sizes = {}
    for r in packed:
        sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.n_tokens
    assert sizes == {d: len((t or "").encode()) + 1 for d, t in rows}
    filled = {}
    for r in packed:
        filled.setdefault((r.bin, r.bin_length), []).append(r.n_tokens)
    _, final = packing.pack(sorted(sizes.values(), reverse=True))
    assert sorted(n for _, n in filled) == sorted(final)
    assert all(sum(own) <= n for (_, n), own in filled.items())


def test_pipeline_of_nothing(spark, folder, tmp_path):
    for table in ("documents", "benchmark"):
        spark.read.parquet(f"{folder[0]}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
