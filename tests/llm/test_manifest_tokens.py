"""Merkle manifest, token files and tokenizer alignment against plain brute force."""

from __future__ import annotations

import random
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pagemill.llm import alignment, merkle, tokenfiles, tokens
from pagemill.llm.tokens import WordEncoder, byte_level_encoder
from pagemill.operators.stage import Stage

WORD, BYTE, PIECE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ROWS = "doc_id long, source string, lang string, n_chars long, text string, tree string, path string"


def digest(text):
    return sha256(text.encode()).hexdigest()


def parents(nodes):
    return [digest("".join(nodes[k : k + 3])) for k in range(0, len(nodes), 3)]


def climb(nodes, at):
    """Digests beside a leaf and its ancestors, level by level, and the root."""
    beside = []
    while len(nodes) > 1:
        first = at - at % 3
        beside.append((at % 3, [d for k, d in enumerate(nodes[first : first + 3]) if first + k != at]))
        nodes, at = parents(nodes), at // 3
    return beside, nodes[0]


def plain_manifest(rows):
    def leaf(row):
        return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row[:5]))

    trees = {}
    for row in rows:
        trees.setdefault((row[1] is not None, (row[1] or "").encode()), []).append(row)
    names = sorted(trees)
    leaves = {n: sorted(((r[0] is not None, r[0] or 0, leaf(r), r) for r in trees[n]), key=lambda x: x[:3]) for n in names}
    subroots = [climb([x[2] for x in leaves[n]], 0)[1] for n in names]
    out = []
    for k, name in enumerate(names):
        top, root = climb(subroots, k)
        for at, (_, _, own, row) in enumerate(leaves[name]):
            path, subroot = climb([x[2] for x in leaves[name]], at)
            now = own
            if row[0] is not None and crc32(str(row[0]).encode()) % 2 == 0:
                now = leaf((*row[:4], None if row[4] is None else row[4].replace("\n", "")))
            folded = now
            for place, others in path + top:
                folded = digest("".join([*others[:place], folded, *others[place:]]))
            proof = digest("".join(d for _, others in path + top for d in others))
            out.append((row[0], own, subroot, root, proof, folded))
    return Counter(out)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    found = [(k, rnd.choice([None, "", "a", "b", "é", "long"]), rnd.choice([None, "en"]), k % 7, rnd.choice([None, "", "one\ntwo", f"text {k}\n", "x" * 9000 + "\n"]), "t", "p") for k in range(60)]
    found += [(k, "hot", "en", 4, f"row\n{k}", "t", "p") for k in range(-5, 2600)]
    found += [(None, "hot", None, None, "no id\n", "t", None), (None, "hot", None, None, "no id\n", "t", None), (4, "hot", "en", 4, "other row of 4", "t", "p"), (7, "alone", "en", 1, "a\nb", "t", "p")]
    rnd.shuffle(found)
    return found


@pytest.fixture(scope="module")
def manifest(spark, rows):
    return merkle.document_manifest(spark.createDataFrame(rows, ROWS).repartition(5))


def test_manifest_like_plain_trees(manifest, rows):
    got = Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in manifest.documents().collect())
    assert got == plain_manifest(rows)


def test_versions_share_all_but_their_ancestors(spark, manifest, rows):
    documents = {(r.tree, r.pos): r for r in manifest.documents().drop("copies").collect()}
    nodes = {(r.tree, r.level, r.pos): r.digest.hex() for r in manifest.nodes().collect()}
    hot = [nodes[("=hot", 0, k)] for k in range(sum(t == "=hot" for t, _ in documents))]
    level = 0
    while len(hot) > 1:
        hot, level = parents(hot), level + 1
        assert hot == [nodes[("=hot", level, k)] for k in range(len(hot))]
    assert max(k[1] for k in nodes if k[0] == "=hot") == level == 8
    some = [r for r in documents.values() if r.tampered and r.tree == "=hot"][:40]
    wanted = [(r.tree, r.pos, tree, lv, p) for r in some for tree, lv, p in (("=hot", level, 0), ("=hot", 1, r.pos // 3), ("=hot", 1, 0), ("=hot", 1, 400), (merkle.TOP, 0, 5))]
    read = manifest.read(spark.createDataFrame(wanted, "version_tree string, version_pos long, tree string, level int, pos long"))
    for r in read.collect():
        mine = documents[(r.version_tree, r.version_pos)]
        if r.level == 1 and r.pos == mine.pos // 3:
            run = [nodes[("=hot", 0, k)] if k != mine.pos else mine.tampered for k in range(r.pos * 3, r.pos * 3 + 3) if ("=hot", 0, k) in nodes]
            assert r.digest.hex() == parents(run)[0]
        elif r.level == 1:
            assert r.digest.hex() == nodes[(r.tree, r.level, r.pos)]
    own = manifest.versions().where("version_tree = '=hot'").groupBy("version_pos").count().select("count").distinct().collect()
    assert [r[0] for r in own] == [1 + level + 2]  # the leaf, its ancestors, and those above the subroot


def test_leaves_as_they_were_are_folded(manifest):
    """A wrong digest above the trees shows on every leaf, not only on tampered ones."""
    [block] = [r.asDict(recursive=True) for r in manifest.forest.block_paths().where("tree = '=alone'").collect()]
    names = ("tree", "block", "levels", "items", "changes", "path", "root")
    for wrong in (False, True):
        above = [{"place": 0, "others": [b"x" * 32 if wrong else b"y" * 32]}]
        root = merkle.fold(block["root"], [{"place": 0, "others": [b"y" * 32]}])[-1]
        batch = pa.RecordBatch.from_pylist([{**{n: block[n] for n in names}, "changes": [None], "top_path": above, "top_pos": 0, "top_root": root}])
        [row] = [r for b in merkle._document_rows(iter([batch])) for r in b.to_pylist()]
        assert row["tampered"] is None and row["copies"] is None
        assert (row["folded_root"] == row["root"]) is not wrong


def test_manifest_of_nothing_and_of_one_row(spark):
    empty = spark.createDataFrame([], ROWS)
    assert merkle.document_manifest(empty).documents().count() == 0
    [one] = merkle.document_manifest(spark.createDataFrame([(7, None, None, None, None, "t", "p")], ROWS)).documents().collect()
    assert one.leaf == one.subroot == one.root == one.folded_root == digest("1:7----") and one.proof_sha256 == digest("")


ODD = [
    None, "", " ", "  ", "\n", " \n ", "a", " a", "a ", "a  b", "it's we'll I'D", "tab\there", "a\r\nb\n\n\nc", "x1y22z333 4", "é İİ. Å",
    "ﬁx  y z", "end.<|endoftext|>more <|startoftext|>x", "<s> </s> <0x0A> <unk>", "▁x a▁", "日本語 텍스트 🙂🙂 عربي", "≮ a≮b", "\x00\x1f\x7f",
    "w" * 5000, "-" * 300 + "'" * 3, "don't stop. " * 3000, "ͅaͅ ΑΣ ς", "\x1c a\x85 b", "#$%&'()*+,-./:;<=>?@[]^_`{|}~", "ſt ŉ ǅ",
]


def odd_texts(n):
    rnd = random.Random(n)
    bits = [" ", " ", "  ", "\n", "\t", "a", "Bc", "déjà", "don't", "'", "'s", "...", "1", "23", "é", "é", "🙂", "▁", " ", "<|endoftext|>", "-", "ß", "İ", "_", "x.y"]
    return ODD + ["".join(rnd.choice(bits) for _ in range(rnd.randint(1, 14))) for _ in range(n)]


def test_words_of_a_block_like_the_library():
    library, encoder = Tokenizer.from_file(WORD), WordEncoder(WORD)
    texts = odd_texts(3000)
    for _ in range(2):  # the second time words are known
        got = encoder.texts(pa.array(texts, pa.string())).to_pylist()
        assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_byte_level_ids_like_the_library():
    library = Tokenizer.from_file(BYTE)
    library.encode_special_tokens = True
    encode, table = byte_level_encoder(BYTE)
    for text in odd_texts(2000):
        ids = np.frombuffer(encode(f" {text or ''}"), "<u4").tolist()
        assert ids == library.encode(f" {text or ''}", add_special_tokens=False).ids
        assert b"".join(table[k] for k in ids).decode() == f" {text or ''}"


def awkward(texts):
    documents = [(k * 3, t, "n", "f", 1) for k, t in enumerate(texts)]
    return documents + [(None, "no id", "n", "f", 1), (None, "no id", "n", "f", 1), (6, "again six", "n", "f", 1), (6, "again six", "n", "f", 1)]


NAMES = "doc_id long, text string, n string, frame string, file int"


def test_token_files_round_trip(spark):
    library = Tokenizer.from_file(WORD)
    documents = awkward(odd_texts(300))
    folder = f"{Stage(spark, 'tokens-test').root}/out"
    tokenfiles.write_token_files(spark.createDataFrame(documents, NAMES).repartition(4), folder, WORD, 2, 49408, file_bytes=2000)
    rows = tokenfiles.with_starts(spark, folder, tokenfiles.read_token_files(spark, folder)).orderBy("file", "number").collect()
    assert len({r.file for r in rows}) > 3
    want = [(d, [*library.encode(t or "", add_special_tokens=False).ids, 2]) for d, t, *_ in documents]
    want.sort(key=lambda x: (x[0] is not None, x[0] or 0, crc32(np.asarray(x[1], "<u4").tobytes())))
    assert [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in rows] == want
    assert [r.start for r in rows] == [sum(len(i) for _, i in want[:k]) for k in range(len(want))]
    assert [r.n_tokens for r in rows] == [len(i) for _, i in want]
    for doc in (0, 6, 66):
        assert sorted(tokenfiles.fetch_document(spark, folder, doc)) == sorted(i for d, i in want if d == doc)
    assert tokenfiles.fetch_document(spark, folder, 1) == []
    content = tokenfiles._contents(spark, f"{folder}/files").select("content").first()[0]
    with pytest.raises(ValueError, match="another dictionary"):
        tokenfiles.parse_footer(bytes(content), b"x" * 32)
    with pytest.raises(ValueError, match="not a file"):
        tokenfiles.parse_footer(bytes(content[:-9]), b"x" * 32)


def test_starts_come_without_a_shuffle_of_documents(spark):
    """A row per file says where its ids begin; documents are neither shuffled nor sorted for it."""
    documents = [(k, f"text number {k}", "n", "f", 1) for k in range(400)]
    folder = f"{Stage(spark, 'tokens-test').root}/out"
    tokenfiles.write_token_files(spark.createDataFrame(documents, NAMES).repartition(4), folder, WORD, 2, 49408, file_bytes=1000)
    read = tokenfiles.read_token_files(spark, folder)
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "Filter " not in plan and "Project " not in plan  # each would copy the contents of files
    rows = tokenfiles.with_starts(spark, folder, read)
    assert "SortMergeJoin" not in (plan := rows._jdf.queryExecution().toString()) and "hashpartitioning" not in plan
    got = [(r.doc_id, r.start) for r in rows.orderBy("doc_id").collect()]
    assert len({r.file for r in rows.collect()}) > 3
    assert got == [(r.doc_id, r.start) for r in tokenfiles.read_index(spark, folder).orderBy("doc_id").collect()]
    assert got == [(r.doc_id, r.start) for r in tokenfiles.with_starts(spark, folder, read.drop("within")).orderBy("doc_id").collect()]
    counts = {r.doc_id: r.n_tokens for r in rows.collect()}
    assert [s for _, s in got] == [sum(counts[d] for d in range(k)) for k in range(400)]


def test_tokenising_tasks_hold_one_small_batch_at_a_time(spark, tmp_path):
    """What Spark hands to a task at once does not grow with the length of texts, and the session is left as it was."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.range(2000).select(F.col("id").alias("doc_id"), F.expr("repeat('ab cd ', 200)").alias("text")).coalesce(1).write.parquet(f"{tmp_path}/long")

    def sizes(batches):
        yield from (pa.RecordBatch.from_pydict({"n": pa.array([b.nbytes], pa.int64())}) for b in batches)

    rows = spark.read.parquet(f"{tmp_path}/long").mapInArrow(sizes, "n long")
    assert max(r.n for r in rows.collect()) > 2_000_000
    with tokenfiles._batches_of(spark, 100_000):
        assert max(r.n for r in rows.collect()) < 120_000
    assert spark.conf.get(name) == before


def test_the_library_gets_few_texts_in_a_call():
    encoder, calls = WordEncoder(WORD), []

    class Counted:
        def __init__(self, library):
            self.library = library

        def encode_batch_fast(self, texts, add_special_tokens):
            calls.append(len(texts))
            return self.library.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    encoder.tokenizer = Counted(encoder.tokenizer)
    texts = [f"日本語 {k}" for k in range(100)]
    got = encoder.texts(pa.array(texts)).to_pylist()
    assert got == [Tokenizer.from_file(WORD).encode(t, add_special_tokens=False).ids for t in texts]
    assert sum(calls) >= 100 and max(calls) <= 16


def test_readers_give_encoders_back():
    """A worker that writes or reads frames does not hold the words of the tasks before."""
    kind, digest = np.dtype("<u2"), bytes(32)
    for run in (tokenfiles._records(kind, digest), tokenfiles._footers(digest), tokenfiles._decoded(b"")):
        tokens.word_encoder(WORD).texts(pa.array(["some words"]))
        assert tokens.word_encoder.cache_info().currsize == 1
        assert list(run(iter([]))) == []
        assert tokens.word_encoder.cache_info().currsize == 0


def test_token_files_of_nothing(spark):
    folder = f"{Stage(spark, 'tokens-test').root}/out"
    tokenfiles.write_token_files(spark.createDataFrame([], NAMES), folder, WORD, 2, 49408)
    assert tokenfiles.read_token_files(spark, folder).count() == 0 and tokenfiles.read_index(spark, folder).count() == 0


def plain_alignment(texts):
    one, other = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    one.encode_special_tokens = True
    tables = alignment.byte_level_side(BYTE).table, alignment.piece_side(PIECE).table
    found, counts = [], Counter()
    for text in texts:
        ids = (one.encode(f" {text}", add_special_tokens=False).ids, other.encode(text)) if text else ([], [])
        pieces = [[table[k] for k in i] for i, table in zip(ids, tables, strict=True)]
        if any(b"".join(p) != f" {text}".encode() for p in pieces):
            ids, pieces = ([], []), ([], [])
        ends = [np.cumsum([len(b) for b in p]).tolist() for p in pieces]
        groups, at = [], [0, 0]
        for end in sorted(set(ends[0]) & set(ends[1])):
            group = []
            for k in (0, 1):
                last = ends[k].index(end) + 1
                group.append(ids[k][at[k] : last])
                at[k] = last
            groups.append(group)
        links = [(g[0][-1], g[1][-1]) for g in groups]
        counts.update(links)
        found.append((ids, groups, links))
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for ids, groups, links in found:
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((len(ids[0]), len(ids[1]), len(groups), len(links), sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links), digest(written) if groups else ""))
    return out


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_alignment_like_a_plain_search(spark, most):
    documents = awkward(odd_texts(250))
    got, pairs = alignment.align_documents(spark.createDataFrame(documents, NAMES).repartition(3), BYTE, PIECE, block_bytes=3000, broadcast_pairs=most)
    want = plain_alignment([d[1] for d in documents])
    columns = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert Counter((r.doc_id, *(r[c] for c in columns)) for r in got.collect()) == Counter((d[0], *w) for d, w in zip(documents, want, strict=True))
    assert pairs.agg(F.sum("n")).first()[0] == sum(w[3] for w in want)
    assert any(w[0] == 0 and d[1] for d, w in zip(documents, want, strict=True)) or "▁x a▁" not in ODD


def test_alignment_of_nothing(spark):
    got, pairs = alignment.align_documents(spark.createDataFrame([], NAMES), BYTE, PIECE)
    assert got.count() == 0 and pairs.count() == 0
    got, _ = alignment.align_documents(spark.createDataFrame([(1, None, "n", "f", 1), (2, "", "n", "f", 1)], NAMES), BYTE, PIECE)
    assert {(r.doc_id, r.n_a, r.n_best, r.count_sum, r.groups_sha256) for r in got.collect()} == {(1, 0, 0, 0, ""), (2, 0, 0, 0, "")}


def test_counts_of_a_batch_are_one_table():
    """A batch of many blocks gives each pair once, with the links of all blocks."""
    texts = ["the same few words again"] * 400
    batch = pa.RecordBatch.from_pydict({"row": list(range(400)), "doc_id": list(range(400)), "text": texts})
    rows = [r for b in alignment._aligned(BYTE, PIECE, 100)(iter([batch])) for r in b.to_pylist()]
    pairs = {r["pair"]: r["n"] for r in rows if r["kind"] == "pair"}
    assert len(pairs) == sum(r["kind"] == "pair" for r in rows)
    links = Counter(k for r in rows if r["kind"] == "doc" for k in r["links"])
    assert pairs == links and set(pairs.values()) == {400}
