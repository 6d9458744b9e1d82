"""Where two tokenizers cut the same bytes: aligned groups of tokens, and how often two tokens end together.

All steps work on Arrow columns of a block of documents.  The tokens of both tokenizers are list columns; they are
flattened with their parent indices, the sizes of their tokens are summed up within each document (a cumulative sum
less its value at the document's start), and a hash join on (document, end) finds the tokens that end
together.  These ends cut both token rows into groups.  A block's pairs of ids are counted by a table's ``group_by``,
a batch's by one over its blocks; Spark adds up the counts of all batches and gives each link its pair's count.

Documents are tokenised once: their links are kept as pair numbers in a written table, beside the counts of
their batch.  The counts are broadcast to the links if the table of different pairs is small (``BROADCAST_PAIRS``); a
larger one is met by a join on pairs, whose hot ones adaptive execution splits.  Both ways give the same rows.

Defined results: a text that is NULL or empty, or whose tokens do not give back a blank and the text (a tokenizer that rewrites
it), has no tokens; strings of special tokens in a text are plain text; repeated rows and ids are documents each, and
their links count each time; a very long text is a block of its own; an empty table has no rows; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.tokens import byte_level_encoder, id_bytes, id_lists, piece_bytes
from pagemill.llm.words import blocks, text_bytes
from pagemill.operators.stage import Stage

# A block takes about 100 times its bytes while it is aligned.
BLOCK_BYTES = 1 << 19
# Different pairs that are sent to every executor, at about 50 bytes each.
BROADCAST_PAIRS = 1_000_000
# Ids of the second tokenizer are below this; a pair of ids is one number.
_SPAN = 1 << 31
# Counts of so many blocks are added up at a time.
_MERGED = 8


class Side:
    """One tokenizer: ``encode`` gives the ids of a list of texts, ``table`` the bytes of each id."""

    def __init__(self, encode: Callable[[list[str]], list[bytes]], table: list[bytes]):
        self.encode, self.table = encode, table
        self.bytes = pa.array(table, pa.large_binary())
        self.sizes = pc.cast(pc.binary_length(self.bytes), pa.int64())
        # Decimal ids with what may follow them in a written group.
        self.written = pa.array([f"{k}{mark}" for mark in ",|;" for k in range(len(table))])

    def texts_of(self, tokens: pa.Array) -> pa.Array:
        """The bytes of each text's tokens in a row."""
        flat = pc.take(self.bytes, tokens.flatten())
        return pc.binary_join(pa.ListArray.from_arrays(tokens.offsets, flat), pa.scalar(b"", pa.large_binary()))


@lru_cache(maxsize=2)
def byte_level_side(path: str) -> Side:
    """A tokenizer of a blank and the text."""
    encode, table = byte_level_encoder(path)
    return Side(lambda texts: [encode(f" {t}") for t in texts], table)


@lru_cache(maxsize=2)
def piece_side(path: str) -> Side:
    """A sentence piece model, which puts a blank before a text by itself."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    table = [piece_bytes(model.id_to_piece(k)) for k in range(model.get_piece_size())]
    return Side(lambda texts: [id_bytes(i) for i in model.encode(texts, num_threads=1)], table)


def token_lists(texts: pa.Array, sides: tuple[Side, Side]) -> list[pa.Array]:
    """Ids of each text on both sides, or none on both where a side does not give back a blank and the text."""
    texts = texts.fill_null("")
    plain = texts.to_pylist()
    lists = [id_lists([ids if t else b"" for t, ids in zip(plain, side.encode(plain), strict=True)]) for side in sides]
    want = pc.binary_join_element_wise(" ", texts, "").cast(pa.large_binary())
    good = pc.and_(*(pc.equal(side.texts_of(l), want) for side, l in zip(sides, lists, strict=True)))
    if not pc.all(good).as_py():
        lists = [pc.if_else(good, l, pa.scalar([], l.type)) for l in lists]
    return lists


def token_ends(tokens: pa.Array, sizes: pa.Array) -> pa.Table:
    """``doc, id, end, at`` of every token of a list column: the byte after it in its document, and its row."""
    ids, docs = pc.list_flatten(tokens).cast(pa.int64()), pc.list_parent_indices(tokens)
    if not len(ids):
        return pa.table({c: pa.array([], pa.int64()) for c in ("doc", "id", "end", "at")})
    total = pc.cumulative_sum(pc.take(sizes, ids))
    # What had been summed up where the document starts.
    begun = np.concatenate([[0], np.asarray(total)])[np.asarray(tokens.offsets)[:-1] - tokens.offsets[0].as_py()]
    return pa.table({"doc": pc.cast(docs, pa.int64()), "id": ids, "end": pc.subtract(total, pc.take(pa.array(begun), docs)), "at": pa.array(np.arange(len(ids)))})


def _marked(n: int, at: np.ndarray) -> np.ndarray:
    found = np.zeros(n, bool)
    found[at] = True
    return found


def align(first: pa.Array, second: pa.Array, one: Side, other: Side) -> dict:
    """Groups and links of a block: two list columns with one row per document."""
    a, b = token_ends(first, one.sizes), token_ends(second, other.sizes)
    links = a.join(b, keys=["doc", "end"], join_type="inner", left_suffix="_a", right_suffix="_b", use_threads=False).sort_by([("doc", "ascending"), ("end", "ascending")])
    n = len(first)
    docs = np.asarray(links.column("doc"))
    ends = np.asarray(links.column("end"))
    # A common end is one cut, however many tokens end there.
    fresh = np.ones(len(docs), bool)
    fresh[1:] = (docs[1:] != docs[:-1]) | (ends[1:] != ends[:-1])
    last = [_marked(len(t), np.asarray(links.column(f"at_{s}"))) for t, s in ((a, "a"), (b, "b"))]
    texts = []
    for k, (table, side, cut) in enumerate(zip((a, b), (one, other), last, strict=True)):
        group = np.cumsum(cut) - cut
        written = np.where(cut, 1 + k, 0)
        texts.append((group * 2 + k, pc.take(side.written, pa.array(np.asarray(table.column("id")) + written * len(side.table))), np.asarray(table.column("doc"))))
    # Both sides are in order already, so a stable sort only merges them.
    order = np.argsort(np.concatenate([t[0] for t in texts]), kind="stable")
    words = pc.take(pa.concat_arrays([t[1] for t in texts]), pa.array(order))
    owner = np.concatenate([t[2] for t in texts])[order]
    bounds = np.searchsorted(owner, np.arange(n + 1))
    spelled = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), words), "")
    # The last group of a text ends with a mark too, which is not written.
    digests = [sha256(s[:-1].encode()).hexdigest() if s else "" for s in spelled.to_pylist()]
    pairs = np.asarray(links.column("id_a")) * _SPAN + np.asarray(links.column("id_b"))
    link_bounds = np.searchsorted(docs, np.arange(n + 1))
    counted = pa.table({"pair": pairs}).group_by("pair", use_threads=False).aggregate([([], "count_all")]).rename_columns(["pair", "n"])
    sizes = [np.diff(np.asarray(t.offsets)) for t in (first, second)]
    return {
        "n_a": sizes[0], "n_b": sizes[1], "n_groups": np.bincount(docs[fresh], minlength=n), "n_links": np.diff(link_bounds),
        "groups_sha256": digests, "links": pa.ListArray.from_arrays(pa.array(link_bounds.astype(np.int32)), pa.array(pairs)),
        "counts": counted,
    }


_KINDS = {
    "kind": pa.string(), "row": pa.int64(), "doc_id": pa.int64(), "n_a": pa.int64(), "n_b": pa.int64(), "n_groups": pa.int64(), "n_links": pa.int64(),
    "groups_sha256": pa.string(), "links": pa.list_(pa.int64()), "pair": pa.int64(), "n": pa.int64(),
}
_KINDS_SQL = (
    "kind string, row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links array<bigint>, "
    "pair bigint, n bigint"
)


def _rows(size: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [columns[c].cast(k) if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], k) if c in columns else pa.nulls(size, k) for c, k in _KINDS.items()],
        names=list(_KINDS),
    )


def _added(counts: list[pa.Table]) -> pa.Table:
    """``pair, n`` of several blocks as one table."""
    return pa.concat_tables(counts).group_by("pair", use_threads=False).aggregate([("n", "sum")]).rename_columns(["pair", "n"])


def _aligned(byte_path: str, piece_path: str, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, other = byte_level_side(byte_path), piece_side(piece_path)
        for batch in batches:
            texts = batch.column("text")
            _, offsets = text_bytes(texts)
            counts = []
            for first, last in blocks(offsets, block_bytes):
                block = align(*token_lists(texts[first:last], (one, other)), one, other)
                yield _rows(
                    last - first, kind=["doc"] * (last - first), row=batch.column("row")[first:last], doc_id=batch.column("doc_id")[first:last],
                    **{c: block[c] for c in ("n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links")},
                )
                counts.append(block["counts"])
                # Added up now and then, so that what is kept does not grow with the batch's blocks.
                if len(counts) == _MERGED:
                    counts = [_added(counts)]
            if counts:
                total = _added(counts)
                yield _rows(len(total), kind=["pair"] * len(total), pair=total.column("pair").combine_chunks(), n=total.column("n").combine_chunks())
            pa.default_memory_pool().release_unused()

    return run


def align_documents(
    documents: DataFrame, byte_path: str, piece_path: str, doc: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES,
    broadcast_pairs: int = BROADCAST_PAIRS,
) -> tuple[DataFrame, DataFrame]:
    """One row per document, and one per pair of ids that end together: ``first, second, n, best``."""
    spark = documents.sparkSession
    stage = Stage(spark, "alignment")
    rows = documents.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    path = f"{stage.root}/blocks"
    rows.select("row", "doc_id", "text").mapInArrow(_aligned(byte_path, piece_path, block_bytes), _KINDS_SQL).write.parquet(path)
    kept = spark.read.schema(_KINDS_SQL).parquet(path)
    counts = kept.where("kind = 'pair'").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = stage.save(counts.withColumn("second", F.col("pair") % _SPAN), "counts")
    highest = counts.groupBy("second").agg(F.max("n").alias("highest"))
    judged = stage.save(counts.join(highest, "second").select("pair", "n", (F.col("n") == F.col("highest")).alias("best")), "judged")
    n_pairs = judged.count()
    made = kept.where("kind = 'doc'").select("row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    links = kept.where("kind = 'doc'").select("row", F.explode("links").alias("pair"))
    met = links.join(F.broadcast(judged) if n_pairs <= broadcast_pairs else judged, "pair")
    sums = met.groupBy("row").agg(F.count_if("best").alias("n_best"), F.sum("n").alias("count_sum"))
    found = made.join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"),
        "groups_sha256",
    )
    return found, judged.select(F.floor(F.col("pair") / _SPAN).alias("first"), (F.col("pair") % _SPAN).alias("second"), "n", "best")


QUERY = "op13_alignment"


def query(spark, folder: str) -> DataFrame:
    import public_tokenizers

    paths = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return align_documents(spark.read.parquet(f"{folder}/documents.parquet"), *paths)[0]


# SQL has no tokenizer; tested against the libraries' own encoding of whole texts and a plain search for common ends.
ORACLE = None
