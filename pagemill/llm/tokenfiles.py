"""Token ids in binary files: one compressed frame per document, found by an index.

A folder has numbered files of documents in the order of their ids.  A file is a row of records with a line feed
after each: the frames of its documents, then its footer, which holds each document's id, the end of its
frame and its token count, and at last the fixed :data:`TRAILER` with the SHA-256 of the dictionary.  A frame is
a document's ids as little-endian integers (two bytes each when the vocabulary allows), compressed by
itself with a zstandard dictionary that all files share and that was trained on such arrays.  So one document is
read with one seek and a few bytes, and a file that was written with another dictionary is noticed.

Files are written and read by Spark's own writers and readers, so a folder may be in any store Spark reaches; a task
that fails is repeated whole.  The dictionary is trained on a bounded sample (about ``SAMPLE_DOCS`` documents, chosen by
a hash of their ids, ``SAMPLE_CHARS`` characters of each): it decides how well frames compress and nothing else.

Defined results: a NULL text is an empty one, and an empty text is a document with the end id alone; documents of one id
(or none; these come first) are ordered by the checksum of their ids, and equal rows are documents each; a very long
text is one frame; an empty table makes a folder with no documents; other columns are not looked at.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from contextlib import contextmanager
from hashlib import sha256
from itertools import pairwise
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagemill.llm.tokens import forget_encoders, word_encoder
from pagemill.llm.words import blocks, text_bytes
from pagemill.operators.stage import Stage

SAMPLE_DOCS = 512
SAMPLE_CHARS = 4096
DICTIONARY_BYTES = 32 << 10
# What a file should come to; more data make more files.
FILE_BYTES = 8 << 20
LEVEL = 3
# Texts that are tokenised together in a task.
BLOCK_BYTES = 4 << 20
# Bytes of a batch that Spark hands to such a task, a little less than a block.
BATCH_BYTES = BLOCK_BYTES - (BLOCK_BYTES >> 3)
# Ids that are read back together in a task.
READ_IDS = 1 << 18

_MAGIC = b"PMTOKEN1"
# Magic, documents, bytes per id, end of the frames, SHA-256 of the dictionary, magic.
TRAILER = struct.Struct("<8sQBQ32s8s")
_DOC = np.dtype([("doc_id", "<i8"), ("has_id", "u1"), ("end", "<u8"), ("n_tokens", "<u8")])


def id_type(vocabulary: int) -> np.dtype:
    return np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")


def train_dictionary(arrays: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary from serialized id arrays; of too few of them, the arrays themselves."""
    try:
        return zstandard.train_dictionary(size, arrays).as_bytes()
    except zstandard.ZstdError:
        return b"".join(arrays)[-size:]


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if data else None


def pack_frame(ids: np.ndarray, kind: np.dtype, press: zstandard.ZstdCompressor) -> bytes:
    return press.compress(ids.astype(kind).tobytes())


def unpack_frame(frame: bytes, kind: np.dtype, press: zstandard.ZstdDecompressor) -> np.ndarray:
    return np.frombuffer(press.decompress(frame), kind).astype("<u4")


def footer(docs: np.ndarray, kind: np.dtype, digest: bytes) -> bytes:
    last = int(docs["end"][-1]) if len(docs) else 0
    return docs.tobytes() + TRAILER.pack(_MAGIC, len(docs), kind.itemsize, last, digest, _MAGIC)


def parse_footer(content: bytes | memoryview, digest: bytes) -> tuple[np.ndarray, np.dtype]:
    """The documents of a file and the type of its ids."""
    at = len(content) - 1 - TRAILER.size
    magic, n, width, end, named, again = TRAILER.unpack(content[at : at + TRAILER.size])
    if magic != _MAGIC or again != _MAGIC or at - n * _DOC.itemsize != end:
        raise ValueError("not a file of token ids")
    if named != digest:
        raise ValueError(f"the file was written with another dictionary, {named.hex()}")
    return np.frombuffer(content[end:at], _DOC), np.dtype(f"<u{width}")


def _tokenised(path: str, end_id: int, kind: np.dtype, dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(dictionary))
        end = np.asarray([end_id], "<u4").tobytes()
        for batch in batches:
            texts = batch.column("text")
            _, offsets = text_bytes(texts)
            for first, last in blocks(offsets, BLOCK_BYTES):
                lists = encoder.texts(texts[first:last])
                flat, bounds = np.asarray(lists.flatten()), np.asarray(lists.offsets).tolist()
                part = [flat[a:b].tobytes() + end for a, b in pairwise(bounds)]
                arrays = [np.frombuffer(b, "<u4") for b in part]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[first:last], batch.column("row")[first:last],
                        pa.array([len(a) for a in arrays], pa.int64()), pa.array([crc32(b) for b in part], pa.int64()),
                        pa.array([pack_frame(a, kind, press) for a in arrays], pa.binary()),
                    ],
                    names=["doc_id", "row", "n_tokens", "crc", "frame"],
                )
                del lists, flat, part, arrays
            # Nothing of a batch is held while the next one comes in.
            del batch, texts
            pa.default_memory_pool().release_unused()

    return run


def _records(kind: np.dtype, digest: bytes):
    """Frames of a file in order, then its footer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        docs, at = [], 0
        for batch in batches:
            frames = batch.column("frame")
            sizes = np.asarray(pc.binary_length(frames)).astype("<u8") + 1
            part = np.zeros(len(batch), _DOC)
            ids = batch.column("doc_id")
            part["doc_id"], part["has_id"] = np.asarray(ids.fill_null(0)), np.asarray(ids.is_valid())
            part["end"], part["n_tokens"] = at + np.cumsum(sizes), np.asarray(batch.column("n_tokens"))
            at = int(part["end"][-1]) if len(part) else at
            docs.append(part)
            yield pa.RecordBatch.from_arrays([frames], names=["record"])
        if at:
            yield pa.RecordBatch.from_arrays([pa.array([footer(np.concatenate(docs), kind, digest)], pa.binary())], names=["record"])

    return run


def _write(records: DataFrame, path: str) -> None:
    # The text writer writes a string's bytes as they are, and a line feed after each.
    records.select(F.col("record").cast("string").alias("record")).write.text(path)


@contextmanager
def _batches_of(spark: SparkSession, most: int):
    """While it lasts, Spark hands at most about so many bytes at once to a task in Python, however long the texts are."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def write_token_files(
    documents: DataFrame, folder: str, tokenizer: str, end_id: int, vocabulary: int, doc: str = "doc_id", text: str = "text",
    file_bytes: int = FILE_BYTES,
) -> None:
    """Write ``folder``: ``files``, ``dictionary``, ``starts`` and ``index``.

    A text is tokenised once; its frame is written, sorted in with the others by ranges of ids, and
    appended to its file.  What is shuffled is compressed.  ``tokenizer`` is the path of the vocabulary file,
    which every executor has.
    """
    spark = documents.sparkSession
    stage = Stage(spark, "tokenfiles")
    kind = id_type(vocabulary)
    rows = documents.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    # About SAMPLE_DOCS documents, found while reading: nothing is sorted or gathered for it.
    every = max(1, rows.count() // SAMPLE_DOCS)
    sample = rows.where((F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0) & (F.col("text") != ""))
    texts = sorted(r[0] for r in sample.select(F.substring("text", 1, SAMPLE_CHARS)).limit(2 * SAMPLE_DOCS).collect())
    dictionary = train_dictionary([np.asarray(ids, kind).tobytes() for ids in word_encoder(tokenizer).texts(pa.array(texts, pa.string())).to_pylist()])
    digest = sha256(dictionary).digest()
    _write(spark.createDataFrame([(bytearray(dictionary),)], "record binary").coalesce(1), f"{folder}/dictionary")

    with _batches_of(spark, BATCH_BYTES):
        frames = stage.save(
            rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
                _tokenised(tokenizer, end_id, kind, dictionary), "doc_id bigint, row bigint, n_tokens bigint, crc bigint, frame binary"
            ).withColumn("n_bytes", F.length("frame")),
            "frames",
        )
    # The sizes are a column of their own, so that no frame is read for their sum.
    total = frames.agg(F.sum("n_bytes")).first()[0] or 0
    order = ["doc_id", "crc", "row"]
    placed = frames.repartitionByRange(max(1, -(-total // file_bytes)), *order).sortWithinPartitions(*order)
    _write(placed.select("doc_id", "n_tokens", "frame").mapInArrow(_records(kind, digest), "record binary"), f"{folder}/files")
    _write_index(spark, folder)


def read_dictionary(spark: SparkSession, folder: str) -> bytes:
    """The shared dictionary; a few bytes, whatever the corpus."""
    found = [bytes(r[0]) for r in _contents(spark, f"{folder}/dictionary").select("content").collect()]
    return b"".join(found)[:-1]


def _contents(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``length``, ``content`` and time of the part files of a folder.

    They go to a task as they are read: a filter or a choice of columns would copy each content once more.
    """
    return spark.read.format("binaryFile").load(path)


def _numbered(batch: pa.RecordBatch) -> Iterator[tuple[int, str, memoryview]]:
    """Number of each file, in the order of ids, its path and its content; an empty partition has an empty file."""
    for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
        data = memoryview(content.as_buffer())
        if len(data):
            yield int(re.search(r"part-(\d+)[^/]*$", path.as_py())[1]), path.as_py(), data


def _footers(digest: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        for batch in batches:
            for file, path, data in _numbered(batch):
                docs, kind = parse_footer(data, digest)
                n, ends = len(docs), docs["end"].astype(np.int64)
                begins = np.concatenate([[0], ends[:-1]])
                tokens = docs["n_tokens"].astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([file] * n, pa.int64()), pa.array(np.arange(n)),
                        pa.array(docs["doc_id"].astype(np.int64), mask=docs["has_id"] == 0), pa.array(begins), pa.array(ends - 1 - begins),
                        pa.array(tokens), pa.array(np.cumsum(tokens) - tokens), pa.array([kind.itemsize] * n, pa.int32()),
                        pa.array([path] * min(n, 1) + [None] * (n - 1), pa.string()), pa.array([tokens.sum()] * n, pa.int64()),
                    ],
                    names=["file", "number", "doc_id", "first_byte", "n_bytes", "n_tokens", "within", "width", "path", "in_file"],
                )

    return run


def _write_index(spark: SparkSession, folder: str) -> None:
    """``index``, one row per document: where its frame lies and how many ids stand before it in its file; then ``starts``,
    one row per file: its path and the ids of all files before, summed over the files of its run of 1,024 files and over the runs before.

    A row per file is small enough to be sent to all documents, so these are neither shuffled nor sorted, and written once.
    """
    digest = sha256(read_dictionary(spark, folder)).digest()
    schema = "file bigint, number bigint, doc_id bigint, first_byte bigint, n_bytes bigint, n_tokens bigint, within bigint, width int, path string, in_file bigint"
    _contents(spark, f"{folder}/files").mapInArrow(_footers(digest), schema).write.parquet(f"{folder}/index")
    rows = spark.read.schema(schema).parquet(f"{folder}/index")
    files = rows.where("number = 0").select("file", "path", F.col("in_file").alias("ids"), F.floor(F.col("file") / 1024).alias("run"))
    earlier = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = files.groupBy("run").agg(F.sum("ids").alias("ids")).select("run", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("before_run"))
    in_run = Window.partitionBy("run").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files.select("file", "path", "run", F.coalesce(F.sum("ids").over(in_run), F.lit(0)).alias("in_run")).join(runs, "run").select(
        "file", "path", (F.col("before_run") + F.col("in_run")).alias("before")
    ).write.parquet(f"{folder}/starts")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """``file, path, number, doc_id, first_byte, n_bytes, n_tokens, start, width`` of every document."""
    rows = spark.read.parquet(f"{folder}/index").drop("path").join(_starts(spark, folder), "file")
    return rows.select("file", "path", "number", "doc_id", "first_byte", "n_bytes", "n_tokens", (F.col("before") + F.col("within")).alias("start"), "width")


def _starts(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("file bigint, path string, before bigint").parquet(f"{folder}/starts")


def _decoded(dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_encoders()
        press = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
        digest = sha256(dictionary).digest()
        for batch in batches:
            for file, _, data in _numbered(batch):
                docs, kind = parse_footer(data, digest)
                before = np.concatenate([[0], np.cumsum(docs["n_tokens"].astype(np.int64))])
                for first, last in blocks(before, READ_IDS):
                    part = docs[first:last]
                    begin = int(docs["end"][first - 1]) if first else 0
                    ids = []
                    for end in part["end"].tolist():
                        ids.append(unpack_frame(bytes(data[begin : end - 1]), kind, press))
                        begin = end
                    sizes = np.array([len(i) for i in ids], np.int64)
                    if (sizes != part["n_tokens"]).any():
                        raise ValueError("a frame does not have the ids that the footer says")
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([file] * len(part), pa.int64()), pa.array(np.arange(first, last)),
                            pa.array(part["doc_id"].astype(np.int64), mask=part["has_id"] == 0), pa.array(sizes), pa.array(before[first:last]),
                            pa.array([i.tobytes() for i in ids], pa.binary()),
                        ],
                        names=["file", "number", "doc_id", "n_tokens", "within", "ids"],
                    )

    return run


def read_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """All documents of a folder: ``file, number, doc_id, n_tokens, within`` and ``ids``.

    ``within`` are the ids before the document in its file; ``ids`` are little-endian, four bytes each.
    """
    return _contents(spark, f"{folder}/files").mapInArrow(
        _decoded(read_dictionary(spark, folder)), "file bigint, number bigint, doc_id bigint, n_tokens bigint, within bigint, ids binary"
    )


def with_starts(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    """Add ``start``, the ids of all documents before, to rows with ``file`` and ``within``, or else ``number``."""
    if "within" not in rows.columns:
        return rows.join(read_index(spark, folder).select("file", "number", "start"), ["file", "number"])
    return rows.join(_starts(spark, folder).drop("path"), "file").withColumn("start", F.col("before") + F.col("within")).drop("before")


def fetch_document(spark: SparkSession, folder: str, doc_id: int, dictionary: bytes | None = None) -> list[list[int]]:
    """Ids of the documents of one id: an index lookup, then one seek and one short read for each."""
    dictionary = read_dictionary(spark, folder) if dictionary is None else dictionary
    press = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))
    found = []
    for row in read_index(spark, folder).where(F.col("doc_id") == doc_id).orderBy("file", "number").collect():
        path = spark._jvm.org.apache.hadoop.fs.Path(row["path"])
        stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
        try:
            stream.seek(row["first_byte"])
            frame = bytes(stream.readNBytes(row["n_bytes"]))
        finally:
            stream.close()
        found.append(unpack_frame(frame, np.dtype(f"<u{row['width']}"), press).tolist())
    return found


# A parameter of the query: a vocabulary file of a public tokenizer, its size and the id that ends a document.
VOCABULARY, VOCABULARY_SIZE, END_ID = "word_bpe_49k.json", 49408, 2
QUERY = "op12_tokenfiles"


def query(spark, folder: str) -> DataFrame:
    import public_tokenizers

    out = f"{Stage(spark, 'tokens').root}/out"
    write_token_files(spark.read.parquet(f"{folder}/documents.parquet"), out, public_tokenizers.path(VOCABULARY), END_ID, VOCABULARY_SIZE)
    rows = read_token_files(spark, out).select("file", "within", "doc_id", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return with_starts(spark, out, rows).select("doc_id", "start", "n_tokens", "ids_crc32")


# SQL has no tokenizer; tested against the library, by brute force, and by reading every file back.
ORACLE = None
