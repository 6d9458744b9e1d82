"""Best-fit packing of documents into sequences of several permitted lengths.

A document's tokens are its UTF-8 bytes and one end mark, or a column of counts.  Pieces of at most the
longest permitted length are dealt into groups of a bounded number of pieces by a hash; each group is
packed by itself.  Within a group pieces are taken longest first; a piece goes to the open bin it
fills best.  If it fits none, the bin size of the least cost per token that holds it is opened.  When
all are placed, each bin is downsized to the shortest permitted length that holds its contents.
The permitted lengths are chosen jointly: the group is packed once for every least size that bins
may be opened with, and the packing whose bins cost least in the end is taken.

The cost of a sequence of n places is ``n * (1 + n / attention)``: memory and work that grow with its
length, and attention, which grows with its square.

Defined results: a NULL text counts as empty and is one piece of one token; a count of tokens that is NULL or below 1
counts as 0 and is one piece without tokens; a text longer than the longest length is cut into pieces;
repeated rows are packed once each; an empty table has no bins; other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LENGTHS = (2048, 4096, 8192, 16384)
ATTENTION = 65536.0
# Pieces that are packed together; with so many, what a group's last bins waste does not count.
GROUP_PIECES = 8192


def cost(length: int, attention: float = ATTENTION) -> float:
    return length * (1 + length / attention)


class OpenBins:
    """Bins by the room they have left: the numbers of the bins with each room, and the rooms in order."""

    def __init__(self):
        self.rooms: list[int] = []
        self.bins: dict[int, list[int]] = {}

    def add(self, room: int, number: int) -> None:
        if room not in self.bins:
            insort(self.rooms, room)
            self.bins[room] = []
        self.bins[room].append(number)

    def take(self, size: int) -> tuple[int, int] | None:
        """The bin with the least room that holds ``size``, and its room."""
        k = bisect_left(self.rooms, size)
        if k == len(self.rooms):
            return None
        room = self.rooms[k]
        number = self.bins[room].pop()
        if not self.bins[room]:
            del self.bins[room]
            self.rooms.pop(k)
        return number, room


def best_fit(sizes: list[int], lengths: tuple[int, ...], least: int, attention: float = ATTENTION) -> tuple[list[int], list[int]]:
    """Bin of each piece, and contents of each bin; ``sizes`` fall, bins below ``least`` are not opened."""
    per_token = sorted((n for n in lengths if n >= least), key=lambda n: cost(n, attention) / n)
    bins, contents, open_bins = [], [], OpenBins()
    for size in sizes:
        found = open_bins.take(size)
        if found is None:
            capacity = next((n for n in per_token if n >= size), max(lengths))
            number, room = len(contents), capacity
            contents.append(0)
        else:
            number, room = found
        contents[number] += size
        if room > size:
            open_bins.add(room - size, number)
        bins.append(number)
    return bins, contents


def downsized(contents: list[int], lengths: tuple[int, ...]) -> list[int]:
    ordered = sorted(lengths)
    return [ordered[bisect_left(ordered, n)] for n in contents]


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, attention: float = ATTENTION) -> tuple[list[int], list[int]]:
    """Bin of each piece and final length of each bin, for the cheapest choice of the least bin opened."""
    best = None
    for least in sorted(lengths):
        bins, contents = best_fit(sizes, lengths, least, attention)
        final = downsized(contents, lengths)
        price = sum(cost(n, attention) for n in final)
        if best is None or price < best[0]:
            best = price, bins, final
    return best[1], best[2]


_PACKED = pa.schema([
    ("doc", pa.int64()), ("piece", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
    ("bin", pa.string()), ("bin_length", pa.int64()), ("bin_start", pa.int64()),
])
_PACKED_SQL = "doc bigint, piece bigint, start bigint, n_tokens bigint, bin string, bin_length bigint, bin_start bigint"


def _pack_group(lengths: tuple[int, ...], attention: float):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("n_tokens", "descending"), ("doc", "ascending"), ("piece", "ascending")])
        sizes = group.column("n_tokens").to_pylist()
        bins, final = pack(sizes, lengths, attention)
        filled = [0] * len(final)
        starts = []
        for number, size in zip(bins, sizes, strict=True):
            starts.append(filled[number])
            filled[number] += size
        name = group.column("pack")[0].as_py()
        return pa.Table.from_arrays(
            [
                *(group.column(c).cast(pa.int64()) for c in ("doc", "piece", "start", "n_tokens")),
                pa.array([f"{name}-{b}" for b in bins], pa.string()), pa.array([final[b] for b in bins], pa.int64()), pa.array(starts, pa.int64()),
            ],
            schema=_PACKED,
        )

    return run


def byte_tokens(text: str) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + 1


def pack_documents(
    documents: DataFrame, doc: str = "doc_id", text: str = "text", tokens: Column | None = None,
    lengths: tuple[int, ...] = LENGTHS, attention: float = ATTENTION, group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """One row per piece: which tokens of which document, and their bin, its length and their place in it."""
    longest = max(lengths)
    sized = documents.select(F.col(doc).cast("bigint").alias("doc"), (byte_tokens(text) if tokens is None else F.greatest(F.coalesce(tokens, F.lit(0)), F.lit(0))).cast("bigint").alias("total"), F.monotonically_increasing_id().alias("row"))
    n_pieces = F.greatest(F.ceil(F.col("total") / longest), F.lit(1))
    n = sized.agg(F.sum(n_pieces)).first()[0] or 0
    groups = max(1, -(-n // group_pieces))
    pieces = sized.select("doc", "total", "row", F.explode(F.sequence(F.lit(0), n_pieces - 1)).alias("piece")).select(
        "doc", F.col("piece").cast("bigint").alias("piece"), (F.col("piece") * longest).cast("bigint").alias("start"),
        F.least(F.col("total") - F.col("piece") * longest, F.lit(longest)).cast("bigint").alias("n_tokens"),
        # The row number deals out repeated rows too; it only decides which pieces meet.
        F.pmod(F.xxhash64("row", "piece"), F.lit(groups)).alias("pack"),
    )
    return pieces.groupBy("pack").applyInArrow(_pack_group(lengths, attention), _PACKED_SQL)


QUERY = "op10_packing"


def query(spark, folder: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{folder}/documents.parquet")).withColumnRenamed("doc", "doc_id")


# Each bin depends on all the pieces before; tested against a plain search instead.
ORACLE = None
