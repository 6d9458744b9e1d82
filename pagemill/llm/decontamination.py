"""Benchmark decontamination with suffix arrays over the training texts.

Each block of documents (a shard) gets a suffix array of its words.  Every suffix of every benchmark
item is searched in it word by word, by binary search; the search gives the places of all matches of
a window and, along each diagonal, the longest verbatim match.  The benchmark travels to the
documents in blocks of bounded size, the documents are never shuffled.

Words are compared by 64-bit fingerprints; a match is a run of such words.  Defined results: NULL and
empty texts have no words and no hits; an item without words is never found; an item shorter than a
window is one window; repeated items count once, an item whose id is NULL marks words but is not
listed; each document row is judged by itself, so repeated ids are repeated rows; with an empty
benchmark nothing is hit; other columns of either table are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.words import ALPHANUMERIC, Words, blocks, covered, per_document, ranges, text_bytes

SHARD_BYTES = 8 << 20
BENCHMARK_BYTES = 8 << 20


class SuffixArray:
    """Suffixes of a sequence of word fingerprints, in order of their first ``depth`` words."""

    def __init__(self, sequence: np.ndarray, depth: int):
        n = len(sequence)
        self.sequence = np.concatenate([sequence, np.zeros(depth + 1, np.uint64)])
        self.order = np.argsort(sequence, kind="stable")
        self.heads = sequence[self.order]
        rank = np.zeros(n + 1, np.int64)  # the place of the first suffix of the group, from 1; 0: past the end
        loose = self._regroup(rank, np.arange(n), self.heads)
        length = 1
        while length < depth and len(loose):
            suffix = self.order[loose]
            after = rank[np.minimum(suffix + length, n)]
            key = (rank[suffix].astype(np.uint64) << np.uint64(32)) | after.astype(np.uint64)
            by = np.argsort(key, kind="stable")
            self.order[loose] = suffix[by]
            loose = self._regroup(rank, loose, key[by])
            length *= 2

    def _regroup(self, rank: np.ndarray, places: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Rank the suffixes at ``places`` by their sorted keys; return the places still tied."""
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        begin = np.flatnonzero(new)
        rank[self.order[places]] = np.repeat(places[begin], np.diff(np.append(begin, len(keys)))) + 1
        last = np.ones(len(keys), bool)
        last[:-1] = new[1:]
        return places[~(new & last)]

    def narrow(self, low: np.ndarray, high: np.ndarray, at: int, word: np.ndarray):
        """Of the suffixes ``low .. high`` those that have ``word`` at word ``at``."""
        return self._bound(low, high, at, word, False), self._bound(low, high, at, word, True)

    def _bound(self, low, high, at, word, upper: bool) -> np.ndarray:
        if at == 0:
            return np.searchsorted(self.heads, word, side="right" if upper else "left")
        low, high = low.copy(), high.copy()
        end = len(self.order)
        while (open_ := low < high).any():
            middle = (low + high) >> 1
            seen = self.sequence[self.order[np.minimum(middle, end - 1)] + at]
            right = open_ & ((seen <= word) if upper else (seen < word))
            low = np.where(right, middle + 1, low)
            high = np.where(open_ & ~right, middle, high)
        return low


class Benchmark:
    """The suffixes of a block of items that are long enough for a window."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        data, offsets = text_bytes(pa.array([t for _, t in items], pa.large_string()))
        words = Words(data, offsets, ALPHANUMERIC, lower=True)
        n = words.counts()
        self.ids = [i for i, _ in items]
        self.need = np.minimum(n, window)
        self.prints = np.concatenate([words.prints(), np.zeros(1, np.uint64)])
        starts = np.where(n > 0, n - self.need + 1, 0)
        self.suffix = ranges(words.first[:-1], starts)
        self.item = np.repeat(np.arange(len(items)), starts)
        self.width = self.need[self.item]
        self.depth = int(self.width.max()) if len(self.width) else 0

    def matches(self, array: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
        """Each match of a window: number of its suffix here, and its place in the sequence."""
        live = np.arange(len(self.suffix))
        low, high = np.zeros(len(live), np.int64), np.full(len(live), len(array.order))
        found, begin, end = [], [], []
        for at in range(self.depth):
            low, high = array.narrow(low, high, at, self.prints[self.suffix[live] + at])
            keep = low < high
            live, low, high = live[keep], low[keep], high[keep]
            done = self.width[live] == at + 1
            found.append(live[done])
            begin.append(low[done])
            end.append(high[done])
            live, low, high = live[~done], low[~done], high[~done]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        suffix, begin, end = (np.concatenate(x) for x in (found, begin, end))
        return np.repeat(suffix, end - begin), array.order[ranges(begin, end - begin)]


def _judge(words: Words, bench: Benchmark):
    """Hit words of the block, and for each (document, item) its longest match."""
    n = words.counts()
    # One empty place after each document keeps matches within it.
    place = np.arange(len(words.start)) + words.document()
    sequence = np.zeros(len(words.start) + words.n_docs, np.uint64)
    sequence[place] = words.prints()
    base = words.first[:-1] + np.arange(words.n_docs)
    suffix, at = bench.matches(SuffixArray(sequence, bench.depth))
    width = bench.width[suffix]
    hit = covered(at, at + width, len(sequence))[place]
    item, item_word = bench.item[suffix], bench.suffix[suffix]
    diagonal = at - item_word
    by = np.lexsort((at, diagonal, item))
    item, at, diagonal, width, item_word = (x[by] for x in (item, at, diagonal, width, item_word))
    new = np.ones(len(at), bool)
    new[1:] = (item[1:] != item[:-1]) | (diagonal[1:] != diagonal[:-1]) | (at[1:] != at[:-1] + 1)
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(at))) - 1 + width[begin]
    item, at, item_word = item[begin], at[begin], item_word[begin]
    doc = np.searchsorted(base, at, side="right") - 1
    by = np.lexsort((at, -length, item, doc))
    doc, item, at, length, item_word = (x[by] for x in (doc, item, at, length, item_word))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    keep = np.flatnonzero(new)
    return n, hit, doc[keep], item[keep], at[keep] - base[doc[keep]], length[keep]


_MATCH = pa.struct([("item_id", pa.string()), ("doc_start", pa.int64()), ("n_words", pa.int64())])
_FINDING = "n_words bigint, hits array<bigint>, matches array<struct<item_id:string,doc_start:bigint,n_words:bigint>>"


def _runs(hit: np.ndarray) -> np.ndarray:
    """Start and end of each run of hit words, flat."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    return edge


def _search(items, window: int, text: str, carried: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench = Benchmark(items.value, window)
        for batch in batches:
            data, offsets = text_bytes(batch.column(text))
            for low, high in blocks(offsets, SHARD_BYTES):
                part = batch.slice(low, high - low)
                words = Words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], ALPHANUMERIC, lower=True)
                n, hit, doc, item, at, length = _judge(words, bench)
                matches: list[list] = [[] for _ in range(high - low)]
                for d, i, a, k in zip(doc.tolist(), item.tolist(), at.tolist(), length.tolist(), strict=True):
                    matches[d].append((bench.ids[i], a, k))
                touched = per_document(hit, words.first) > 0
                hits = [
                    _runs(hit[words.first[d] : words.first[d + 1]]).tolist() if touched[d] else [] for d in range(high - low)
                ]
                if carried:
                    for d, (old, seen) in enumerate(zip(part.column("hits").to_pylist(), part.column("matches").to_pylist(), strict=True)):
                        if old:
                            edges = np.array(old + hits[d])
                            hits[d] = _runs(covered(edges[::2], edges[1::2], int(n[d]))).tolist()
                        matches[d] = [(m["item_id"], m["doc_start"], m["n_words"]) for m in seen] + matches[d]
                own = [c for c in part.schema.names if not carried or c not in ("n_words", "hits", "matches")]
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in own]
                    + [
                        pa.array(n, pa.int64()),
                        pa.array(hits, pa.list_(pa.int64())),
                        pa.array([[dict(zip(("item_id", "doc_start", "n_words"), m, strict=True)) for m in x] for x in matches], pa.list_(_MATCH)),
                    ],
                    names=[*own, "n_words", "hits", "matches"],
                )

    return run


def benchmark_blocks(benchmark: DataFrame, item: str = "item_id", text: str = "text", most: int = BENCHMARK_BYTES):
    """Distinct items in broadcast blocks of about ``most`` bytes; one longer item is a block of its own."""
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).where(F.col("text").isNotNull()).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // most))
    block = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    for k in range(n):
        rows = items.where(block == k).collect()
        yield benchmark.sparkSession.sparkContext.broadcast([(r.item, r.text) for r in rows])


def _found(documents: DataFrame, benchmark: DataFrame, keep: list[str], text: str, window: int, item: str, item_text: str) -> DataFrame:
    """Column ``i`` of ``keep`` as ``k_i``, which clashes with no other name, and the findings."""
    found = documents.select(*(F.col(k).alias(f"k_{i}") for i, k in enumerate(keep)), F.col(text).alias("k_text"))
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields)
    for k, items in enumerate(benchmark_blocks(benchmark, item, item_text)):
        found = found.mapInArrow(_search(items, window, "k_text", k > 0), f"{fields}, {_FINDING}")
    return found


def find_leaks(
    documents: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", window: int = 10, item: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """``keep`` columns of each document with ``n_words``, ``hits`` and ``matches``.

    ``hits`` are the start and end of each run of hit words; ``matches`` has for each item found its
    longest verbatim match and where it is.  Every block of the benchmark is one more pass of the
    suffix arrays, without a shuffle.
    """
    found = _found(documents, benchmark, keep, text, window, item, item_text)
    return found.select(*(F.col(f"k_{i}").alias(k) for i, k in enumerate(keep)), "n_words", "hits", "matches")


def drop_leaks(documents: DataFrame, benchmark: DataFrame, text: str = "text", window: int = 10) -> DataFrame:
    """The documents without any hit word, with all their columns."""
    names = documents.columns
    clean = _found(documents, benchmark, names, text, window, "item_id", "text").where(F.size("hits") == 0)
    return clean.select(*(F.col(f"k_{i}").alias(k) for i, k in enumerate(names)))


def leak_report(documents: DataFrame, benchmark: DataFrame, doc: str = "doc_id", text: str = "text", window: int = 10) -> DataFrame:
    """Per document the numbers of words, of hit words and of items found, and a digest of those items."""
    found = find_leaks(documents, benchmark, [doc], text, window)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size("hits") / 2, F.lit(1)).cast("int")), lambda k: F.get("hits", 2 * k - 1) - F.get("hits", 2 * k - 2))
    n_hit = F.aggregate(pairs, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))
    items = F.array_sort(F.array_distinct(F.array_compact(F.transform("matches", lambda m: m["item_id"]))))
    return found.select(doc, "n_words", n_hit.alias("n_hit"), items.alias("items")).select(
        doc, "n_words", "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERY = "op1_decontaminate"


def query(spark, folder: str) -> DataFrame:
    return leak_report(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet"))


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
ORACLE = rf"""
with d as (select doc_id, row_number() over () as r, {_WORDS} as w from documents),
b as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark),
bw as (
  select distinct item, least(len(w), 10) as k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') as g
  from (select item, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from b where len(w) > 0)
),
dw as (
  select r, i, k, array_to_string(w[i:i + k - 1], ' ') as g
  from (select r, w, k, unnest(range(1, len(w) - k + 2)) as i from d cross join (select distinct k from bw) where len(w) >= k)
),
m as (select r, i, dw.k, item from dw join bw on dw.g = bw.g and dw.k = bw.k),
h as (select r, count(distinct p) as n_hit from (select r, unnest(range(i, i + k)) as p from m) group by r),
t as (select r, list_sort(list_distinct(list(item) filter (item is not null))) as items from m group by r)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit,
  coalesce(len(items), 0)::bigint as n_items,
  sha256(coalesce(array_to_string(items, ','), '')) as items_sha256,
  coalesce(n_hit, 0) > 0 as contaminated
from d left join h on d.r = h.r left join t on d.r = t.r
"""
