"""Removal of passages that an earlier document has, by sharded automata of repeated phrases.

Documents are dealt into shards by their id.

1. Each shard sends the 64-bit fingerprints of its windows of words to buckets, each distinct one once.
2. A bucket finds the windows that recur in a later document, and asks the shard of the first document
   that has them for their text, naming the shards where they recur.
3. The first documents' shards cut the passages of those windows from their texts and send them
   to the shards named.
4. Each shard compiles the passages it got into an Aho-Corasick automaton over words, streams all its
   documents through it, and removes what a passage of an earlier document covers.

Fingerprints only say where to look: what is removed is found word by word.  The automaton holds
blocks of ``(window + 1) // 2`` words cut side by side from the passages, since every window has one
whole; a hit is extended to both sides, and counts when it is as long as a window.  A hot passage
reaches its bucket once per shard, and each shard once.

Defined results: NULL and empty texts have no words; a document without an id, or with no earlier
document, loses nothing; rows that share an id are not earlier than each other; extra columns are not
looked at.
"""

from __future__ import annotations

from collections import defaultdict
from hashlib import sha256
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.words import SPACED, Words, covered, text_bytes, window_prints

WINDOW = 13
SHARD_BYTES = 6 << 20
# A word's number is spelled in digits of this base: the automaton library searches the children of a
# node one by one, and a letter a word would give its root one child for each word of the passages.
BASE = 256
# Text bytes per bucket of fingerprints: about two million of them.
BUCKET_BYTES = 12 << 20


class Shard:
    """The documents of one shard, by id; those without an id come last and are in no window."""

    def __init__(self, docs: pa.Table, window: int):
        docs = docs.combine_chunks().sort_by([("doc", "ascending")])
        self.docs = docs
        ids = docs.column("doc")
        self.named = np.asarray(ids.is_valid())
        self.ids = ids.fill_null(0).to_numpy()
        column = docs.column("text").combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        data, offsets = text_bytes(column.cast(pa.large_string()))
        self.words = Words(data, offsets, SPACED)
        at = self.words.windows(window)
        doc = np.searchsorted(self.words.first, at, side="right") - 1
        keep = self.named[doc]
        self.at, self.doc = at[keep], doc[keep]
        self.prints = window_prints(self.words.prints(), self.at, window)

    def distinct(self):
        """Each fingerprint once: its first window, and whether a later id of this shard has it too."""
        by = np.argsort(self.prints, kind="stable")
        value = self.prints[by]
        new = np.ones(len(value), bool)
        new[1:] = value[1:] != value[:-1]
        start = np.flatnonzero(new)
        first, last = by[start], by[np.append(start[1:], len(by)) - 1] if len(by) else by
        return value[start], first, self.ids[self.doc[last]] > self.ids[self.doc[first]]


_PRINTS = pa.schema([("bucket", pa.int32()), ("shard", pa.int32()), ("prints", pa.binary()), ("docs", pa.binary()), ("ids", pa.binary()), ("again", pa.binary())])
_PRINTS_SQL = "bucket int, shard int, prints binary, docs binary, ids binary, again binary"


def _windows(bits: int, window: int):
    """Step 1."""

    def run(docs: pa.Table) -> pa.Table:
        shard = Shard(docs, window)
        value, first, again = shard.distinct()
        by = np.argsort(first)  # by document, so that its number need not be sent with each window
        value, doc, again = value[by], shard.doc[first[by]], again[by]
        bucket = (value >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(value), np.int64)
        by = np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")
        value, doc, again, bucket = value[by], doc[by], again[by], bucket[by]
        edge = np.searchsorted(bucket, np.arange((1 << bits) + 1))
        rows = []
        for b in range(1 << bits):
            part = slice(edge[b], edge[b + 1])
            if part.start < part.stop:
                own, counts = np.unique(doc[part], return_counts=True)
                rows.append({
                    "bucket": b, "shard": docs.column("shard")[0].as_py(), "prints": value[part].tobytes(),
                    "docs": counts.astype(np.int32).tobytes(), "ids": shard.ids[own].astype(np.int64).tobytes(),
                    "again": np.packbits(again[part]).tobytes(),
                })
        return pa.Table.from_pylist(rows, _PRINTS)

    return run


_WANTED = pa.schema([("shard", pa.int32()), ("prints", pa.binary()), ("targets", pa.binary())])


def _recurring(group: pa.Table) -> pa.Table:
    """Step 2: for each shard the windows it must send, and to which shards."""
    value, doc, shard, again = [], [], [], []
    for row in group.select(["shard", "prints", "docs", "ids", "again"]).to_pylist():
        v = np.frombuffer(row["prints"], np.uint64)
        value.append(v)
        doc.append(np.repeat(np.frombuffer(row["ids"], np.int64), np.frombuffer(row["docs"], np.int32)))
        shard.append(np.full(len(v), row["shard"], np.int32))
        again.append(np.unpackbits(np.frombuffer(row["again"], np.uint8), count=len(v)).astype(bool))
    value, doc, shard, again = (np.concatenate(x) for x in (value, doc, shard, again))
    by = np.argsort(value, kind="stable")
    ordered = value[by]
    same = ordered[1:] == ordered[:-1]
    several = np.zeros(len(by), bool)
    several[1:] |= same
    several[:-1] |= same
    by = by[several | again[by]]
    value, doc, shard, again = value[by], doc[by], shard[by], again[by]
    by = np.lexsort((doc, value))
    value, doc, shard, again = value[by], doc[by], shard[by], again[by]
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    start = np.flatnonzero(new)
    first = np.repeat(start, np.diff(np.append(start, len(value))))
    keep = (doc > doc[first]) | again
    owner, value, target = shard[first][keep], value[keep], shard[keep]
    by = np.argsort(owner, kind="stable")
    owner, value, target = owner[by], value[by], target[by]
    rows = []
    for part in np.split(np.arange(len(owner)), np.flatnonzero(np.diff(owner)) + 1):
        if len(part):
            rows.append({"shard": int(owner[part[0]]), "prints": value[part].tobytes(), "targets": target[part].tobytes()})
    return pa.Table.from_pylist(rows, _WANTED)


_PASSAGE = pa.schema([("shard", pa.int32()), ("owner", pa.int64()), ("passage", pa.binary())])


def _passages(window: int):
    """Step 3: runs of wanted windows, for each shard that wants them."""

    def run(key, docs: pa.Table, wanted: pa.Table) -> pa.Table:
        if not docs.num_rows or not wanted.num_rows:
            return _PASSAGE.empty_table()
        shard = Shard(docs, window)
        value, first, _ = shard.distinct()
        ask = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in wanted.column("prints")])
        target = np.concatenate([np.frombuffer(x.as_py(), np.int32) for x in wanted.column("targets")])
        window_no = first[np.searchsorted(value, ask)]
        by = np.lexsort((window_no, target))
        target, window_no = target[by], window_no[by]
        at, doc = shard.at[window_no], shard.doc[window_no]
        new = np.ones(len(at), bool)
        new[1:] = (target[1:] != target[:-1]) | (at[1:] != at[:-1] + 1)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(at)) - 1
        texts: dict[tuple[int, int], bytes] = {}
        passages = []
        for a, b in zip(at[begin].tolist(), at[end].tolist(), strict=True):
            if (a, b) not in texts:
                texts[a, b] = shard.words.text(a, b + window)
            passages.append(texts[a, b])
        return pa.Table.from_arrays(
            [pa.array(target[begin], pa.int32()), pa.array(shard.ids[doc[begin]], pa.int64()), pa.array(passages, pa.binary())], schema=_PASSAGE
        )

    return run


class Automaton:
    """Passages of earlier documents, to be found in a document's words."""

    def __init__(self, passages: list[tuple[int, bytes]], window: int):
        self.window, self.block = window, (window + 1) // 2
        self.number: dict[bytes, int] = {}
        self.owners: list[int] = []
        self.passages: list[list[int]] = []
        places: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for owner, text in passages:
            words = [self.number.setdefault(w, len(self.number) + 1) for w in text.split(b" ")]
            for at in range(0, len(words) - self.block + 1, self.block):
                places[tuple(words[at : at + self.block])].append((len(self.passages), at))
            self.owners.append(owner)
            self.passages.append(words)
        self.places = list(places.values())
        self.digits = 1
        while BASE**self.digits <= len(self.number):
            self.digits += 1
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for k, key in enumerate(places):
            self.automaton.add_word(self._spelled(key), k)
        if places:
            self.automaton.make_automaton()

    def _spelled(self, numbers) -> tuple[int, ...]:
        """The digits of each number, each place with letters of its own, so that matches begin at words."""
        letters = np.empty((len(numbers), self.digits), np.int64)
        left = np.array(numbers, np.int64)
        for place in range(self.digits):
            letters[:, place] = left % BASE + place * BASE
            left //= BASE
        return tuple(letters.ravel().tolist())

    def spans(self, doc: int, words: list[bytes]) -> list[tuple[int, int]]:
        """Word spans of ``doc`` that a passage of an earlier document covers, a window long at least."""
        if not self.places:
            return []
        seen = tuple(map(self.number.get, words, repeat(0)))
        found, done = [], {}
        for letter, k in self.automaton.iter(self._spelled(seen)):
            last = letter // self.digits
            start = last - self.block + 1
            for passage, at in self.places[k]:
                if self.owners[passage] >= doc:
                    continue
                line = (passage, start - at)
                if done.get(line, -1) >= last:
                    continue
                low, high = self._extend(self.passages[passage], seen, start, at)
                done[line] = high - 1
                if high - low >= self.window:
                    found.append((low, high))
        return found

    def _extend(self, passage: list[int], seen: tuple, start: int, at: int) -> tuple[int, int]:
        low, p = start, at
        while low and p and seen[low - 1] == passage[p - 1]:
            low, p = low - 1, p - 1
        high, p = start + self.block, at + self.block
        n, m = len(seen), len(passage)
        while high < n and p < m and seen[high] == passage[p]:
            high, p = high + 1, p + 1
        return low, high


def _remove(window: int, keep_text: bool):
    """Step 4."""

    def run(key, docs: pa.Table, passages: pa.Table) -> pa.Table:
        out = []
        automaton = Automaton(list(zip(passages.column("owner").to_pylist(), passages.column("passage").to_pylist(), strict=True)), window)
        for batch in docs.select(["doc", "text"]).to_batches():
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                words = (text.as_py() or b"").split()
                spans = automaton.spans(doc, words) if doc is not None else []
                left = words
                if spans:
                    gone = covered(np.array([a for a, _ in spans]), np.array([b for _, b in spans]), len(words))
                    left = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                kept = b" ".join(left)
                out.append((doc, len(words), len(words) - len(left), kept.decode() if keep_text else sha256(kept).hexdigest()))
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.table({
            "doc": pa.array(columns[0], pa.int64()), "n_words": pa.array(columns[1], pa.int64()),
            "n_removed": pa.array(columns[2], pa.int64()), "kept": pa.array(columns[3], pa.string()),
        })

    return run


def remove_repeats(documents: DataFrame, doc: str = "doc_id", text: str = "text", window: int = WINDOW, digest: bool = False) -> DataFrame:
    """``doc, n_words, n_removed, kept`` for each row: what is left, its words joined by one blank.

    With ``digest`` the SHA-256 of that text stands in its place.
    """
    size = documents.agg(F.sum(F.octet_length(text))).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    bits = max(size // BUCKET_BYTES, 1).bit_length() - 1
    # Rows of one id meet in one shard; rows without an id are dealt by their text.
    dealt = documents.select(
        F.col(doc).cast("bigint").alias("doc"), F.col(text).alias("text"),
        F.pmod(F.when(F.col(doc).isNull(), F.xxhash64(text)).otherwise(F.xxhash64(F.col(doc).cast("bigint"))), F.lit(shards)).cast("int").alias("shard"),
    ).repartition(shards, "shard")
    prints = dealt.groupBy("shard").applyInArrow(_windows(bits, window), _PRINTS_SQL)
    wanted = prints.groupBy("bucket").applyInArrow(_recurring, "shard int, prints binary, targets binary")
    passages = dealt.groupBy("shard").cogroup(wanted.groupBy("shard")).applyInArrow(_passages(window), "shard int, owner bigint, passage binary")
    return dealt.groupBy("shard").cogroup(passages.groupBy("shard")).applyInArrow(
        _remove(window, not digest), "doc bigint, n_words bigint, n_removed bigint, kept string"
    )


QUERY = "op5_substrings"


def query(spark, folder: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{folder}/documents.parquet"), digest=True)
    return found.select(F.col("doc").alias("doc_id"), "n_words", "n_removed", F.col("kept").alias("kept_sha256"))


ORACLE = r"""
with d as (
  select doc_id, row_number() over () as r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
),
g as (
  select doc_id, r, i, array_to_string(w[i:i + 12], ' ') as g
  from (select doc_id, r, w, unnest(range(1, len(w) - 11)) as i from d where len(w) >= 13)
),
later as (select r, i from g qualify doc_id > min(doc_id) over (partition by g)),
gone as (select r, list_distinct(list(p)) as ps from (select r, unnest(range(i, i + 13)) as p from later) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(len(ps), 0)::bigint as n_removed,
  sha256(coalesce(array_to_string(case when ps is null then w else
    list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: not list_contains(ps, x[2])), lambda x: x[1]) end, ' '), '')) as kept_sha256
from d left join gone on d.r = gone.r
"""
