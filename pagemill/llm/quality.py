"""Quality rules as a short-circuit cascade.

Every document gets its base measures and the base verdict.  Documents that pass it go through
further rules, each tested only on what the rules before it have left.  The order is found on a
sample: a rule's cost is the time it takes there, its selectivity the share it rejects, and rules
run by rejections per second, most first.  A document is kept when no rule rejects it, so the order
changes the time and never the verdict.

Defined results: NULL and empty texts have no words and fail the base rule; each row is judged by
itself; other columns are not looked at.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.words import SPACED, SPACES, Words, blocks, byte_table, covered, mix, per_document, text_bytes, window_prints

# The sample that the order of the rules is found on.
SAMPLE_ROWS = 1000
SAMPLE_TEXT_BYTES = 100_000

MIN_WORDS = 20
REPEAT_WINDOW = 8
MAX_REPEAT_PERCENT = 30

_SYMBOL = byte_table(lambda b: chr(b) in "#*$%&|<>")
_BEGINS = byte_table(lambda b: b & 0xC0 != 0x80)
_UPPER = byte_table(lambda b: 0x41 <= b <= 0x5A)
_ASCII_LETTER = byte_table(lambda b: b < 0x80 and chr(b).isalpha())
_SHOUT = byte_table(lambda b: chr(b) in "!?")
_DIGIT = byte_table(lambda b: 0x30 <= b <= 0x39)


class Block:
    """The documents of a block that a rule is asked about."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.words = Words(data, offsets, SPACED)
        self.n_words = self.words.counts()

    def bytes_in(self, table: np.ndarray) -> np.ndarray:
        """How many bytes of each document are in ``table``."""
        return per_document(table[self.words.data], self.words.offsets)

    def lines(self, doc: int) -> list[bytes]:
        """The lines of a document that have a word."""
        a, b = self.words.offsets[doc : doc + 2]
        return [x for x in self.words.data[a:b].tobytes().split(b"\n") if x.strip(SPACES)]

    def only(self, docs: np.ndarray) -> Block:
        o = self.words.offsets
        lengths = np.diff(o)[docs]
        keep = np.repeat(np.isin(np.arange(len(o) - 1), docs), np.diff(o))
        return Block(self.words.data[keep], np.concatenate([[0], np.cumsum(lengths)]))


class Rule(NamedTuple):
    """``rejects`` gives one flag for each document of a block."""

    name: str
    rejects: Callable[[Block], np.ndarray]


def word_chars(block: Block) -> np.ndarray:
    w = block.words
    return per_document(_BEGINS[w.data] & SPACED[w.data], w.offsets)


def repeated_words(block: Block, window: int = REPEAT_WINDOW) -> np.ndarray:
    """Words in windows found twice or more in their own document."""
    w = block.words
    at = w.windows(window)
    doc = np.searchsorted(w.first, at, side="right") - 1
    key = window_prints(w.prints(), at, window) ^ mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    again = np.zeros(len(key), bool)
    again[1:] |= same
    again[:-1] |= same
    start = at[order[again]]
    return per_document(covered(start, start + window, len(w.start)), w.first)


def duplicate_lines(block: Block) -> np.ndarray:
    found = []
    for d in range(block.words.n_docs):
        lines = block.lines(d)
        found.append(len(lines) - len(set(lines)))
    return np.array(found, np.int64)


def _too_many_symbols(block: Block) -> np.ndarray:
    return 10 * block.bytes_in(_SYMBOL) > 3 * block.n_words


def _shouting(block: Block) -> np.ndarray:
    return 10 * block.bytes_in(_SHOUT) > 3 * block.n_words


def _capitals(block: Block) -> np.ndarray:
    return 2 * block.bytes_in(_UPPER) > block.bytes_in(_ASCII_LETTER)


def _word_length(block: Block) -> np.ndarray:
    chars = word_chars(block)
    return (chars < 2 * block.n_words) | (chars > 20 * block.n_words)


def _mostly_digits(block: Block) -> np.ndarray:
    return 2 * block.bytes_in(_DIGIT) > np.maximum(word_chars(block), 1)


def _repeated_lines(block: Block) -> np.ndarray:
    lines = np.array([len(block.lines(d)) for d in range(block.words.n_docs)], np.int64)
    repeated = duplicate_lines(block)
    return (repeated >= 3) & (10 * repeated > 3 * lines)


def _stutter(block: Block) -> np.ndarray:
    """Words equal to the word before."""
    w, seen = block.words, block.words.prints()
    same = np.zeros(len(seen), bool)
    same[1:] = seen[1:] == seen[:-1]
    same[w.first[:-1][w.first[:-1] < len(same)]] = False
    return 10 * per_document(same, w.first) > 3 * block.n_words


RULES = (
    Rule("repeated_lines", _repeated_lines),
    Rule("word_length", _word_length),
    Rule("mostly_digits", _mostly_digits),
    Rule("capitals", _capitals),
    Rule("shouting", _shouting),
    Rule("symbols", _too_many_symbols),
    Rule("stutter", _stutter),
)


def base_failed(n_words: np.ndarray, n_repeat: np.ndarray) -> np.ndarray:
    return (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)


def rule_order(documents: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> tuple[Rule, ...]:
    """``rules`` by rejections per second on a sample of a fixed number of rows.

    The sample only orders the rules; texts beyond ``SAMPLE_TEXT_BYTES`` are left out of it.
    """
    texts = documents.select(F.col(text).alias("t")).where(F.octet_length("t") <= SAMPLE_TEXT_BYTES)
    n = documents.count()
    drawn = texts.sample(fraction=min(1.0, 1.5 * SAMPLE_ROWS / max(n, 1)), seed=7).limit(SAMPLE_ROWS)
    block = Block(*text_bytes(pa.array([r.t for r in drawn.collect()], pa.large_string())))
    worth = []
    for rule in rules:
        begun = time.perf_counter()
        rejected = float(np.mean(rule.rejects(block))) if block.words.n_docs else 0.0
        worth.append(rejected / max(time.perf_counter() - begun, 1e-9))
    return tuple(rules[k] for k in sorted(range(len(rules)), key=lambda k: -worth[k]))


def judge(block: Block, rules: tuple[Rule, ...]) -> dict[str, np.ndarray]:
    repeated = repeated_words(block)
    failed = base_failed(block.n_words, repeated)
    kept = ~failed
    left, docs = block, np.flatnonzero(kept)
    if len(docs) < block.words.n_docs:
        left = block.only(docs)
    for rule in rules:
        if not len(docs):
            break
        bad = rule.rejects(left)
        kept[docs[bad]] = False
        # What is left is copied only when that saves later rules some work.
        if 10 * bad.sum() > len(docs):
            docs, left = docs[~bad], left.only(np.flatnonzero(~bad))
    return {
        "n_words": block.n_words,
        "word_chars": word_chars(block),
        "n_symbols": block.bytes_in(_SYMBOL),
        "n_dup_lines": duplicate_lines(block),
        "n_repeat_words": repeated,
        "base_failed": failed,
        "kept": kept,
    }


_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MEASURES = ", ".join(f"{c} bigint" for c in _COLUMNS) + ", base_failed boolean, kept boolean"


def _measure(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("k_text"))
            for low, high in blocks(offsets):
                found = judge(Block(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]), rules)
                own = [c for c in batch.schema.names if c != "k_text"]
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in own] + [pa.array(v) for v in found.values()], names=own + list(found)
                )

    return run


def quality(documents: DataFrame, keep: list[str], text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``keep`` columns of every document with its base measures and the verdict of the cascade."""
    ordered = rule_order(documents, rules, text)
    renamed = documents.select(*(F.col(k).alias(f"k_{i}") for i, k in enumerate(keep)), F.col(text).alias("k_text"))
    fields = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in renamed.schema.fields if f.name != "k_text")
    measured = renamed.mapInArrow(_measure(ordered), fields + _MEASURES)
    return measured.select(*(F.col(f"k_{i}").alias(k) for i, k in enumerate(keep)), *_COLUMNS, "base_failed", F.col("kept").alias("kept"))


def keep_good(documents: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that the cascade keeps, with all their columns."""
    ordered = rule_order(documents, rules, text)
    names = [f"k_{i}" for i in range(len(documents.columns))]
    at = documents.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(at))
            for low, high in blocks(offsets):
                found = judge(Block(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]), ordered)
                yield batch.slice(low, high - low).filter(pa.array(found["kept"]))

    renamed = documents.toDF(*names)
    return renamed.mapInArrow(run, renamed.schema).toDF(*documents.columns)


QUERY = "op3_quality"


def query(spark, folder: str) -> DataFrame:
    return quality(spark.read.parquet(f"{folder}/documents.parquet"), ["doc_id"])


def _count(of: str) -> str:
    return f"len(text) - len(regexp_replace(text, '[{of}]', '', 'g'))"


ORACLE = rf"""
with d as (
  select doc_id, row_number() over () as r, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents
),
g as (
  select r, i, array_to_string(w[i:i + 7], ' ') as g
  from (select r, w, unnest(range(1, len(w) - 6)) as i from d where len(w) >= 8)
),
again as (select r, i from g qualify count(*) over (partition by r, g) > 1),
rep as (select r, count(distinct p) as n from (select r, unnest(range(i, i + 8)) as p from again) group by r),
m as (
  select doc_id, text, lines, w, len(w)::bigint as n_words,
    len(array_to_string(w, ''))::bigint as word_chars,
    ({_count('#*$%&|<>')})::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(n, 0)::bigint as n_repeat_words
  from d left join rep on d.r = rep.r
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
  not (
    n_words < 20 or 100 * n_repeat_words > 30 * n_words
    or 10 * n_symbols > 3 * n_words
    or 10 * ({_count('!?')}) > 3 * n_words
    or 2 * ({_count('A-Z')}) > ({_count('A-Za-z')})
    or word_chars < 2 * n_words or word_chars > 20 * n_words
    or 2 * ({_count('0-9')}) > greatest(word_chars, 1)
    or n_dup_lines >= 3 and 10 * n_dup_lines > 3 * len(lines)
    or 10 * len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) > 3 * n_words
  ) as kept
from m
"""
