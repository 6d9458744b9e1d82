"""Token ids of whole texts by public tokenizers, as Arrow list columns."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Words kept by an encoder: two generations of so many, of so many characters at most.
KEPT_WORDS = 200_000
KEPT_CHARS = 32
# Words that are joined to one text, and texts that the library encodes in one call.
_JOINED = 256
_TEXTS = 16

# Letters that are one letter for every rule of a tokenizer, in either case and in any normal form.
_LETTERS = r"A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{12f}\x{131}-\x{148}\x{14a}-\x{17f}"
# ASCII signs without the apostrophe, which begins contractions.
_SIGNS = r"!-&(-/:-@\[-`{-~"
_END = "\x1f"


def id_lists(ids: list[bytes]) -> pa.Array:
    """A list column from the ids of each text, little-endian unsigned integers of four bytes."""
    bounds = np.concatenate([[0], np.cumsum([len(i) for i in ids], dtype=np.int64) // 4])
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), "<u4")))


def id_bytes(ids: list[int]) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


def load_tokenizer(path: str, special_as_text: bool = False):
    """A tokenizer of the ``tokenizers`` library that uses the one core a task has."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    if special_as_text:
        tokenizer.encode_special_tokens = True
    return tokenizer


class WordEncoder:
    """A tokenizer that drops white space and makes tokens of letters, of one digit, or of other signs.

    The ids of a text are those of its words in a row, so the different words of a block of texts are encoded
    by the library once, many in a call: every word ends with a token that the vocabulary marks as a word's
    end.  This holds for texts of Latin letters, digits and ASCII signs without an apostrophe; any other text, and
    one with the string of a special token, goes to the library whole.  Words seen are kept in two
    generations, so that common ones stay and memory does not grow with the corpus.
    """

    PLAIN = rf"^[{_LETTERS}0-9{_SIGNS} \t\n\r]*$"
    WORDS = rf"[ \t\n\r]*([{_LETTERS}]+|[0-9]|[{_SIGNS}]+)"

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        vocabulary = described["model"]["vocab"]
        self.special = [t["content"] for t in described["added_tokens"]]
        suffix = described["model"]["end_of_word_suffix"]
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[k for entry, k in vocabulary.items() if entry.endswith(suffix)]] = True
        # The empty text has one word, and it has no ids.
        self.fresh: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; what the library holds beside them, many bytes a token, lasts for a few texts only."""
        runs = (texts[k : k + _TEXTS] for k in range(0, len(texts), _TEXTS))
        return [id_bytes(e.ids) for run in runs for e in self.tokenizer.encode_batch_fast(run, add_special_tokens=False)]

    def _encode(self, words: list[str]) -> list[bytes]:
        """Ids of words, each of which is one word of the tokenizer."""
        found = b"".join(self.whole([" ".join(words[k : k + _JOINED]) for k in range(0, len(words), _JOINED)]))
        cuts = 4 * np.flatnonzero(self.ends[np.frombuffer(found, "<u4")]) + 4
        if len(cuts) != len(words):
            return self.whole(words)
        return [found[a:b] for a, b in pairwise([0, *cuts.tolist()])]

    def words(self, words: list[str]) -> list[bytes]:
        fresh, old = self.fresh, self.old
        missing = [w for w in words if w not in fresh]
        new = [w for w in missing if w not in old]
        if len(new) < len(missing):
            fresh.update((w, old[w]) for w in missing if w in old)
        if new:
            fresh.update(zip(new, self._encode(new), strict=True))
        found = list(map(fresh.__getitem__, words))
        for w in [w for w in new if len(w) > KEPT_CHARS]:
            del fresh[w]
        if len(fresh) > KEPT_WORDS:
            self.old, self.fresh = fresh, {"": b""}
        return found

    def texts(self, texts: pa.Array) -> pa.Array:
        """A list column of the ids of each text; a NULL is an empty text."""
        texts = texts.fill_null("").cast(pa.string())
        plain = pc.match_substring_regex(texts, self.PLAIN)
        for string in self.special:
            plain = pc.and_(plain, pc.invert(pc.match_substring(texts, string)))
        odd = pc.indices_nonzero(pc.invert(plain))
        if len(odd):
            both = pa.concat_arrays([
                self._plain_texts(pc.if_else(plain, texts, "")), id_lists(self.whole(texts.take(odd).to_pylist())),
            ])
            at = np.arange(len(texts))
            at[np.asarray(odd)] = len(texts) + np.arange(len(odd))
            return both.take(pa.array(at))
        return self._plain_texts(texts)

    def _plain_texts(self, texts: pa.Array) -> pa.Array:
        # Cut at blanks and line feeds first, so that the pattern sees each different part once.
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        parts = lists.flatten().dictionary_encode()
        marked = pc.replace_substring_regex(pc.ascii_trim_whitespace(parts.dictionary), self.WORDS, rf"\1{_END}")
        words = pc.split_pattern(pc.ascii_rtrim(marked, _END), _END)
        coded = words.flatten().dictionary_encode()
        ids = _regrouped(pc.take(id_lists(self.words(coded.dictionary.to_pylist())), coded.indices), words)
        return _regrouped(pc.take(ids, parts.indices), lists)


def _regrouped(items: pa.Array, lists: pa.Array) -> pa.Array:
    """The items of lists of lists, whose inner lists are ``items``, as one list for each of ``lists``."""
    bounds = np.asarray(items.offsets)[np.asarray(lists.offsets) - lists.offsets[0].as_py()] - items.offsets[0].as_py()
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), items.flatten())


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder per worker process, whose words serve all its tasks."""
    return WordEncoder(path)


def forget_encoders() -> None:
    """Give back the memory of a worker process whose next tasks encode nothing."""
    word_encoder.cache_clear()
    pa.default_memory_pool().release_unused()


# What byte-level tokenizers of this kind cut texts by (a fixed value of the vocabulary).
_BYTE_LEVEL_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_characters() -> dict[str, int]:
    # Printable bytes stand for themselves, the others for characters from 256 on, in order.
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    table = {chr(b): b for b in plain}
    return table | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}


_BYTE_OF = _byte_characters()


def byte_level_bytes(entry: str) -> bytes:
    """Bytes of an entry of a byte-level vocabulary, where every byte is written as a printable character."""
    return bytes(map(_BYTE_OF.__getitem__, entry))


@lru_cache(maxsize=2)
def byte_level_encoder(path: str) -> tuple[Callable[[str], bytes], list[bytes]]:
    """An encoder of texts by a byte-level vocabulary whose ids rise in the order of its merges, and its tokens' bytes.

    Strings of special tokens are plain text.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        described = json.load(file)
    special = {t["content"]: t["id"] for t in described["added_tokens"]}
    entries = {entry: k for entry, k in described["model"]["vocab"].items() if entry not in special}
    table = [b""] * (1 + max([*entries.values(), *special.values()]))
    for entry, k in entries.items():
        table[k] = byte_level_bytes(entry)
    merged = [m if isinstance(m, list) else re.split(" ", m) for m in described["model"]["merges"]]
    order = [entries["".join(m)] for m in merged]
    if order != sorted(order):
        raise ValueError("the ids of this vocabulary are not in the order of its merges")
    encoding = tiktoken.Encoding("own", pat_str=_BYTE_LEVEL_PATTERN, mergeable_ranks={table[k]: k for k in entries.values()}, special_tokens={})
    return lambda text: id_bytes(encoding.encode_ordinary(text)), table


def piece_bytes(piece: str) -> bytes:
    """Bytes of a sentence piece: ``<0xHH>`` is a byte, U+2581 a blank."""
    if re.fullmatch("<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()
