"""Text functions built from native expressions: whitespace, counts, character references."""

from __future__ import annotations

from html import unescape
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip and str.split treat as white space.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
# The same set as a character class.  The rarer ones are tested behind a range, so that most
# characters of most texts need three comparisons only.
_RARE = (
    r"[\x{85}-\x{3000}&&[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]"
)
SPACE_CLASS = r"\t-\r\x1c-\x20" + _RARE
_NOT_BLANK = r"\t-\r\x1c-\x1f" + _RARE


def strip(text: Column) -> Column:
    """Drop white space of every kind at both ends (``trim`` alone only knows the blank)."""
    return F.trim(text, F.lit(SPACES))


def squeeze(text: Column) -> Column:
    """One blank for each run of white space."""
    # A single blank is left as it is, and nothing is copied for it.
    return F.regexp_replace(text, f"[{_NOT_BLANK}][{SPACE_CLASS}]*+| [{SPACE_CLASS}]++", " ")


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def token_count(text: Column) -> Column:
    """Number of white-space separated words."""
    words = strip(squeeze(text))
    return F.when(words == "", 0).otherwise(F.size(F.split(words, " "))).cast("bigint")


def byte_size(text: Column) -> Column:
    """Length in UTF-8 bytes."""
    return F.octet_length(text).cast("bigint")


def fixed2(thousandths: Column) -> Column:
    """A decimal as text with two places, halves going to the even neighbour."""
    return F.bround(thousandths, 2).cast("decimal(38,2)").cast("string")


_CELL, _ENTRY, _SIDE = "\x1d", "\x1e", "\x1f"
_LETTERS, _LENGTHS = 64, 16


def _lookup(table: dict[str, str], name: Column) -> Column:
    """Value of ``name`` in a fixed table, NULL when it is not there.

    A small table is one string literal that is searched from its start: a map would be slow to plan
    with, and as slow to search.  A big one is cut by the first character and the length of its names
    into a literal array of such strings, so that a search meets a few names only.
    """

    def packed(names) -> str:
        return _ENTRY + "".join(f"{n}{_SIDE}{table[n]}{_ENTRY}" for n in names)

    if len(table) > 64:
        cells: list[list[str]] = [[] for _ in range(_LETTERS * _LENGTHS)]
        for n in table:
            cells[ord(n[0]) % _LETTERS * _LENGTHS + len(n) % _LENGTHS].append(n)
        place = F.ascii(name) % _LETTERS * _LENGTHS + F.length(name) % _LENGTHS
        entries = F.get(F.split(F.lit(_CELL.join(map(packed, cells))), _CELL), place)
    else:
        entries = F.lit(packed(table))
    wanted = F.concat(F.lit(_ENTRY), name, F.lit(_SIDE))
    return F.when(
        F.contains(entries, wanted),
        F.substring_index(
            F.call_function("substring_index", entries, wanted, F.lit(-1)), _ENTRY, 1
        ),
    )


# The names that are also read without their semicolon, longest first.
_OPEN_NAMES = "|".join(sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True))
# Numeric references 128..159 stand for characters of another code page.
_C1 = {str(n): unescape(f"&#{n};") for n in range(0x80, 0xA0)}

_PIECES = r"&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[A-Za-z][A-Za-z0-9]*;?|[^&]+|&"


def _numeric(ref: Column) -> Column:
    digits = F.regexp_extract(ref, r"^&#[xX]?0*([0-9a-fA-F]*)", 1)
    number = F.when(
        ref.rlike("^&#[xX]"), F.conv(F.concat(F.lit("0"), digits), 16, 10).try_cast("bigint")
    ).otherwise(F.concat(F.lit("0"), digits).try_cast("bigint"))
    code = F.when(F.length(digits) > 8, F.lit(0x110000)).otherwise(number)
    unprintable = (
        code.between(0x1, 0x8) | (code == 0xB) | code.between(0xE, 0x1F) | (code == 0x7F)
        | code.between(0xFDD0, 0xFDEF) | (code.bitwiseAND(0xFFFE) == 0xFFFE)
    )
    return (
        F.when((code == 0) | (code > 0x10FFFF) | code.between(0xD800, 0xDFFF), F.lit("�"))
        .when(code.between(0x80, 0x9F), _lookup(_C1, code.cast("string")))
        .when(unprintable, F.lit(""))
        .otherwise(F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32"))
    )


def _named(ref: Column) -> Column:
    name = F.substr(ref, F.lit(2))
    prefix = F.regexp_extract(name, f"^(?:{_OPEN_NAMES})", 0)
    by_prefix = F.concat(_lookup(html5, prefix), F.substr(name, F.length(prefix) + 1))
    return F.coalesce(
        _lookup(html5, name),
        F.when(prefix != "", by_prefix),
        ref,
    )


def decode_entities(text: Column) -> Column:
    """Replace character references (named, decimal, hexadecimal; semicolon optional)."""
    decoded = F.array_join(
        F.transform(
            F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0)),
            lambda piece: F.when(piece.startswith("&#") & (F.length(piece) > 2), _numeric(piece))
            .when(piece.startswith("&") & (F.length(piece) > 1), _named(piece))
            .otherwise(piece),
        ),
        "",
    )
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


# In an attribute a name counts only as a whole, and not before an equals sign: query strings are full of
# parameters that begin like a reference.
_ATTRIBUTE_PIECES = r"&#[xX][0-9a-fA-F]+;?|&#[0-9]+;?|&[A-Za-z][A-Za-z0-9]*+(?:;|(?!=))|[^&]+|&"


def decode_attribute(text: Column) -> Column:
    """Replace character references by the rules for attribute values."""
    decoded = F.array_join(
        F.transform(
            F.regexp_extract_all(text, F.lit(_ATTRIBUTE_PIECES), F.lit(0)),
            lambda piece: F.when(piece.startswith("&#") & (F.length(piece) > 2), _numeric(piece))
            .when(
                piece.startswith("&") & (F.length(piece) > 1),
                F.coalesce(_lookup(html5, F.substr(piece, F.lit(2))), piece),
            )
            .otherwise(piece),
        ),
        "",
    )
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)
