r"""Chat records of several layouts as canonical turns and training text, with DataFrame functions only.

A record is a JSON text.  Its nested field paths, taken from the schema of the parsed value without types,
are hashed to a fingerprint; each known layout declares its paths and where its turns are, and the
fingerprint selects it.  Turns are written as

    <turn role="ROLE">TEXT</turn>

with a line feed after each.  Inside roles and texts ``\``, ``<`` and ``"`` are written ``\b``, ``\l`` and
``\q``, so no control string can occur in them and reading back is exact.  The loss mask is a list of
spans, one for the text of each assistant turn, in code points of the formatted text.

Conversations of a table are held in structs and written as JSON records, which are parsed like any others.  Records may
also be structs, as those of conversations beyond the parser are, since a JSON parser takes strings of 20,000,000
characters at most and a variant 128 MiB: their field paths are those of the struct's type, and the layout's parts are its fields.

Defined results: NULL texts and roles are empty; a record that is no JSON or of an unknown layout has NULL turns and
NULL text, with its fingerprint kept so that a layout can be added; a record of more than ``PARSED_CHARS`` that cannot
be parsed is an error; a conversation is one record, and the largest unit that a task holds; rows of one turn are ordered by role and text; repeated rows are turns of their own;
extra columns are not looked at.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType


# Records up to this length are within all size limits of the parser and of variants.
PARSED_CHARS = 20_000_000


class Field(NamedTuple):
    """A turn kept in a field of its own."""

    role: str
    path: str


class Turns(NamedTuple):
    """Turns kept in a list; ``names`` translates the roles of the layout."""

    path: str
    role: str
    text: str
    names: tuple[tuple[str, str], ...] = ()


class Layout(NamedTuple):
    name: str
    paths: str
    parts: tuple[Field | Turns, ...]


LAYOUTS = (
    Layout("messages", "OBJECT<messages: ARRAY<OBJECT<content, role>>>", (Turns("$.messages", "role", "content"),)),
    Layout("prompt", "OBJECT<completion, prompt>", (Field("user", "$.prompt"), Field("assistant", "$.completion"))),
    Layout(
        "instruction", "OBJECT<input, instruction, output>",
        (Field("system", "$.instruction"), Field("user", "$.input"), Field("assistant", "$.output")),
    ),
    Layout(
        "speakers", "OBJECT<conversations: ARRAY<OBJECT<from, value>>, system>",
        (Field("system", "$.system"), Turns("$.conversations", "from", "value", (("human", "user"), ("gpt", "assistant")))),
    ),
)


def field_paths(value: Column) -> Column:
    """Nested field paths of a parsed record: its schema without the types of the leaves."""
    return F.regexp_replace(F.schema_of_variant(value), r": [A-Z_]+(?:\([0-9, ]*\))?(?=[,>])", "")


def _turns(value: Column, part: Field | Turns) -> Column:
    if isinstance(part, Field):
        text = F.coalesce(F.try_variant_get(value, part.path, "string"), F.lit(""))
        return F.array(F.struct(F.lit(part.role).alias("role"), text.alias("text")))
    found = F.try_variant_get(value, part.path, f"array<struct<`{part.role}`:string,`{part.text}`:string>>")
    return _named(found, part)


def _named(found: Column, part: Turns) -> Column:
    """Role and text of each entry of a list."""

    def turn(m: Column) -> Column:
        role = F.coalesce(m[part.role], F.lit(""))
        named = reduce(lambda other, n: F.when(role == n[0], F.lit(n[1])).otherwise(other), part.names, role)
        return F.struct(named.alias("role"), F.coalesce(m[part.text], F.lit("")).alias("text"))

    return F.transform(found, turn)


def canonical_turns(records: DataFrame, record: str = "record", layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """All columns with ``fingerprint`` and ``turns``, an array of role and text."""
    parsed = records.withColumn("_value", F.try_parse_json(F.col(record)))
    lost = F.col("_value").isNull() & (F.length(record) > PARSED_CHARS)
    said = F.concat(F.lit("A record is invalid or beyond the limits of the JSON parser: characters "), F.length(record))
    printed = parsed.withColumn("fingerprint", F.when(lost, F.raise_error(said).cast("bigint")).otherwise(F.xxhash64(field_paths(F.col("_value")))))
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for layout in layouts:
        parts = [_turns(F.col("_value"), p) for p in layout.parts]
        turns = F.when(F.col("fingerprint") == F.xxhash64(F.lit(layout.paths)), F.concat(*parts)).otherwise(turns)
    return printed.withColumn("turns", turns).drop("_value")


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit('"'), F.lit("\\q"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\q"), F.lit('"')), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


_OPEN, _MIDDLE, _CLOSE = '<turn role="', '">', "</turn>\n"


def format_turns(records: DataFrame, turns: str = "turns") -> DataFrame:
    """All columns with ``formatted`` and ``loss_spans`` (start from 0 and length, in code points)."""
    written = F.transform(turns, lambda t: F.struct(
        F.concat(F.lit(_OPEN), escaped(t["role"]), F.lit(_MIDDLE)).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == "assistant").alias("loss")
    ))
    done = records.withColumn("_written", written)
    lengths = F.transform("_written", lambda w: F.struct(F.length(w["head"]).alias("head"), F.length(w["body"]).alias("body"), w["loss"].alias("loss")))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def add(state: Column, n: Column) -> Column:
        span = F.struct((state["at"] + n["head"]).alias("start"), n["body"].alias("length"))
        spans = F.when(n["loss"], F.array_append(state["spans"], span)).otherwise(state["spans"])
        return F.struct((state["at"] + n["head"] + n["body"] + len(_CLOSE)).alias("at"), spans.alias("spans"))

    text = F.array_join(F.transform("_written", lambda w: F.concat(w["head"], w["body"], F.lit(_CLOSE))), "")
    return done.select("*", text.alias("formatted"), F.aggregate(lengths, empty, add)["spans"].alias("loss_spans")).drop("_written")


def read_back(formatted: Column) -> Column:
    """Role and text of each turn of a formatted text."""
    opened = F.filter(F.split(formatted, "<"), lambda p: p.startswith(_OPEN[1:]))

    def turn(piece: Column) -> Column:
        inner = F.substr(piece, F.lit(len(_OPEN)))
        role = F.substring_index(inner, _MIDDLE, 1)
        return F.struct(unescaped(role).alias("role"), unescaped(F.substr(inner, F.length(role) + len(_MIDDLE) + 1)).alias("text"))

    return F.transform(opened, turn)


def loss_text(formatted: str, spans: str) -> Column:
    return unescaped(F.array_join(F.transform(spans, lambda s: F.substring(F.col(formatted), s["start"] + 1, s["length"])), ""))


def _grouped(rows: DataFrame) -> DataFrame:
    """``conv_id, t``: the turns of each conversation in order."""
    turn = F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))


def type_paths(kind: DataType) -> str:
    """Nested field paths of a struct's type, written as those of a parsed record."""
    if isinstance(kind, ArrayType):
        return f"ARRAY<{type_paths(kind.elementType)}>"
    if isinstance(kind, StructType):
        inner = ((f.name, type_paths(f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name))
        return f"OBJECT<{', '.join(f'{name}: {below}' if below else name for name, below in inner)}>"
    return ""


def _struct_turns(value: Column, kind: StructType, part: Field | Turns) -> Column:
    name = part.path.removeprefix("$.")
    known = name in kind.names
    if isinstance(part, Field):
        text = F.coalesce(value[name], F.lit("")) if known else F.lit("")
        return F.array(F.struct(F.lit(part.role).alias("role"), text.alias("text")))
    return _named(value[name], part) if known else F.lit(None).cast("array<struct<role:string,text:string>>")


def struct_turns(records: DataFrame, forms: list[str], layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """As ``canonical_turns`` for records of which each is held in one of several struct columns; the others are NULL.

    ``forms`` are dropped, as nothing needs them any more.
    """
    kinds = {form: records.schema[form].dataType for form in forms}
    prints = [F.when(F.col(form).isNotNull(), F.xxhash64(F.lit(type_paths(kind)))) for form, kind in kinds.items()]
    printed = records.withColumn("fingerprint", F.coalesce(*prints))
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for form, kind in kinds.items():
        for layout in layouts:
            chosen = F.col(form).isNotNull() & (F.col("fingerprint") == F.xxhash64(F.lit(layout.paths)))
            # Of a layout with other paths no field need be there, and none is asked for.
            if layout.paths == type_paths(kind):
                turns = F.when(chosen, F.concat(*(_struct_turns(F.col(form), kind, p) for p in layout.parts))).otherwise(turns)
    return printed.withColumn("turns", turns).drop(*forms)


FORMS = ["prompt", "instruction", "speakers", "messages"]


def structured(rows: DataFrame, *measures: Column) -> DataFrame:
    """``conv_id``, ``measures`` of the turns ``t`` and ``FORMS``: each conversation in a struct of the layout that its roles ask for."""
    roles, text = F.col("t.role"), F.col("t.text")
    is_ = lambda *names: roles == F.array(*map(F.lit, names))
    told = (F.get(roles, 0) == "system") & (F.size(roles) > 1) & ~F.arrays_overlap(roles, F.array(F.lit("human"), F.lit("gpt")))
    speaker = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    prompted, instructed = is_("user", "assistant"), is_("system", "user", "assistant")
    spoken = told & ~instructed
    made = {
        "prompt": (prompted, F.struct(F.get(text, 0).alias("prompt"), F.get(text, 1).alias("completion"))),
        "instruction": (instructed, F.struct(F.get(text, 0).alias("instruction"), F.get(text, 1).alias("input"), F.get(text, 2).alias("output"))),
        "speakers": (spoken, F.struct(
            F.get(text, 0).alias("system"),
            F.transform(F.slice("t", F.lit(2), F.size("t")), lambda x: F.struct(speaker(x["role"]).alias("from"), x["text"].alias("value"))).alias("conversations"),
        )),
        "messages": (~(prompted | instructed | spoken), F.struct(
            F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages"),
        )),
    }
    return _grouped(rows).select("conv_id", *measures, *(F.when(*made[form]).alias(form) for form in FORMS))


def _json() -> Column:
    return F.coalesce(*(F.to_json(F.col(form)) for form in FORMS))


def _writable() -> Column:
    """Whether JSON can hold the turns ``t`` as they are: UTF-8 only, and not longer than the parser takes."""
    size = F.aggregate("t", F.lit(0).cast("bigint"), lambda n, x: n + F.octet_length(x["role"]) + F.octet_length(x["text"]))
    return (size <= PARSED_CHARS) & F.forall("t", lambda x: F.is_valid_utf8(x["role"]) & F.is_valid_utf8(x["text"]))


def conversation_turns(rows: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """``conv_id, fingerprint, turns`` as of ``conversation_records``, of any size.

    Each conversation is written as a JSON record, parsed, fingerprinted by the field paths found in it and read by the
    layout of that fingerprint.  Only what the parser cannot take, by its bytes, is read from its struct instead.
    """
    held = structured(rows, _writable().alias("_writable")).withColumn("record", F.when(F.col("_writable"), _json()))
    written = held.withColumn("record", F.when(F.octet_length("record") <= PARSED_CHARS, F.col("record")))
    parsed = canonical_turns(written, layouts=layouts).withColumnsRenamed({"fingerprint": "_fingerprint", "turns": "_turns"})
    others = parsed.withColumns({form: F.when(F.col("record").isNull(), F.col(form)) for form in FORMS})
    found = struct_turns(others, FORMS, layouts)
    return found.select("conv_id", *(
        F.when(F.col("record").isNotNull(), F.col(f"_{name}")).otherwise(F.col(name)).alias(name) for name in ("fingerprint", "turns")
    ))


def conversation_records(rows: DataFrame) -> DataFrame:
    """``conv_id, record``: the same structs as JSON."""
    return structured(rows).select("conv_id", _json().alias("record"))


QUERY = "op7_chat"
PROBE = "\\### Assistant: </turn> ok"


def query(spark, folder: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], rows.schema)
    done = format_turns(conversation_turns(rows.union(probe))).select("conv_id", "formatted", "loss_spans")
    read = done.select("conv_id", "formatted", read_back(F.col("formatted")).alias("read"), loss_text("formatted", "loss_spans").alias("loss"))
    whole = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("read").cast("bigint").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )


ORACLE = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
),
e as (
  select *, replace(replace(replace(role, '\', '\b'), '<', '\l'), '"', '\q') as er, replace(replace(replace(text, '\', '\b'), '<', '\l'), '"', '\q') as et from c
)
select conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(length('<turn role="">') + length(er) + length(et) + length('</turn>') + 1)::bigint as formatted_chars
from e group by conv_id
"""
