"""Near-duplicate lines by a segment-partition edit join, with DataFrame functions only.

Lines of at least ``min_chars`` code points are compared; two are near when an edit distance of
``edits`` or less lies between them.  A line is split into ``edits + 1`` segments; of two near lines the
longer one has one of the shorter one's segments unchanged, a few places away at most.  Segments are
index keys, the possible substrings of the longer line are its probes, and both carry the length and
the place of the segment.

A key that many lines share is not paired out.  Its lines are keyed anew, each by a constant number of keys:
characters are dealt into a few groups by code point, an edit touches two groups at most, so the characters of
the groups that no edit touches are the same sequence in both lines; a key is such a sequence for a choice of groups.
First a third and then half of a line has to agree.  Lines that still crowd differ in few places.  Two of them are
near just if they are ``P [c] m [c] S`` for one P, m and S, where each ``[c]`` is a code point or nothing: all lines with
one (P, m, S) are near each other, and a link to one of them will do.  P ends where lines with one beginning part from
each other, S begins where lines with one end do, so that only such places are tried.

A mark says of each code point (modulo 64) whether it occurs an odd number of times: an edit changes two bits at
most, so that only lines whose marks are near are compared.  Candidates are then verified by a banded
bit-parallel automaton: bit k of state d says that the diagonal k - edits is reached with d edits.  ``edits`` is 1 or 2.

Defined results: a NULL or empty text has no lines; equal lines are near; lines under ``min_chars`` are
near where they are equal, and are looked at where ``short`` is set, as it is for removal; blank ones
are left alone; a document without an id takes no part and is kept as it is; rows that share an id are one
document, but a line goes only from a row that has it; in each class of near lines the first occurrence
(least id, then least line number) stays.  A line of any length is one unit; an empty table has no classes; other
columns are not looked at, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.llm.components import components
from pagemill.llm.urlfilter import bloom
from pagemill.operators.stage import Stage

EDITS = 2
MIN_CHARS = 20
# Most lines that the filter for reading texts again is sized for; with more it lets more through.
FILTER_LINES = 1 << 20
# Pairs of one key that are compared at once; with more, its lines are keyed anew.
PAIRS = 50
# The same where lines carry marks, by which most pairs are dropped inside the join.
MARKED_PAIRS = 1_000
# Documents whose lines are sampled for heavy keys, and the lines of the sample that make a key heavy.  So heavy
# keys are few, and a key that is not found has few of all lines.
SAMPLE_DOCUMENTS = 20_000
HEAVY = 64
# Characters that are counted before two lines are compared; any others would do.
COUNTED = " etaonisrhdlu"
# Groups of characters that have to agree, of those that no edit touches, round by round.
ALIKE = (2, 4)


def _choices(edits: int) -> list[tuple[int, int, int]]:
    """Segment ``k``, how far it may have moved, and by how much the line that is probed is longer."""
    return [
        (k, shift, by)
        for by in range(edits + 1)
        for k in range(edits + 1)
        for shift in range(max(-k, by - (edits - k)), min(k, by + edits - k) + 1)
    ]


def _entries(lines: DataFrame, edits: int) -> DataFrame:
    """Index keys (role 0) and probes (role 1) of ``line, text, n``."""
    choices = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(s).alias("shift"), F.lit(by).alias("by")) for k, s, by in _choices(edits)))
    made = lines.select("*", F.inline(choices))
    own = (F.col("shift") == 0) & (F.col("by") == 0)
    length = F.col("n") - F.col("by")
    base, over = F.call_function("div", length, F.lit(edits + 1)).cast("int"), length % (edits + 1)
    # The last segments get what is over.
    start = base * F.col("k") + F.greatest(F.col("k") - (edits + 1) + over, F.lit(0)) + F.col("shift")
    size = base + F.when(F.col("k") >= (edits + 1) - over, 1).otherwise(0)
    placed = made.where(length > edits).select("*", length.alias("length"), start.alias("start"), size.alias("size")).where(
        (F.col("start") >= 0) & (F.col("start") + F.col("size") <= F.col("n"))
    )
    part = F.substring(F.col("text"), F.col("start") + 1, F.col("size"))
    return placed.select("line", F.xxhash64("length", "k", part).alias("key"), F.when(own, 0).otherwise(1).alias("role"))


def _shared(entries: DataFrame) -> DataFrame:
    """Keys that two lines or more share, with the number of ``pairs``."""
    n = F.count(F.lit(1))
    counted = entries.groupBy("key").agg(n.alias("n"), F.min("line").alias("low"), F.max("line").alias("high")).where("low != high")
    return counted.select("key", F.floor(F.col("n") * (F.col("n") - 1) / 2).alias("pairs"))


def _heavy(lines: DataFrame, edits: int) -> DataFrame:
    """Keys that ``HEAVY`` lines or more of a sample share."""
    distinct = lines.select("text").distinct().select(F.xxhash64("text").alias("line"), "text", F.length("text").alias("n"))
    return _entries(distinct, edits).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HEAVY).select("key", F.lit(True).alias("heavy"))


def _alive(entries: DataFrame, heavy: DataFrame) -> DataFrame:
    """Entries whose key pairs a line with another one, with the number of ``pairs``; NULL where the key is a heavy one.

    Entries of heavy keys are dealt by their line, so that no task gets them all.
    """
    dealt = entries.join(F.broadcast(heavy), "key", "left").withColumn("_own", F.when(F.col("heavy"), F.xxhash64("key", "line")).otherwise(F.col("key")))
    own = Window.partitionBy("_own")
    n_index = F.sum(F.when(F.col("role") == 0, 1)).over(own)
    n_probe = F.sum(F.when(F.col("role") == 1, 1)).over(own)
    pairs = n_index * F.coalesce(n_probe, F.lit(0)) + F.floor(n_index * (n_index - 1) / 2)
    counted = dealt.select("line", "key", "role", "heavy", pairs.alias("pairs"), F.min("line").over(own).alias("low"), F.max("line").over(own).alias("high"))
    met = counted.where(F.col("heavy") | ((F.col("pairs") > 0) & (F.col("low") != F.col("high"))))
    return met.select("line", "key", "role", F.when(F.col("heavy"), F.lit(None)).otherwise(F.col("pairs")).alias("pairs"))


def _mark(text: Column) -> Column:
    """Bit k: is the number of code points that are k modulo 64 odd?"""
    one = F.lit(1).cast("bigint")
    return F.aggregate(
        F.split(text, ""), F.lit(0).cast("bigint"), lambda bits, c: bits.bitwiseXOR(F.call_function("shiftleft", one, F.pmod(F.ascii(c), F.lit(64))))
    )


def _counts(text: Column) -> Column:
    return F.array(*(F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in COUNTED))


def _paired(entries: DataFrame, edits: int) -> DataFrame:
    """Pairs of lines under one key; where lines have marks, those whose marks are near."""
    marked = ["mark"] if "mark" in entries.columns else []
    index = entries.where(F.col("role") == 0).select("key", F.col("line").alias("a"), *(F.col(m).alias("a_mark") for m in marked))
    other = entries.select("key", "role", F.col("line").alias("b"), *(F.col(m).alias("b_mark") for m in marked))
    useful = ((F.col("role") == 1) & (F.col("a") != F.col("b"))) | (F.col("a") < F.col("b"))
    if marked:
        useful = useful & _alike(F.col("a_mark"), F.col("b_mark"), edits)
    return index.join(other, "key").where(useful).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _alike(one: Column, other: Column, edits: int) -> Column:
    return F.bit_count(one.bitwiseXOR(other)) <= 2 * edits


def _sequences(lines: DataFrame, edits: int, alike: int) -> DataFrame:
    """Keys of ``line, text, mark``: the characters of every choice of ``alike`` groups out of ``2 * edits + alike``."""
    groups = 2 * edits + alike
    chars = F.split("text", "")
    of_group = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: F.array_join(F.filter(chars, lambda c: F.pmod(F.ascii(c), F.lit(groups)) == g), ""))
    dealt = lines.select("line", "mark", of_group.alias("parts"))
    keys = [F.xxhash64(F.lit(k), *(F.get("parts", g) for g in chosen)) for k, chosen in enumerate(combinations(range(groups), alike))]
    return dealt.select("line", "mark", F.lit(0).alias("role"), F.explode(F.array(*keys)).alias("key"))


def _partings(lines: DataFrame, text: Column, stage: Stage, name: str) -> DataFrame:
    """``line`` and the lengths ``at`` of its beginnings after which other lines go on differently."""
    places = F.transform(F.sequence(F.lit(0), F.col("n")), lambda k: F.struct(
        k.alias("at"), F.xxhash64(F.substr(text, F.lit(1), k)).alias("begin"), F.substr(text, k + 1, F.lit(1)).alias("next")
    ))
    placed = lines.select("line", F.inline(places))
    parting = placed.groupBy("at", "begin").agg(F.min("next").alias("low"), F.max("next").alias("high")).where("low != high").select("at", "begin")
    found = placed.select("line", "at", "begin").join(stage.save(parting, f"{name}-parting"), ["at", "begin"])
    return stage.save(found.groupBy("line").agg(F.sort_array(F.collect_set("at")).alias("at")), name)


def _star_pairs(lines: DataFrame, stage: Stage, edits: int) -> DataFrame:
    """Links of ``line, text, n`` that join all near lines: one from the least line of each (P, m, S) to the others."""
    fronts = _partings(lines, F.col("text"), stage, "fronts").withColumnRenamed("at", "fronts")
    backs = _partings(lines, F.reverse("text"), stage, "backs").withColumnRenamed("at", "backs")
    front = lines.join(fronts, "line").join(backs, "line", "left").select("line", "text", "n", "backs", F.explode("fronts").alias("i"))
    # A beginning and an end that overlap leave nothing of the shorter line.
    close = F.array(*(F.col("n") - F.col("i") - k for k in range(edits + 1)))
    ends = F.array_union(F.coalesce("backs", F.array().cast("array<int>")), close) if edits == 2 else close
    variants = [(f, l) for f in (0, 1) for l in (0, 1) if f + l <= edits]

    def keys(s: Column) -> Column:
        middle = F.col("n") - F.col("i") - s
        begin, end = F.substr("text", F.lit(1), F.col("i")), F.substr("text", F.col("n") - s + 1, s)
        own = [F.when(middle >= f + l, F.xxhash64(begin, F.substr("text", F.col("i") + (1 + f), middle - (f + l)), end)) for f, l in variants]
        return F.array(*own)

    fitting = F.filter(ends, lambda s: (s >= 0) & (s + F.col("i") <= F.col("n")))
    keyed = front.select("line", F.explode(F.flatten(F.transform(fitting, keys))).alias("key")).where(F.col("key").isNotNull())
    keyed = stage.save(keyed.distinct(), "decompositions")
    least = keyed.groupBy("key").agg(F.min("line").alias("a"), F.max("line").alias("high")).where(F.col("a") != F.col("high")).select("key", "a")
    return keyed.join(least, "key").where(F.col("a") != F.col("line")).select("a", F.col("line").alias("b")).distinct()


def _texts(lines: DataFrame, wanted: DataFrame, stage: Stage, name: str) -> DataFrame:
    """The distinct ``lines`` that ``wanted`` (``key``) names, read again through a Bloom filter of bounded size."""
    wanted = stage.save(wanted.distinct(), f"{name}-keys")
    seen = bloom(wanted, min(max(wanted.count(), 1), FILTER_LINES), 0)
    return stage.save(lines.where(seen.has(F.col("line"))).distinct(), name)


def candidate_pairs(lines: DataFrame, stage: Stage, edits: int = EDITS, sample: DataFrame | None = None) -> DataFrame:
    """Pairs ``a, b`` of the fingerprints of ``lines`` (``line, text, n``) that may be near.

    Lines that crowd to the end are each paired with one line of every set that is near throughout.  ``sample``,
    some of the lines, only tells which keys go to the crowded lines without being counted.
    """
    if edits not in (1, 2):
        raise ValueError("edits must be 1 or 2")
    distinct = lines.select("text").distinct().select(F.xxhash64("text").alias("line"), "text", F.length("text").alias("n"))
    heavy = stage.save(_heavy(lines if sample is None else sample, edits), "heavy")
    alive = stage.save(_alive(_entries(distinct, edits), heavy), "keys")
    found = [stage.save(_paired(alive.where(F.col("pairs") <= PAIRS), edits), "pairs-0")]
    many = alive.where(F.col("pairs").isNull() | (F.col("pairs") > PAIRS)).select(F.col("line").alias("key"))
    if many.isEmpty():
        return found[0]
    crowded = _texts(lines, many, stage, "crowded")
    crowded = stage.save(crowded.withColumn("mark", _mark(F.col("text"))), "marked")
    for level, alike in enumerate(ALIKE, 1):
        entries = stage.save(_sequences(crowded, edits, alike), f"entries-{level}")
        shared = stage.save(_shared(entries).select("key", "pairs"), f"keys-{level}")
        met = entries.join(shared, "key")
        found.append(stage.save(_paired(met.where(F.col("pairs") <= MARKED_PAIRS), edits), f"pairs-{level}"))
        left = stage.save(met.where(F.col("pairs") > MARKED_PAIRS).select("line").distinct(), f"left-{level}")
        if left.isEmpty():
            break
        crowded = stage.save(crowded.join(left, "line", "left_semi"), f"crowded-{level}")
    else:
        found.append(stage.save(_star_pairs(crowded.select("line", "text", "n"), stage, edits), "stars"))
    return reduce(DataFrame.union, found).distinct()


def within(x: Column, y: Column, edits: int) -> Column:
    """Is the edit distance of two texts ``edits`` or less?"""
    width = (1 << (2 * edits + 1)) - 1
    begin = F.struct(*(F.lit(((1 << (d + 1)) - 1) << edits & width).alias(f"s{d}") for d in range(edits + 1)))

    def matches(pair: Column) -> Column:
        """For each code point of ``y`` the diagonals on which ``x`` has the same."""

        def at(char: Column, j: Column) -> Column:
            bits = F.lit(0)
            for k in range(2 * edits + 1):
                bits = bits + F.when(F.get(pair["a"], j + (k - edits)) == char, 1 << k).otherwise(0)
            return bits

        return F.transform(pair["b"], at)

    def step(state: Column, match: Column) -> Column:
        rows, above = [], None
        for d in range(edits + 1):
            now = state[f"s{d}"].bitwiseAND(match)
            if d:
                before = state[f"s{d - 1}"]
                now = now.bitwiseOR(before).bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(above, 1).bitwiseAND(width))
            rows.append(now.alias(f"s{d}"))
            above = now
        return F.struct(*rows)

    gap = F.length(x) - F.length(y)
    # One array of one pair gives the code points a name, so that a text is taken apart once.
    pair = F.array(F.struct(F.split(x, "").alias("a"), F.split(y, "").alias("b")))
    last = F.transform(pair, lambda p: F.aggregate(matches(p), begin, step)[f"s{edits}"])
    reached = F.call_function("shiftright", F.get(last, 0), gap + edits).bitwiseAND(1) == 1
    return F.when(F.abs(gap) > edits, F.lit(False)).when(F.length(y) == 0, F.lit(True)).otherwise(reached)


def all_lines(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    return documents.where(F.col(doc).isNotNull()).select(F.col(doc).alias("doc"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "text"))


def document_lines(documents: DataFrame, doc: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    return all_lines(documents, doc, text).where(F.length("text") >= min_chars)


def line_classes(
    documents: DataFrame, doc: str = "doc_id", text: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS, short: bool = False
) -> DataFrame:
    """``doc, line_no, line_class, first_doc, first_line, kept`` for every line that is long enough.

    ``short``: also for shorter lines that are not blank, whose class is their text.
    """
    return _classes(documents, doc, text, edits, min_chars, short).drop("line")


def _classes(documents: DataFrame, doc: str, text: str, edits: int, min_chars: int, short: bool, named_lines: bool = False) -> DataFrame:
    """The same; ``named_lines``: with ``line``, the digest of the line's own text."""
    stage = Stage(documents.sparkSession, "lines")
    lines = document_lines(documents, doc, text, min_chars)
    texts = lines.select(F.xxhash64("text").alias("line"), "text", F.length("text").alias("n"))
    share = min(1.0, SAMPLE_DOCUMENTS / max(1, documents.count()))
    sample = document_lines(documents.sample(share, 1), doc, text, min_chars).select("text") if share < 1 else None
    pairs = stage.save(candidate_pairs(texts, stage, edits, sample), "pairs")
    name = F.md5("text")
    paired = _texts(texts, pairs.select(F.explode(F.array("a", "b")).alias("key")), stage, "paired")
    paired = stage.save(paired.withColumn("counts", _counts(F.col("text"))), "paired-counts")
    left, right = (paired.select(F.col("line").alias(x), F.col("text").alias(f"{x}_text"), F.col("counts").alias(f"{x}_counts")) for x in "ab")
    # An edit adds or takes one of a character, or both of different ones.
    differing = reduce(Column.__add__, (F.abs(F.get("a_counts", k) - F.get("b_counts", k)) for k in range(len(COUNTED))))
    met = pairs.join(left, "a").join(right, "b").where(differing <= 2 * edits)
    links = met.where(within(F.col("a_text"), F.col("b_text"), edits)).select(F.md5("a_text").alias("a"), F.md5("b_text").alias("b"))
    near = components(links, stage, "near")
    own = [F.unhex("line").alias("line")] if named_lines else []
    # A short line has the text of no other class, so it finds none here.
    said = all_lines(documents, doc, text).where((F.length("text") >= min_chars) | F.col("text").rlike(r"(?U)\S")) if short else lines
    named = said.select("doc", "line_no", name.alias("line"))
    classed = named.join(near.withColumnRenamed("node", "line"), "line", "left").select("doc", "line_no", F.coalesce("component", "line").alias("line_class"), *own)
    classed = stage.save(classed, "classed")
    first = stage.save(classed.groupBy("line_class").agg(F.min(F.struct("doc", "line_no")).alias("first")), "first")
    return classed.join(first, "line_class").select(
        "doc", "line_no", "line_class", F.col("first.doc").alias("first_doc"), F.col("first.line_no").alias("first_line"),
        ((F.col("doc") == F.col("first.doc")) & (F.col("line_no") == F.col("first.line_no"))).alias("kept"), *(["line"] if named_lines else []),
    )


def drop_near_lines(documents: DataFrame, doc: str = "doc_id", text: str = "text", edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents without the lines that occur before, all columns kept; a text may become empty."""
    found = _classes(documents, doc, text, edits, min_chars, True, True).where(~F.col("kept"))
    name = lambda number, line: F.concat_ws(":", number, F.md5(line))
    gone = found.groupBy("doc").agg(F.collect_set(F.concat_ws(":", "line_no", F.lower(F.hex("line")))).alias("_gone")).withColumnRenamed("doc", "_doc")
    lines = F.split(F.col(text), "\n", -1)
    # Names of lines are strings, so that they are looked up by their hash.
    names = F.array_except(F.transform(lines, lambda line, k: name(k, line)), F.col("_gone"))
    left = F.transform(F.array(F.struct(lines.alias("lines"), names.alias("names"))), lambda x: F.array_join(
        F.transform(x["names"], lambda n: F.get(x["lines"], F.substring_index(n, ":", 1).cast("int"))), "\n"
    ))
    joined = documents.join(gone, documents[doc] == gone["_doc"], "left")
    return joined.select(*(F.when(F.col("_gone").isNull(), F.col(c)).otherwise(F.get(left, 0)).alias(c) if c == text else documents[c] for c in documents.columns))


QUERY = "op6_lines"


def query(spark, folder: str) -> DataFrame:
    found = line_classes(spark.read.parquet(f"{folder}/documents.parquet"), short=True)
    return found.select(
        F.col("doc").alias("doc_id"), F.col("line_no").cast("bigint").alias("line_no"), F.col("first_doc").alias("first_doc_id"),
        F.col("first_line").cast("bigint").alias("first_line_no"), "kept",
    )


# The distance function of the SQL engine counts bytes, so this twin holds where near lines differ in
# ASCII characters; the tests compare code points with a plain table of distances.
ORACLE = r"""
with recursive l as (
  select doc_id, generate_subscripts(lines, 1) - 1 as line_no, unnest(lines) as line
  from (select doc_id, string_split(text, chr(10)) as lines from documents where doc_id is not null and text is not null)
),
t as materialized (select doc_id, line_no, line from l where length(line) >= 20 or regexp_matches(line, '[^\p{Z}\x{09}-\x{0D}\x{85}]')),
u as materialized (select line, length(line) as n, row_number() over () as id from (select distinct line from t)),
seg as (
  select id, n, k, n // 3 * k + greatest(k - 3 + n % 3, 0) as s, n // 3 + case when k >= 3 - n % 3 then 1 else 0 end as c, line
  from u cross join (select unnest([0, 1, 2]) as k) where n >= 20
),
idx as (select id, n, k, s, line[s + 1:s + c] as g from seg),
shape as (select distinct n, k, s, c from seg),
prb as (
  select u.id, p.n, p.k, p.s, u.line[p.s + d + 1:p.s + d + p.c] as g
  from u join shape p on p.n between u.n - 2 and u.n cross join (select unnest([-2, -1, 0, 1, 2]) as d) where p.s + d >= 0 and u.n >= 20
),
cand as (select distinct i.id as x, p.id as y from idx i join prb p on i.n = p.n and i.k = p.k and i.g = p.g and i.id <> p.id),
e as materialized (
  select distinct x, y from cand join u a on a.id = x join u b on b.id = y where levenshtein(a.line, b.line) <= 2
),
sym as materialized (select x, y from e union select y, x from e),
reach as (select x, x as y from sym union select reach.x, sym.y from reach join sym on reach.y = sym.x),
cls as (select x, min(y) as m from reach group by x),
r as (select doc_id, line_no, coalesce(m, id) as c from t join u on t.line = u.line left join cls on x = id)
select doc_id, line_no::bigint as line_no, first(doc_id) over w as first_doc_id, (first(line_no) over w)::bigint as first_line_no,
  doc_id = first(doc_id) over w and line_no = first(line_no) over w as kept
from r window w as (partition by c order by doc_id, line_no)
"""
