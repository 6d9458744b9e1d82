"""URL filters by Bloom filter cascades, with DataFrame functions only.

A cascade tells listed keys from all other keys of the corpus without error and without a join.  Its first
filter holds the listed keys; the second the keys of the corpus that pass the first by mistake; the
third the listed keys that pass the second; and so on, until nobody passes by mistake.  A key is listed
if the first filter it fails is an even one.  Since all keys of the corpus took part in the
making, the answer is exact for each of them.

Three cascades judge a URL: the rules that allow, the rules that block, both asked for every host suffix and
path prefix of the URL, and a list of single pages, asked for host and path.  The longest rule wins;
without a rule a listed page is blocked.

A filter is an array literal of ``BITS_PER_KEY`` bits per key.  A list longer than ``LIST_KEYS`` is dealt into
several cascades by a hash of the key, so that each literal keeps its size.  Defined results: a NULL
URL or one without ``://`` has neither host nor path, no rule, and is allowed; repeated rows
get the same verdict; an empty list blocks nothing, an empty table has no rows; a very long URL is a key
like any other; extra columns are not looked at.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.operators.stage import Stage

BITS_PER_KEY = 10
HASHES = 5
LIST_KEYS = 1 << 17
# The page list of the query, since the tables hold none: pages captured more than once, and a quarter of
# all, those whose SHA-256 in hexadecimal digits sorts below this.
LISTED_BELOW = "4"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)


class Bloom(NamedTuple):
    words: list[int]
    level: int

    def has(self, key: Column) -> Column:
        bits = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        found = F.lit(True)
        for place in places(key, len(self.words), self.level):
            word = F.get(bits, F.call_function("div", place, F.lit(64)).cast("int"))
            found = found & (F.call_function("shiftright", word, (place % 64).cast("int")).bitwiseAND(1) == 1)
        return found


def places(key: Column, words: int, level: int) -> list[Column]:
    """Bits of a key in a filter of ``words`` 64-bit words; each level hashes anew."""
    bits = F.lit(64 * words)
    one, two = (F.pmod(F.xxhash64(F.lit(2 * level + k), key), bits) for k in (0, 1))
    return [(one + two * k) % bits for k in range(HASHES)]


def bloom(keys: DataFrame, n: int, level: int) -> Bloom:
    words = max(1, -(-n * BITS_PER_KEY // 64))
    place = keys.select(F.explode(F.array(*places(F.col("key"), words, level))).alias("place"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("place") % 64).cast("int"))
    rows = place.groupBy(F.call_function("div", F.col("place"), F.lit(64)).alias("word")).agg(F.bit_or(bit).alias("bits")).collect()
    filled = [0] * words
    for row in rows:
        filled[row.word] = row.bits
    return Bloom(filled, level)


class Cascade(NamedTuple):
    parts: list[list[Bloom]]

    def has(self, key: Column) -> Column:
        part = F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(len(self.parts)))
        found = F.lit(False)
        for k, levels in enumerate(self.parts):
            listed = F.lit(len(levels) % 2 == 1)
            for level in reversed(levels):
                listed = F.when(level.has(key), listed).otherwise(F.lit(level.level % 2 == 1))
            found = F.when(part == k, listed).otherwise(found) if len(self.parts) > 1 else listed
        return found


def build_cascade(keys: DataFrame, stage: Stage, name: str) -> Cascade:
    """``keys``: every ``key`` of the corpus once, with whether it is ``listed``."""
    kept = stage.save(keys, name)
    n = kept.where("listed").count()
    parts = max(1, -(-n // LIST_KEYS))
    cascades = []
    for k in range(parts):
        own = kept.where(F.pmod(F.xxhash64("key", F.lit(-1)), F.lit(parts)) == k) if parts > 1 else kept
        inserted, tested, levels = own.where("listed"), own.where(~F.col("listed")), []
        size = n if parts == 1 else inserted.count()
        while size:
            levels.append(bloom(inserted, size, len(levels)))
            passed = stage.save(tested.where(levels[-1].has(F.col("key"))), f"{name}-{k}-{len(levels)}")
            inserted, tested = passed, inserted
            size = passed.count()
        cascades.append(levels)
    return Cascade(cascades)


def host_and_path(url: Column) -> tuple[Column, Column]:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    upper = "".join(map(chr, range(65, 91)))
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def rule_keys(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """Every rule that could fit: host suffixes with path prefixes of the lengths that rules have."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    lengths = F.array(*(F.lit(n) for n in sorted({len(r.path) for r in rules})))
    prefixes = F.transform(F.filter(lengths, lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))


def judge_urls(pages: DataFrame, listed: DataFrame, page: str = "page_id", url: str = "url", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict``; ``listed`` has each ``key`` (host and path) of the corpus and ``listed``."""
    stage = Stage(pages.sparkSession, "urls")
    host, path = host_and_path(F.col(url))
    parsed = pages.select(F.col(page).alias("page_id"), host.alias("host"), path.alias("path"))
    asked = parsed.select(F.explode(rule_keys(F.col("host"), F.col("path"), rules)).alias("key")).distinct()
    by_verdict = {}
    for verdict in ("allow", "block"):
        own = [r.host + r.path for r in rules if r.verdict == verdict]
        by_verdict[verdict] = build_cascade(asked.withColumn("listed", F.col("key").isin(own)), stage, verdict)
    single = build_cascade(listed.select("key", "listed"), stage, "single")
    candidates = parsed.withColumn("_keys", rule_keys(F.col("host"), F.col("path"), rules))
    longest = {v: F.array_max(F.transform(F.filter("_keys", c.has), lambda k: F.struct(F.length(k).alias("n"), k.alias("key")))) for v, c in by_verdict.items()}
    ruled = candidates.select("page_id", "host", "path", longest["allow"].alias("allow"), longest["block"].alias("block"))
    blocks = F.col("block.n").isNotNull() & (F.col("allow.n").isNull() | (F.col("block.n") > F.col("allow.n")))
    rule = F.when(blocks, F.col("block.key")).otherwise(F.col("allow.key"))
    page_key = F.concat("host", "path")
    return ruled.select(
        "page_id", "host", "path", rule.alias("rule"),
        F.when(blocks, F.lit("block")).when(F.col("allow.n").isNotNull(), F.lit("allow"))
        .when((page_key != "") & single.has(page_key), F.lit("block")).otherwise(F.lit("allow")).alias("verdict"),
    )


def listed_pages(pages: DataFrame, url: str = "url", below: str = LISTED_BELOW) -> DataFrame:
    """Every page key of a corpus, listed when it was captured more than once or its digest says so."""
    host, path = host_and_path(F.col(url))
    often = F.count(F.lit(1)) > 1
    counted = pages.groupBy(F.concat(host, path).alias("key")).agg(often.alias("often"))
    return counted.select("key", (F.col("often") | (F.sha2("key", 256) < below)).alias("listed"))


QUERY = "op4_urls"


def query(spark, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    return judge_urls(pages, listed_pages(pages))


ORACLE = r"""
with p as (
  select page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path, row_number() over () as r
  from pages
),
rules as (
  select * from (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
    ('block', 'net', '/es/'), ('block', 'net', '/fr/')) t(verdict, h, start)
),
best as (
  select r, arg_max(h || start, length(h || start)) as rule, arg_max(verdict, length(h || start)) as verdict
  from p join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, start) group by r
),
often as (select host, path from p group by host, path having count(*) > 1 or sha256(host || path) < '4')
select page_id, p.host, p.path, rule,
  coalesce(verdict, case when o.host is not null and p.host || p.path <> '' then 'block' else 'allow' end) as verdict
from p left join best on p.r = best.r left join often o on o.host = p.host and o.path = p.path
"""
