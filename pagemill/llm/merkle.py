"""A Merkle manifest of a table as a persistent tree: what changes is copied, the rest is shared.

The rows of each tree (documents: of one source) are leaves in the order of their ids, and every ``BRANCH``
consecutive nodes have one parent.  A tree is kept as aligned blocks of ``BLOCK`` leaves, each with the nodes
of its ``HEIGHT`` lowest levels; the tops of the blocks are the leaves of the next round of blocks, until one
node is left, and the roots of all trees are the leaves of one more tree.  Blocks are written tables and
are built apart from each other, so a tree with a third of all rows is many tasks.

A tampered leaf makes a version of the tree.  It copies the leaf's ancestors only: those within the aligned
block by the block's own nodes, those above by the path of the block's top, which rounds hand down by joins
on blocks, never on versions.  All other nodes are those of the first version.

Digests are SHA-256 of their children's hexadecimal digests.  Defined results: a NULL column is written ``-`` and an
empty text ``0:``; a NULL source is a tree of its own, before all others, and a NULL id comes first and is never
tampered with; rows of one id are ordered by their leaf, and equal rows are a leaf each; a very long text
is hashed where it is read, and only digests travel; an empty table has no rows and no root; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.ordering import numbered
from pagemill.operators.stage import Stage

BRANCH = 3
HEIGHT = 7
BLOCK = BRANCH**HEIGHT
# One leaf per row: these columns, in this order.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")

_STEP = pa.struct([("place", pa.int32()), ("others", pa.list_(pa.binary()))])
_STEP_SQL = "struct<place:int,others:array<binary>>"
_COPY = pa.struct([("tree", pa.string()), ("level", pa.int32()), ("pos", pa.int64()), ("digest", pa.binary())])
_COPY_SQL = "struct<tree:string,level:int,pos:bigint,digest:binary>"

# The tree whose leaves are the roots of the others; no source has this name, see tree_name.
TOP = "^"


def tree_name(source: Column) -> Column:
    """Name of a source's tree: sorts like the source, NULL first."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))


def field_text(column: Column) -> Column:
    value = column.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf_digest(*columns: Column) -> Column:
    """SHA-256 of a row: fields marked with their sizes, so that no two rows are written alike."""
    return F.unhex(F.sha2(F.concat(*map(field_text, columns)), 256))


def joined(digests: list[bytes]) -> bytes:
    """The parent of some nodes."""
    return sha256("".join(d.hex() for d in digests).encode()).digest()


def block_levels(leaves: list[bytes], n: int) -> list[list[bytes]]:
    """Levels of a block, leaves first; ``n`` is the size of the whole tree at the leaves' level."""
    levels = [leaves]
    while n > 1 and len(levels) <= HEIGHT:
        below = levels[-1]
        levels.append([joined(below[k : k + BRANCH]) for k in range(0, len(below), BRANCH)])
        n = -(-n // BRANCH)
    return levels


def path_of(levels: list[list[bytes]], at: int) -> list[dict]:
    """What is beside a leaf of a block and beside its ancestors, below the block's top."""
    path = []
    for nodes in levels[:-1]:
        first = at - at % BRANCH
        run = nodes[first : first + BRANCH]
        path.append({"place": at - first, "others": run[: at - first] + run[at - first + 1 :]})
        at //= BRANCH
    return path


def fold(digest: bytes, path: list[dict]) -> list[bytes]:
    """The ancestors of a node, lowest first, from the digests beside it and beside them."""
    found = []
    for step in path:
        others = step["others"]
        digest = joined([*others[: step["place"]], digest, *others[step["place"] :]])
        found.append(digest)
    return found


def proof_digest(path: list[dict]) -> str:
    return sha256("".join(d.hex() for step in path for d in step["others"]).encode()).hexdigest()


def _build(with_changes: bool, item: pa.DataType):
    """Nodes of one aligned block."""
    schema = pa.schema([
        ("tree", pa.string()), ("block", pa.int64()), ("n", pa.int64()), ("items", pa.list_(item)),
        ("levels", pa.list_(pa.list_(pa.binary()))), ("changes", pa.list_(pa.binary())),
    ])

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        n = group.column("n")[0].as_py()
        levels = block_levels(group.column("digest").to_pylist(), n)
        changes = group.column("changed").to_pylist() if with_changes else None
        return pa.Table.from_arrays(
            [
                group.column("tree")[:1].combine_chunks().cast(pa.string()), pa.array([group.column("pos")[0].as_py() // BLOCK], pa.int64()), pa.array([n], pa.int64()),
                pa.array([group.column("item").to_pylist()], pa.list_(item)), pa.array([levels], schema.field("levels").type), pa.array([changes], schema.field("changes").type),
            ],
            schema=schema,
        )

    return run


def _blocks(rows: DataFrame, with_changes: bool, item: str, arrow_item: pa.DataType) -> DataFrame:
    sql = f"tree string, block bigint, n bigint, items array<{item}>, levels array<array<binary>>, changes array<binary>"
    return rows.groupBy("tree", F.floor(F.col("pos") / BLOCK).alias("_block")).applyInArrow(_build(with_changes, arrow_item), sql)


def _item_paths(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The path of every leaf of every block up to its root: that in the block, then that of the block's top."""
    for batch in blocks:
        out: dict[str, list] = {c: [] for c in ("tree", "pos", "path", "root")}
        for row in batch.to_pylist():
            for at in range(len(row["levels"][0])):
                out["tree"].append(row["tree"])
                out["pos"].append(row["block"] * BLOCK + at)
                out["path"].append([*path_of(row["levels"], at), *row["path"]])
                out["root"].append(row["root"])
        yield pa.RecordBatch.from_arrays(
            [pa.array(out["tree"], pa.string()), pa.array(out["pos"], pa.int64()), pa.array(out["path"], pa.list_(_STEP)), pa.array(out["root"], pa.binary())],
            names=list(out),
        )


class Forest:
    """Trees over ordered leaves, in written tables of aligned blocks.

    ``leaves`` has ``tree, pos, n, item, digest`` and, for versions, ``changed`` (the digest of a tampered leaf or
    NULL); see :func:`pagemill.llm.ordering.numbered` for ``pos`` and ``n``.
    """

    def __init__(self, leaves: DataFrame, stage: Stage, name: str, item: str = "bigint", arrow_item: pa.DataType | None = None):
        self.stage, self.name = stage, name
        arrow_item = pa.int64() if arrow_item is None else arrow_item
        self.rounds = [stage.save(_blocks(leaves, "changed" in leaves.columns, item, arrow_item), f"{name}-0")]
        # The driver asks for one number per round; a round has BLOCK times fewer nodes than the one before.
        while (self.rounds[-1].agg(F.max("n")).first()[0] or 0) > BLOCK:
            tops = self.tops(self.rounds[-1]).withColumn("item", F.col("pos"))
            self.rounds.append(stage.save(_blocks(tops, False, "bigint", pa.int64()), f"{name}-{len(self.rounds)}"))

    @staticmethod
    def tops(blocks: DataFrame) -> DataFrame:
        """The highest node of each block, as a leaf of the next round."""
        return blocks.select(
            "tree", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).cast("bigint").alias("n"),
            F.element_at("levels", -1)[0].alias("digest"),
        )

    def roots(self) -> DataFrame:
        """``tree, digest``: one row per tree."""
        return self.tops(self.rounds[-1]).select("tree", "digest")

    def nodes(self) -> DataFrame:
        """All nodes of the first version: ``tree, level, pos, digest``."""
        parts = []
        for k, blocks in enumerate(self.rounds):
            leveled = blocks.select("tree", "block", F.posexplode("levels").alias("level", "digests"))
            # A block's top is the next round's leaf.
            kept = leveled.where("level > 0") if k else leveled
            width = F.lit(BLOCK) / F.pow(F.lit(float(BRANCH)), "level")
            parts.append(kept.select(
                "tree", (F.col("level") + k * HEIGHT).cast("int").alias("level"), (F.col("block") * width).cast("bigint").alias("first"),
                F.posexplode("digests").alias("at", "digest"),
            ).select("tree", "level", (F.col("first") + F.col("at")).alias("pos"), "digest"))
        out = parts[0]
        for part in parts[1:]:
            out = out.union(part)
        return out

    def block_paths(self) -> DataFrame:
        """The lowest blocks with the path of their top up to the root of their tree, and that root."""
        nothing = F.array().cast(f"array<{_STEP_SQL}>")
        upper = self.rounds[-1].withColumns({"path": nothing, "root": F.element_at("levels", -1)[0]})
        for blocks in reversed(self.rounds[:-1]):
            paths = upper.select("tree", "block", "levels", "path", "root").mapInArrow(
                _item_paths, f"tree string, pos bigint, path array<{_STEP_SQL}>, root binary"
            )
            upper = blocks.join(paths.withColumnRenamed("pos", "block"), ["tree", "block"])
        return upper


def _document_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Proof and version of every leaf."""
    names = ("doc_id", "tree", "pos", "leaf", "tampered", "subroot", "root", "proof_sha256", "folded_root", "copies")
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(_COPY))
    for batch in batches:
        for row in batch.to_pylist():
            out: list[list] = [[] for _ in names]
            levels, depth = row["levels"], len(row["path"])
            within = len(levels) - 1
            for at, (item, leaf) in enumerate(zip(row["items"], levels[0], strict=True)):
                path = [*path_of(levels, at), *row["path"], *row["top_path"]]
                changed = row["changes"][at]
                pos = row["block"] * BLOCK + at
                # A leaf that is as it was is folded like a tampered one: its path is checked, not taken for right.
                start = leaf if changed is None else changed
                ancestors = fold(start, path)
                last, copies = ancestors[-1] if ancestors else start, None
                if changed is not None:
                    copies, places = [{"tree": row["tree"], "level": 0, "pos": pos, "digest": changed}], (pos, row["top_pos"])
                    for k, digest in enumerate(ancestors):
                        above = k - within - depth
                        level, place = (k, places[0]) if above < 0 else (above, places[1])
                        copies.append({
                            "tree": row["tree"] if above < 0 else TOP, "level": level + 1,
                            "pos": place // BRANCH ** (level + 1), "digest": digest,
                        })
                for column, value in zip(out, (
                    item, row["tree"], pos, leaf.hex(), changed.hex() if changed else None, row["root"].hex(), row["top_root"].hex(),
                    proof_digest(path), last.hex(), copies,
                ), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=list(names))


class Manifest:
    """The forest of a table's groups and the tree over their roots.

    ``rows`` has ``doc_id, tree, digest, changed``; ``changed`` is NULL for a leaf that is as it was.
    """

    def __init__(self, rows: DataFrame):
        self.stage = Stage(rows.sparkSession, "manifest")
        leaves = self.stage.save(rows.select("doc_id", "tree", "digest", "changed", F.monotonically_increasing_id().alias("row")), "leaves")
        placed = numbered(leaves, "tree", ["doc_id", "digest", "row"], self.stage, "ordered")
        self.forest = Forest(placed.select("tree", "pos", "n", F.col("doc_id").alias("item"), "digest", "changed"), self.stage, "blocks")
        roots = self.stage.save(self.forest.roots().select(F.lit(TOP).alias("group"), F.col("tree").alias("item"), "digest"), "roots")
        tops = numbered(roots, "group", ["item"], self.stage, "roots-ordered")
        self.top = Forest(tops.select(F.col("group").alias("tree"), "pos", "n", "item", "digest"), self.stage, "top", "string", pa.string())

    def documents(self) -> DataFrame:
        """One row per leaf: its proof's digest, the root its version folds to, and the nodes the version copied."""
        top = self.top.block_paths()
        paths = top.select("tree", "block", "levels", "path", "root").mapInArrow(
            _item_paths, f"tree string, pos bigint, path array<{_STEP_SQL}>, root binary"
        )
        names = top.select(F.posexplode("items").alias("at", "tree"), "block").select("tree", (F.col("block") * BLOCK + F.col("at")).alias("top_pos"))
        above = paths.select(F.col("pos").alias("top_pos"), F.col("path").alias("top_path"), F.col("root").alias("top_root")).join(names, "top_pos")
        return self.forest.block_paths().join(above, "tree").mapInArrow(
            _document_rows,
            "doc_id bigint, tree string, pos bigint, leaf string, tampered string, subroot string, root string, proof_sha256 string, "
            f"folded_root string, copies array<{_COPY_SQL}>",
        )

    def nodes(self) -> DataFrame:
        """All nodes of the first version: ``tree, level, pos, digest``; the tree ``TOP`` is that of the roots."""
        return self.forest.nodes().union(self.top.nodes())

    def versions(self) -> DataFrame:
        """The nodes each version has of its own: ``version_tree, version_pos, tree, level, pos, digest``."""
        changed = self.documents().where("copies IS NOT NULL")
        return changed.select(F.col("tree").alias("version_tree"), F.col("pos").alias("version_pos"), F.explode("copies").alias("c")).select(
            "version_tree", "version_pos", "c.*"
        )

    def read(self, wanted: DataFrame) -> DataFrame:
        """Nodes of versions: the version's own copy where it has one, else the shared node.

        ``wanted`` has ``version_tree, version_pos, tree, level, pos``; ``digest`` is added.
        """
        keys = ["tree", "level", "pos"]
        own = self.versions().withColumnRenamed("digest", "own")
        shared = wanted.join(self.nodes(), keys, "left")
        return shared.join(own, ["version_tree", "version_pos", *keys], "left").withColumn("digest", F.coalesce("own", "digest")).drop("own")


def tampered(doc: Column, every: int = 2) -> Column:
    """Is the row one of those that the check tampers with?  By the checksum of its id, in decimal."""
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % every == 0, F.lit(False))


def document_manifest(documents: DataFrame, columns: tuple[str, ...] = COLUMNS, doc: str = "doc_id", source: str = "source", text: str = "text") -> Manifest:
    """The manifest of documents by source; where :func:`tampered` says so, line feeds are taken out of the text."""
    cut = {c: F.replace(F.col(c), F.lit("\n"), F.lit("")) if c == text else F.col(c) for c in columns}
    return Manifest(documents.select(
        F.col(doc).cast("bigint").alias("doc_id"), tree_name(F.col(source)).alias("tree"), leaf_digest(*map(F.col, columns)).alias("digest"),
        F.when(tampered(F.col(doc)), leaf_digest(*cut.values())).alias("changed"),
    ))


QUERY = "op11_manifest"


def query(spark, folder: str) -> DataFrame:
    rows = document_manifest(spark.read.parquet(f"{folder}/documents.parquet")).documents()
    return rows.select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"),
        "pos", F.coalesce(F.size("copies"), F.lit(0)).cast("bigint").alias("n_copied"),
    )


def _field(value: str) -> str:
    return f"case when {value} is null then '-' else strlen({value}::varchar) || ':' || {value} end"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


# CRC-32 of a decimal number, bit by bit; its lowest bit says whether 2 divides it.
_CRC = """xor(list_reduce(list_concat([4294967295::bigint], list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
    lambda x, b: list_reduce(list_concat([xor(x, b)], [0::bigint, 0, 0, 0, 0, 0, 0, 0]), lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295)"""


def _climb(name: str, start: str) -> str:
    """Recursive table of all nodes above some leaves."""
    return f"""{name}(tree, level, pos, n, digest) as ({start}
  union all select tree, level + 1, pos // 3, (any_value(n) + 2) // 3, sha256(string_agg(digest, '' order by pos)) from {name} where n > 1 group by tree, level, pos // 3)"""


def _fold(name: str, nodes: str, start: str) -> str:
    """Recursive table of what leaves fold to with the nodes beside their ancestors."""
    return f"""{name}(tree, leaf_pos, here, level, pos, digest, n) as ({start}
  union all select f.tree, f.leaf_pos, any_value(u.tree), f.level + 1, f.pos // 3, sha256(string_agg(case when u.pos = f.pos then f.digest else u.digest end, '' order by u.pos)), (any_value(f.n) + 2) // 3
  from {name} f join {nodes} u on u.tree = f.here and u.level = f.level and u.pos // 3 = f.pos // 3 where f.n > 1 group by f.tree, f.leaf_pos, f.level, f.pos // 3)"""


ORACLE = f"""with recursive hashed as (select doc_id, case when source is null then '' else '=' || source end as tree, {_leaf('text')} as leaf,
  case when {_CRC} % 2 = 0 then {_leaf("replace(text, chr(10), '')")} end as changed from documents),
base as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by tree) as n from hashed),
{_climb('up', 'select tree, 0, pos, n, leaf from base')},
{_climb('top', "select '^', 0, row_number() over (order by tree) - 1, count(*) over (), digest from up where n = 1")},
named as (select tree, digest as subroot, row_number() over (order by tree) - 1 as top_pos, count(*) over () as top_n from up where n = 1),
beside as (
  select b.tree, b.pos, 0 as part, u.level, u.pos as place, u.digest from base b join up u on u.tree = b.tree and u.n > 1
    and u.pos // 3 = (b.pos // (3 ** u.level)::bigint) // 3 and u.pos <> b.pos // (3 ** u.level)::bigint
  union all select b.tree, b.pos, 1, t.level, t.pos, t.digest from base b join named m on m.tree = b.tree join top t on t.n > 1
    and t.pos // 3 = (m.top_pos // (3 ** t.level)::bigint) // 3 and t.pos <> m.top_pos // (3 ** t.level)::bigint),
proofs as (select tree, pos, sha256(string_agg(digest, '' order by part, level, place)) as proof from beside group by tree, pos),
{_fold('folded', 'up', 'select tree, pos, tree, 0, pos, coalesce(changed, leaf), n from base')},
{_fold('refolded', 'top', "select f.tree, f.leaf_pos, '^', 0, m.top_pos, f.digest, m.top_n from folded f join named m on m.tree = f.tree where f.n = 1")},
sized as (select tree, leaf_pos, max(level) as levels from (select tree, leaf_pos, level from folded) group by all),
resized as (select tree, leaf_pos, max(level) as levels from refolded group by all)
select b.doc_id, b.leaf, m.subroot, t.digest as root, coalesce(p.proof, sha256('')) as proof_sha256, r.digest as folded_root, r.digest = t.digest as verified,
  b.pos::bigint as pos, case when b.changed is null then 0 else 1 + s.levels + q.levels end::bigint as n_copied
from base b join named m on m.tree = b.tree join (select digest from top where n = 1) t on true left join proofs p on p.tree = b.tree and p.pos = b.pos
join refolded r on r.tree = b.tree and r.leaf_pos = b.pos and r.n = 1 join sized s on s.tree = b.tree and s.leaf_pos = b.pos join resized q on q.tree = b.tree and q.leaf_pos = b.pos"""
