"""Exact Jaccard join of documents on word shingles, with signature trees.

1. Each block of documents makes the set of 64-bit shingle fingerprints of every document.  Equal sets
   of a block are kept once.  The fingerprints go to buckets, without the bytes that the bucket tells;
   one that several documents of the block share goes there once, with its count.
2. Buckets return how many sets have each fingerprint, if two or more.  A set most of whose shingles
   nobody else has cannot be similar to another, and is done.
3. The others keep their shared fingerprints, rarest first.  Two similar sets must share one of the
   first ``n - ceil(t n) + 1`` of them (prefix filter).  Each set is tested against the set with the
   least name that shares most of its prefix; that links most copies to one centre.
4. Where a prefix fingerprint still spans several linked groups, the documents of the smaller groups
   meet blocks of all others.  In each such cell both sides are signature trees, whose nodes hold
   the OR of their documents' bitmaps and the range of their sizes; pairs of nodes are pruned by the
   largest overlap they could have, leaves are compared exactly.
5. Links become components.

Equal sets are one node, so a hot group of exact copies costs one row per block; a hot fingerprint
reaches a bucket once per block.  Defined results: a NULL or empty text has an empty set and is linked
with nothing; a document whose id is NULL takes no part and gets no component; rows that share an
id are one document; extra columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.components import components
from pagemill.llm.words import SPACED, Words, blocks, text_bytes, window_prints
from pagemill.operators.stage import Stage

BLOCK_BYTES = 4 << 20
# Text bytes per bucket of fingerprints: about a quarter of a million of them.
BUCKET_BYTES = 3 << 19
SHINGLE = 5
# The most documents on one side of a cell.
CELL = 1024
BITS = 2048
FAN_OUT = 8


def shingle_sets(words: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle fingerprints of all documents, by document and then by value, and their counts."""
    n, prints = words.counts(), words.prints()
    at = words.windows(size)
    doc = np.searchsorted(words.first, at, side="right") - 1
    parts, owners = [window_prints(prints, at, size)], [doc]
    for short in range(1, size):
        docs = np.flatnonzero(n == short)
        parts.append(window_prints(prints, words.first[docs], short))
        owners.append(docs)
    value, doc = np.concatenate(parts), np.concatenate(owners)
    by = np.argsort(value)
    value, doc = value[by], doc[by]
    by = np.argsort(doc.astype(np.uint16) if words.n_docs < 65536 else doc, kind="stable")
    value, doc = value[by], doc[by]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[new], np.bincount(doc[new], minlength=words.n_docs).astype(np.int64)


_ROW = pa.schema([("bucket", pa.int64()), ("shard", pa.string()), ("single", pa.binary()), ("places", pa.binary()), ("multi", pa.binary()), ("weights", pa.binary()), ("docs", pa.binary())])
_ROW_SQL = "bucket bigint, shard string, single binary, places binary, multi binary, weights binary, docs binary"


def _fingerprints(bits: int, size: int):
    """Step 1: per block a row for each bucket, and one row that goes straight to step 3."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = text_bytes(batch.column("k_text"))
            ids = batch.column("k_0")
            named = np.asarray(ids.is_valid())
            ids = np.asarray(ids.fill_null(0))
            for low, high in blocks(offsets, BLOCK_BYTES):
                words = Words(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low], SPACED, lower=True)
                value, n = shingle_sets(words, size)
                begin = np.concatenate([[0], np.cumsum(n)])
                digests = [blake2b(value[a:b].tobytes(), digest_size=16).digest() for a, b in zip(begin[:-1], begin[1:], strict=True)]
                own = ids[low:high]
                known = named[low:high] & (n > 0)
                first: dict[bytes, int] = {}
                for d in np.argsort(own, kind="stable").tolist():
                    if known[d]:
                        first.setdefault(digests[d], d)
                holder = np.zeros(len(n), bool)
                holder[list(first.values())] = True
                doc = np.repeat(np.arange(len(n)), n)
                mine = holder[doc]
                value, doc = value[mine], doc[mine]
                by = np.argsort(value, kind="stable")
                ordered = value[by]
                new = np.ones(len(ordered), bool)
                new[1:] = ordered[1:] != ordered[:-1]
                start = np.flatnonzero(new)
                weight = np.diff(np.append(start, len(ordered)))
                several = np.zeros(len(value), bool)
                several[by] = np.repeat(weight > 1, weight)
                shard = f"{task}.{k}"
                k += 1
                table = pa.table({
                    "doc": own, "named": named[low:high], "n": n, "digest": pa.array(digests, pa.binary(16)), "holder": holder,
                })
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, table.schema) as writer:
                    writer.write_table(table)
                # Shared within the block: known to be shared, so only the number of sets is asked for.
                inner = (value[several], doc[several].astype(np.int32))
                rows = [((1 << bits) + task, shard, inner[0].tobytes(), inner[1].tobytes(), None, None, sink.getvalue().to_pybytes())]
                value, doc = value[~several], doc[~several]
                bucket = (value >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(value), np.int64)
                by = np.argsort(bucket.astype(np.uint16) if bits <= 16 else bucket, kind="stable")
                value, doc, bucket = value[by], doc[by].astype(np.int32), bucket[by]
                edge = np.searchsorted(bucket, np.arange((1 << bits) + 1))
                multi, weight = ordered[start][weight > 1], weight[weight > 1]
                at = (multi >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(multi), np.int64)
                cut = np.searchsorted(at, np.arange((1 << bits) + 1))
                for b in range(1 << bits):
                    one, many = slice(edge[b], edge[b + 1]), slice(cut[b], cut[b + 1])
                    if one.start < one.stop or many.start < many.stop:
                        rows.append((b, shard, _cut(value[one], bits), _packed(doc[one]), _cut(multi[many], bits), _narrow(weight[many]), None))
                yield pa.RecordBatch.from_pylist([dict(zip(_ROW.names, r, strict=True)) for r in rows], _ROW)

    return run


def _narrow(numbers: np.ndarray) -> bytes:
    """Numbers from 0 on in the least width that holds them, which stands before them."""
    most = int(numbers.max()) if len(numbers) else 0
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
    return bytes([width]) + numbers.astype(f"<u{width}").tobytes()


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


def _packed(doc: np.ndarray) -> bytes:
    """Rising document numbers: how many there are of each, or their steps where documents are more than numbers."""
    if not len(doc):
        return b""
    if doc[-1] < len(doc):
        return b"n" + _narrow(np.bincount(doc))
    return b"s" + _narrow(np.diff(doc, prepend=0))


def _unpacked(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, np.int32)
    numbers = _wide(raw[1:])
    return (np.repeat(np.arange(len(numbers)), numbers) if raw[:1] == b"n" else np.cumsum(numbers)).astype(np.int32)


def _cut(value: np.ndarray, bits: int) -> bytes:
    """Fingerprints of one bucket without the whole bytes that the bucket's number tells."""
    return np.ascontiguousarray(value.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : 8 - bits // 8]).tobytes()


def _uncut(raw: bytes, bits: int, bucket: int) -> np.ndarray:
    kept = 8 - bits // 8
    whole = np.zeros((len(raw) // kept, 8), np.uint8)
    whole[:, :kept] = np.frombuffer(raw, np.uint8).reshape(-1, kept)
    if kept < 8:
        top = np.array([bucket << (64 - bits)], np.uint64).astype("<u8").view(np.uint8)
        whole[:, kept:] = top[kept:]
    return whole.view("<u8").ravel().astype(np.uint64, copy=False)


_SHARED = pa.schema([("shard", pa.string()), ("bucket", pa.int64()), ("single", pa.binary()), ("places", pa.binary()), ("multi", pa.binary()), ("weights", pa.binary()), ("docs", pa.binary())])
_SHARED_SQL = "shard string, bucket bigint, single binary, places binary, multi binary, weights binary, docs binary"


def _count_sets(bits: int):
    """Step 2: fingerprints that two or more sets have, back to their blocks with the number of sets."""

    def run(group: pa.Table) -> pa.Table:
        bucket = group.column("bucket")[0].as_py()
        if bucket >= 1 << bits:
            return group.select(_SHARED.names).cast(_SHARED)
        shards = group.column("shard").to_pylist()
        single = [_uncut(x.as_py(), bits, bucket) for x in group.column("single")]
        multi = [_uncut(x.as_py(), bits, bucket) for x in group.column("multi")]
        weight = [np.ones(len(x), np.int64) for x in single] + [_wide(x.as_py()) for x in group.column("weights")]
        value, weight = np.concatenate(single + multi), np.concatenate(weight)
        by = np.argsort(value)
        ordered = value[by]
        new = np.ones(len(ordered), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        start = np.flatnonzero(new)
        total = np.add.reduceat(weight[by], start)
        sets = np.zeros(len(value), np.int32)
        sets[by] = np.minimum(np.repeat(total, np.diff(np.append(start, len(value)))), 2**31 - 1)
        rows, at, after = [], 0, sum(map(len, single))
        for k, shard in enumerate(shards):
            one, many = sets[at : at + len(single[k])], sets[after : after + len(multi[k])]
            at, after = at + len(one), after + len(many)
            keep = one > 1
            place = _unpacked(group.column("places")[k].as_py())[keep]
            if len(place) or len(many):
                rows.append({
                    "shard": shard, "bucket": bucket, "single": _cut(single[k][keep], bits), "places": _packed(place),
                    "multi": _cut(multi[k], bits), "weights": _narrow(np.concatenate([one[keep], many])), "docs": None,
                })
        return pa.Table.from_pylist(rows, _SHARED)

    return run


_SETS = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("digest", pa.binary()), ("tokens", pa.list_(pa.int64())), ("prefix", pa.int32())])
_SETS_SQL = "doc bigint, n bigint, digest binary, tokens array<bigint>, prefix int"


def _gather(bits: int):
    """Step 3: all documents of a block; the sets that may be similar to another with their shared part."""

    def run(group: pa.Table) -> pa.Table:
        value, place, sets, names, sizes = [], [], [], [], []
        for row in group.to_pylist():
            if row["docs"] is not None:
                docs = pa.ipc.open_stream(row["docs"]).read_all()
                inner, owner = np.frombuffer(row["single"], np.uint64), np.frombuffer(row["places"], np.int32)
            else:
                value.append(_uncut(row["single"], bits, row["bucket"]))
                place.append(_unpacked(row["places"]))
                names.append(_uncut(row["multi"], bits, row["bucket"]))
                counted = _wide(row["weights"])
                sets.append(counted[: len(place[-1])])
                sizes.append(counted[len(place[-1]) :])
        names, sizes = np.concatenate([*names, np.zeros(0, np.uint64)]), np.concatenate([*sizes, np.zeros(0, np.int64)])
        by = np.argsort(names)
        names, sizes = names[by], sizes[by]
        value = np.concatenate([*value, inner])
        place = np.concatenate([*place, owner])
        sets = np.concatenate([*sets, sizes[np.searchsorted(names, inner)]])
        return _hopeful(docs, value, place, sets)

    return run


def _hopeful(docs: pa.Table, value: np.ndarray, place: np.ndarray, sets: np.ndarray) -> pa.Table:
    """Rows of the documents, with the shared fingerprints, rarest first, where they are enough."""
    by = np.lexsort((value, sets, place))
    value, place = value[by], place[by]
    n = docs.column("n").to_numpy()
    shared = np.bincount(place, minlength=len(n))
    begin = np.concatenate([[0], np.cumsum(shared)])
    need = (3 * n + 3) // 4
    hopeful = (n > 0) & (shared >= need) & docs.column("holder").to_numpy()
    signed = value.view(np.int64)
    return pa.Table.from_arrays(
        [
            pa.array([d if k else None for d, k in zip(docs.column("doc").to_pylist(), docs.column("named").to_pylist(), strict=True)], pa.int64()),
            pa.array(n, pa.int64()),
            docs.column("digest").cast(pa.binary()),
            pa.array([signed[begin[d] : begin[d + 1]] if hopeful[d] else None for d in range(len(n))], pa.list_(pa.int64())),
            pa.array(np.where(hopeful, shared - need + 1, 0), pa.int32()),
        ],
        schema=_SETS,
    )


class Tree:
    """Signature tree over documents in the given order; the lowest level has one node per document."""

    def __init__(self, tokens: list[np.ndarray], sizes: np.ndarray, groups: np.ndarray):
        bitmap = np.zeros((len(tokens), BITS // 8), np.uint8)
        for k, t in enumerate(tokens):
            bits = np.zeros(BITS, bool)
            bits[t.view(np.uint64) & np.uint64(BITS - 1)] = True
            bitmap[k] = np.packbits(bits)
        bitmap = bitmap.view(np.uint64)
        loss = np.array([len(t) for t in tokens]) - np.bitwise_count(bitmap).sum(1)
        self.levels = [(bitmap, sizes, sizes, loss, groups)]
        while len(self.levels[-1][0]) > 1:
            bitmap, low, high, loss, group = self.levels[-1]
            cut = np.arange(0, len(low), FAN_OUT)
            least, most = np.minimum.reduceat(group, cut), np.maximum.reduceat(group, cut)
            self.levels.append((
                np.bitwise_or.reduceat(bitmap, cut, axis=0), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut),
                np.maximum.reduceat(loss, cut), np.where((least == most) & (least >= 0), least, -1),
            ))

    def level(self, k: int):
        return self.levels[min(k, len(self.levels) - 1)]


def _possible(left, right, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Pairs of nodes that may hold a similar pair of documents of different groups."""
    (a, a_low, a_high, a_loss, a_group), (b, b_low, b_high, b_loss, b_group) = left, right
    keep = (4 * a_high[i] >= 3 * b_low[j]) & (4 * b_high[j] >= 3 * a_low[i]) & ((a_group[i] != b_group[j]) | (a_group[i] < 0))
    i, j = i[keep], j[keep]
    overlap = np.bitwise_count(a[i] & b[j]).sum(1, dtype=np.int64) + np.minimum(a_loss[i], b_loss[j])
    keep[keep] = 7 * overlap >= 3 * (a_low[i] + b_low[j])
    return keep


def _children(i: np.ndarray, j: np.ndarray, below_i: int, below_j: int, split_i: bool, split_j: bool):
    for split, below, first in ((split_i, below_i, True), (split_j, below_j, False)):
        if split:
            parent = i if first else j
            child = (parent[:, None] * FAN_OUT + np.arange(FAN_OUT)).ravel()
            other = np.repeat(j if first else i, FAN_OUT)
            ok = child < below
            i, j = (child[ok], other[ok]) if first else (other[ok], child[ok])
    return i, j


def dual_traversal(left: Tree, right: Tree, step: int = 20_000) -> Iterator[tuple[int, int]]:
    """Pairs of leaves that no bound could exclude, depth first."""
    top = max(len(left.levels), len(right.levels)) - 1
    stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        k, i, j = stack.pop()
        if len(i) > step:
            stack += [(k, i[a : a + step], j[a : a + step]) for a in range(0, len(i), step)]
            continue
        keep = _possible(left.level(k), right.level(k), i, j)
        i, j = i[keep], j[keep]
        if k == 0:
            yield from zip(i.tolist(), j.tolist(), strict=True)
        elif len(i):
            down = _children(i, j, len(left.level(k - 1)[0]), len(right.level(k - 1)[0]), k < len(left.levels), k < len(right.levels))
            stack.append((k - 1, *down))


_LINKS = pa.schema([("a", pa.binary()), ("b", pa.binary())])


def _compare(group: pa.Table) -> pa.Table:
    """Step 4: links between the visitors and the documents of a cell, none within a group already linked."""
    group = group.sort_by([("component", "ascending"), ("n", "ascending"), ("digest", "ascending")])
    name = {c: k for k, c in enumerate(dict.fromkeys(group.column("component").to_pylist()))}
    parent = list(range(len(name)))

    def root(k: int) -> int:
        while parent[k] != k:
            parent[k] = parent[parent[k]]
            k = parent[k]
        return k

    sides = []
    for visitor in (True, False):
        side = group.filter(pa.compute.equal(group.column("visitor"), visitor))
        tokens = [np.asarray(x.values) for x in side.column("tokens")]
        groups = np.array([name[c] for c in side.column("component").to_pylist()], np.int64)
        sides.append((side.column("component").to_pylist(), tokens, side.column("n").to_numpy(), groups))
    links = []
    if sides[0][1] and sides[1][1]:
        (a_name, a_tokens, a_n, a_group), (b_name, b_tokens, b_n, b_group) = sides
        ordered_a, ordered_b = [None] * len(a_tokens), [None] * len(b_tokens)
        for i, j in dual_traversal(Tree(a_tokens, a_n, a_group), Tree(b_tokens, b_n, b_group)):
            x, y = root(a_group[i]), root(b_group[j])
            if x == y:
                continue
            if ordered_a[i] is None:
                ordered_a[i] = np.sort(a_tokens[i])
            if ordered_b[j] is None:
                ordered_b[j] = np.sort(b_tokens[j])
            common = len(np.intersect1d(ordered_a[i], ordered_b[j], assume_unique=True))
            if 7 * common >= 3 * (a_n[i] + b_n[j]):
                parent[x] = y
                links.append({"a": a_name[i], "b": b_name[j]})
    return pa.Table.from_pylist(links, _LINKS)


def shared_sets(documents: DataFrame, stage: Stage, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Steps 1 to 3: ``doc, n, digest`` of every document; ``tokens, prefix`` of sets with a chance."""
    renamed = documents.select(F.col(doc).cast("bigint").alias("k_0"), F.col(text).alias("k_text"))
    size = renamed.agg(F.sum(F.octet_length("k_text"))).first()[0] or 0
    bits = max(size // BUCKET_BYTES, 1).bit_length() - 1
    rows = renamed.mapInArrow(_fingerprints(bits, SHINGLE), _ROW_SQL)
    shared = rows.groupBy("bucket").applyInArrow(_count_sets(bits), _SHARED_SQL)
    return stage.save(shared.groupBy("shard").applyInArrow(_gather(bits), _SETS_SQL), "sets")


def _similar(a: str, b: str):
    common = F.size(F.array_intersect(f"{a}_tokens", f"{b}_tokens"))
    return 7 * common >= 3 * (F.col(f"{a}_n") + F.col(f"{b}_n"))


def similar_components(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, n, component``: for every document the size of its set and the least id it is linked to."""
    stage = Stage(documents.sparkSession, "jaccard")
    sets = shared_sets(documents, stage, doc, text)
    known = sets.where(F.col("doc").isNotNull() & (F.col("n") > 0))
    holders = stage.save(
        known.where(F.col("tokens").isNotNull()).dropDuplicates(["digest"]).select("digest", "n", "tokens", "prefix"), "holders"
    )
    postings = holders.select("digest", F.explode(F.slice("tokens", F.lit(1), F.col("prefix"))).alias("token"))
    # Step 3: one candidate centre for each set.
    centres = postings.groupBy("token").agg(F.min("digest").alias("centre"), F.count(F.lit(1)).alias("c")).where(F.col("c") > 1).drop("c")
    best = (
        postings.join(centres, "token").where(F.col("digest") != F.col("centre"))
        .groupBy("digest", "centre").count()
        .groupBy("digest").agg(F.max_by("centre", F.struct("count", "centre")).alias("centre"))
    )
    one = holders.select("digest", F.col("n").alias("a_n"), F.col("tokens").alias("a_tokens"))
    other = holders.select(F.col("digest").alias("centre"), F.col("n").alias("b_n"), F.col("tokens").alias("b_tokens"))
    linked = best.join(one, "digest").join(other, "centre").where(_similar("a", "b")).select(F.col("digest").alias("a"), F.col("centre").alias("b"))
    # Rows of one id are one document.
    twice = known.groupBy("doc").agg(F.min("digest").alias("a"), F.max("digest").alias("z")).where(F.col("a") != F.col("z")).select("doc", "a")
    same_id = known.select("doc", F.col("digest").alias("b")).join(twice, "doc").select("a", "b")
    first = components(linked.union(same_id), stage, "near")
    grouped = holders.select("digest").join(first.withColumnRenamed("node", "digest"), "digest", "left").select(
        "digest", F.coalesce("component", "digest").alias("component")
    )
    # Step 4: groups that a prefix token still spans.
    named = stage.save(postings.join(grouped, "digest"), "postings")
    spans = named.groupBy("token").agg(F.min("component").alias("least"), F.max("component").alias("most")).where(F.col("least") != F.col("most"))
    open_ = stage.save(named.join(spans.select("token", "least"), "token").select("digest", "component", "least").distinct(), "open")
    cells = components(open_.select(F.col("component").alias("a"), F.col("least").alias("b")).distinct(), stage, "span")
    members = stage.save(
        open_.select("digest", "component").distinct().join(cells.select(F.col("node").alias("component"), F.col("component").alias("cell")), "component"), "members"
    )
    sizes = members.groupBy("cell", "component").count()
    main = sizes.groupBy("cell").agg(
        F.max_by("component", F.struct("count", "component")).alias("main"), F.sum("count").alias("docs"), F.max("count").alias("in_main")
    ).select("cell", "main", F.ceil(F.col("docs") / CELL).alias("blocks"), F.ceil((F.col("docs") - F.col("in_main")) / CELL).alias("visits"))
    placed = members.join(main, "cell").join(holders, "digest").select(
        "cell", "component", "digest", "n", "tokens", "blocks", "visits", (F.col("component") != F.col("main")).alias("small"),
        F.pmod(F.xxhash64("digest"), F.col("blocks")).alias("own_block"), F.pmod(F.xxhash64("digest", F.lit(1)), F.col("visits")).alias("own_visit"),
    )
    columns = ["cell", "block", "visit", "visitor", "component", "digest", "n", "tokens"]
    staying = placed.select("*", F.lit(False).alias("visitor"), F.col("own_block").alias("block"), F.explode(F.sequence(F.lit(0), F.col("visits") - 1)).alias("visit"))
    visiting = placed.where("small").select("*", F.lit(True).alias("visitor"), F.col("own_visit").alias("visit"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    links = staying.select(*columns).union(visiting.select(*columns)).groupBy("cell", "block", "visit").applyInArrow(_compare, "a binary, b binary")
    second = components(links, stage, "cell").select(F.col("node").alias("component"), F.col("component").alias("top"))
    final = first.join(second, "component", "left").select(F.col("node").alias("digest"), F.coalesce("top", "component").alias("top")).union(
        second.join(first, second["component"] == first["node"], "left_anti").select(F.col("component").alias("digest"), "top")
    )
    tops = stage.save(
        sets.join(final, "digest", "left").select("doc", "n", F.when(F.col("n") > 0, F.coalesce("top", "digest")).alias("top")), "tops"
    )
    # Written, so that the join deals both sides anew and a hot component can be split.
    least = stage.save(tops.where(F.col("doc").isNotNull() & F.col("top").isNotNull()).groupBy("top").agg(F.min("doc").alias("component")), "least")
    return tops.join(least, "top", "left").select(
        "doc", "n", F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc")).alias("component")
    )


def drop_near_duplicates(documents: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, that with the least id, with all columns; unnamed rows stay.

    Of several rows with that id all stay.
    """
    found = similar_components(documents, doc, text).where(F.col("doc") != F.col("component")).select(F.col("doc").alias("_gone")).distinct()
    return documents.join(found, documents[doc] == found["_gone"], "left_anti")


QUERY = "op8_jaccard"


def query(spark, folder: str) -> DataFrame:
    found = similar_components(spark.read.parquet(f"{folder}/documents.parquet"))
    return found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


ORACLE = r"""
with recursive d as (
  select doc_id, row_number() over () as r,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
),
s as (
  select r, g from (
    select r, array_to_string(w[i:i + 4], ' ') as g from (select r, w, unnest(range(1, greatest(len(w) - 3, 2))) as i from d where len(w) > 0)
  ) group by r, g
),
n as (select r, count(*) as n from s group by r),
o as (select a.r as x, b.r as y, count(*) as c from s a join s b on a.g = b.g and a.r < b.r group by a.r, b.r),
l as (select x, y from o join n p on p.r = x join n q on q.r = y where 100 * c >= 75 * (p.n + q.n - c)),
e as materialized (
  select distinct p.doc_id as x, q.doc_id as y from l join d p on p.r = x join d q on q.r = y where p.doc_id is not null and q.doc_id is not null
),
sym as materialized (select x, y from e union select y, x from e),
reach as (select x, x as y from sym union select reach.x, sym.y from reach join sym on reach.y = sym.x),
least_ as (select x, min(y) as m from reach group by x)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(m, d.doc_id) as component_id
from d left join n on n.r = d.r left join least_ on least_.x = d.doc_id
"""
