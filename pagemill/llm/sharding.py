"""Shards of nearly equal size by sampled splitters.

Records are ordered by a key, here a fingerprint of the text, and then by id, so that equal texts lie side
by side.  A sample weighted by size gives quantiles of that order, which cut it into many ranges; ranges
that come out overfull are sampled again and subdivided.  The exact sizes of the ranges, one number
each, then tell every range where its records lie in the whole order, and so their shard: the order is
cut into pieces of equal bytes.  Records of one key stay together as long as they are less than a
sixteenth of a shard; larger groups are cut where the bytes say.

No task sorts more than a range, whose rows are bounded; a hot key is cut by id, and repeated rows of one id
by row number, like any other stretch of the order.  Row numbers tell nothing else apart than records that
are alike, so the result is the same however the files lie.  Defined results: a NULL text has no bytes
and its own key; a NULL id has its place among the ids; repeated rows are placed one by one; a very
long text is one record, never cut; an empty table has no shards; other columns stay as they are,
and none of them is shuffled but those asked for.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.operators.stage import Stage

SHARDS = 16
RANGE_ROWS = 4096
# Splitter samples per range.
OVERSAMPLE = 16


ORDER = ["key", "sub", "row"]


def _order_key(*columns) -> np.ndarray:
    """Signed 64-bit columns as byte strings that sort as their rows do."""
    flip = np.uint64(1 << 63)
    rows = np.stack([np.asarray(c, np.int64).view(np.uint64) ^ flip for c in columns], axis=1)
    return np.ascontiguousarray(rows.astype(">u8")).view(f"S{8 * len(columns)}").ravel()


def _range_of(splitters: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield rows.assign(range=np.searchsorted(splitters, _order_key(*(rows[c] for c in ORDER)), side="right").astype(np.int64))

    return run


def _sample(rows: DataFrame, total: int, wanted: int) -> list:
    """About ``wanted`` keys, each drawn as often as its bytes ask for."""
    chance = F.col("size") * wanted / F.lit(total)
    drawn = F.floor(chance + F.pmod(F.xxhash64(*ORDER), F.lit(1 << 20)) / F.lit(1 << 20))
    return rows.select(*ORDER, drawn.alias("times")).where("times > 0").collect()


def _quantiles(sample: list, parts: int) -> np.ndarray:
    keys = _order_key(*([r[c] for r in sample] for c in ORDER))
    order = np.argsort(keys)
    weight = np.cumsum(np.array([r.times for r in sample], np.float64)[order])
    cut = np.searchsorted(weight, np.arange(1, parts) * (weight[-1] / parts))
    return np.unique(keys[order][np.minimum(cut, len(order) - 1)])


def _ranged(rows: DataFrame, splitters: np.ndarray) -> DataFrame:
    return rows.mapInPandas(_range_of(splitters), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", range bigint")


def assign_shards(
    records: DataFrame, key: Column, size: Column, tie: Column, keep: list[str], n_shards: int = SHARDS, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """``keep`` columns with ``size, shard, slot``; slots of a shard run from 0 without a gap.

    The driver holds the splitters and one count per range, that is a record for each ``range_rows`` rows.
    """
    stage = Stage(records.sparkSession, "shards")
    rows = stage.save(
        records.select(
            *(F.col(k).alias(f"k_{i}") for i, k in enumerate(keep)), size.cast("bigint").alias("size"), key.cast("bigint").alias("key"),
            F.xxhash64(tie).alias("sub"), F.monotonically_increasing_id().alias("row"),
        ),
        "rows",
    )
    count, total = rows.agg(F.count(F.lit(1)), F.sum("size")).first()
    total = total or 0
    parts = max(4 * n_shards, -(-count // range_rows)) if count else 1
    splitters = _quantiles(_sample(rows, total, OVERSAMPLE * parts), parts) if total else np.zeros(0, f"S{8 * len(ORDER)}")
    while True:
        ranged = _ranged(rows, splitters)
        sizes = {r["range"]: (r.n, r.bytes) for r in ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).collect()}
        crowded = {k: max(-(-n // range_rows), 2) for k, (n, _) in sizes.items() if n > 2 * range_rows}
        more = splitters
        if crowded:
            inside = ranged.where(F.col("range").isin(list(crowded))).withColumn("size", F.lit(1))
            rows_inside = sum(sizes[k][0] for k in crowded)
            sample = _sample(inside.select(*ORDER, "size"), rows_inside, OVERSAMPLE * sum(crowded.values()))
            if sample:
                more = np.union1d(splitters, _quantiles(sample, sum(crowded.values()) + 1))
        if len(more) == len(splitters):
            break
        splitters = more
    ordered = sorted(sizes)
    rows_before = dict(zip(ordered, accumulate((sizes[k][0] for k in ordered), initial=0), strict=False))
    bytes_before = dict(zip(ordered, accumulate((sizes[k][1] for k in ordered), initial=0), strict=False))
    before = records.sparkSession.createDataFrame(
        [(k, rows_before[k], bytes_before[k]) for k in ordered] or [(0, 0, 0)], "range bigint, rows_before bigint, bytes_before bigint"
    )
    order = Window.partitionBy("range").orderBy(*ORDER)
    ends = stage.save(
        ranged.withColumn("place", F.row_number().over(order) - 1)
        .withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .join(before, "range")
        .select(*(f"k_{i}" for i in range(len(keep))), "size", "key", (F.col("bytes_before") + F.col("end")).alias("end"), (F.col("rows_before") + F.col("place")).alias("row")),
        "ends",
    )
    # A group may lie in several ranges; only groups of two records or more are met again.
    groups = ends.groupBy("key").agg(F.sum("size").alias("bytes"), F.min(F.col("end") - F.col("size")).alias("begin"), F.count(F.lit(1)).alias("records"))
    small = groups.where((F.col("records") > 1) & (F.col("bytes") * 16 * n_shards < F.lit(total))).select("key", "begin")
    # The middle of a record, or the start of a small group, decides.
    at = F.coalesce("begin", F.col("end") - F.ceil(F.col("size") / 2))
    shard = F.least(F.floor(at * n_shards / F.lit(max(total, 1))), F.lit(n_shards - 1)).cast("int")
    placed = ends.join(small, "key", "left")
    named = stage.save(placed.select(*(f"k_{i}" for i in range(len(keep))), "size", shard.alias("shard"), "row"), "placed")
    first = named.groupBy("shard").agg(F.min("row").alias("first"))
    return named.join(F.broadcast(first), "shard").select(  # a row per shard
        *(F.col(f"k_{i}").alias(k) for i, k in enumerate(keep)), "size", "shard", (F.col("row") - F.col("first")).alias("slot")
    )


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder per shard, its records in the order of their slots."""
    assigned.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


QUERY = "op2_sharding"


def query(spark, folder: str) -> DataFrame:
    text = F.col("text")
    documents = spark.read.parquet(f"{folder}/documents.parquet").select(
        "doc_id", "text", F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32")
    )
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 1
    found = assign_shards(documents, F.coalesce(F.xxhash64(text), F.lit(0)), size, F.col("doc_id"), ["doc_id", "text_crc32"])
    return found.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


# Which records a shard gets follows from fingerprints that SQL lacks; tested by the law it promises.
ORACLE = None
